"""Documents to token ids: language identification, line dedup, near-duplicate join, source mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame, which is written as Parquet and read again for the next. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, jaccard, langid, linededup, mixing
from quillspark.llm.idfiles import tokenizer_path
from quillspark.llm.shared import documents, drop_since, mark, shared_dir, write_table
from quillspark.session import ship


#: Share of a source's documents from which a line is boilerplate. Of the lines of one of sf0.1's sources (500 documents) some 4,000
#: are on one document, about 45 on two, and a short tail on more than 1 %; the commonest is on about 10 %.
LINE_RATIO = 0.01
#: Of the documents of such a line, the share that must differ beside it: copies are the join's work and keep their lines here.
LINE_DIFFER = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the languages learned from the labelled ones explain; the others go.

    Null and empty texts and texts without a letter go. A text may mix languages, be of any length and be
    repeated: equal texts are judged alike. Without a labelled document nothing is learned and all go; an
    empty table stays empty. Null ids and sources change nothing; all columns pass, whatever their names.
    """
    ship(spark)
    return langid.keep_identified(docs, langid.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than LINE_RATIO of a source's documents go, unless the documents are copies; the source stands for the host.

    Documents stay, with ``n_chars`` counted anew; null text stays null, a text all of whose lines go becomes
    empty. Null sources are one source. A line counts once a document; repeated rows count each; a ratio equal
    to the bound keeps the line. An empty table stays empty; all columns pass, helper columns are ``_ld_*``.
    """
    out = linededup.dedup_lines(docs, host_col="source", text_col="text", max_ratio=LINE_RATIO, least_differ=LINE_DIFFER).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The one of the smallest id stays; where ids repeat or are null, the first by id, null last, then by a hash
    of the row. Null and empty texts link with nothing and stay, as often as they are there; texts of fewer than
    five words link as equal sequences. An empty table stays empty; all columns pass, whatever their names.
    """
    ship(spark)
    return jaccard.keep_one(docs, 5, Fraction(4, 5)).select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it.

    Null and empty texts have size 0 and are taken by their source's rate; a source without a word takes none
    of its documents; null sources are one source. Rows that repeat an id are drawn each for itself; ties in
    size are ordered by a hash of the id. An empty table stays empty; all columns pass, helpers are ``_mix_*``.
    """
    return mixing.mix(docs)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row for each copy in the mix.

    Null and empty texts have no ids and decode to the empty text; texts of any length are encoded whole;
    repeated rows give repeated results, null ids stay null; an empty table gives an empty result.
    """
    ship(spark)
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("bpe_codec", bpe_codec),
]

#: The language model has no form in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, place = documents(spark, sf_dir), mark()
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        docs = write_table(stage(spark, docs, sf_dir), path)
        # What the stage wrote on its way, and the table it read, are not needed any more.
        drop_since(spark, place, (path,))
    return STAGES[-1][1](spark, docs, sf_dir)
