"""Conformance: comparing results with expectations, and properties of the parser as queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon
from ..plans.syntax import syntax, table


def case_id_valid(cases: DataFrame, col: str = "case_id") -> DataFrame:
    """Whether case ids are portable relative paths."""
    c = F.col(col)
    ok = c.rlike(r"^[A-Za-z0-9._/-]+\z") & ~c.startswith("/") & ~c.endswith("/") & F.forall(F.split(c, "/"), lambda x: ~x.isin("", ".", ".."))
    return cases.withColumn("valid", F.coalesce(ok, F.lit(False)))


def matches(results: DataFrame, expected: DataFrame) -> DataFrame:
    """case_id and whether tree, diagnostics and diagnostic_count agree; a result without expectation does not."""
    e = expected.select("case_id", F.col("tree").alias("e_tree"), F.col("diagnostics").alias("e_diagnostics"), F.col("diagnostic_count").alias("e_count"))
    same = F.col("tree").isNotNull() & (F.col("tree") == F.col("e_tree")) & (F.col("diagnostics") == F.col("e_diagnostics")) & (F.col("diagnostic_count") == F.col("e_count"))
    return results.join(e, "case_id", "left").select("case_id", F.coalesce(same, F.lit(False)).alias("matches"))


def token_coverage(parsed: DataFrame) -> DataFrame:
    """doc_id, covered bytes, and whether tokens follow each other without gap or overlap; of rows with tokens (start, end)."""
    n = F.size("tokens")
    covered = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + t["end"] - t["start"])
    joined = F.forall(F.zip_with(F.slice("tokens", F.lit(2), n), F.slice("tokens", F.lit(1), n - 1), lambda t, before: t["start"] == before["end"]), lambda x: x)
    return parsed.where(n > 0).select("doc_id", covered.alias("covered"), ((F.get("tokens", F.lit(0))["start"] == 0) & joined).alias("contiguous"))


#: What ``lossless_flags`` reads.
LOSSLESS = ["tokens.text", "elements.text"]


def lossless(sources: DataFrame) -> DataFrame:
    """doc_id, and whether tokens and tree each give the text back."""
    return lossless_flags(syntax(sources, LOSSLESS, keep=["text"]))


def lossless_flags(parsed: DataFrame) -> DataFrame:
    """The same of parsed rows; elements without text are nodes."""
    text = F.coalesce("text", F.lit(""))
    return parsed.select("doc_id", (F.array_join("tokens.text", "") == text).alias("tokens_lossless"), (F.array_join("elements.text", "") == text).alias("tree_lossless"))


def prefixes(sources: DataFrame) -> DataFrame:
    """doc_id, cut, text: every prefix that ends at a token, the empty one too."""
    cuts = table(sources, "tokens.end").unionByName(sources.select("doc_id", F.lit(0).cast("long").alias("end")))
    raw = sources.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    joined = cuts.join(raw, "doc_id")
    return joined.select("doc_id", F.col("end").alias("cut"), F.decode(F.substring("raw", F.lit(1), F.col("end").cast("int")), "UTF-8").alias("text"))


def prefix_property(sources: DataFrame) -> DataFrame:
    """doc_id, prefixes, all_lossless: the parser is total and lossless on every prefix."""
    cut = prefixes(sources).withColumn("own", F.col("doc_id")).select(F.monotonically_increasing_id().alias("doc_id"), "text", "own")
    found = syntax(cut, ["elements.text"], keep=["text", "own"])
    return found.groupBy(F.col("own").alias("doc_id")).agg(F.count(F.lit(1)).alias("prefixes"), F.bool_and(F.array_join("elements.text", "") == F.col("text")).alias("all_lossless"))


def determinism(sources: DataFrame, workers: int = 4, parts: int = 16) -> DataFrame:
    """doc_id, digests: distinct snapshot digests over several parses in different tasks; 1 is right."""
    copies = sources.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(workers))).alias("worker")).repartition(parts, "doc_id", "worker")
    return syntax(copies, ["snapshot_digest"]).groupBy("doc_id").agg(F.countDistinct("snapshot_digest").alias("digests"))


def event_validation(events: DataFrame) -> DataFrame:
    """doc_id and the first structural error of a stream of tree events (ord, what: start, token, finish), or null."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    step = F.when(F.col("what") == "start", 1).when(F.col("what") == "finish", -1).otherwise(0)
    rows = events.withColumn("before", F.coalesce(F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("starts", F.coalesce(F.sum((F.col("what") == "start").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    error = (
        F.when((F.col("what") == "start") & (F.col("before") == 0) & (F.col("starts") > 0), F.concat(F.lit("MultipleRoots:"), F.col("ord")))
        .when((F.col("what") == "token") & (F.col("before") <= 0), F.concat(F.lit("TokenOutsideRoot:"), F.col("ord")))
        .when((F.col("what") == "finish") & (F.col("before") <= 0), F.concat(F.lit("UnexpectedFinish:"), F.col("ord")))
    )
    rows = rows.withColumn("error", error).withColumn("step", step)
    out = rows.groupBy("doc_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ord"))).alias("first"), F.sum("step").alias("open"))
    return out.select("doc_id", F.coalesce("first", F.when(F.col("open") > 0, F.concat(F.lit("UnclosedNodes:"), F.col("open")))).alias("error"))


def _digests(df: DataFrame, column: str, one) -> DataFrame:
    """doc_id, digest and error of each row's array, by an Arrow function."""

    def run(batches):
        for b in batches:
            found = [one(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d for d, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["doc_id", "digest", "error"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), column).mapInArrow(run, "doc_id long, digest string, error string")


def event_digests(events: DataFrame) -> DataFrame:
    """doc_id, digest, error of each stream of tree events (ord, what, kind, text); an invalid one has an error."""
    rows = events.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "what", "kind", "text"))).alias("events"))
    return _digests(rows, "events", lambda es: canon.tree_events_digest([(e["what"], e["kind"], e["text"]) for e in es]))


_DIAGNOSTIC = ("severity", "start", "end", "code", "message", "notes")


def diagnostic_digests(diagnostics: DataFrame) -> DataFrame:
    """doc_id, digest, error (null) of each diagnostic (severity, start, end, code, message, notes)."""
    return _digests(diagnostics.select("doc_id", F.struct(*_DIAGNOSTIC).alias("d")), "d", lambda d: (canon.diagnostic_digest(d), None))


def diagnostic_set_digests(diagnostics: DataFrame) -> DataFrame:
    """doc_id, digest, error (null) of all diagnostics of a document, whatever their order."""
    rows = diagnostics.groupBy("doc_id").agg(F.collect_list(F.struct(*_DIAGNOSTIC)).alias("ds"))
    return _digests(rows, "ds", lambda ds: (canon.diagnostics_digest(ds), None))
