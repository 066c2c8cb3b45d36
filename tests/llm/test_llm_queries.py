import pytest
from compare import assert_same
from conftest import SF

from quillspark.llm import avi, bpe, fingerprint, idfiles, jaccard, secrets
from quillspark.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_mix_is_near_its_targets(spark):
    df = QUERIES["op4_mixing"](spark, "/root/testdata/sf0.1").groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r[2] / r[1] - 1) < 0.1 for r in df)


def test_against_brute_force(spark, rows):
    path = idfiles.tokenizer_path()
    assert sorted(map(tuple, QUERIES["op1_token_files"](spark, SF).collect())) == idfiles.brute_force(rows, path)
    assert sorted(map(tuple, QUERIES["op6_bpe"](spark, SF).collect())) == sorted(bpe.brute_force(rows, path))
    assert sorted(map(tuple, QUERIES["op8_fingerprints"](spark, SF).collect())) == sorted(fingerprint.brute_force(rows))
    from fractions import Fraction

    assert sorted(map(tuple, QUERIES["op5_ngram_join"](spark, SF).collect())) == jaccard.brute_force(rows, 3, Fraction(9, 10))
    got = {r.doc_id: tuple(r)[1:5] for r in QUERIES["op2_secrets"](spark, SF).collect()}
    assert got == {d: secrets.brute_force(t) for d, t in rows}


def test_media_round_trip(spark, rows):
    import hashlib
    import zlib

    got = {r.doc_id: r for r in QUERIES["op7_media"](spark, SF).collect()}
    for d, t in rows:
        p = avi.pad(t.encode())
        assert (got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def test_licences_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    names = {"MIT License": "mit", "Apache License, Version 2.0": "apache", "GNU General Public License, version 3": "gpl", "CC BY-NC 4.0": "cc-by-nc"}
    want = sorted((r.doc_id, i, f) for r in docs for i, line in enumerate(r.text.split("\n")) for n, f in names.items() if n in line)
    got = sorted((r.doc_id, r.paragraph, r.licence) for r in QUERIES["op9_licences"](spark, "/root/testdata/sf0.01").collect() if r.licence != "unknown")
    assert got == want


def test_pipeline_against_brute_force(spark, rows):
    """Each stage's rule on plain Python lists; sources as the one that the mix does not change."""
    from fractions import Fraction

    import corpus_pipeline as cp
    from quillspark.llm import langid, mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    kept = [r for r in docs.collect() if model.explains(r.text)]
    totals, seen = {}, {}
    for r in kept:
        totals[r.source] = totals.get(r.source, 0) + 1
        for line in {x.strip(" \t\r\f\v") for x in r.text.split("\n")} - {""}:
            seen[r.source, line] = seen.get((r.source, line), 0) + 1
    often = {k for k, n in seen.items() if n >= 3 and n > cp.LINE_RATIO * totals[k[0]]}
    # Of a line's documents, the first and the last lines beside it: copies have the same.
    beside = {k: [] for k in often}
    for r in kept:
        keys = [x for y in r.text.split("\n") if (x := y.strip(" \t\r\f\v"))]
        for line in {x for x in keys if (r.source, x) in often}:
            beside[r.source, line].append([x for x in keys if x != line])
    drop = {k for k, others in beside.items() if max(len({x[e] for x in others if x}) for e in (0, -1)) >= max(3, cp.LINE_DIFFER * len(others))}
    texts = {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" \t\r\f\v")) not in drop) for r in kept}
    source = {r.doc_id: r.source for r in kept}
    alone = [d for d, _, c in jaccard.brute_force(list(texts.items()), 5, Fraction(4, 5)) if c == d]
    frame = spark.createDataFrame([(d, texts[d], source[d]) for d in alone], "doc_id long, text string, source string")
    copies = {r.doc_id: r["_mix_copies"] for r in mixing.plan(frame).collect()}
    want = [x for d in alone for x in bpe.brute_force([(d, texts[d])], idfiles.tokenizer_path()) * copies[d]]
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(want)
