"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
from fractions import Fraction

import pytest

from quillspark.llm import avi, bpe, fingerprint, idfiles, jaccard, langid, licences, linededup, mixing, secrets
from quillspark.llm.idfiles import tokenizer_path
from quillspark.llm.shared import shared_dir, write_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, token string, rank int, line string, host string"
LONG = " ".join(f"word{i % 700}" for i in range(60_000)) + " Zürich 中文 🦀."


def rows():
    texts = [None, "", "   \n", "a", "Hello, hello world.\nReleased under the MIT License.", "Hello, hello world.\nReleased under the MIT License.", LONG, "12 ## 34", 'token = "abcdef123456"', "Straße ΑΣ İ 'tis don't <|endoftext|> x"]
    out = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t or ""), 1, 2, "t", 3, "l", "h") for i, t in enumerate(texts)]
    return [*out, out[4], (None, "no id", None, None, 5, 1, 2, "t", 3, "l", "h")]


@pytest.fixture(scope="module")
def docs(spark):
    return write_table(spark.createDataFrame(rows(), SCHEMA).repartition(3))


def ordered(found):
    return sorted(map(tuple, found), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < -1")


def test_token_files(spark, docs, none):
    path = tokenizer_path()
    for kind, frame, n in (("<u2", docs, 12), ("<u2", none, 0)):
        folder = shared_dir(spark)
        tokens = idfiles.encode_documents(frame, path)
        manifest = idfiles.write_id_files(write_table(tokens), folder, 3, kind)
        got = [(r.doc_id, r.start, r.n_tokens) for r in idfiles.read_id_files(spark, folder, manifest).collect()]
        assert len(got) == n
    known = [(d, t) for d, t, *_ in rows() if d is not None]
    want = idfiles.brute_force([(-1, "no id"), *known], path)
    assert sorted(x[1:] for x in got) == [] and idfiles.id_kind(path) == "<u2"
    folder = shared_dir(spark)
    manifest = idfiles.write_id_files(write_table(idfiles.encode_documents(docs, path)), folder, 3, "<u2")
    back = idfiles.read_id_files(spark, folder, manifest).selectExpr("coalesce(doc_id, -1) d", "start", "n_tokens", "crc32(ids) c").collect()
    assert sorted(map(tuple, back)) == sorted(want)


def test_secrets(docs, none):
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert [s.kind for s in got[8].spans] == ["assign"] and got[0].spans == [] and secrets.scan(none).count() == 0
    assert secrets.scan(docs).count() == 12


def test_language(docs, none):
    model = langid.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert got[0] == got[1] == got[7] == ("und", 0.0) and 0 <= got[6][1] <= 1
    assert langid.identify(none, langid.train(none)).count() == 0 and langid.identify(docs, langid.train(none)).where("lang_pred <> 'und'").count() == 0
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and 7 not in {r.doc_id for r in kept.collect()}


def test_mixing(docs, none):
    p = {r.doc_id: r for r in mixing.plan(docs).where("doc_id IS NOT NULL").collect()}
    assert p[0]["_mix_size"] == 0 and p[6]["_mix_size"] == 60_003 and all(0 <= r["_mix_copies"] <= 3 for r in p.values())
    assert mixing.plan(none).count() == 0 and mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == mixing.plan(docs).groupBy().sum("_mix_copies").first()[0]


def test_join(docs, none):
    # Rows that repeat an id, and rows without one, are rows of their own.
    odd = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(4, LONG + " tail"), (8, "Hello, hello world.\nReleased under the MIT License."), (None, LONG), (None, "no id"), (None, None)], "doc_id long, text string"))
    for frame in (docs, odd, docs.where("doc_id <> 4")):
        every = [(r.doc_id, r.text) for r in frame.collect()]
        assert ordered(jaccard.components(frame, 3, Fraction(9, 10)).collect()) == jaccard.brute_force(every, 3, Fraction(9, 10))
    assert jaccard.components(none, 3, Fraction(9, 10)).count() == 0
    left = jaccard.keep_one(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 6, 7, 8, 9]


def test_lexicon_of_words_that_tie(spark, monkeypatch):
    import pyspark

    rows = [(i, " ".join(f"word{chr(97 + i)}{chr(97 + k)}" for k in range(20)) + " the the") for i in range(20)]
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string")
    name = bpe.build_lexicon(docs, tokenizer_path(), most=100)
    words = bpe.word_counts(docs, tokenizer_path()).where("n > 1").collect()
    held = bpe.Lexicon(pyspark.SparkFiles.get(name)).places([bytes(r.word) for r in words])
    assert len(words) == 401 and 40 < (held >= 0).sum() <= 130
    got = sorted(map(tuple, bpe.digests(docs, tokenizer_path()).collect()))
    assert got == sorted(bpe.brute_force(rows + rows, tokenizer_path()))


def test_helper_names_do_not_clash(spark):
    """Inputs with columns named like the operators' own."""
    names = ["_mix_size", "_mix_copies", "_ld_host", "_ld_lines", "_nj_id", "_nj_key", "_row", "_at", "_words", "_grams", "_p", "_text", "to", "hash", "cell", "task"]
    rows = [(i, f"line {i}\ntop of the page\nReleased under the MIT License." if i else None, "en", "s", 0, *["x"] * len(names)) for i in [0, 1, 2, 3, 4, 4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    model = langid.train(plain)
    for run in (
        lambda d: jaccard.components(d, 3, Fraction(9, 10)), lambda d: jaccard.keep_one(d).select("doc_id", "text"), lambda d: fingerprint.neighbours(d, parts=2), lambda d: langid.identify(d, model),
        lambda d: secrets.scan(d), lambda d: licences.classify(d, licences.train(spark)), lambda d: bpe.digests(d, tokenizer_path()), lambda d: langid.keep_identified(d, model).select("doc_id", "text"),
    ):
        assert sorted(map(str, run(docs).collect())) == sorted(map(str, run(plain).collect()))
    assert jaccard.keep_one(docs).columns == docs.columns


def test_bpe(docs, none):
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in bpe.digests(docs, tokenizer_path()).collect())
    assert got == sorted(bpe.brute_force([(-1 if d is None else d, t) for d, t, *_ in rows()], tokenizer_path()))
    assert bpe.digests(none, tokenizer_path()).count() == 0
    name = bpe.build_lexicon(docs, tokenizer_path())
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(docs, tokenizer_path(), name), tokenizer_path()).collect()}
    assert back[1] == "" and back[3] == "a</w>"


def test_media(docs, none):
    media = avi.media_columns(docs)
    got = {r.doc_id: r for r in media.collect()}
    for d, t, *_ in rows():
        raw = (t or "").encode()
        assert avi.load_all([bytes(got[d].media)])[0]["payload"] == avi.pad(raw) and got[d].n_bytes == len(raw)
    clips = [tuple(r) for r in avi.clip_rows(media).where("doc_id = 6").orderBy("clip").collect()]
    assert clips[0][2] == 0 and clips[-1][3] * avi.FPS == len(avi.pad(LONG.encode())) // avi.FRAME
    assert all(a[3] == b[2] for a, b in zip(clips, clips[1:])) and avi.clip_rows(avi.media_columns(none)).count() == 0


def test_fingerprints(docs, none):
    def as_set(found):
        return sorted(map(str, map(tuple, found)))

    assert as_set(fingerprint.neighbours(docs, parts=3).collect()) == as_set(fingerprint.brute_force([(d, t) for d, t, *_ in rows()]))
    # One id, and no id, on most rows: their cells are cut by the hash, and every row meets its successor.
    hot = [(7, f"text {i} " * (i % 9 + 1)) for i in range(150)] + [(None, f"none {i % 40}") for i in range(100)] + [(i, f"own {i}") for i in range(50)] + [(60, "z" * 5000)]
    frame = docs.sparkSession.createDataFrame(hot, "doc_id long, text string").repartition(4)
    assert as_set(fingerprint.neighbours(frame, parts=5).collect()) == as_set(fingerprint.brute_force(hot))
    assert fingerprint.neighbours(none).count() == 0 and fingerprint.fingerprints(docs).count() == 12
    one = docs.where("doc_id = 3")
    assert [r.near_next for r in fingerprint.neighbours(one).collect()] == [1.0]


def test_licences(spark, docs, none):
    model = licences.train(spark)
    got = sorted((r.doc_id, r.paragraph, r.licence) for r in licences.classify(docs, model).collect())
    assert got == [(4, 1, "mit"), (4, 1, "mit"), (5, 1, "mit")] and licences.classify(none, model).count() == 0


def test_line_dedup(spark, docs, none):
    out = linededup.dedup_lines(docs, "source", "text", 0.2, 2)
    got = {r.doc_id: (r.text, r["_ld_before"], r["_ld_after"]) for r in out.collect() if r.doc_id != 4}
    assert got[0] == (None, 0, 0) and got[1] == ("", 1, 1) and linededup.dedup_lines(none, "source", "text").count() == 0
    pages = [(i, "h", "top \n" + str(i)) for i in range(4)] + [(4, "g", "top"), (5, None, "x"), (6, None, "x"), (7, None, "x"), (8, "h", None)]
    frame = spark.createDataFrame(pages, "page_id long, host string, text string")
    kept = {r.page_id: r.text for r in linededup.dedup_lines(frame).collect()}
    assert kept == {**{i: str(i) for i in range(4)}, 4: "top", 5: "", 6: "", 7: "", 8: None}
    # Hosts of fewer than MIN_PAGES pages have no boilerplate: two pages of one line each tell nothing.
    two = spark.createDataFrame([(1, "two", "same\na"), (2, "two", "same\nb")], "page_id long, host string, text string")
    assert {r.text for r in linededup.dedup_lines(two).collect()} == {"same\na", "same\nb"} and linededup.MIN_PAGES == 3
    # A ratio that equals the bound keeps its lines.
    assert all(r.text.startswith("top") for r in linededup.dedup_lines(frame.where("host = 'h' AND text IS NOT NULL"), max_ratio=1.0).collect())


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as cp

    d = docs.where("doc_id IS NOT NULL").select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (d, d.where("doc_id < -1")):
        at = frame
        for _, stage in cp.STAGES[:-1]:
            at = write_table(stage(spark, at, ""))
            assert at.columns == frame.columns
        assert cp.STAGES[-1][1](spark, at, "").count() == at.count()


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == secrets.brute_force(None)[3]
