import codecs
import random
import re
import time

from pyspark.sql import functions as F

from quillspark.functions import sidecar
from quillspark.functions.udtf import register
from quillspark.operators import docs, lines, tree
from quillspark.plans.syntax import diagnostics, syntax, table, tokens
from quillspark.sources import decode as decoding
from quillspark.sources.decode import decode, decode_sources, map_offsets, read_files
from quillspark.streaming.repl import complete_inputs, parse_stream


def test_decode_limits():
    assert decode(b"\xff", "latin1", limit=1)["error"] == "DecodedTooLarge:1:2"
    assert decode(b"abc", "utf8", "strict", 2)["error"] == "DecodedTooLarge:2:3"
    assert decode(b"", "utf8", "strict")["boundaries"] == [(0, 0)]
    assert decode(b"A\xe9B", "latin1")["boundaries"] == [(0, 0), (1, 1), (3, 2), (4, 3)]


def test_offsets_against_a_scan(spark):
    raw = b"a\xff\xe2\x82z"
    d = decode(raw)
    source = spark.createDataFrame([(1, bytearray(raw), "utf8", "recovering")], "doc_id long, raw binary, encoding string, mode string")
    decoded = decode_sources(source)
    size = len(d["text"].encode())
    points = spark.createDataFrame([(1, i) for i in range(size + 2)], "doc_id long, offset long")

    def by_hand(x):
        at = d["boundaries"]
        if x > size:
            return None
        for (a, b), (c, e) in zip([(0, 0), *at], at):
            if x == c:
                return e
            if a < x < c:
                return b + x - a if c - a == e - b else b
        return 0

    got = {r.offset: r.mapped for r in map_offsets(decoded, points, bias="Left").collect()}
    assert got == {i: by_hand(i) for i in range(size + 2)}
    back = {r.offset: r.mapped for r in map_offsets(decoded, points, to="decoded", bias="Right").where("offset <= 5").collect()}
    assert back == {0: 0, 1: 1, 2: 4, 3: 7, 4: 7, 5: 8}


def test_files(spark, tmp_path):
    (tmp_path / "a.R").write_bytes(b"x <- '\xff'\n")
    (tmp_path / "b.txt").write_text("no")
    got = read_files(spark, str(tmp_path)).collect()
    assert [r.text for r in got] == ["x <- '�'\n"]
    assert read_files(spark, str(tmp_path), max_original=3).first().error == "OriginalTooLarge:3:9"
    assert read_files(spark, str(tmp_path), mode="strict").first().error == "InvalidUtf8:6:1"
    assert read_files(spark, str(tmp_path), max_decoded=9).first().error == "DecodedTooLarge:9:11"
    assert read_files(spark, str(tmp_path), encoding="latin1").first().text == "x <- 'ÿ'\n"
    # Issues go with the text into the parse of a file.
    read = read_files(spark, str(tmp_path))
    assert read.columns == ["doc_id", "source_name", "text", "issues", "boundaries", "error"]
    assert [(r.code, r.start, r.end) for r in diagnostics(read).collect()] == [("R-SOURCE-001", 6, 9)]


def test_decoding_is_the_codecs_and_linear(monkeypatch):
    r = random.Random(5)
    odd = [0x41, 0x0A, 0x80, 0xBF, 0xC0, 0xC2, 0xE0, 0xE2, 0x82, 0xAC, 0xED, 0xA0, 0xF0, 0x9F, 0x98, 0xF4, 0x90, 0xF5, 0xFF]
    monkeypatch.setattr(decoding, "_CHUNK", 7)
    for _ in range(3000):
        raw = bytes(r.choice(odd) for _ in range(r.randint(0, 25)))
        found = []

        def record(e):
            found.append((e.start, e.end))
            return "\ufffd", e.end

        codecs.register_error("quillspark-test", record)
        text = raw.decode("utf-8", "quillspark-test")
        d = decode(raw)
        assert d["text"] == text and [(a, z) for a, z, _, _ in d["issues"]] == found
        assert all(text.encode()[a:z] == b"\xef\xbf\xbd" for _, _, a, z in d["issues"])
    monkeypatch.undo()
    began = time.time()
    d = decoding.decode_source(bytes(range(1, 256)) * 30_000)
    assert len(d.issues[0]) == 30_000 * 128 and time.time() - began < 20


def test_a_long_chain_is_parsed_in_the_row(spark):
    n = 40_000
    s = spark.createDataFrame([(1, "a" + "+a" * n)], "doc_id long, text string")
    assert table(s, "elements.kind").where("kind = 'BINARY_EXPR'").count() == n
    assert tree.operands(syntax(s, [tree.FIELDS])).count() == n
    # A path only for what is located.
    found = syntax(s, ["elements.kind,path"], located=["EXPRESSION_LIST"]).select(F.inline("elements")).where("path IS NOT NULL").collect()
    assert [tuple(x) for x in found] == [("EXPRESSION_LIST", [0])]


def test_one_python_node_and_null_text(spark):
    s = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string")
    df = syntax(s, ["status", "tokens", "elements"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {r.doc_id: r.status for r in df.collect()} == {1: "Empty", 2: "Complete"}
    assert tokens(s.limit(0)).count() == 0


def test_relational_runs_agree_with_the_sidecar(spark):
    text = "#' a\n  #' b\nx\n#' c\n\n#' d\nNULL\n#' e"
    s = spark.createDataFrame([(1, text), (2, "y"), (3, "#' z")], "doc_id long, text string")
    both = syntax(s, docs.WITH_TREE)
    got = {(r.doc_id, r.block, r.h_start, r.h_end, r.line_count) for r in docs.runs(both).collect()}
    assert got == {(r.doc_id, r.block, r.h_start, r.h_end, r.line_count) for r in table(s, "rox_blocks").collect()}
    mine = docs.associate(both)
    columns = ["doc_id", "block", "state", "expr_start", "expr_end", "gap_start", "gap_end"]
    assert sorted(map(str, mine.select(columns).collect())) == sorted(map(str, table(s, "rox_assoc").select(columns).collect()))


def test_scans_are_pruned(spark):
    s = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 5")
    plan = lines.line_stats(s)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,5)]" in plan and "lang" not in plan.split("ReadSchema")[1]


def test_table_functions(spark):
    register(spark)
    assert [r.kind for r in spark.sql("SELECT kind FROM r_tokens('a+1') ORDER BY tok").collect()] == ["IDENTIFIER", "PLUS", "DOUBLE"]
    assert spark.sql("SELECT * FROM r_nodes('a')").count() == 3
    assert spark.sql("SELECT code FROM r_diagnostics(')')").first().code == "R-PARSE-001"
    assert [r.start for r in spark.sql("SELECT start FROM r_lines('é\r\nb') ORDER BY line").collect()] == [0, 4]


def test_lines_in_sql_join_and_shuffle_nothing(spark):
    register(spark)
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "é", "\n", "\r", "\r\n", "🦀"]) for _ in range(r.randint(0, 300))) for _ in range(30)] + [None, "", "\n"]
    texts += [texts[0], "x\n" * 30_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").createOrReplaceTempView("lined")
    df = spark.sql("SELECT doc_id, line, start, content FROM lined, LATERAL r_lines(text)")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    want, got = [], sorted(tuple(x) for x in df.collect())
    for i, t in enumerate(texts):
        at, parts = 0, re.split("(\r\n|\r|\n)", t or "")
        for k, (content, ending) in enumerate(zip(parts[::2], [*parts[1::2], ""])):
            want.append((i, k, at, content))
            at += len((content + ending).encode())
    assert got == want


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("s", 0, "f <- function(x) {"), ("s", 1, "x"), ("t", 0, ")"), ("s", 2, "}"), ("s", 3, "y")], "session string, seq long, line string").coalesce(1).write.json(str(src))
    stream = spark.readStream.schema("session string, seq long, line string").json(str(src))
    q = complete_inputs(stream).writeStream.format("memory").queryName("repl_out").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.session, r.n): (r.status, r.text) for r in spark.table("repl_out").collect()}
    assert got == {("s", 0): ("Complete", "f <- function(x) {\nx\n}\n"), ("s", 1): ("Complete", "y\n"), ("t", 0): ("Invalid", ")\n")}
    texts = stream.selectExpr("seq AS doc_id", "line AS text")
    q = parse_stream(texts).writeStream.format("memory").queryName("parsed_out").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("parsed_out").count() == 5


def test_points_and_ranges_against_the_sidecar(spark):
    text = "#' @examples\n  #' f(1)\n#' é [a\nx\n\n#' b\n"
    s = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = table(s, "rox_tokens").collect()
    points = spark.createDataFrame([(1, i) for i in range(-1, len(text.encode()) + 3)], "doc_id long, point long")
    for to in ("host", "projected"):
        own = [(r.p_start, r.p_end, r.h_start, r.h_end) if to == "host" else (r.h_start, r.h_end, r.p_start, r.p_end) for r in rows]
        for affinity in ("Left", "Right"):
            got = {r.point: r.mapped for r in docs.map_points(docs.spans_of(table(s, "rox_tokens"), to), points, affinity).collect()}
            assert got == {p: sidecar.map_point(own, p, affinity) for p in got} and len(got) == points.count()


def test_points_in_the_row_without_joins(spark):
    texts = ["#' @examples\n  #' f(1)\n#' é [a\nx\n\n#' b\n", "x\n", None, "x\n  #' a\n"]
    s = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parsed, asked = syntax(s, [docs.SPANS]), F.transform(F.sequence(F.lit(-1), F.lit(60)), lambda i: F.struct(i.cast("long").alias("point")))
    points = parsed.select("doc_id", F.inline(asked))
    for to in ("host", "projected"):
        for affinity in ("Left", "Right"):
            one = docs.map_points_in(parsed, asked, to, affinity)
            plan = one._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and plan.count("MapInArrow") == 1
            assert sorted(one.collect(), key=str) == sorted(docs.map_points(docs.spans_of(table(s, "rox_tokens"), to), points, affinity).collect(), key=str)
    # Tables whose sizes are guessed too small are not broadcast either.
    assert "Join" not in docs.map_points(docs.spans_of(table(s, "rox_tokens")), points)._jdf.queryExecution().executedPlan().toString()


def test_ranges_in_the_row_without_joins(spark):
    texts = ["#' @examples\n  #' f(1)\n#' é [a\nx\n\n#' b\n", "x\n", None, "x\n  #' a\n"]
    s = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parsed = syntax(s, [docs.SPANS])
    asked = F.transform(F.sequence(F.lit(-1), F.lit(60)), lambda i: F.struct(i.cast("long").alias("start"), (i + i % 5).cast("long").alias("end")))
    ranges = parsed.select("doc_id", F.inline(asked))
    own = {d: [(r.p_start, r.p_end, r.h_start, r.h_end) for r in table(s, "rox_tokens").where(F.col("doc_id") == d).collect()] for d in range(len(texts))}
    got = docs.map_ranges_in(parsed, asked)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1
    rows = got.collect()
    for r in rows:
        a, z = sidecar.map_point(own[r.doc_id], r.start, "Right"), sidecar.map_point(own[r.doc_id], r.end, "Left")
        assert (r.mapped_start, r.mapped_end) == ((None, None) if a is None or z is None else (a, z))
    assert len(rows) == ranges.count()
    assert sorted(rows, key=str) == sorted(docs.map_ranges(docs.spans_of(table(s, "rox_tokens")), ranges).collect(), key=str)


def test_locations_without_joins(spark):
    s = spark.createDataFrame([(1, "f(x, 2)\n"), (2, None), (None, "a\n"), (3, "a <- b\n")], "doc_id long, text string")
    own = tree.locations(table(s, tree.LOCATED))
    gone = own.where("doc_id = 1").withColumn("path", F.concat("path", F.array(F.lit(99))))
    odd = spark.createDataFrame([(3, None, "SOURCE_FILE", 0, 7, False), (9, [], "SOURCE_FILE", 0, 7, False), (3, [], "SOURCE_FILE", 0, 6, False)], own.schema)
    got = tree.resolve(own.unionByName(gone).unionByName(odd), table(s, tree.RESOLVED))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    ids = {(r.doc_id, tuple(r.path)): r.id for r in table(s, "elements.id,path").collect()}
    for r in rows:
        place = (r.doc_id, r.path and tuple(r.path) or ()) if r.path is not None else None
        want = "WrongDocument" if r.doc_id not in (1, 2, 3) else "MissingElement" if place not in ids else "StaleElement" if r.end == 6 and r.path == [] else None
        assert (r.error, r.id) == (want, None if want else ids[place])
    assert len(rows) == own.count() + gone.count() + 3


def test_locations_query_parses_twice(spark):
    from quillspark.queries import QUERIES

    plan = QUERIES["locations_resolve"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Exchange") == 1 and "Join" not in plan


def test_lines_of_many_endings(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "é", "\n", "\r", "\r\n", "🦀"]) for _ in range(r.randint(0, 300))) for _ in range(40)] + [None, ""]
    s = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for x in lines.line_table(s).orderBy("doc_id", "line").collect():
        got.setdefault(x.doc_id, []).append((x.start, x.end, x.full_end, x.content))
    for i, t in enumerate(texts):
        if t is None:
            assert i not in got
            continue
        at, want = 0, []
        parts = re.split("(\r\n|\r|\n)", t)
        for content, ending in zip(parts[::2], [*parts[1::2], ""]):
            end = at + len(content.encode())
            want.append((at, end, end + len(ending), content))
            at = end + len(ending)
        assert got[i] == want
    plan = lines.line_table(s)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_views_shuffle_nothing(spark):
    s = spark.createDataFrame([(1, "f(x)")], "doc_id long, text string")
    parsed = syntax(s, [tree.FIELDS])
    for view in (tree.calls, tree.call_arguments, tree.function_params, tree.operands, tree.branches, tree.loops, tree.top_expressions):
        assert "Exchange" not in view(parsed)._jdf.queryExecution().executedPlan().toString()


def test_violations_both_ways(spark):
    s = spark.createDataFrame([(1, "f(x) <- 'a"), (2, None), (3, "#' é\n)")], "doc_id long, text string")
    parsed = syntax(s, ["elements", "diagnostics"], keep=["text"]).persist()
    assert all(r.violations == [] for r in tree.violations(parsed).collect())
    e, d = parsed.select("doc_id", F.inline("elements")), parsed.select("doc_id", F.inline("diagnostics"))
    assert tree.validate(e, d, s).count() == 0
    wrong = e.withColumn("kind", F.when(F.col("id") == 0, "ERROR").otherwise(F.col("kind"))).withColumn("kind_id", F.when(F.col("is_token"), 300).otherwise(F.col("kind_id")))
    found = {r.violation for r in tree.validate(wrong, d.withColumn("end", F.lit(99)), s.withColumn("text", F.lit("other"))).collect()}
    assert found == {"InvalidRoot", "NodeKindUsedAsToken", "SourceMismatch", "OutOfBoundsDiagnostic"}
    parsed.unpersist()
