"""Documentation blocks relationally: runs, projection, tags, association and mapping of points and ranges.

``runs`` and ``associate`` read parsed rows (``syntax(s, FIELDS)``, ``WITH_TREE``); the flat ``rox_*``
tables come from the parse plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import REGISTRY
from . import tree


#: What ``runs`` reads of a parse, and ``associate`` beside it.
FIELDS = ["tokens.kind,start,end"]
WITH_TREE = [*FIELDS, tree.FIELDS]


def _comments() -> Column:
    """Of the tokens of a row: its documentation comments, and whether each is the first of a block.

    Lines join when one NEWLINE, or one and a WHITESPACE, lies between them.
    """
    def line(t, i):
        k1, k2, k3 = (F.get("tokens", i - k)["kind"] for k in (1, 2, 3))
        joined = ((k1 == "NEWLINE") & (k2 == "ROXYGEN_COMMENT")) | ((k1 == "WHITESPACE") & (k2 == "NEWLINE") & (k3 == "ROXYGEN_COMMENT"))
        return F.when(t["kind"] == "ROXYGEN_COMMENT", F.struct(t["start"].alias("start"), t["end"].alias("end"), (~F.coalesce(joined, F.lit(False))).alias("first")))

    return F.filter(F.transform("tokens", line), lambda x: x.isNotNull())


def _blocks(parsed: DataFrame) -> DataFrame:
    """``parsed`` with _blocks, an array of block, h_start, h_end, line_count, next_start."""
    df = parsed.select("*", F.inline(F.array(F.struct(_comments().alias("_lines")))))
    firsts = F.filter(F.transform("_lines", lambda x, i: F.when(x["first"], i)), lambda i: i.isNotNull())
    df = df.select("*", F.inline(F.array(F.struct(firsts.alias("_firsts")))))

    def block(i, k):
        after = F.coalesce(F.get("_firsts", k + 1), F.size("_lines"))
        return F.struct(k.cast("long").alias("block"), F.get("_lines", i)["start"].alias("h_start"), F.get("_lines", after - 1)["end"].alias("h_end"), (after - i).cast("long").alias("line_count"), F.get("_lines", after)["start"].alias("next_start"))

    return df.withColumn("_blocks", F.transform("_firsts", block)).drop("_lines", "_firsts")


def runs(parsed: DataFrame) -> DataFrame:
    """doc_id, block, h_start, h_end, line_count of each block, without a shuffle."""
    return _blocks(parsed).select("doc_id", F.inline("_blocks")).drop("next_start")


def associate(parsed: DataFrame) -> DataFrame:
    """doc_id, block, state, expr_start, expr_end, gap_start, gap_end: each block with the first expression from its end on.

    Blocks and top expressions of a document go through one window, each block taking the next expression.
    """
    code = ("WHITESPACE", "NEWLINE", "COMMENT", "ROXYGEN_COMMENT", "NULL_KW")

    def top(e):
        inside = F.slice("elements", e["id"] + 1, e["last_desc"] - e["id"] + 1)
        return F.struct(e["start"].alias("at"), F.lit(1).alias("order"), F.struct(e["start"].alias("start"), e["end"].alias("end"), ~F.exists(inside, lambda k: k["is_token"] & ~k["kind"].isin(*code)).alias("only_null")).alias("t"), F.lit(None).cast(_BLOCK).alias("b"))

    def block(b):
        return F.struct(b["h_end"].alias("at"), F.lit(0).alias("order"), F.lit(None).cast(_TOP).alias("t"), b.alias("b"))

    size = F.get("elements", F.lit(0))["end"].alias("size")
    rows = _blocks(parsed).where(F.size("_blocks") > 0).select("doc_id", size, F.inline(F.concat(F.transform("_blocks", block).cast(_ENTRIES), F.transform(F.filter(tree.tops(), lambda e: ~e["kind"].isin("ERROR", "MISSING")), top).cast(_ENTRIES))))
    later = Window.partitionBy("doc_id").orderBy("at", "order").rowsBetween(0, Window.unboundedFollowing)
    near = rows.withColumn("t", F.first_value("t", ignoreNulls=True).over(later)).where("order = 0").select("doc_id", "size", "b.*", "t")
    state = (
        F.when(F.col("next_start").isNotNull() & (F.col("t").isNull() | (F.col("next_start") < F.col("t.start"))), "Ambiguous")
        .when(F.col("t").isNull(), "Detached")
        .when(F.col("t.only_null"), "TerminatedByNull")
        .otherwise("Normal")
    )
    return near.select("doc_id", "block", state.alias("state"), F.col("t.start").alias("expr_start"), F.col("t.end").alias("expr_end"), F.col("h_end").alias("gap_start"), F.coalesce("t.start", "size").alias("gap_end"))


_BLOCK = "struct<block:bigint,h_start:bigint,h_end:bigint,line_count:bigint,next_start:bigint>"
_TOP = "struct<start:bigint,end:bigint,only_null:boolean>"
_ENTRIES = f"array<struct<at:bigint,order:int,t:{_TOP},b:{_BLOCK}>>"


def projection(rox_tokens: DataFrame) -> DataFrame:
    """doc_id and the projected text, put together from its tokens in order."""
    return rox_tokens.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok", "text"))), lambda x: x["text"]), "").alias("projected"))


def registry(spark, tags: dict[str, str] = REGISTRY) -> DataFrame:
    """The dimension table of tags: name, body_mode."""
    return spark.createDataFrame(list(tags.items()), "name string, body_mode string")


def extend_registry(tags: DataFrame, more: DataFrame) -> DataFrame:
    """Tags added, or replaced by name."""
    return tags.join(F.broadcast(more.select("name")), "name", "left_anti").unionByName(more)


def tags(rox_tokens: DataFrame, tag_table: DataFrame) -> DataFrame:
    """doc_id, tok, name, body_mode (null: unknown) of every tag."""
    # The registry has a row a tag: dozens, by its definition.
    return rox_tokens.where("kind = 'TAG_NAME'").select("doc_id", "tok", F.col("text").alias("name"), "h_start", "h_end").join(F.broadcast(tag_table), "name", "left")


#: What ``params`` reads of a parse.
PARAMS = ["rox_elements.parent_id,kind,p_start,tok", "rox_tokens.text"]


def params(parsed: DataFrame) -> DataFrame:
    """doc_id, p_start, name of every documented parameter, names below a NAME_LIST, without a shuffle."""
    names = F.filter("rox_elements", lambda e: (e["kind"] == "IDENTIFIER") & (F.get("rox_elements", e["parent_id"])["kind"] == "NAME_LIST"))
    return parsed.select("doc_id", F.inline(F.transform(names, lambda e: F.struct(e["p_start"].alias("p_start"), F.get("rox_tokens", e["tok"])["text"].alias("name")))))


#: What ``map_points_in`` and ``map_ranges_in`` read of a parse.
SPANS = "rox_tokens.p_start,p_end,h_start,h_end"
_SPAN = "struct<from_start:bigint,from_end:bigint,to_start:bigint,to_end:bigint>"


def _together(spans: DataFrame, asked: DataFrame) -> DataFrame:
    """Spans and what is asked of them as rows of one table: doc_id, and s or p."""
    p = F.struct(*asked.columns)
    kind = asked.select(p.alias("p")).schema["p"].dataType
    rows = spans.select("doc_id", F.struct("from_start", "from_end", "to_start", "to_end").cast(_SPAN).alias("s"), F.lit(None).cast(kind).alias("p"))
    return rows.unionByName(asked.select("doc_id", p.alias("p")), allowMissingColumns=True)


def _together_in(parsed: DataFrame, asked: Column, to: str) -> DataFrame:
    """The same rows from one parse (``syntax(s, [SPANS])``): ``asked`` is an array of structs in its row."""
    a, b = ("p", "h") if to == "host" else ("h", "p")
    inner = parsed.select(asked.alias("x")).schema["x"].dataType.elementType
    kind = f"array<struct<s:{_SPAN},p:struct<{','.join(['doc_id:' + parsed.schema['doc_id'].dataType.simpleString(), *[f'`{f.name}`:{f.dataType.simpleString()}' for f in inner]])}>>>"
    spans = F.transform("rox_tokens", lambda t: F.struct(F.struct(t[f"{a}_start"], t[f"{a}_end"], t[f"{b}_start"], t[f"{b}_end"]), F.lit(None)))
    points = F.transform(asked, lambda x: F.struct(F.lit(None), F.struct(F.col("doc_id"), *[x[f.name] for f in inner])))
    return parsed.select("doc_id", F.inline(F.concat(spans.cast(kind), points.cast(kind))))


def _mapped(rows: DataFrame, point: Column, name: str, affinity: str, edges: bool) -> DataFrame:
    """``rows`` of ``_together`` with the place of ``point`` as column ``name``; windows by document alone, no join."""
    right = affinity == "Right"
    a, z = F.col("s.from_start"), F.col("s.from_end")
    # With Right the span that begins at the point counts, with Left the one that ends there; empty spans hold no point.
    placed = rows.withColumns({"_at": F.coalesce(a, point), "_order": F.when(F.col("s").isNull() == F.lit(right), 1).otherwise(0)})
    order = Window.partitionBy("doc_id").orderBy("_at", "_order", "s.from_end").rowsBetween(Window.unboundedPreceding, 0)
    held = placed.withColumn("_s", F.last_value(F.when(z > a, F.col("s")), ignoreNulls=True).over(order))
    start, end = F.col("_s.from_start"), F.col("_s.from_end")
    inside = ((start <= point) & (point < end)) if right else ((start < point) & (point <= end))
    value = F.when(inside, F.col("_s.to_start") + point - start)
    if edges:
        # What no span holds on that side may still lie on an edge: the first that begins there, or the last that ends there
        # (one that isn't empty and ends there holds the point).
        here = Window.partitionBy("doc_id", "_at")
        edge = F.min("s.to_start").over(here) if right else F.max(F.when(z == a, F.col("s.to_end"))).over(here)
        held = held.withColumn("_edge", edge)
        value = F.coalesce(value, F.when(F.col("doc_id").isNotNull() & point.isNotNull(), F.col("_edge")))
    return held.withColumn(name, value).select(*rows.columns, name)


def _points(rows: DataFrame, affinity: str, edges: bool) -> DataFrame:
    return _mapped(rows, F.col("p.point"), "_a", affinity, edges).where("p IS NOT NULL").select("p.*", F.col("_a").alias("mapped"))


def _ranges(rows: DataFrame, start_affinity: str, end_affinity: str, edges: bool) -> DataFrame:
    left = _mapped(rows, F.col("p.start"), "_a", start_affinity, edges)
    both = _mapped(left, F.col("p.end"), "_z", end_affinity, edges).where("p IS NOT NULL")
    known = F.col("_a").isNotNull() & F.col("_z").isNotNull()
    return both.select("p.*", F.when(known, F.col("_a")).alias("mapped_start"), F.when(known, F.col("_z")).alias("mapped_end"))


def map_points(spans: DataFrame, points: DataFrame, affinity: str = "Right", edges: bool = True) -> DataFrame:
    """points (doc_id, point) with ``mapped``; spans have doc_id, from_start, from_end, to_start, to_end.

    Inside a span, or at the boundary on the side of the affinity, a point moves along; at a boundary
    that nothing touches from that side, it goes with the span that ends or begins there, unless
    ``edges`` is off. Spans do not overlap: one window finds the last one that begins before a point.
    """
    return _points(_together(spans, points), affinity, edges)


def map_points_in(parsed: DataFrame, points: Column, to: str = "host", affinity: str = "Right", edges: bool = True) -> DataFrame:
    """As ``map_points``, with spans and points (an array of structs with ``point``) from the same parsed rows."""
    return _points(_together_in(parsed, points, to), affinity, edges)


def map_ranges(spans: DataFrame, ranges: DataFrame, start_affinity: str = "Right", end_affinity: str = "Left", edges: bool = True) -> DataFrame:
    """ranges (doc_id, start, end) with ``mapped_start`` and ``mapped_end``, both null where either end has no place."""
    return _ranges(_together(spans, ranges), start_affinity, end_affinity, edges)


def map_ranges_in(parsed: DataFrame, ranges: Column, to: str = "host", start_affinity: str = "Right", end_affinity: str = "Left", edges: bool = True) -> DataFrame:
    """As ``map_ranges``, with spans and ranges (an array of structs with ``start`` and ``end``) from the same parsed rows."""
    return _ranges(_together_in(parsed, ranges, to), start_affinity, end_affinity, edges)


def spans_of(tokens: DataFrame, to: str = "host") -> DataFrame:
    """The spans that lead from the projection to the host, or back, from ``rox_tokens``."""
    a, b = ("p", "h") if to == "host" else ("h", "p")
    return tokens.select("doc_id", F.col(f"{a}_start").alias("from_start"), F.col(f"{a}_end").alias("from_end"), F.col(f"{b}_start").alias("to_start"), F.col(f"{b}_end").alias("to_end"))


def embedded_spans(mappings: DataFrame) -> DataFrame:
    """The spans that lead from the embedded code of a document's blocks to the host; doc_id becomes (doc_id, block)."""
    return mappings.select(F.struct("doc_id", "block").alias("doc_id"), F.col("e_start").alias("from_start"), F.col("e_end").alias("from_end"), F.col("h_start").alias("to_start"), F.col("h_end").alias("to_end"))


def embedded_to_host(mappings: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (doc_id, block, start, end) in embedded code with mapped_start and mapped_end in the host."""
    keyed = ranges.select(F.struct("doc_id", "block").alias("doc_id"), "start", "end")
    return map_ranges(embedded_spans(mappings), keyed, edges=False).select("doc_id.doc_id", "doc_id.block", "start", "end", "mapped_start", "mapped_end")
