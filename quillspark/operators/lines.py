"""Lines, positions and ``#line`` directives of sources, with built-in functions only.

``sources`` has doc_id, source_name and text. Offsets are UTF-8 bytes, lines count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENDING = r"\r\n|\r|\n"
DIRECTIVE = r"^[ \t]*#[ \t]*line[ \t]+([0-9]+)[ \t]*(\"[^\"]*\"[ \t]*)?\z"


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, computed once however often later steps name them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _with_ends(sources: DataFrame) -> DataFrame:
    """``sources`` with _content, _width (bytes of each line's ending) and _end (bytes up to each line's end, ending included).

    Sums run in the row: by fold within blocks of about the root of the number of lines, then over the blocks.
    """
    ending = F.transform(F.regexp_extract_all("text", F.lit(ENDING), F.lit(0)), lambda e: F.octet_length(e))
    df = _once(sources.where("text IS NOT NULL"), _content=F.split("text", ENDING, -1), _width=F.concat(ending, F.array(F.lit(0))))
    df = _once(df, _size=F.zip_with("_content", "_width", lambda c, w: (F.octet_length(c) + w).cast("long")), _block=F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("_content"))).cast("int")))
    zero = F.array(F.lit(0).cast("long"))
    blocks = F.sequence(F.lit(0), F.ceil(F.size("_size") / F.col("_block")).cast("int") - 1)
    sums = F.transform(blocks, lambda k: F.aggregate(F.slice("_size", k * F.col("_block") + 1, F.col("_block")), zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
    df = _once(df, _sums=sums)
    df = _once(df, _before=F.aggregate("_sums", zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.element_at(x, -1)))))
    ends = F.flatten(F.transform("_sums", lambda x, k: F.transform(F.slice(x, F.lit(2), F.size(x) - 1), lambda v: v + F.get("_before", k))))
    return df.withColumn("_end", ends).drop("_size", "_block", "_sums", "_before")


def line_table(sources: DataFrame, *more: Column) -> DataFrame:
    """doc_id, line, start, end, full_end, content (and ``more`` columns of the source), without a shuffle."""
    rows = _with_ends(sources).select("doc_id", *more, F.posexplode(F.arrays_zip("_content", "_width", "_end")).alias("line", "x"))
    size = F.octet_length("x._content").cast("long")
    return rows.select("doc_id", *[c for c in rows.columns[1:-2]], F.col("line").cast("long").alias("line"), (F.col("x._end") - F.col("x._width") - size).alias("start"), (F.col("x._end") - F.col("x._width")).alias("end"), F.col("x._end").alias("full_end"), F.col("x._content").alias("content"))


def line_stats(sources: DataFrame) -> DataFrame:
    """doc_id, line_count, longest (bytes), text_len; null text counts as no line."""
    contents = F.split("text", ENDING, -1)
    return sources.select("doc_id", F.size(contents).cast("long").alias("line_count"), F.array_max(F.transform(contents, lambda c: F.octet_length(c))).cast("long").alias("longest"), F.octet_length("text").cast("long").alias("text_len"))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def positions(sources: DataFrame, points: DataFrame) -> DataFrame:
    """points (doc_id, offset) with line and the three columns, or an error; points of unknown documents go.

    An as-of join by one window: lines and points of a document in order, each point taking the last line before it.
    """
    lines = line_table(sources, F.octet_length("text").cast("long").alias("len"))
    # A document's first line stands before every point.
    at = F.when(F.col("line") == 0, F.lit(-(2**63)).cast("long")).otherwise(F.col("start"))
    kind = points.select(F.struct(*points.columns).alias("p")).schema["p"].dataType
    rows = lines.select("doc_id", at.alias("_at"), F.lit(0).alias("_point"), F.struct("line", "start", "end", "content", "len").alias("_line"), F.lit(None).cast(kind).alias("p"))
    rows = rows.unionByName(points.select("doc_id", F.col("offset").alias("_at"), F.lit(1).alias("_point"), F.struct(*points.columns).alias("p")), allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("l", F.last_value("_line", ignoreNulls=True).over(order)).where("_point = 1 AND l IS NOT NULL").select("p.*", "l.line", "l.start", "l.end", "l.content", "l.len")
    # The bytes before the point; inside a character they are no valid text, after a CR they end the line's content.
    head = F.substring(F.encode("content", "UTF-8"), F.lit(1), (F.col("offset") - F.col("start")).cast("int"))
    over = F.greatest(F.lit(0), F.col("offset") - F.col("end")).cast("long")
    error = F.when((F.col("offset") < 0) | (F.col("offset") > F.col("len")), "OffsetOutOfBounds").when(~F.is_valid_utf8(head.cast("string")), "NotUtf8Boundary")
    ok = error.isNull()
    prefix = F.decode(F.when(ok, head), "UTF-8")
    return found.select(
        *[F.col(c) for c in points.columns],
        F.when(ok, F.col("line")).alias("line"),
        F.when(ok, F.col("offset") - F.col("start")).alias("utf8_column"),
        F.when(ok, F.length(prefix) + over).cast("long").alias("scalar_column"),
        F.when(ok, utf16_length(prefix) + over).cast("long").alias("utf16_column"),
        error.alias("error"),
    )


def offsets(sources: DataFrame, points: DataFrame, unit: str = "utf8") -> DataFrame:
    """points (doc_id, line, column) with the byte offset, or an error; ``unit``: utf8, scalar or utf16."""
    lines = line_table(sources).select("doc_id", "line", "start", "end", "content")
    found = points.join(lines, ["doc_id", "line"], "left")
    column = F.col("column")
    if unit == "utf8":
        size = (F.col("end") - F.col("start")).cast("long")
        head = F.substring(F.encode("content", "UTF-8"), F.lit(1), column.cast("int")).cast("string")
        wrong = F.when(column > size, "ColumnOutOfBounds").when(~F.is_valid_utf8(head), "NotUtf8Boundary")
        value = F.col("start") + column
    elif unit == "scalar":
        wrong = F.when(column > F.length("content"), "ColumnOutOfBounds")
        value = F.col("start") + F.octet_length(F.substring("content", F.lit(1), column.cast("int")))
    elif unit == "utf16":
        raw = F.encode("content", "UTF-16BE")
        head = F.substring(raw, F.lit(1), (column * 2).cast("int"))
        # A high surrogate as the last unit leaves its scalar cut in two.
        last = F.conv(F.hex(F.substring(head, -2, 2)), 16, 10).cast("int")
        wrong = F.when(column > utf16_length(F.col("content")), "ColumnOutOfBounds").when((column > 0) & last.between(0xD800, 0xDBFF), "InsideUtf16Scalar")
        value = F.col("start") + F.octet_length(F.decode(head, "UTF-16BE"))
    else:
        raise ValueError(f"no such unit: {unit}")
    error = F.when(F.col("start").isNull(), "LineOutOfBounds").otherwise(wrong)
    return found.select(*[F.col(c) for c in points.columns], F.when(error.isNull(), value).cast("long").alias("offset"), error.alias("error"))


def directives(lines: DataFrame) -> DataFrame:
    """doc_id, physical_line, logical_line, source_name of ``#line`` directives on any physical line."""
    number = F.expr("try_cast(regexp_extract(content, '" + DIRECTIVE.replace("\\", "\\\\").replace("'", "\\'") + "', 1) AS BIGINT)")
    quoted = F.regexp_extract("content", DIRECTIVE, 2)
    name = F.when(quoted != "", F.regexp_extract(quoted, '^"([^"]*)"', 1))
    found = lines.where(F.col("content").rlike(DIRECTIVE)).select("doc_id", F.col("line").alias("physical_line"), number.alias("logical_line"), name.alias("source_name"))
    return found.where((F.col("logical_line") > 0) & (F.col("logical_line") <= 2**32 - 1))


def directive_errors(directives: DataFrame, line_counts: DataFrame) -> DataFrame:
    """doc_id and what is wrong with given directives (doc_id, ord, physical_line, logical_line), the first in their order, or null.

    ``line_counts`` has doc_id and line_count; ``ord`` is the order in which the directives are given.
    """
    before = F.lag("physical_line").over(Window.partitionBy("doc_id").orderBy("ord"))
    d = directives.join(line_counts, "doc_id").withColumn("_before", before)
    error = (
        F.when(F.col("physical_line") >= F.col("line_count"), F.concat_ws(":", F.lit("DirectiveLineOutOfBounds"), "physical_line", "line_count"))
        .when(F.col("logical_line") == 0, F.concat_ws(":", F.lit("ZeroLogicalLine"), "physical_line"))
        .when(F.col("physical_line") <= F.col("_before"), "DirectivesOutOfOrder")
    )
    return d.withColumn("_error", error).groupBy("doc_id").agg(F.min_by("_error", F.when(F.col("_error").isNotNull(), F.col("ord"))).alias("error"))


def segments(sources: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, physical_start, logical_start, source_name: where each numbering begins; names carry on.

    ``marks``: directives, as ``directives`` finds them or given ones that ``directive_errors`` has passed.
    """
    first = sources.select("doc_id", F.lit(0).cast("long").alias("physical_start"), F.lit(1).cast("long").alias("logical_start"), F.col("source_name").alias("own"))
    more = marks.select("doc_id", (F.col("physical_line") + 1).alias("physical_start"), "logical_line", "source_name")
    order = Window.partitionBy("doc_id").orderBy("physical_start").rowsBetween(Window.unboundedPreceding, 0)
    return first.unionByName(more.toDF("doc_id", "physical_start", "logical_start", "own")).select("doc_id", "physical_start", "logical_start", F.last_value("own", ignoreNulls=True).over(order).alias("source_name"))


def logical_lines(sources: DataFrame) -> DataFrame:
    """doc_id, line, logical_line, logical_name of every physical line: one pass over each document's lines."""
    lines = line_table(sources)
    marks = directives(lines).select("doc_id", (F.col("physical_line") + 1).alias("line"), F.col("logical_line").alias("mark"), F.col("source_name").alias("mark_name"))
    rows = lines.select("doc_id", "line").join(marks, ["doc_id", "line"], "left").join(sources.select("doc_id", F.col("source_name").alias("own_name")), "doc_id")
    order = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    base = F.last_value(F.when(F.col("mark").isNotNull(), F.col("mark") - F.col("line")), ignoreNulls=True).over(order)
    name = F.coalesce(F.last_value("mark_name", ignoreNulls=True).over(order), F.col("own_name"))
    return rows.select("doc_id", "line", (F.col("line") + F.coalesce(base, F.lit(1))).alias("logical_line"), name.alias("logical_name"))
