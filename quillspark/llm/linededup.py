r"""Line dedup by site-relative frequency, with DataFrame functions only.

Pages are grouped by host. A line counts once a page; a line found on at least ``min_pages`` pages
of a host and on more than ``max_ratio`` of the host's pages is boilerplate and leaves every page
of that host.

Lines end at ``\n``; they are compared without white space at either end. Blank lines are neither
counted nor dropped. Null text is kept as null with 0 lines; null hosts form one group; repeated
page rows count as pages of their own; an empty table gives an empty result. Ties (a ratio equal
to ``max_ratio``) are kept. Input columns pass through, helper columns are named ``_ld_*``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import write_table

MAX_RATIO = 0.3
MIN_PAGES = 3
#: Bytes of the boilerplate table up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
EDGE = r"\A[ \t\r\f\x0B]+|[ \t\r\f\x0B]+\z"


def line_array(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.regexp_replace(line, EDGE, "")


def boilerplate(pages: DataFrame, host_col: str, text_col: str, max_ratio=MAX_RATIO, min_pages=MIN_PAGES) -> DataFrame:
    """One row a host: _ld_host and _ld_lines, its boilerplate lines.

    Every line listed is on more than ``max_ratio`` of the host's pages, so a list holds at most
    (mean distinct lines of a page) / ``max_ratio`` entries, however many pages the host has.
    """
    base = pages.select(F.col(host_col).alias("_ld_host"), F.col(text_col).alias("_ld_text"))
    totals = base.groupBy("_ld_host").agg(F.count(F.lit(1)).alias("_ld_total"))
    distinct = F.array_distinct(F.transform(line_array(F.col("_ld_text")), _key))
    lines = base.select("_ld_host", F.explode(distinct).alias("_ld_line")).where("_ld_line <> ''")
    # Lines of a hot host spread by the line; equal lines are summed before the shuffle.
    counts = lines.groupBy("_ld_host", "_ld_line").agg(F.count(F.lit(1)).alias("_ld_pages")).where(F.col("_ld_pages") >= min_pages)
    totals = totals.withColumnRenamed("_ld_host", "_ld_h")
    found = counts.join(totals, F.col("_ld_host").eqNullSafe(F.col("_ld_h"))).where(F.col("_ld_pages") > F.col("_ld_total") * F.lit(max_ratio))
    return found.groupBy("_ld_host").agg(F.array_sort(F.collect_list("_ld_line")).alias("_ld_lines"))


def scattered(pages: DataFrame, flags: DataFrame, host_col: str, text_col: str, least: float, min_pages=MIN_PAGES) -> DataFrame:
    """``flags`` without the lines of copied pages: of the pages of a line, ``least`` or more must differ in their first or in their last other line."""
    base = pages.select(F.col(host_col).alias("_ld_h"), F.col(text_col).alias("_ld_text"))
    base = base.join(flags, F.col("_ld_h").eqNullSafe(F.col("_ld_host")))
    base = base.select("_ld_host", "_ld_lines", F.filter(F.transform(line_array(F.col("_ld_text")), _key), lambda x: x != "").alias("_ld_keys"))
    lines = base.select("_ld_host", "_ld_keys", F.explode(F.array_intersect("_ld_lines", "_ld_keys")).alias("_ld_line"))
    others = F.array_remove("_ld_keys", F.col("_ld_line"))
    ends = lines.select("_ld_host", "_ld_line", F.inline(F.array(*(F.struct(F.lit(k).alias("_ld_end"), F.xxhash64(F.try_element_at(others, F.lit(k))).alias("_ld_other"), F.size(others).alias("_ld_n")) for k in (1, -1)))))
    counts = ends.groupBy("_ld_host", "_ld_line", "_ld_end", "_ld_other").agg(F.count(F.lit(1)).alias("_ld_pages"), F.max("_ld_n").alias("_ld_n"))
    counts = counts.groupBy("_ld_host", "_ld_line", "_ld_end").agg(F.sum("_ld_pages").alias("_ld_pages"), F.sum((F.col("_ld_n") > 0).cast("long")).alias("_ld_differ"))
    found = counts.groupBy("_ld_host", "_ld_line").agg(F.max("_ld_pages").alias("_ld_pages"), F.max("_ld_differ").alias("_ld_differ"))
    found = found.where((F.col("_ld_differ") >= min_pages) & (F.col("_ld_differ") >= F.col("_ld_pages") * F.lit(least)))
    return found.groupBy("_ld_host").agg(F.array_sort(F.collect_list("_ld_line")).alias("_ld_lines"))


def dedup_lines(pages: DataFrame, host_col="host", text_col="text", max_ratio=MAX_RATIO, min_pages=MIN_PAGES, least_differ=0.0) -> DataFrame:
    """``pages`` with the boilerplate lines gone from ``text_col``, and _ld_before / _ld_after line counts.

    With ``least_differ``, lines that are on many pages only because the pages are copies stay (see ``scattered``).
    """
    flags = write_table(boilerplate(pages, host_col, text_col, max_ratio, min_pages))
    if least_differ:
        flags = write_table(scattered(pages, flags, host_col, text_col, least_differ, min_pages))
    held = flags.select(F.sum(F.aggregate("_ld_lines", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 32)).alias("b")).first().b or 0
    right = F.broadcast(flags) if held <= BROADCAST_BYTES else flags
    joined = pages.join(right, F.col(host_col).eqNullSafe(F.col("_ld_host")), "left")
    lines = line_array(F.col(text_col))
    kept = F.when(F.col("_ld_lines").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("_ld_lines"), _key(x))))
    out = joined.withColumn("_ld_before", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")).withColumn("_ld_kept", kept)
    out = out.withColumn("_ld_after", F.when(F.col(text_col).isNull(), 0).otherwise(F.size("_ld_kept")).cast("long"))
    return out.withColumn(text_col, F.array_join("_ld_kept", "\n")).drop("_ld_host", "_ld_lines", "_ld_kept")


# The lines of an HTML page: what block elements hold, without tags.
_HTML = (
    (r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", ""),
    (r"[\r\n]+", " "),
    (r"(?i)<(/?(p|div|li|ul|ol|h[1-6]|tr|table|article|nav|section|header|footer|head|body|title|html)|br|hr)( [^>]*)?/?>", "\n"),
    (r"<[^>]*>", ""),
    (r"\n[ \n]*", "\n"),
)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)"


def html_lines(html: Column) -> Column:
    for pattern, to in _HTML:
        html = F.regexp_replace(html, pattern, to)
    return F.btrim(html, F.lit("\n"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.select("page_id", F.lower(F.regexp_extract("url", HOST, 1)).alias("host"), html_lines(F.col("html")).alias("text"))
    # Both passes over the lines read the extracted text; the HTML is parsed once.
    out = dedup_lines(write_table(pages))
    return out.select("page_id", "host", F.col("_ld_before").alias("n_lines"), F.col("_ld_after").alias("n_kept"), "text")


def _sql_html() -> str:
    x = "html"
    for pattern, to in _HTML:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')" if to != "\n" else f"regexp_replace({x}, '{pattern}', chr(10), 'g')"
    return f"trim({x}, chr(10))"


ORACLE = rf"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host, {_sql_html()} AS text FROM pages
), t AS (
  SELECT host, count(*) AS total FROM p GROUP BY host
), l AS (
  SELECT host, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{EDGE}', '', 'g')))) AS line FROM p
), f AS (
  SELECT l.host, line FROM l JOIN t ON l.host IS NOT DISTINCT FROM t.host WHERE line <> ''
  GROUP BY l.host, line, total HAVING count(*) >= {MIN_PAGES} AND count(*) > total * {MAX_RATIO}::DOUBLE
), g AS (
  SELECT host, list(line) AS flagged FROM f GROUP BY host
), k AS (
  SELECT page_id, p.host, string_split(text, chr(10)) AS lines,
    CASE WHEN flagged IS NULL THEN string_split(text, chr(10))
      ELSE list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(flagged, regexp_replace(x, '{EDGE}', '', 'g'))) END AS kept
  FROM p LEFT JOIN g ON p.host IS NOT DISTINCT FROM g.host
)
SELECT page_id, host, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(kept), 0) AS BIGINT) AS n_kept,
  CASE WHEN lines IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text
FROM k
"""
