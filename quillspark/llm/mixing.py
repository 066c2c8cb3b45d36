"""Mixing sources to target weights, with DataFrame functions only.

Sizes are counted per document and summed per source; the per-source table then gets a target by
water-filling under a cap, and every document its number of copies: ``floor(rate)`` plus one copy
drawn with probability ``rate - floor(rate)``. The draws are seeded by hashes: a source's documents
are dealt by the hash of their id to groups of about a thousand, ordered by size in each, and a
uniform number hashed from the group shifts a systematic draw along that order. Each document is
so drawn with exactly its probability, while the words taken stay near the target, also where a
source has few documents or a few very long ones. Draws of each document by its own hash alone would
have the same probabilities; the words taken are then 0.93 to 1.19 times the targets of sf0.1's 20
sources (0.77 to 1.57 at sf0.01), against 0.97 to 1.02 (0.81 to 1.05) with the shared shift.

Defined results: null text has size 0; null sources form one source, ordered last; a source of
size 0 has target 0 and its documents no copies; rows that repeat a ``doc_id`` are drawn each
for itself; an empty table gives an empty result; other columns pass through ``mix`` untouched, and its helper
columns are named ``_mix_*`` so that they do not clash with those of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import write_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: A source's target stops at so many times its size.
MOST = 3
#: Rows of the per-source table up to which it is broadcast (about 100 bytes a row).
BROADCAST_SOURCES = 50_000
SEED = "mix-1"
#: Documents of one systematic draw, so that no source, however hot, is sorted in one task.
GROUP_DOCS = 1000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(text: Column, at: int = 1) -> Column:
    """A number from 0 to 2**32 - 1, hashed from the text."""
    return F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: source, source_size, target. ``sizes`` has source and size."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # One row a source from here on: the windows without a key order that small table only.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("place", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - (F.sum("cap").over(fill) - F.col("cap"))
    heavy = F.sum("weight").over(every) - (F.sum("weight").over(fill) - F.col("weight"))
    # What a unit of weight gets when the sources before this one are capped; its largest value is
    # the level at which no source is above its cap and nothing is left over.
    by = by.withColumn("level", left.cast("double") / heavy.cast("double"))
    level = F.max("level").over(every)
    target = F.least(F.col("cap").cast("double"), level * F.col("weight").cast("double"))
    return by.select("source", "source_size", "n_docs", "place", target.alias("target"))


def plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed=SEED, weights=WEIGHTS, most=MOST) -> DataFrame:
    """``docs`` with _mix_size, _mix_source_size, _mix_target and _mix_copies."""
    sizes = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    targets = write_table(source_targets(sizes, weights, most))
    n = targets.count()
    right = targets.select(*[F.col(c).alias(f"_mix_{c}") for c in targets.columns])
    # Beyond the bound the join shuffles, and the adaptive planner splits the partitions of hot sources.
    right = F.broadcast(right) if n <= BROADCAST_SOURCES else right
    joined = docs.withColumn("_mix_size", word_count(F.col(text_col))).join(right, F.col(source_col).eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    groups = F.ceil(F.col("_mix_n_docs") / F.lit(GROUP_DOCS)).cast("long")
    out = joined.withColumn("_mix_group", _uniform(key) % groups).withColumn("_mix_hash", _uniform(key, 9))
    order = Window.partitionBy("_mix_place", "_mix_group").orderBy(F.desc("_mix_size"), "_mix_hash", id_col)
    out = out.withColumn("_mix_rank", F.row_number().over(order).cast("double"))
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size").cast("double")).otherwise(0.0)
    shift = _uniform(F.concat(F.lit(f"{seed}:"), F.col("_mix_place").cast("string"), F.lit(":"), F.col("_mix_group").cast("string"))).cast("double") / F.lit(4294967296.0)
    part = rate - F.floor(rate)
    drawn = shift + F.col("_mix_rank") * part
    copies = (F.floor(rate) + F.when(drawn - F.floor(drawn) < part, 1).otherwise(0)).cast("long")
    return out.withColumn("_mix_copies", copies)


def mix(docs: DataFrame, **options) -> DataFrame:
    """Every document as often as the mix takes it, with the columns of ``docs``."""
    planned = plan(docs, **options).where("_mix_copies > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))).alias("_mix_copy")
    return planned.select("*", copies).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    from .shared import documents

    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return plan(docs).select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM s
), c AS (
  SELECT *, CAST([5, 2, 1][(place - 1) % 3 + 1] AS BIGINT) AS weight, source_size * 3 AS cap FROM w
), l AS (
  SELECT *,
    CAST(sum(source_size) OVER () - (sum(cap) OVER f - cap) AS DOUBLE)
      / CAST(sum(weight) OVER () - (sum(weight) OVER f - weight) AS DOUBLE) AS level
  FROM c WINDOW f AS (ORDER BY cap / weight, place)
), t AS (
  SELECT source, source_size, n_docs, place, least(CAST(cap AS DOUBLE), max(level) OVER () * CAST(weight AS DOUBLE)) AS target FROM l
), h AS (
  SELECT doc_id, size, source_size, target, place,
    CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % CAST(ceil(n_docs / {GROUP_DOCS}) AS BIGINT) AS grp,
    CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 9, 8)) AS BIGINT) AS hash
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT *, rate - floor(rate) AS part,
    CAST(('0x' || substr(md5('{SEED}:' || CAST(place AS VARCHAR) || ':' || CAST(grp AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE
      + CAST(row_number() OVER (PARTITION BY place, grp ORDER BY size DESC, hash, doc_id NULLS FIRST) AS DOUBLE) * (rate - floor(rate)) AS drawn
  FROM h
)
SELECT doc_id, size, source_size, target,
  size * CAST(floor(rate) + CASE WHEN drawn - floor(drawn) < part THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM r
"""
