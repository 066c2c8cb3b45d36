"""Quartile bucket digests of documents, and their likeness.

Three kinds of byte triplets from a sliding window are hashed to 128 buckets; each bucket is coded
in two bits by the quartile its count falls in; in front go a logarithmic length and the ratios of
the quartiles. Two digests differ by a score that is bounded, and likeness is 1 less its share of
the bound. Shifted, cut or edited text moves few buckets across a quartile.

``neighbours`` pairs each document with the next in ascending ``doc_id``. Ids are dealt to cells by
quantiles, cells in their order to tasks by their bytes, a heavy cell of one id is cut by the hash of
its texts, every cell also gets the first document of the one after it, and tasks stream through
their sorted cells; no text leaves the executors.

Defined results: null is the empty text; texts below three bytes have the digest of no triplets;
equal texts have equal digests; rows that repeat a ``doc_id`` are ordered by a hash of their text (xxhash64, seed 42), then the text; null ids
sort first; in a table of one document the next is itself; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, partitions

BUCKETS = 128
#: Differences from here on count as this.
BOUND = 300
#: What a bucket adds whose codes differ by 0 to 3.
STEP = np.array([0, 1, 3, 6])
_SLICE = 1 << 20
_MIX = [(0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), (0x27D4EB2F, 0x165667B1, 0x9E3779B1), (0xC2B2AE3D, 0x27D4EB2F, 0x85EBCA77)]
_PICK = [(0, 1, 2), (0, 1, 3), (0, 2, 3)]
# What each byte value adds to a triplet's hash at each of its places.
_TABLES = [[(np.arange(1, 257, dtype=np.uint64) * m & 0xFFFFFFFF).astype(np.uint32) for m in row] for row in _MIX]


def bucket_counts(raw: bytes) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for lo in range(0, len(raw), _SLICE):
        b = np.frombuffer(raw, np.uint8, min(_SLICE + 3, len(raw) - lo), lo)
        for (x, y, z), (tx, ty, tz) in zip(_PICK, _TABLES):
            # starts that belong to this slice; the last slice ends where the window does
            n = min(_SLICE, len(b) - z)
            if n > 0:
                h = tx[b[x : x + n]] ^ ty[b[y : y + n]] ^ tz[b[z : z + n]]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                total += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return total


def digest(text: str | bytes | None) -> str:
    """72 hexadecimal digits: length, two quartile ratios, 128 two-bit codes."""
    raw = text if isinstance(text, bytes) else (text or "").encode()
    counts = bucket_counts(raw)
    q1, q2, q3 = np.sort(counts)[[31, 63, 95]].tolist()
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    length = min(0xFFFF, round(math.log1p(len(raw)) * 16))
    ratios = [255 * q1 // q3 if q3 else 0, 255 * q2 // q3 if q3 else 0]
    return f"{length:04x}{ratios[0]:02x}{ratios[1]:02x}" + packed.tobytes().hex()


def difference(a: str, b: str) -> int:
    """From 0 to BOUND."""
    x, y = np.frombuffer(bytes.fromhex(a[8:]), np.uint8), np.frombuffer(bytes.fromhex(b[8:]), np.uint8)
    score = 0
    for shift in (0, 2, 4, 6):
        gap = np.abs((x >> shift & 3).astype(np.int8) - (y >> shift & 3).astype(np.int8))
        score += int(STEP[gap].sum())
    score += abs(int(a[:4], 16) - int(b[:4], 16)) // 2
    score += (abs(int(a[4:6], 16) - int(b[4:6], 16)) + abs(int(a[6:8], 16) - int(b[6:8], 16))) // 16
    return min(BOUND, score)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / BOUND


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's first."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and fingerprint, with no shuffle."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(t) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


class _Cells:
    """Where rows go: ids are cut at bounds, and a cell between two bounds that holds one id alone is cut again by a hash."""

    def __init__(self, bounds: np.ndarray, pieces: dict[int, int] | None = None):
        self.bounds, self.pieces = bounds, pieces or {}
        sizes = np.array([self.pieces.get(k, 1) for k in range(len(bounds) + 2)])
        self.first = np.cumsum(sizes) - sizes

    def between(self, known: pd.Series, ids: pd.Series) -> np.ndarray:
        """The place between bounds; null ids, given as 0, have the first to themselves."""
        return np.where(known.to_numpy(bool), np.searchsorted(self.bounds, ids.to_numpy(np.int64), "right") + 1, 0)

    def of(self, known: pd.Series, ids: pd.Series, hashes: pd.Series) -> np.ndarray:
        at = self.between(known, ids)
        out = self.first[at]
        for k, n in self.pieces.items():
            mine = at == k
            # Hashes in their order, from the least 64-bit number up.
            out[mine] += ((hashes.to_numpy()[mine].astype(np.float64) + 2.0**63) / 2.0**64 * n).astype(np.int64).clip(0, n - 1)
        return out


def _with_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, dealt by ranges and sorted so that each row's successor follows it; ``extra`` marks rows that only follow."""
    # Bounds, bytes and first rows of the cells: as many values as there are cells, not documents.
    n = 8 * parts
    own = [F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0).cast("long"))]
    cuts = docs.select("doc_id").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n)
    rough = _Cells(np.unique(np.array(cuts).astype(np.int64)))

    @F.pandas_udf("long")
    def between(known: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(rough.between(known, x))

    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).groupBy(between(*own).alias("k")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    # Long texts and many rows both weigh; a cell of one id alone that is too heavy is cut by the hash of its texts.
    weight = {r.k: r.bytes + 200 * r.rows for r in sizes}
    fair = max(1, sum(weight.values()) // (2 * parts))
    cells = _Cells(rough.bounds, {r.k: int(min(4 * parts, -(-weight[r.k] // fair))) for r in sizes if r.lo == r.hi and weight[r.k] > fair})

    @F.pandas_udf("long")
    def cell_of(known: pd.Series, x: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(cells.of(known, x, h))

    # The hash orders rows of one id; where no cell is cut by it, it is not needed to tell cells apart.
    hashed = F.xxhash64("text") if cells.pieces else F.lit(0).cast("long")
    found = docs.groupBy(cell_of(*own, hashed).alias("cell")).agg(F.min(F.struct(own[0].alias("known"), own[1].alias("id"), hashed.alias("hash"))).alias("first")).collect()
    firsts = {r.cell: tuple(r["first"]) for r in found}
    filled = sorted(firsts)
    before = {c: filled[i - 1] for i, c in enumerate(filled)}
    # Cells in order fill the tasks up to a fair share of the weight.
    share = {c: weight[k] / cells.pieces.get(k, 1) for k in weight for c in range(int(cells.first[k]), int(cells.first[k]) + cells.pieces.get(k, 1))}
    total, running, task = sum(share.values()) or 1, 0.0, {}
    for c in filled:
        task[c] = min(parts - 1, int(running / total * parts))
        running += share[c]

    @F.pandas_udf("array<struct<cell:bigint,task:int,extra:int>>")
    def dealt(known: pd.Series, x: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for c, *key in zip(cells.of(known, x, h).tolist(), known.tolist(), x.tolist(), h.tolist()):
            row = [{"cell": c, "task": task[c], "extra": 0}]
            if firsts[c] == tuple(key):
                row.append({"cell": before[c], "task": task[before[c]], "extra": 1})
            out.append(row)
        return pd.Series(out)

    rows = docs.withColumn("hash", hashed).select("doc_id", "text", "hash", F.inline(dealt(*own, "hash")))
    order = [F.xxhash64("text"), F.col("text")]
    return rows.repartitionById(parts, F.col("task")).sortWithinPartitions("cell", "extra", F.col("doc_id").asc_nulls_first(), *order).select("doc_id", "text", F.col("cell").alias("bucket"), "extra")


def neighbours(docs: DataFrame, id_col="doc_id", text_col="text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, with likeness to the edited and the next."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        held = None  # bucket, doc_id, text, digest: waits for its successor
        for b in batches:
            rows = []
            for doc, text, bucket, extra in zip(*[c.to_pylist() for c in b.columns]):
                own = digest(text)
                if held and held[0] == bucket:
                    _, d, t, f = held
                    new = edited(t, text)
                    g = digest(new)
                    rows.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), f, g, likeness(f, g), likeness(f, own)))
                held = None if extra else (bucket, doc, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_next(base, parts or partitions(docs.sparkSession)).mapInArrow(run, schema)


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    return neighbours(documents(spark, sf_dir))


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    import xxhash

    def order(row):
        h = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
        return row[0] is not None, row[0] or 0, h - (1 << 64) * (h >= 1 << 63), row[1] or ""

    rows = [(d, t or "") for d, t in sorted(rows, key=order)]
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        new = edited(t, after)
        f, g, h = digest(t), digest(new), digest(after)
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), f, g, likeness(f, g), likeness(f, h)))
    return out
