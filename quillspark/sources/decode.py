"""Bytes to text with exact offset maps, and reading sources into tables.

Text comes from built-in functions; what needs a decoder's error positions (issues and boundaries)
comes from one Arrow function, and only when it is asked for.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ORIGINAL, MAX_DECODED = 64 << 20, 128 << 20


#: Bytes whose units are told apart at a time.
_CHUNK = 4 << 20
#: By lead byte: how many bytes follow, and the least and greatest that may come second.
_FOLLOW, _SECOND_LEAST, _SECOND_MOST = np.full(256, -1, np.int8), np.full(256, 0x80, np.uint8), np.full(256, 0xBF, np.uint8)
for _leads, _n in ((range(0x00, 0x80), 0), (range(0xC2, 0xE0), 1), (range(0xE0, 0xF0), 2), (range(0xF0, 0xF5), 3)):
    _FOLLOW[list(_leads)] = _n
_SECOND_LEAST[[0xE0, 0xF0]] = (0xA0, 0x90)
_SECOND_MOST[[0xED, 0xF4]] = (0x9F, 0x8F)


def invalid_units(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal invalid units of UTF-8: leads with what follows them rightly, and lone other bytes."""
    data = np.concatenate((np.frombuffer(raw, np.uint8), np.zeros(3, np.uint8)))
    starts, ends, held = [], [], 0  # up to ``held``, bytes belong to a lead before this chunk
    for lo in range(0, len(raw), _CHUNK):
        b = data[lo : min(lo + _CHUNK, len(raw)) + 3]
        n = len(b) - 3
        follow = _FOLLOW[b[:n]]
        lead = np.flatnonzero(follow > 0)
        wanted, first = follow[lead], b[lead]
        ok = [(b[lead + 1] >= _SECOND_LEAST[first]) & (b[lead + 1] <= _SECOND_MOST[first])]
        for k in (2, 3):
            ok.append(ok[-1] & (wanted >= k) & (b[lead + k] & 0xC0 == 0x80))
        taken = np.zeros(n + 3, bool)
        taken[: max(0, held - lo)] = True
        for k, yes in enumerate(ok, 1):
            taken[lead[yes] + k] = True
        right = sum(x.astype(np.int8) for x in ok)
        size = np.zeros(n, np.int8)
        size[(follow < 0) & ~taken[:n]] = 1
        cut = right < wanted
        size[lead[cut]] = 1 + right[cut]
        at = np.flatnonzero(size)
        starts.append(lo + at)
        ends.append(lo + at + size[at])
        held = lo + n + int(taken[n:].sum())
    return (np.concatenate(starts), np.concatenate(ends)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Decoded:
    """Text or an error; issues as four arrays (original and decoded ranges); boundaries as two (decoded, original)."""

    text: str | None
    error: str | None = None
    issues: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 4
    boundaries: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64),) * 2


def _boundaries(size: int, length: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(0, 0), each unit's edges (decoded, original) in turn, and both ends, without repeats."""
    at = [np.concatenate(([0], np.stack([e[i] for e in edges], 1).ravel() if edges else np.zeros(0, np.int64), [end])) for i, end in ((0, size), (1, length))]
    new = np.concatenate(([True], (np.diff(at[0]) != 0) | (np.diff(at[1]) != 0)))
    return at[0][new].astype(np.int64), at[1][new].astype(np.int64)


def _too_large(sizes: np.ndarray, limit: int) -> Decoded | None:
    """An error if what had been written, step by step, passed the limit."""
    over = np.flatnonzero(sizes > limit)
    return Decoded(None, f"DecodedTooLarge:{limit}:{sizes[over[0]]}") if over.size else None


def decode_source(raw: bytes, encoding: str = "utf8", mode: str = "recovering", limit: int = MAX_DECODED) -> Decoded:
    """One source, in time and memory that grow with its size alone."""
    n = len(raw)
    if encoding == "latin1":
        high = np.flatnonzero(np.frombuffer(raw, np.uint8) > 0x7F)
        size, k = n + len(high), np.arange(len(high))
        if size > limit:
            return _too_large(np.arange(1, n + 1) + np.cumsum(np.frombuffer(raw, np.uint8) > 0x7F), limit)
        return Decoded(raw.decode("latin-1"), boundaries=_boundaries(size, n, [(high + k, high), (high + k + 2, high + 1)]))
    if mode == "strict":
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError as e:
            cut = e.end == n and e.reason == "unexpected end of data"
            return Decoded(None, f"InvalidUtf8:{e.start}:{'' if cut else e.end - e.start}")
        return _too_large(np.array([n]), limit) or Decoded(text, boundaries=_boundaries(n, n, []))
    starts, ends = invalid_units(raw)
    # Each unit becomes three bytes; those before it have moved what follows.
    moved = np.cumsum(3 - (ends - starts))
    new_ends = ends + moved
    size = n + (int(moved[-1]) if len(moved) else 0)
    if wrong := _too_large(np.append(new_ends, size), limit):
        return wrong
    return Decoded(raw.decode("utf-8", "replace"), None, (starts, ends, new_ends - 3, new_ends), _boundaries(size, n, [(new_ends - 3, starts), (new_ends, ends)]))


def decode(raw: bytes, encoding: str = "utf8", mode: str = "recovering", limit: int = MAX_DECODED) -> dict:
    """text, issues (original and decoded ranges), boundaries (decoded, original) and error of one source, as plain lists."""
    d = decode_source(raw, encoding, mode, limit)
    return {"text": d.text, "issues": list(zip(*(x.tolist() for x in d.issues))), "boundaries": list(zip(*(x.tolist() for x in d.boundaries))), "error": d.error}


def text_of(raw: Column, encoding: Column | str = "utf8") -> Column:
    """Decoded text by built-in functions: invalid units of UTF-8 become U+FFFD."""
    encoding = F.lit(encoding) if isinstance(encoding, str) else encoding
    return F.when(encoding == "latin1", F.decode(raw, "ISO-8859-1")).otherwise(F.make_valid_utf8(raw.cast("string")))


def from_text(df: DataFrame, id_col: str, text_col: str, name: Column | None = None) -> DataFrame:
    """The sources table of a column that is text already."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), (name if name is not None else F.lit(None)).cast("string").alias("source_name"), F.col(text_col).alias("text"))


def from_bytes(df: DataFrame, max_original: int = MAX_ORIGINAL, max_decoded: int = MAX_DECODED, keep: Iterable[str] = ()) -> DataFrame:
    """doc_id, the ``keep`` columns, text, issues, boundaries and error of rows with doc_id, raw, encoding and mode.

    The size is checked before anything is decoded; a source that is too large, or that strict
    decoding refuses, has an error in place of text, and other rows go on.
    """
    size = F.octet_length("raw")
    checked = df.withColumn("error", F.when(size > max_original, F.format_string("OriginalTooLarge:%d:%d", F.lit(max_original), size)))
    return decode_sources(checked.withColumn("raw", F.when(F.col("error").isNull(), F.col("raw"))), max_decoded, keep)


def read_files(spark: SparkSession, path: str, glob: str = "*.[rR]", encoding: str = "utf8", max_original: int = MAX_ORIGINAL, mode: str = "recovering", max_decoded: int = MAX_DECODED) -> DataFrame:
    """Source files as doc_id, source_name, text, issues, boundaries and error (see ``from_bytes``); larger ones are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    large = F.col("length") > max_original
    rows = files.select(
        F.xxhash64("path").alias("doc_id"),
        F.col("path").alias("source_name"),
        F.when(~large, F.col("content")).alias("raw"),
        F.lit(encoding).alias("encoding"),
        F.lit(mode).alias("mode"),
        F.when(large, F.format_string("OriginalTooLarge:%d:%d", F.lit(max_original), F.col("length"))).alias("error"),
    )
    return decode_sources(rows, max_decoded, ["source_name"])


_ISSUE = "array<struct<orig_start:bigint,orig_end:bigint,dec_start:bigint,dec_end:bigint>>"
_BOUNDARY = "array<struct<decoded:bigint,original:bigint>>"


def _lists(rows: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> pa.Array:
    offsets = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]), pa.int32())
    parts = [pa.array(np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64), pa.int64()) for k in range(len(names))]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, names))


def decode_sources(df: DataFrame, limit: int = MAX_DECODED, keep: Iterable[str] = ()) -> DataFrame:
    """doc_id, the ``keep`` columns, text, issues, boundaries and error of rows with doc_id, raw, encoding and mode.

    A row that has an ``error`` already keeps it and is not decoded.
    """
    kept, failed = list(keep), "error" in df.columns

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 100):
                b = whole.slice(lo, 100)
                errors = b.column(4).to_pylist() if failed else [None] * b.num_rows
                found = [Decoded(None, e) if e else decode_source(raw or b"", encoding or "utf8", mode or "recovering", limit) for raw, encoding, mode, e in zip(*[b.column(k).to_pylist() for k in (1, 2, 3)], errors)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        *[b.column(4 + failed + k) for k in range(len(kept))],
                        pa.array([d.text for d in found], pa.string()),
                        _lists([d.issues for d in found], ("orig_start", "orig_end", "dec_start", "dec_end")),
                        _lists([d.boundaries for d in found], ("decoded", "original")),
                        pa.array([d.error for d in found], pa.string()),
                    ],
                    ["doc_id", *kept, "text", "issues", "boundaries", "error"],
                )

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(["doc_id long", *[f"`{k}` {types[k]}" for k in kept], "text string", f"issues {_ISSUE}", f"boundaries {_BOUNDARY}", "error string"])
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "raw", "encoding", "mode", *(["error"] if failed else []), *kept).mapInArrow(run, schema)


def boundaries(decoded: DataFrame) -> DataFrame:
    """doc_id, ord, decoded, original: the places that both spaces share, in order."""
    return decoded.select("doc_id", F.posexplode("boundaries").alias("ord", "b")).select("doc_id", F.col("ord").cast("long").alias("ord"), "b.*")


def map_offsets(decoded: DataFrame, points: DataFrame, to: str = "original", bias: str | None = None) -> DataFrame:
    """points (doc_id, offset) with ``mapped``: the place in the other space, None inside a changed unit.

    ``bias`` Left or Right gives that unit's edge instead. Boundaries, each with the one after it, and
    points of a document go through one window, each point taking the last boundary up to it.
    """
    own, other = ("decoded", "original") if to == "original" else ("original", "decoded")
    kind = points.select(F.struct(*points.columns).alias("p")).schema["p"].dataType
    pairs = F.transform("boundaries", lambda b, i: F.struct(b[own].alias("own"), b[other].alias("other"), F.get("boundaries", i + 1)[own].alias("next_own"), F.get("boundaries", i + 1)[other].alias("next_other")))
    rows = decoded.select("doc_id", F.explode(pairs).alias("_b")).select("doc_id", F.col("_b.own").alias("_at"), F.lit(0).alias("_point"), "_b", F.lit(None).cast(kind).alias("p"))
    rows = rows.unionByName(points.select("doc_id", F.col("offset").alias("_at"), F.lit(1).alias("_point"), F.struct(*points.columns).alias("p")), allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("b", F.last_value("_b", ignoreNulls=True).over(order)).where("_point = 1").select("p.*", "b")
    b, at = F.col("b"), F.col("offset")
    same = b["next_own"] - b["own"] == b["next_other"] - b["other"]
    edge = {None: F.lit(None).cast("long"), "Left": b["other"], "Right": b["next_other"]}[bias]
    value = F.when(b["own"] == at, b["other"]).when(b["next_own"].isNull(), None).when(same, b["other"] + at - b["own"]).otherwise(edge)
    return found.withColumn("mapped", F.when(at >= 0, value)).drop("b")
