r"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in order of falling corpus frequency, so that the commonest 256 take
one byte. A rank takes 1 to 4 bytes; its length less one goes to a separate control stream, four
lengths a byte. A reader looks each control byte up in a 256-row table of lengths, sums them to
byte positions and gathers all values of a file at once.

A shard file is ``QSI1``, then little-endian: u32 documents, u64 values, u64 data bytes, i64 ids of
the documents, u32 values of each, u8 null flags of the ids, control bytes, data bytes. The folder
also holds ``ranks.u4``: the ids by rank.

Defined results: a null or empty text holds the end id alone; a null ``doc_id`` is kept (it sorts
first); rows that repeat a ``doc_id`` are all kept, ordered by a hash of their ids; an empty table writes no
shards and reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, partitions, read_file, shared_dir, slices, write_file, write_table
from .tokens import library_encoder

MAGIC = b"QSI1"
END_ID = 1
#: Values after which a task closes a shard and begins the next.
SHARD_VALUES = 4 << 20
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = raw[at] if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        if (has := np.flatnonzero(lengths > k)).size:
            out[has] |= raw[at[has] + k] << np.uint32(8 * k)
    return out


def shard_bytes(doc_ids: list, counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = MAGIC + struct.pack("<IQQ", len(ids), len(ranks), len(data))
    return head + ids.tobytes() + np.array(counts, "<u4").tobytes() + null.tobytes() + control + data


def parse_shard(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc ids, values of each, all ranks."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token-id shard")
    docs, n, size = struct.unpack_from("<IQQ", raw, 4)
    at = 24
    ids = np.frombuffer(raw, "<i8", docs, at)
    counts = np.frombuffer(raw, "<u4", docs, at + 8 * docs)
    null = np.frombuffer(raw, np.uint8, docs, at + 12 * docs)
    at += 13 * docs
    width = -(-n // 4)
    if len(raw) != at + width + size:
        raise ValueError("a token-id shard is cut off")
    ranks = unpack(raw[at : at + width], raw[at + width :], n)
    return [None if x else int(d) for d, x in zip(ids, null)], counts, ranks


def id_kind(tokenizer: str) -> str:
    """Two bytes hold the ids of most vocabularies, which keeps what is shuffled small."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def encode_documents(docs: DataFrame, tokenizer: str, id_col="doc_id", text_col="text", end_id: int | None = END_ID) -> DataFrame:
    """doc_id and its ids, as little-endian unsigned integers of ``id_kind(tokenizer)``; counts is null.

    Each task adds one row that has only counts: how often each id came, as 64-bit integers. So the
    frequencies need no further pass over the ids.
    """
    kind = id_kind(tokenizer)
    tail = np.array([] if end_id is None else [end_id], kind)

    def run(batches):
        enc, total = library_encoder(tokenizer), np.zeros(0, np.int64)
        for b in slices(batches):
            ids = [np.concatenate((i.astype(kind), tail)) for i in enc.ids([t or "" for t in b.column(1).to_pylist()])]
            got = np.bincount(np.concatenate(ids), minlength=len(total))
            got[: len(total)] += total
            total = got
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i.tobytes() for i in ids], pa.binary()), pa.nulls(len(ids), pa.binary())], _NAMES)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], _NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, counts binary")


_NAMES = ["doc_id", "ids", "counts"]


def _frequencies(encoded: DataFrame) -> DataFrame:
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0):
                got = np.frombuffer(x.as_buffer(), "<i8").copy()
                if len(got) < len(total):
                    got, total = total, got
                got[: len(total)] += total
                total = got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return encoded.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_id_files(encoded: DataFrame, folder: str, shards: int, kind: str = "<u4") -> DataFrame:
    """Write what ``encode_documents`` gave in ascending doc_id order; returns the manifest, a table with a row a shard file.

    part, shard, name, docs, values, and start: the values in the files before it. The manifest is
    written beside the shards; its running sum has a row for every SHARD_VALUES ids or task.
    """
    spark = encoded.sparkSession
    # As many rows as the vocabulary has ids, however large the corpus.
    by = _frequencies(encoded).orderBy(F.desc("n"), "id").select("id").collect()
    order = np.array([r.id for r in by], "<u4")
    write_file(f"{folder}/ranks.u4", order.tobytes())
    rank_of = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    held = spark.sparkContext.broadcast(rank_of)

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        ids, counts, parts, n = [], [], [], 0
        rows = []

        def close():
            nonlocal ids, counts, parts, n, k
            name = f"{folder}/part-{part:08d}-{k:06d}.qsi"
            write_file(name, shard_bytes(ids, counts, held.value[np.concatenate(parts)]))
            rows.append({"part": part, "shard": k, "name": name, "docs": len(ids), "values": n})
            ids, counts, parts, n, k = [], [], [], 0, k + 1

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.frombuffer(x.as_buffer(), kind)
                ids.append(d)
                counts.append(len(v))
                parts.append(v)
                n += len(v)
                if n >= SHARD_VALUES:
                    close()
        if ids:
            close()
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("values", pa.int64())]))

    # Rows of one id, or without one, are told apart by a hash, so that they can lie in several tasks.
    tokens = encoded.where("counts IS NULL").select("doc_id", "ids", F.xxhash64("ids").alias("hash"))
    by = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    ordered = tokens.repartitionByRange(shards, *by).sortWithinPartitions(*by, "ids").select("doc_id", "ids")
    done = write_table(ordered.mapInArrow(run, "part long, shard long, name string, docs long, values long"))
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return write_table(done.withColumn("start", F.coalesce(F.sum("values").over(before), F.lit(0))), f"{folder}/manifest")


def read_id_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, unsigned 32-bit) of every document in the files of the manifest, each file in one task."""
    # Four bytes for each id of the vocabulary that occurs.
    held = spark.sparkContext.broadcast(np.frombuffer(read_file(f"{folder}/ranks.u4"), "<u4"))

    def run(batches):
        order = held.value
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, counts, ranks = parse_shard(read_file(name))
                values = order[ranks]
                ends = np.cumsum(counts, dtype=np.int64)
                at = ends - counts
                for lo in range(0, len(ids), 2000):
                    hi = min(lo + 2000, len(ids))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo:hi], pa.int64()), pa.array(at[lo:hi] + first, pa.int64()), pa.array(counts[lo:hi].astype(np.int64)), pa.array([values[a:z].tobytes() for a, z in zip(at[lo:hi], ends[lo:hi])], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    files = manifest.select("name", "start").repartition(partitions(spark), "name")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    path = tokenizer_path()
    encoded = write_table(encode_documents(documents(spark, sf_dir), path))
    manifest = write_id_files(encoded, folder, partitions(spark), id_kind(path))
    back = read_id_files(spark, folder, manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def brute_force(rows: list[tuple[int, str | None]], tokenizer: str) -> list[tuple]:
    """(doc_id, start, n_tokens, ids_crc32) straight from the library."""
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(tokenizer), 0, []
    for d, text in sorted(rows):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, END_ID]
        out.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out
