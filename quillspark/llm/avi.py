"""AVI motion-JPEG columns: RIFF files, intra frames, shots and timed clips.

Writing: bytes become the quantised coefficients of 24 x 24 grey baseline JPEG frames, one byte a
coefficient (less 128) with all quantisers 1, so the entropy coding, which is lossless, carries
them unchanged. Reading: the RIFF chunks and the ``idx1`` index give the frames; their Huffman
codes are decoded for all frames together, one symbol of each at a step; coefficients give back the
bytes, and an inverse transform in whole numbers gives the pixels. Shots begin where the histogram
difference of successive frames stands out of its recent mean and deviation.

The reader takes any grey baseline JPEG frame (one component, 8 bits, any Huffman and quantiser
tables, no restart intervals); the default tables need not be in the frames that this module writes,
since it writes its own.

Defined results: null and empty texts store one frame of padding; texts of any length are stored
whole, in slices of bounded memory; equal texts give equal files and features; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents

SIDE = 24
FRAME = SIDE * SIDE
BLOCKS = FRAME // 64
FPS = 25
#: Frames coded or decoded together.
SLICE_FRAMES = 4096
#: A shot begins where the difference is above mean + DEVIATIONS * deviation of the last WINDOW differences, and above LEAST_CUT.
WINDOW, DEVIATIONS, LEAST_CUT = 8, 2.5, 0.15
BINS = 16


def _zigzag() -> np.ndarray:
    """Row-major places of the 64 coefficients in scan order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


class Huffman:
    """A JPEG table: counts of codes by length 1 to 16, and the symbols in code order."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.counts, self.symbols = counts, symbols
        self.code, self.length = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
        self.symbol_at, self.length_at = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        code = k = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                s = symbols[k]
                self.code[s], self.length[s] = code, length
                lo = code << 16 - length
                self.symbol_at[lo : lo + (1 << 16 - length)] = s
                self.length_at[lo : lo + (1 << 16 - length)] = length
                code, k = code + 1, k + 1
            code <<= 1

    def segment(self, kind: int) -> bytes:
        body = bytes([kind, *self.counts, *self.symbols])
        return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


def _table(by_length: dict[int, list[int]]) -> Huffman:
    return Huffman([len(by_length.get(n, [])) for n in range(1, 17)], [s for n in range(1, 17) for s in by_length.get(n, [])])


# Differences of the first coefficient; then sizes without a run, the end of a block, and all runs.
DC = _table({4: list(range(10))})
_PLAIN = list(range(1, 9))
AC = _table({4: _PLAIN, 5: [0x00], 9: [0x09, 0x0A, 0xF0, *[r << 4 | s for r in range(1, 16) for s in range(1, 11)]]})


def _frame_head() -> bytes:
    dqt = b"\xff\xdb" + struct.pack(">HB", 67, 0) + b"\x01" * 64
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0])
    sos = b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0x00, 0, 63, 0])
    return b"\xff\xd8" + dqt + sof + DC.segment(0x00) + AC.segment(0x10) + sos


HEAD = _frame_head()


def _sizes(v: np.ndarray) -> np.ndarray:
    """Bits of |v|, and v's extra bits, as JPEG codes them."""
    size = np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames of a payload whose length is a multiple of FRAME (at most SLICE_FRAMES of them)."""
    block = np.frombuffer(payload, np.uint8).astype(np.int64).reshape(-1, 64) - 128
    n, frames = len(block), len(block) // BLOCKS
    dc = block[:, 0].reshape(frames, BLOCKS)
    dsize, dbits = _sizes(np.diff(dc, axis=1, prepend=0).ravel())
    acode, alen = AC.code.astype(np.int64), AC.length.astype(np.int64)
    at = np.arange(n)
    flat = block[:, 1:]
    row, col = np.nonzero(flat)
    size, bits = _sizes(flat[row, col])
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    run = col - np.concatenate(([0], col[:-1] + 1)) if len(col) else col
    run = np.where(first, col, run)
    symbol = (run & 15) << 4 | size
    keys = [at << 8, row << 8 | (col + 1) << 2 | 3]
    codes = [DC.code.astype(np.int64)[dsize] << dsize | dbits, acode[symbol] << size | bits]
    lens = [DC.length.astype(np.int64)[dsize] + dsize, alen[symbol] + size]
    for k in range(int(run.max(initial=0)) >> 4):  # runs of 16 zeros before a value
        has = np.flatnonzero(run >> 4 > k)
        keys.append(row[has] << 8 | (col[has] + 1) << 2 | k)
        codes.append(np.full(len(has), acode[0xF0]))
        lens.append(np.full(len(has), alen[0xF0]))
    if (short := np.flatnonzero(flat[:, -1] == 0)).size:
        keys.append(short << 8 | 255 << 0)
        codes.append(np.full(len(short), acode[0x00]))
        lens.append(np.full(len(short), alen[0x00]))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    code, length, frame = np.concatenate(codes)[order], np.concatenate(lens)[order], (key[order] >> 8) // BLOCKS
    total = np.bincount(frame, weights=length, minlength=frames).astype(np.int64)
    width = (total + 7) // 8
    base = np.cumsum(width) - width
    ends = np.cumsum(length)
    frame_first = np.concatenate(([0], np.cumsum(total)[:-1]))
    bit = ends - length - frame_first[frame] + base[frame] * 8
    # Each code touches two 32-bit words at most; codes don't overlap, so sums are unions.
    wide = code.astype(np.uint64) << (64 - length - (bit & 31)).astype(np.uint64)
    words = int(bit[-1] // 32) + 2
    at_word = bit >> 5
    out = np.bincount(at_word, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=words + 1)
    out += np.bincount(at_word + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words + 1)
    raw = bytearray(out.astype(np.uint64).astype(">u4").tobytes())
    raw = np.frombuffer(raw, np.uint8)[: int(base[-1] + width[-1])].copy()
    raw[base + width - 1] |= ((1 << (width * 8 - total)) - 1).astype(np.uint8)
    body = raw.tobytes()
    return [HEAD + body[a : a + w].replace(b"\xff", b"\xff\0") + b"\xff\xd9" for a, w in zip(base.tolist(), width.tolist())]


def pad(raw: bytes) -> bytes:
    short = -len(raw) % FRAME if raw else FRAME
    return raw + b"\xff" * short


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    sizes = np.array([len(f) for f in frames], np.int64)
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10
    index[:, 2] = 4 + np.cumsum(8 + sizes + (sizes & 1)) - (8 + sizes + (sizes & 1))
    index[:, 3] = sizes
    movi = _chunk(b"LIST", b"movi" + b"".join([_chunk(b"00dc", f) for f in frames]))
    return _chunk(b"RIFF", b"AVI " + hdrl + movi + _chunk(b"idx1", index.tobytes()))


def _chunks(raw: memoryview, lo: int, hi: int):
    """(name, where the body begins, its size) of the chunks from lo to hi."""
    while lo + 8 <= hi:
        name, size = bytes(raw[lo : lo + 4]), struct.unpack_from("<I", raw, lo + 4)[0]
        if lo + 8 + size > hi:
            raise ValueError("an AVI chunk is cut off")
        yield name, lo + 8, size
        lo += 8 + size + (size & 1)


def parse_avi(raw: bytes) -> dict:
    """fps and (start, size) of every frame, by the index; without an index, by the movie list."""
    view = memoryview(raw)
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index = 0.0, None, None
    for name, at, size in _chunks(view, 12, 8 + struct.unpack_from("<I", raw, 4)[0]):
        kind = bytes(view[at : at + 4]) if name == b"LIST" else b""
        if kind == b"hdrl":
            for n2, a2, s2 in _chunks(view, at + 4, at + size):
                if n2 == b"LIST" and bytes(view[a2 : a2 + 4]) == b"strl":
                    for n3, a3, _ in _chunks(view, a2 + 4, a2 + s2):
                        if n3 == b"strh" and bytes(view[a3 : a3 + 4]) == b"vids":
                            scale, rate = struct.unpack_from("<II", view, a3 + 20)
                            fps = rate / scale if scale else 0.0
        elif kind == b"movi":
            movi = (at, size)
        elif name == b"idx1":
            index = np.frombuffer(raw, "<u4", size // 16 * 4, at).reshape(-1, 4)
    if movi is None:
        raise ValueError("an AVI file without a movie list")
    if index is not None:
        index = index[index[:, 0] >> 16 == int.from_bytes(b"dc", "little")]
        starts = index[:, 2].astype(np.int64)
        # Offsets count from the list's name, in some files from the file's first byte.
        from_list = not len(starts) or starts[0] < movi[0]
        starts = starts + 8 + (movi[0] if from_list else 0)
        spans = list(zip(starts.tolist(), index[:, 3].tolist()))
    else:
        spans = [(a, s) for n, a, s in _chunks(view, movi[0] + 4, movi[0] + movi[1]) if n[2:] == b"dc"]
    return {"fps": fps, "frames": spans}


@lru_cache(64)
def _frame_tables(head: bytes) -> tuple[int, int, np.ndarray, Huffman, Huffman]:
    """width, height, quantisers in scan order, tables of the first and the other coefficients."""
    at, quant, tables, shape, scan = 2, {}, {}, None, None
    while at < len(head):
        mark, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif mark == 0xC4:
            while body:
                counts = list(body[1:17])
                tables[body[0]] = Huffman(counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif mark == 0xC0:
            shape = struct.unpack_from(">BHHB", body)
            quantiser = body[8]
        elif mark in (0xC1, 0xC2, 0xC3, 0xDD):
            raise ValueError("not a baseline frame without restarts")
        elif mark == 0xDA:
            scan = body[2]
        at += 2 + size
    if not shape or shape[0] != 8 or shape[3] != 1 or scan is None:
        raise ValueError("not a grey 8-bit frame")
    return shape[2], shape[1], quant[quantiser], tables[scan >> 4], tables[0x10 | scan & 15]


def _split_frame(frame: bytes) -> tuple[bytes, bytes]:
    """Everything to the end of the scan header; the entropy-coded bytes, unstuffed."""
    if frame.startswith(HEAD):
        head = HEAD
    else:
        at = 2
        while frame[at + 1] != 0xDA:
            at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
        head = frame[: at + 2 + struct.unpack_from(">H", frame, at + 2)[0]]
    end = frame.rfind(b"\xff\xd9")
    return head, frame[len(head) : end].replace(b"\xff\0", b"\xff")


def decode_frames(frames: list[bytes]) -> tuple[np.ndarray, tuple[int, int, np.ndarray]]:
    """Coefficients in scan order, (frames, blocks, 64), of frames with one header; and width, height, quantisers."""
    parts = [_split_frame(f) for f in frames]
    if len({h for h, _ in parts}) > 1:
        raise ValueError("frames with different headers")
    width, height, quant, dc, ac = _frame_tables(parts[0][0])
    blocks = -(-width // 8) * -(-height // 8)
    sizes = np.array([len(b) for _, b in parts], np.int64)
    data = np.frombuffer(b"".join([b for _, b in parts]) + b"\xff" * 16, np.uint8)
    # The eight bytes from each place on, as one number.
    window = np.zeros(len(data) - 8, np.uint64)
    for k in range(8):
        window |= data[k : k + len(window)].astype(np.uint64) << np.uint64(56 - 8 * k)
    symbols = np.concatenate([ac.symbol_at, dc.symbol_at])
    lengths = np.concatenate([ac.length_at, dc.length_at])
    n = len(frames)
    out = np.zeros(n * blocks * 64, np.int64)
    pos = (np.cumsum(sizes) - sizes) * 8
    stop = np.cumsum(sizes) * 8
    block, k, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    who = np.arange(n)
    one, top = np.uint64(1), np.uint64(64)
    while who.size:
        bits = window[pos >> 3] << (pos & 7).astype(np.uint64)
        first = k == 0
        place = (bits >> np.uint64(48)).astype(np.int64) + (first << 16)
        symbol, length = symbols[place], lengths[place]
        if not length.all():
            raise ValueError("a code that the frame's tables don't have")
        size = symbol & np.uint64(15)
        run = (symbol >> np.uint64(4)).astype(np.int64)
        extra = np.where(size > 0, (bits << length) >> (top - np.maximum(size, one)), np.uint64(0)).astype(np.int64)
        half = (one << size).astype(np.int64)
        value = np.where(extra << 1 >= half, extra, extra - half + 1)
        value[size == 0] = 0
        last = np.where(first, last + value, last)
        ended = ~first & (symbol == 0)
        k += np.where(first, 0, run)
        if (k > 63).any():
            raise ValueError("a run beyond its block")
        out[(who * blocks + block) * 64 + k] = np.where(first, last, value)
        k += 1
        pos += (length + size).astype(np.int64)
        full = ended | (k > 63)
        block += full
        k[full] = 0
        if full.any():
            left = block < blocks
            if not left.all():
                if (pos[~left] > stop[~left]).any():
                    raise ValueError("a frame's codes are cut off")
                who, pos, stop, block, k, last = who[left], pos[left], stop[left], block[left], k[left], last[left]
        if (pos > stop).any():
            raise ValueError("a frame's codes are cut off")
    return out.reshape(n, blocks, 64), (width, height, quant)


def coefficient_bytes(coefficients: np.ndarray) -> bytes:
    return (coefficients + 128).astype(np.uint8).tobytes()


#: The transform's basis in whole numbers, so that sums are exact in any order.
_BASIS = np.rint(np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]) * (1 << 12))


def pixels(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(frames, blocks, 64) grey values, row by row within a block."""
    square = np.zeros(coefficients.shape)
    square[..., ZIGZAG] = coefficients * quant
    square = square.reshape(-1, 8, 8)
    grey = np.matmul(np.matmul(_BASIS.T, square), _BASIS)
    grey = np.floor((grey + (1 << 23)) / (1 << 24)) + 128
    return np.clip(grey, 0, 255).astype(np.uint8).reshape(coefficients.shape)


def histograms(grey: np.ndarray) -> np.ndarray:
    """Counts of BINS levels a frame."""
    n = len(grey)
    level = (grey.reshape(n, -1) >> (8 - BINS.bit_length() + 1)).astype(np.int64) + np.arange(n)[:, None] * BINS
    return np.bincount(level.ravel(), minlength=n * BINS).reshape(n, BINS)


def shot_starts(counts: np.ndarray) -> list[int]:
    """Frames at which shots begin, the first always."""
    if not len(counts):
        return []
    gaps = np.abs(np.diff(counts, axis=0)).sum(axis=1)  # of frame i + 1 to frame i; whole numbers
    sums = np.concatenate(([0], np.cumsum(gaps)))
    squares = np.concatenate(([0], np.cumsum(gaps * gaps)))
    i = np.arange(len(gaps))
    lo = np.maximum(0, i - WINDOW)
    n = np.maximum(1, i - lo)
    mean = (sums[i] - sums[lo]) / n
    spread = np.sqrt(np.maximum(0, (squares[i] - squares[lo]) / n - mean * mean))
    least = LEAST_CUT * 2 * counts[0].sum()
    cut = (gaps > least) & (gaps > mean + DEVIATIONS * spread)
    return [0, *(np.flatnonzero(cut) + 1).tolist()]


def store(payload: bytes) -> bytes:
    """The AVI file that holds a payload."""
    frames: list[bytes] = []
    for lo in range(0, len(payload), SLICE_FRAMES * FRAME):
        frames += encode_frames(payload[lo : lo + SLICE_FRAMES * FRAME])
    return write_avi(frames)


def store_all(payloads: list[bytes]) -> list[bytes]:
    """Files of several payloads, their frames coded together."""
    joined, at, out = b"".join(payloads), 0, []
    frames: list[bytes] = []
    for lo in range(0, len(joined), SLICE_FRAMES * FRAME):
        frames += encode_frames(joined[lo : lo + SLICE_FRAMES * FRAME])
    for p in payloads:
        n = len(p) // FRAME
        out.append(write_avi(frames[at : at + n]))
        at += n
    return out


def load_all(files: list[bytes]) -> list[dict]:
    """payload (bytes), fps, frames and shots (first frames) of each file; frames of one header are decoded together."""
    parsed = [parse_avi(f) for f in files]
    frames = [f[a : a + s] for f, p in zip(files, parsed) for a, s in p["frames"]]
    alike: dict[bytes, list[int]] = {}
    for i, frame in enumerate(frames):
        alike.setdefault(_split_frame(frame)[0], []).append(i)
    payload: list[bytes] = [b""] * len(frames)
    levels = np.zeros((len(frames), BINS), np.int64)
    for of in alike.values():
        for lo in range(0, len(of), SLICE_FRAMES):
            some = of[lo : lo + SLICE_FRAMES]
            coefficients, (_, _, quant) = decode_frames([frames[i] for i in some])
            raw, size = coefficient_bytes(coefficients), coefficients[0].size
            for k, i in enumerate(some):
                payload[i] = raw[k * size : (k + 1) * size]
            levels[some] = histograms(pixels(coefficients, quant))
    out, at = [], 0
    for p in parsed:
        n = len(p["frames"])
        out.append({"payload": b"".join(payload[at : at + n]), "fps": p["fps"], "frames": n, "shots": shot_starts(levels[at : at + n])})
        at += n
    return out


def _groups(items: list, weight, most: int = SLICE_FRAMES * FRAME):
    """Runs of items of a bounded weight together."""
    held, total = [], 0
    for x in items:
        if held and total + weight(x) > most:
            yield held
            held, total = [], 0
        held.append(x)
        total += weight(x)
    if held:
        yield held


def media_columns(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, media: an AVI file for every text."""

    def run(batches):
        for b in batches:
            rows = [(d, (t or "").encode()) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            for part in _groups(rows, lambda r: len(r[1]) + FRAME):
                files = store_all([pad(raw) for _, raw in part])
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array([len(raw) for _, raw in part], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clip_rows(media: DataFrame, media_col="media", id_col="doc_id") -> DataFrame:
    """Timed clips: doc_id, clip, start_s, end_s, frames."""

    def run(batches):
        for b in batches:
            rows = []
            pairs = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for part in _groups(pairs, lambda r: len(r[1])):
                for (d, _), x in zip(part, load_all([m for _, m in part])):
                    ends = [*x["shots"][1:], x["frames"]]
                    rows += [(d, i, a / x["fps"], z / x["fps"], z - a) for i, (a, z) in enumerate(zip(x["shots"], ends))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64()])], ["doc_id", "clip", "start_s", "end_s", "frames"])

    return media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, "doc_id long, clip int, start_s double, end_s double, frames long")


def feature(x: dict) -> str:
    """Rate, frames, shots and where each begins."""
    return f"fps={x['fps']:g};frames={x['frames']};shots={len(x['shots'])};starts={','.join(map(str, x['shots']))}"


def op7_media(spark, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            rows = list(zip(*[c.to_pylist() for c in b.columns]))
            out = []
            for part in _groups(rows, lambda r: len(r[2])):
                for (d, n, m), x in zip(part, load_all([r[2] for r in part])):
                    p = x["payload"]
                    out.append((d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(x)))
            columns = list(zip(*out)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media_columns(documents(spark, sf_dir)).mapInArrow(run, schema)
