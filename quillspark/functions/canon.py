"""Canonical frames and digests.

A frame is a tag byte, a little-endian 64-bit length and the bytes. Digests absorb bytes into four
64-bit lanes; those of many inputs advance together, a byte of each at a step.
"""

from __future__ import annotations

import struct

import numpy as np

from .grammar import MISSING, Parse, flatten
from .kinds import ID

# Fixed values of the digests.
ALGORITHM = b"r-conformance-fnv4-v1"
SEEDS = (0xCBF29CE484222325, 0x84222325CBF29CE4, 0x9E3779B97F4A7C15, 0x6A09E667F3BCC909)
PRIME = 0x100000001B3
_MASK = (1 << 64) - 1


class Frames:
    def __init__(self, domain: bytes | None = None):
        self.parts: list[bytes] = []
        if domain is not None:
            self.field(0, domain)

    def field(self, tag: int, value: bytes | str) -> None:
        raw = value.encode() if isinstance(value, str) else value
        self.parts.append(struct.pack("<BQ", tag, len(raw)) + raw)

    def count(self, tag: int, n: int) -> None:
        self.field(tag, struct.pack("<Q", n))

    def flag(self, tag: int, value: bool) -> None:
        self.field(tag, bytes([value]))

    def span(self, tag: int, at: tuple[int, int]) -> None:
        self.field(tag, struct.pack("<II", *at))

    def version(self, tag: int, v: tuple[int, int, int]) -> None:
        self.field(tag, struct.pack("<HHH", *v))

    def bytes(self) -> bytes:
        return b"".join(self.parts)


def absorb_many(inputs: list[bytes]) -> list[str]:
    """Hexadecimal digests of raw inputs (with all their fields framed), all in step."""
    if not inputs:
        return []
    sizes = np.array([len(x) for x in inputs], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(inputs[i] for i in order), np.uint8)
    sizes = sizes[order]
    starts = np.cumsum(sizes) - sizes
    lanes = np.repeat(np.array(SEEDS, np.uint64)[:, None], len(inputs), axis=1)
    lane_tags = (np.arange(4, dtype=np.uint64) << np.uint64(8))[:, None]
    shifts = (29 + np.arange(4)).astype(np.uint64)[:, None]
    alive = len(inputs)
    for k in range(int(sizes[0])):
        while sizes[alive - 1] <= k:
            alive -= 1
        x = lanes[:, :alive] ^ (data[starts[:alive] + k].astype(np.uint64) + lane_tags)
        x *= np.uint64(PRIME)
        x ^= x >> shifts
        lanes[:, :alive] = x
    out = [""] * len(inputs)
    for i, column in zip(order.tolist(), lanes.T):
        out[i] = column.astype("<u8").tobytes().hex()
    return out


def digest_input(domain: bytes, *fields: tuple[int, bytes]) -> bytes:
    """What a digest absorbs: the algorithm, its domain, then the fields."""
    f = Frames()
    f.field(0, ALGORITHM)
    f.field(0, domain)
    for tag, raw in fields:
        f.field(tag, raw)
    return f.bytes()


def r_tree(p: Parse, flat=None) -> bytes:
    out, flat = Frames(b"r-tree-v1"), flat or flatten(p)
    raw = p.lexed.text.encode("utf-8", "surrogatepass")
    for mark, i in walk(flat):
        if flat.token[i] is None:
            out.field(1, flat.kind[i]) if mark == 1 else out.field(4, b"")
        elif mark == 1:
            out.field(2, flat.kind[i])
            out.field(3, raw[flat.start[i] : flat.end[i]])
    return out.bytes()


def walk(flat):
    """(1, element) on entering and (2, element) on leaving, in order."""
    open_ones: list[int] = []
    for i in range(len(flat.kind)):
        while open_ones and flat.last[open_ones[-1]] < i:
            yield 2, open_ones.pop()
        yield 1, i
        open_ones.append(i)
    while open_ones:
        yield 2, open_ones.pop()


def r_diagnostics(p: Parse) -> bytes:
    out = Frames(b"r-diagnostics-v1")
    out.count(1, len(p.diagnostics))
    for d in p.diagnostics:
        out.field(2, d.code)
        out.field(3, "Error")
        out.span(4, (d.start, d.end))
        out.field(5, d.message)
        out.field(6, d.recovery)
        out.span(7, d.recovery_range())
        out.field(8, d.recovery_token or "")
    return out.bytes()


def snapshot(p: Parse, flat=None) -> bytes:
    out = Frames(b"parse-snapshot-v1")
    out.field(1, p.lexed.text)
    out.version(2, p.r_version)
    out.version(3, p.roxygen_version)
    out.field(4, p.completeness)
    out.field(5, r_tree(p, flat))
    out.field(6, r_diagnostics(p))
    return out.bytes()


def tree_hash64(p: Parse, flat=None) -> int:
    """FNV-1a over entering and leaving all elements, with kinds and the tokens' bytes."""
    flat = flat or flatten(p)
    raw = p.lexed.text.encode("utf-8", "surrogatepass")
    h = SEEDS[0]
    for mark, i in walk(flat):
        fed = bytes([mark]) + struct.pack("<H", ID[flat.kind[i]])
        if flat.token[i] is not None and flat.token[i] != MISSING:
            fed += raw[flat.start[i] : flat.end[i]]
        for b in fed:
            h = (h ^ b) * PRIME & _MASK
    return h


def tree_events_digest(events: list[tuple[str, str | None, str | None]]) -> tuple[str | None, str | None]:
    """Digest of ("start", kind, None), ("token", kind, text), ("finish", None, None); or the first error."""
    out, depth, rooted = Frames(), 0, False
    for i, (what, kind, text) in enumerate(events):
        if what == "start":
            if not depth and rooted:
                return None, f"MultipleRoots:{i}"
            rooted, depth = True, depth + 1
            out.field(1, kind)
        elif not depth:
            return None, f"{'TokenOutsideRoot' if what == 'token' else 'UnexpectedFinish'}:{i}"
        elif what == "token":
            out.field(2, kind)
            out.field(3, text)
        else:
            out.field(4, b"")
            depth -= 1
    if not rooted:
        return None, "Empty"
    if depth:
        return None, f"UnclosedNodes:{depth}"
    return absorb_many([digest_input(b"tree") + out.bytes()])[0], None


_SEVERITY = {"Error": 1, "Warning": 2, "Note": 3}


def _diagnostic_fields(d: dict) -> bytes:
    f = Frames()
    f.field(1, bytes([_SEVERITY[d["severity"]]]))
    f.field(2, struct.pack("<I", d["start"]))
    f.field(3, struct.pack("<I", d["end"]))
    f.field(4, d["code"])
    f.field(5, d["message"])
    f.count(6, len(d["notes"]))
    for n in d["notes"]:
        f.field(7, n)
    return f.bytes()


def diagnostic_digest(d: dict) -> str:
    return absorb_many([digest_input(b"diagnostic") + _diagnostic_fields(d)])[0]


def diagnostics_digest(ds: list[dict]) -> str:
    """Of a multiset: the order given does not matter."""
    ordered = sorted(ds, key=lambda d: (_SEVERITY[d["severity"]], d["start"], d["end"], d["code"].encode(), d["message"].encode(), [n.encode() for n in d["notes"]]))
    head = Frames()
    head.count(10, len(ordered))
    return absorb_many([digest_input(b"diagnostic-set") + head.bytes() + b"".join(map(_diagnostic_fields, ordered))])[0]
