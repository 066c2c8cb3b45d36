"""A minimal acyclic transducer from words to token ids, in one file that is memory-mapped.

Words are added in byte order; states whose remaining words are the same are shared (the finished
part of the automaton is hashed as it is left behind), so common endings are stored once. Every arc
carries the number of words that sort before those behind it, so the outputs along a word's path
sum to its place in the sorted list, and that place gives its slice of ids.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"QSLEXI01"


def _build(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Arcs by state and which states end a word; state 0 is the start."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # from, label, to: the last word's states that are still open

    def settle(keep: int) -> None:
        while len(path) > keep:
            at, label, to = path.pop()
            shape = (final[to], tuple(sorted(arcs[to].items())))
            if (same := known.setdefault(shape, to)) != to:
                arcs[at][label] = same
                arcs[to].clear()

    last = b""
    for w in words:
        keep = 0
        while keep < min(len(w), len(last)) and w[keep] == last[keep]:
            keep += 1
        settle(keep)
        at = path[-1][2] if path else 0
        for label in w[keep:]:
            arcs.append({})
            final.append(False)
            arcs[at][label] = len(arcs) - 1
            path.append((at, label, len(arcs) - 1))
            at = len(arcs) - 1
        final[at] = True
        last = w
    settle(0)
    return arcs, final


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file's bytes for words and their ids."""
    words = sorted(entries)
    arcs, final = _build(words)
    number: dict[int, int] = {0: 0}  # reachable states, numbered as met
    order = [0]
    for s in order:
        for label in sorted(arcs[s]):
            if (t := arcs[s][label]) not in number:
                number[t] = len(order)
                order.append(t)
    count: dict[int, int] = {}

    def words_behind(top: int) -> int:
        stack = [top]
        while stack:
            s = stack[-1]
            if s in count:
                stack.pop()
            elif todo := [t for t in arcs[s].values() if t not in count]:
                stack += todo
            else:
                count[s] = final[s] + sum(count[t] for t in arcs[s].values())
                stack.pop()
        return count[top]

    words_behind(0)
    keys, targets, outputs = [], [], []
    for s in order:
        before = int(final[s])
        for label in sorted(arcs[s]):
            t = arcs[s][label]
            keys.append(number[s] << 8 | label)
            targets.append(number[t])
            outputs.append(before)
            before += count[t]
    ends = np.cumsum([0] + [len(entries[w]) for w in words])
    ids = [i for w in words for i in entries[w]]
    head = MAGIC + struct.pack("<QQQQ", len(order), len(keys), len(words), len(ids))
    pad = b"\0" * (-len(order) % 8)
    return b"".join([head, np.array(keys, "<i8").tobytes(), ends.astype("<i8").tobytes(), np.array(targets, "<i4").tobytes(), np.array(outputs, "<i4").tobytes(), np.array(ids, "<u4").tobytes(), np.array([final[s] for s in order], np.uint8).tobytes(), pad])


class Lexicon:
    """A compiled lexicon, mapped from its file: workers of a host share its pages."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a lexicon file")
        states, arcs, words, ids = struct.unpack("<QQQQ", bytes(raw[8:40]))
        at = 40

        def take(kind: str, n: int):
            nonlocal at
            size = n * np.dtype(kind).itemsize
            part = raw[at : at + size].view(kind)
            at += size
            return part

        self.keys, self.ends = take("<i8", arcs), take("<i8", words + 1)
        self.targets, self.outputs, self.ids = take("<i4", arcs), take("<i4", arcs), take("<u4", ids)
        self.final = take("u1", states)
        self.states = states

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the lexicon, -1 where it isn't there. All words step together."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        alive = np.flatnonzero(lengths > 0)
        state = np.zeros(n, np.int64)
        place = np.zeros(n, np.int64)
        step = 0
        while alive.size:
            key = state[alive] << 8 | text[starts[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            alive, arc = alive[ok], arc[ok]
            state[alive] = self.targets[arc]
            place[alive] += self.outputs[arc]
            step += 1
            ended = lengths[alive] == step
            done = alive[ended]
            done = done[self.final[state[done]] == 1]
            out[done] = place[done]
            alive = alive[~ended]
        return out

    def at(self, place: int) -> np.ndarray:
        return self.ids[self.ends[place] : self.ends[place + 1]]
