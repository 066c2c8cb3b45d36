"""Text to token ids with a file of the ``tokenizers`` library, a word cache in front of it.

The pre-tokenizer of the vocabularies used here never lets a token cross a blank, so a text's ids
are those of its blank-separated pieces in turn. Pieces repeat; a worker keeps the ids of those it has
met in a table and hands the library only the others. Whole texts go through: no truncation.
"""

from __future__ import annotations

import os
import re
from operator import itemgetter

import numpy as np

from .workspace import kept

#: Pieces kept per worker; when there are more, the table begins anew.
CACHE_PIECES = 1_200_000
#: Longer pieces (bytes) repeat too rarely to be kept.
CACHE_LENGTH = 48
#: Lower-case words kept beside the pieces.
CACHE_WORDS = 400_000
#: Characters that these vocabularies' normalisation leaves alone but for their case.
ODD = re.compile("[^\x21-\x7e\u00a1-\u012f\u0131-\u024f]|<\\|")


class PieceTable:
    """Ids of blank-separated pieces, found for a whole run of texts with array operations.

    Pieces are hashed by byte and place, looked up in an open-addressing table and compared byte for
    byte with what the table holds, so equal hashes of different pieces do no harm. ``learn`` gives
    the ids of pieces that aren't held, as a dict from piece to little-endian 32-bit ids.
    """

    def __init__(self, learn, most: int = CACHE_PIECES):
        self.learn, self.most = learn, most
        self.bits = max(4, int(most * 2 - 1).bit_length())
        self.weights = np.random.default_rng(7).integers(1, 2**63, CACHE_LENGTH, np.uint64) | np.uint64(1)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.clear()

    def clear(self) -> None:
        self.n, self.text_size, self.ids_size = 0, 0, 0
        self.keys = np.zeros(1024, np.uint64)
        self.text_at, self.text_len, self.ids_at, self.ids_len = (np.zeros(1024, np.int32) for _ in range(4))
        self.text, self.ids = np.zeros(1 << 14, np.uint8), np.zeros(1 << 14, np.uint32)
        self.slots.fill(-1)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate((array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)))

    def _append(self, keys: np.ndarray, pieces: list[bytes], ids: list[bytes]) -> np.ndarray:
        """New entries, not yet in the slots; returns their places."""
        n, k = self.n, len(pieces)
        for name in ("keys", "text_at", "text_len", "ids_at", "ids_len"):
            setattr(self, name, self._room(getattr(self, name), n + k))
        text, values = np.frombuffer(b"".join(pieces), np.uint8), np.frombuffer(b"".join(ids), "<u4")
        self.text, self.ids = self._room(self.text, self.text_size + len(text)), self._room(self.ids, self.ids_size + len(values))
        self.text[self.text_size : self.text_size + len(text)] = text
        self.ids[self.ids_size : self.ids_size + len(values)] = values
        sizes, counts = np.fromiter(map(len, pieces), np.int64, k), np.fromiter(map(len, ids), np.int64, k) // 4
        self.keys[n : n + k] = keys
        self.text_len[n : n + k], self.ids_len[n : n + k] = sizes, counts
        self.text_at[n : n + k] = self.text_size + np.cumsum(sizes) - sizes
        self.ids_at[n : n + k] = self.ids_size + np.cumsum(counts) - counts
        self.n, self.text_size, self.ids_size = n + k, self.text_size + len(text), self.ids_size + len(values)
        return np.arange(n, n + k)

    def _insert(self, entries: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (self.keys[entries] >> np.uint64(64 - self.bits)).astype(np.int64)
        while entries.size:
            free = np.flatnonzero(self.slots[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.slots[slot[won]] = entries[won]
            left = np.ones(len(entries), bool)
            left[won] = False
            entries, slot = entries[left], slot[left] + 1 & mask

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        mask = (1 << self.bits) - 1
        out = np.full(len(keys), -1, np.int64)
        todo, slot = np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while todo.size:
            held = self.slots[slot].astype(np.int64)
            same = (held >= 0) & (self.keys[held] == keys[todo])
            out[todo[same]] = held[same]
            on = (held >= 0) & ~same
            todo, slot = todo[on], slot[on] + 1 & mask
        return out

    def look_up(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit arrays."""
        if self.n > self.most:
            self.clear()
        raw = b"\n".join(texts)
        buf = np.frombuffer(raw, np.uint8)
        body = (buf != 32) & (buf != 10)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], body, [False])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        lens = ends - starts
        firsts = np.cumsum(lens) - lens
        rel = np.arange(int(lens.sum())) - np.repeat(firsts, lens)
        letters = buf[body]
        value = (letters.astype(np.uint64) + np.uint64(1)) * self.weights[np.minimum(rel, CACHE_LENGTH - 1)]
        keys = np.add.reduceat(value, firsts) if len(firsts) else np.zeros(0, np.uint64)
        keys = (keys ^ lens.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
        keys *= np.uint64(0xBF58476D1CE4E5B9)
        short = lens <= CACHE_LENGTH
        entry = np.where(short, self._find(keys), -1)
        if (new := np.flatnonzero(short & (entry < 0))).size:
            distinct, at = np.unique(keys[new], return_index=True)
            pieces = [raw[a:z] for a, z in zip(starts[new[at]].tolist(), ends[new[at]].tolist())]
            words = [p.decode() for p in pieces]
            ids = self.learn(words)
            self._insert(self._append(distinct, pieces, [ids[w] for w in words]))
            entry[new] = self._find(keys[new])
        kept = self.n, self.text_size, self.ids_size
        # Long pieces, and any whose bytes are not the entry's, get an entry for this call only.
        sizes = np.where(short, lens, 0)
        inside = np.repeat(short, lens)
        same = np.ones(len(lens), bool)
        if short.any():
            equal = self.text[np.repeat(self.text_at[entry[short]], lens[short]) + rel[inside]] == letters[inside]
            at = np.cumsum(sizes[short]) - sizes[short]
            same[short] = np.logical_and.reduceat(equal, at) & (self.text_len[entry[short]] == lens[short])
        if (odd := np.flatnonzero(~short | ~same)).size:
            pieces = [raw[a:z] for a, z in zip(starts[odd].tolist(), ends[odd].tolist())]
            words = [p.decode() for p in pieces]
            ids = self.learn(list(dict.fromkeys(words)))
            entry[odd] = self._append(np.zeros(len(odd), np.uint64), pieces, [ids[w] for w in words])
        counts = self.ids_len[entry].astype(np.int64)
        done = np.cumsum(counts)
        found = self.ids[np.repeat(self.ids_at[entry].astype(np.int64) - done + counts, counts) + np.arange(int(counts.sum()))]
        self.n, self.text_size, self.ids_size = kept
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        cut = np.concatenate(([0], done))[np.searchsorted(starts, offsets)]
        return [found[a:z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]


#: Bytes of a text that are worked on at a time.
SLICE = 1 << 20


def cuts(raw: bytes, most: int = SLICE):
    """A text in slices of about that many bytes, cut at blanks: no token crosses one. A run without blanks stays whole."""
    at = 0
    while len(raw) - at > most:
        ends = [e for e in (raw.find(b" ", at + most), raw.find(b"\n", at + most)) if e >= 0]
        if not ends:
            break
        yield raw[at : min(ends)]
        at = min(ends)
    yield raw[at:]


def look_up_texts(table: PieceTable, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text, however long, with no more than some slices of them in work at a time."""
    parts, of = [], []
    for i, t in enumerate(texts):
        for part in cuts(t.encode()):
            parts.append(part)
            of.append(i)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for i, ids in zip(of, (ids for some in groups(parts) for ids in table.look_up(some))):
        found[i].append(ids)
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in found]


def groups(texts: list, most: int = SLICE):
    """Runs of texts of a bounded length together."""
    held, total = [], 0
    for t in texts:
        if held and total + len(t) > most:
            yield held
            held, total = [], 0
        held.append(t)
        total += len(t)
    if held:
        yield held


def pieces_of(text: str) -> list[str]:
    return [p for p in text.replace("\n", " ").split(" ") if p]


class LibraryEncoder:
    """``ids(texts)``: one uint32 array a text, as encode_batch(add_special_tokens=False) gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.pieces, self.known = PieceTable(self._learn), {}
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, pieces: list[str], single: bool) -> dict[str, bytes]:
        """Ids of distinct pieces: many in one text, cut apart again.

        ``single``: each is one word to the pre-tokenizer, so it ends with the token that ends a word;
        others are cut by where their tokens begin.
        """
        got = {}
        for lo in range(0, len(pieces), 128):
            part = pieces[lo : lo + 128]
            e = self.tok.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(self.ends_word[ids]) + 1 if single else ()
            if len(cut) == len(part):
                cut = [0, *(cut * 4).tolist()]
            else:
                starts = np.cumsum([0] + [len(p) + 1 for p in part])
                cut = (np.searchsorted(np.fromiter(map(itemgetter(0), e.offsets), np.int64), starts) * 4).tolist()
            raw = ids.tobytes()
            got.update(zip(part, [raw[a:b] for a, b in zip(cut, cut[1:])]))
        return got

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """A plain word has the ids of its lower case, then those of the points and commas that end it."""
        words, tails, whole = [], [], []
        for p in pieces:
            word = p.rstrip(".,")
            if word.isalpha() and (word.isascii() or not ODD.search(word)):
                words.append(word.lower())
                tails.append(p[len(word) :])
            else:
                words.append(p)
                tails.append("")
                whole.append(p)
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        other = self._encode(list(set(whole).difference(known)), False) if whole else {}
        known.update(other)
        new = list(set(words).union(tails).difference(known, ("",)))
        known.update(self._encode(new, True))
        known[""] = b""
        got = {p: known[w] + known[t] for p, w, t in zip(pieces, words, tails)}
        for w in [*new, *other]:
            if len(w) > CACHE_LENGTH:
                del known[w]
        return got

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return look_up_texts(self.pieces, texts)


def library_encoder(path: str) -> LibraryEncoder:
    """One encoder a worker process and file."""
    return kept(("encoder", path), lambda: LibraryEncoder(path))
