"""BPE encoding and decoding with a lexicon of frequent words.

Two passes over the whole corpus: the first counts words and compiles the commonest with their ids
into a minimal acyclic transducer (``lexicon.py``), which every worker maps from one file; the
second encodes: words that the transducer holds take its ids, all others are merged exactly, by
rank. The ids are those of the ``tokenizers`` library for the same vocabulary file.

Defined results: null and empty texts have no ids and decode to the empty text; texts of any
length are encoded whole; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored. Of words whose counts tie at the bound of the lexicon, a
hash chooses those that fit; which words it holds never changes the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .idfiles import tokenizer_path
from .lexicon import Lexicon, compile_lexicon
from .shared import documents, shared_dir, slices, write_file, write_table
from .tokens import CACHE_LENGTH, ODD, PieceTable, cuts, look_up_texts, pieces_of
from .workspace import kept

#: Words in the lexicon at most; a bound on its size, not on the words that are encoded.
LEXICON_WORDS = 32_768
#: Counts from here on are told apart by their logarithm only when the lexicon's words are chosen.
HIGH = 65_536
#: Distinct pieces that a counting task holds before it sends their counts on.
COUNT_PIECES = 150_000
#: Pieces and words kept by a worker: fewer than the library's encoder keeps, beside the merge table.
KEPT_PIECES, KEPT_WORDS = 300_000, 150_000
END = "</w>"

_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class WordBPE:
    """Splitting, merging and decoding for a word-end BPE vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        chars = _byte_chars()
        self.byte_of = {c: b for b, c in chars.items()}
        self.inner = [vocab[chars[b]] for b in range(256)]
        self.ending = [vocab[chars[b] + END] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {c: np.array([i], "<u4").tobytes() for c, i in special.items()}
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
        strings = {i: s for s, i in vocab.items()} | {i: s for s, i in special.items()}
        self.strings = [strings[i] for i in range(len(strings))]
        self.library = Tokenizer.from_file(path)
        self.lexicon: Lexicon | None = None
        self.pieces, self.known = PieceTable(self._learn, KEPT_PIECES), dict(self.special)

    def words(self, piece: str) -> list[bytes]:
        """The piece's pre-tokens as UTF-8; a special token stands as itself, as str."""
        word = piece.rstrip(".,")
        if word.isalpha() and (word.isascii() or not ODD.search(word)):
            whole = [word.lower().encode()]
            return whole if len(word) == len(piece) else [*whole, piece[len(word) :].encode()]
        if not ODD.search(piece):
            return [w.encode() for w in _WORD.findall(piece.lower())]
        out = []
        for part in self.split_special.split(piece):
            if part in self.special:
                out.append(part)
            elif part:
                for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out.append(bytes(map(self.byte_of.__getitem__, w)))
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the leftmost pair of the lowest rank."""
        ids = [self.inner[b] for b in word[:-1]]
        ids.append(self.ending[word[-1]])
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.merges.get
        none = 1 << 60
        pairs = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)
            new = best & 0xFFFFF
            ids[i : i + 2] = [new]
            del pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 20 | new, none)
            if i < len(pairs):
                pairs[i] = get(new << 20 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << 20 | ids[j]) != m:
                continue
            ids[i], ids[j] = m & 0xFFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if x := get(ids[i] << 20 | ids[after[j]]):
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := get(ids[before[i]] << 20 | ids[i])):
                heapq.heappush(heap, (x, before[i]))
        return [i for i in ids if i >= 0]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        parts = [self.words(p) for p in pieces]
        if len(self.known) > KEPT_WORDS:
            self.known = dict(self.special)
        known = self.known
        new = [w for w in set().union(*parts) if w not in known]
        places = self.lexicon.places(new) if self.lexicon else np.full(len(new), -1)
        for w, place in zip(new, places.tolist()):
            known[w] = self.lexicon.at(place).tobytes() if place >= 0 else np.array(self.merge(w), "<u4").tobytes()
        got = {p: known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]) for p, ws in zip(pieces, parts)}
        for w in new:
            if len(w) > CACHE_LENGTH:
                del known[w]
        return got

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return look_up_texts(self.pieces, texts)

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False): this vocabulary has no decoder."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


def codec(path: str, lexicon: str | None = None) -> WordBPE:
    """One codec a worker process and vocabulary file; ``lexicon`` names a file sent with addFile."""
    out = kept(("codec", path), lambda: WordBPE(path))
    if lexicon and getattr(out, "lexicon_name", None) != lexicon:
        out.lexicon, out.lexicon_name = Lexicon(SparkFiles.get(lexicon)), lexicon
    return out


def word_counts(docs: DataFrame, tokenizer: str, text_col="text") -> DataFrame:
    """word (binary) and n, over all texts."""

    def run(batches):
        enc, held = codec(tokenizer), Counter()

        def counts():
            words = Counter()
            for p, n in held.items():
                for w in enc.words(p):
                    if isinstance(w, bytes):
                        words[w] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.binary()), pa.array(words.values(), pa.int64())], ["word", "n"])

        for b in slices(batches):
            for t in b.column(0).to_pylist():
                for part in cuts((t or "").encode()):
                    held.update(pieces_of(part.decode()))
                    if len(held) > COUNT_PIECES:
                        yield counts()
        yield counts()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, text_col="text", most: int = LEXICON_WORDS) -> str:
    """Count, compile, write to the shared folder and send the file to executors; returns its name."""
    spark = docs.sparkSession
    counts = write_table(word_counts(docs, tokenizer, text_col).where("n > 1"))
    # How many words have each count (beyond HIGH, each step of its logarithm): a bounded table for
    # the driver, which gives the level from which on the words fit.
    level_of = F.when(F.col("n") <= HIGH, F.col("n")).otherwise(HIGH + F.floor(F.log2("n") * 256))
    levels = {r.level: r.words for r in counts.groupBy(level_of.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()}
    least, held, share = max(levels, default=0) + 1, 0, 0.0
    for level in sorted(levels, reverse=True):
        if held + levels[level] > most:
            # Of the words that tie at the bound, about as many as there is room for, by their hash.
            share = 0.95 * (most - held) / levels[level]
            break
        held += levels[level]
        least = level
    chosen = level_of >= least
    if share:
        chosen |= (level_of == level) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))
    top = counts.where(chosen).select("word").collect()
    enc = WordBPE(tokenizer)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    uri = f"{shared_dir(spark)}/{name}"
    write_file(uri, compile_lexicon({bytes(r.word): enc.merge(bytes(r.word)) for r in top}))
    spark.sparkContext.addFile(uri)
    return name


def encode_documents(docs: DataFrame, tokenizer: str, lexicon: str, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit)."""

    def run(batches):
        enc = codec(tokenizer, lexicon)
        for b in slices(batches):
            ids = enc.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i.tobytes() for i in ids], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the text that its ids decode to."""

    def run(batches):
        enc = codec(tokenizer)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(np.frombuffer(x.as_buffer(), "<u4")) for x in b.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _joined_sha256(strings: list[str], ids: np.ndarray, step: int = 1 << 16) -> str:
    """The digest of the ids' strings joined by blanks, some at a time."""
    found = hashlib.sha256()
    for lo in range(0, len(ids), step):
        found.update(((" " if lo else "") + " ".join(map(strings.__getitem__, ids[lo : lo + step].tolist()))).encode())
    return found.hexdigest()


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded and decoded in one worker."""
    lexicon = build_lexicon(docs, tokenizer)

    def run(batches):
        enc = codec(tokenizer, lexicon)
        numbers = [str(i) for i in range(len(enc.strings))]
        for b in slices(batches):
            n, sums, back = [], [], []
            for ids in enc.encode([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(ids))
                sums.append(_joined_sha256(numbers, ids))
                back.append(_joined_sha256(enc.strings, ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), tokenizer_path())


def brute_force(rows: list[tuple[int, str | None]], tokenizer: str) -> list[tuple]:
    """The same digests, straight from the library."""
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(tokenizer), []
    for d, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        out.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out
