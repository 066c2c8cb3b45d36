r"""N-gram Jaccard join: near-duplicate documents by a grouped prefix join over word shingles.

Steps, each over all documents:

1. ``shingle sets``: a document's distinct word n-grams as sorted 64-bit hashes. Documents with
   equal sets form a class; the smallest ``doc_id`` of a class stands for it from here on.
2. ``order``: hashes are ordered from rare to common by a frequency sketch of fixed size, hash
   value breaking ties. Two sets at or above the threshold share a hash among the first
   ``n - ceil(t n) + 1`` of each in this order: their prefixes.
3. ``groups``: classes with identical prefixes and size collapse into one group.
4. ``group pairs``: groups that share a prefix hash are filtered by size and by the positions of
   the shared hash, which bound the overlap.
5. ``expand and verify``: members of the pairs that pass are compared exactly on their whole sets.

The result is connected components, not pairs, so a list of groups that share a hash is worked in
two rounds: first every list links to one pivot for each band of sizes, which settles groups of
copies in linear work; then, with the components so far known, the groups of a list that lie
outside its largest component meet all the others, and the pairs that pass are verified. No link is
lost: pairs left out join documents that are already connected.

No list is held by one task for being long. Hashes on more than ``BLOCK`` groups are counted first
(the sketch tells which can be), and their groups meet the pivots in a join; in the second round
such a list is cut into blocks, and only the groups outside the largest component go to all of them.

A document has the words ``[^\x20\x09-\x0D]+`` with A-Z in lower case; with fewer words than the
n-gram, the whole sequence is its one shingle; without words or text its set is empty, it links
with nothing and is its own component. Rows that repeat a ``doc_id`` are rows of their own, each in
the component of its text. A row without an id links like any other; its component has the smallest
id there is, or null where no row has one. An empty table gives an empty result; other columns are
ignored. Long texts are hashed in slices of ``SLICE`` bytes. Hashes have 64 bits: two different
shingles of the pair compared would have to collide.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, partitions, slices, write_table
from .workspace import kept

#: Buckets of the frequency sketch (4 bytes each where it is used), whatever the corpus.
SKETCH = 1 << 20
#: Groups of a list that one task compares with each other, and from which a hash counts as heavy.
BLOCK = 500
#: Heavy hashes, or their pivots, up to which they are broadcast (about 40 bytes each).
BROADCAST_HEAVY = 500_000
#: Lists up to this length are compared whole at once.
SHORT = 8
#: Partners of one document that a task compares with it, or that are listed in one row.
PARTNERS = 200
#: Bytes of a text whose words are held at a time, and bytes of sets in one Arrow batch.
SLICE, BATCH_BYTES = 1 << 20, 16 << 20
#: Pairs up to which the table of documents to verify is broadcast (about 50 bytes each).
BROADCAST_IDS = 500_000
_M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_BLANKS = bytes(range(256)).translate(bytes.maketrans(b"\t\n\v\f\r", b"     "))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else _BLANKS[b] for b in range(256))


class Shingler:
    """Sorted distinct shingle hashes of texts; word hashes are kept for the words met lately."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def _word_hash(self, w: bytes) -> bytes:
        if len(self.words) > 300_000:
            self.words.clear()
        h = self.words[w] = blake2b(w, digest_size=8).digest()
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        raw = text.encode().translate(_LOWER) if text else b""
        get, new = self.words.get, self._word_hash
        hashed, at = [], 0
        while at < len(raw):
            end = raw.find(b" ", at + SLICE)
            end = len(raw) if end < 0 else end
            hashed.append(b"".join([get(w) or new(w) for w in raw[at:end].split(b" ") if w]))
            at = end
        h = np.frombuffer(b"".join(hashed), np.uint64)
        if not len(h):
            return np.zeros(0, np.uint64)
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out ^= h[k : len(h) - n + 1 + k]
            out *= np.uint64(_M1)
            out ^= out >> np.uint64(29)
            out *= np.uint64(_M2)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def shingler(n: int) -> Shingler:
    """One a worker process and shingle length."""
    return kept(("shingles", n), lambda: Shingler(n))


def prefix_size(n: int, threshold: Fraction) -> int:
    return n - -(-threshold.numerator * n // threshold.denominator) + 1 if n else 0


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents hold a shingle of each bucket, as 32-bit counts."""
    width = 1 << 14

    def run(batches):
        shingles, total = shingler(n), np.zeros(SKETCH, np.uint32)
        for b in slices(batches):
            found = np.concatenate([shingles(t) for t in b.column(0).to_pylist()] or [np.zeros(0, np.uint64)])
            total += np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
        for k in range(0, SKETCH, width):
            part = total[k : k + width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(width, np.uint32), 0
        for b in batches:
            for p in b.column(b.schema.get_field_index("part")):
                part = p.as_py()
            for x in b.column(b.schema.get_field_index("counts")):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    # A fixed number of parts, each summed in a task of its own.
    parts = docs.select("text").mapInArrow(run, "part long, counts binary").groupBy("part").applyInArrow(add, "part long, counts binary").collect()
    total = np.zeros(SKETCH, np.uint32)
    for r in parts:
        total[r.part : r.part + width] = np.frombuffer(r.counts, np.uint32)
    return total


def _prefixes(docs: DataFrame, n: int, threshold: Fraction, sketch) -> DataFrame:
    """doc_id, n_shingles, sig (of the whole set), prefix (hashes in order) and its own digest pkey."""

    def run(batches):
        shingles, often = shingler(n), sketch.value
        for b in slices(batches):
            count, sig, prefix, pkey = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t)
                count.append(len(s))
                sig.append(blake2b(s.tobytes(), digest_size=16).digest())
                k = prefix_size(len(s), threshold)
                order = np.lexsort((s, often[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))[:k]
                prefix.append(s[order].tobytes())
                pkey.append(blake2b(prefix[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(sig, pa.binary()), pa.array(prefix, pa.binary()), pa.array(pkey, pa.binary())], ["doc_id", "n_shingles", "sig", "prefix", "pkey"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, sig binary, prefix binary, pkey binary")


def _postings(groups: DataFrame, sketch, maybe: bool = False) -> DataFrame:
    """token, gid, n, pos, several for every hash of every group's prefix; several: the group has more members than one.

    ``maybe``: only of hashes that can be heavy, by the sketch.
    """

    def run(batches):
        often = sketch.value
        for b in slices(batches, 500):
            if not b.num_rows:
                continue
            parts = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(2)]
            sizes = np.array([len(p) for p in parts])
            token, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
            pos = np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])
            if maybe:
                at = np.flatnonzero(often[token & (SKETCH - 1)] > BLOCK)
                token, row, pos = token[at], row[at], pos[at]
            gid, n, several = (b.column(k).to_numpy(zero_copy_only=False)[row] for k in (0, 1, 3))
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(gid), pa.array(n), pa.array(pos), pa.array(several)], ["token", "gid", "n", "pos", "several"])

    return groups.select("gid", "n", "prefix", "several").mapInArrow(run, "token long, gid long, n long, pos int, several boolean")


def _passes(n1, p1, n2, p2, num: int, den: int):
    """Whether two groups, of different sets, with a shared hash at these positions can reach the threshold."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    # overlap * (num + den) >= num * (n1 + n2), with at most this overlap; different sets of one size differ somewhere
    most = np.minimum(np.minimum(n1 - p1, n2 - p2), small - (n1 == n2))
    return (small * den >= large * num) & (most * (num + den) >= num * (n1 + n2))


def _passing(n1, p1, n2, p2, num: int, den: int) -> Column:
    """The same of columns."""
    most = F.least(n1 - p1, n2 - p2, F.when(n1 == n2, n1 - 1).otherwise(F.least(n1, n2)))
    return (F.least(n1, n2) * den >= F.greatest(n1, n2) * num) & (most * (num + den) >= (n1 + n2) * num)


def _lists(batches, names):
    """Runs of rows of one key from sorted batches: (key, columns as arrays)."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        cut = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
            part = [c[a:z] for c in columns]
            if held and held[0] == part[0][0]:
                held[1].append(part)
            else:
                if held:
                    yield held[0], [np.concatenate(c) for c in zip(*held[1])]
                held = (part[0][0], [part])
    if held:
        yield held[0], [np.concatenate(c) for c in zip(*held[1])]


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_FIRST = pa.schema([("pair", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("pos", pa.int32())])
_FIRST_SQL = "pair boolean, a long, b long, n long, pos int"


def _pair_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_PAIR)


def _small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def _first_round(groups: DataFrame, sketch, threshold: Fraction, parts: int) -> DataFrame:
    """Rows of two kinds from the lists of each shared hash.

    Pairs (a: pivot, b: other) that pass: all of a short list, else each band's pivot, the group whose
    hash comes first, with the rest of its band. And the rows (a: token, b: gid, n, pos) of the longer
    lists, which the second round needs. Lists of one group leave nothing.
    """
    num, den = threshold.numerator, threshold.denominator
    heavy = write_table(_postings(groups, sketch, True).groupBy("token").count().where(F.col("count") > BLOCK).select(F.col("token").alias("t")))
    light = _postings(groups, sketch)
    if heavy.isEmpty():
        return _light(light, threshold, parts)
    held = _small(heavy, BROADCAST_HEAVY)
    light = light.join(held, F.col("token") == F.col("t"), "left_anti")
    # Sizes in bands no wider than the size filter; a heavy hash's groups meet the band's pivot where they are.
    long = write_table(_postings(groups, sketch, True).join(held, F.col("token") == F.col("t")).select("token", "gid", "n", "pos", F.floor(F.log("n") / math.log(den / num)).alias("band")))
    pivots = write_table(long.groupBy("token", "band").agg(F.min(F.struct("pos", "gid", "n")).alias("p")))
    met = long.join(_small(pivots, BROADCAST_HEAVY), ["token", "band"])
    passed = _passing(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"), num, den) & (F.col("gid") != F.col("p.gid"))
    pairs = met.where(passed).select(F.lit(True).alias("pair"), F.col("p.gid").alias("a"), F.col("gid").alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("pos"))
    rows = long.select(F.lit(False).alias("pair"), F.col("token").alias("a"), F.col("gid").alias("b"), "n", "pos")
    return _light(light, threshold, parts).unionByName(pairs).unionByName(rows)


def _light(postings: DataFrame, threshold: Fraction, parts: int) -> DataFrame:
    num, den = threshold.numerator, threshold.denominator

    def run(batches):
        pairs, rows, size = [], [], 0

        def batch():
            a = np.concatenate([x[0] for x in pairs] + [x[0] for x in rows])
            b = np.concatenate([x[1] for x in pairs] + [x[1] for x in rows])
            k = sum(len(x[0]) for x in pairs)
            n = np.concatenate([np.zeros(k, np.int64)] + [x[2] for x in rows])
            pos = np.concatenate([np.zeros(k, np.int32)] + [x[3] for x in rows])
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(a)) < k), pa.array(a), pa.array(b), pa.array(n), pa.array(pos)], schema=_FIRST)

        for _, (token, gid, n, pos, several) in _lists(batches, ["token", "gid", "n", "pos", "several"]):
            if len(gid) < 2:
                continue
            if len(gid) <= SHORT and not several.any():
                i, j = np.triu_indices(len(gid), 1)
            else:
                band = np.floor(np.log(n) / np.log(den / num)).astype(np.int64)
                order = np.lexsort((gid, pos, band))
                gid, n, pos, band = gid[order], n[order], pos[order], band[order]
                first = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
                i, j = np.repeat(first, np.diff([*first, len(gid)])), np.arange(len(gid))
                rows.append((token, gid, n, pos))
                size += len(gid)
            ok = (i != j) & _passes(n[i], pos[i], n[j], pos[j], num, den)
            if ok.any():
                pairs.append((gid[i[ok]], gid[j[ok]]))
                size += int(ok.sum())
            if size > 100_000:
                yield batch()
                pairs, rows, size = [], [], 0
        if size:
            yield batch()

    return postings.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(run, _FIRST_SQL)


def _cross_pairs(postings: DataFrame, threshold: Fraction, parts: int) -> DataFrame:
    """Pairs that pass in lists with several components; postings have ``root``, the component so far."""
    num, den = threshold.numerator, threshold.denominator
    # Sums of what tasks have read, before anything is dealt by the hash.
    by = postings.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"))
    mixed = by.groupBy("token").agg(F.sum("k").alias("long"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("k", "root")).alias("main")).where("roots > 1")
    rows = postings.join(mixed.select(F.col("token").alias("t"), "long", "main"), F.col("token") == F.col("t")).drop("t")
    # A long list is cut into blocks. Its visitors, the groups outside its largest component, go in
    # parts of a block's size to every block: each cell is a block and a part.
    whole = F.col("long") <= BLOCK
    blocks = F.when(whole, 1).otherwise(F.ceil(F.col("long") / F.lit(BLOCK))).cast("int")
    visits = F.when(whole, 1).otherwise(F.ceil((F.col("long") - F.col("main.k")) / F.lit(BLOCK))).cast("int")
    at = F.pmod(F.xxhash64("gid", "token"), blocks).cast("int")
    part = F.pmod(F.xxhash64("token", "gid"), visits).cast("int")
    stays = F.transform(F.sequence(F.lit(0), visits - 1), lambda j: F.struct(at.alias("i"), j.alias("j"), F.lit(False).alias("visitor")))
    comes = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(i.alias("i"), part.alias("j"), F.lit(True).alias("visitor")))
    cells = F.when(whole | (F.col("root") == F.col("main.root")), stays).otherwise(F.concat(stays, comes))
    rows = rows.select("token", "gid", "n", "pos", "root", whole.alias("whole"), F.inline(cells)).withColumn("cell", F.xxhash64("token", "i", "j"))

    def run(batches):
        found, size = [], 0
        for _, (_, token, gid, n, pos, root, whole, visitor) in _lists(batches, ["cell", "token", "gid", "n", "pos", "root", "whole", "visitor"]):
            order = np.lexsort((gid, n))
            gid, n, pos, root, visitor, token, whole = gid[order], n[order], pos[order], root[order], visitor[order], token[order], whole[order]
            low, last = np.searchsorted(n, -(-n * num // den), "left"), np.searchsorted(n, n * den // num, "right")
            for x in np.flatnonzero(visitor | whole).tolist():
                y = slice(x + 1 if whole[x] else int(low[x]), int(last[x]))
                ok = (root[y] != root[x]) & ~visitor[y] & (token[y] == token[x]) & _passes(n[x], pos[x], n[y], pos[y], num, den)
                if ok.any():
                    other = gid[y][ok]
                    found.append((np.full(len(other), gid[x]), other))
                    size += len(other)
            if size > 100_000:
                yield _pair_batch(found)
                found, size = [], 0
        yield _pair_batch(found)

    return rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def _verify(docs: DataFrame, pairs: DataFrame, n: int, threshold: Fraction, parts: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold.

    Each set is sent once for each pair in which it is b, with the pair's a, and made once for every
    PARTNERS of these; those of many partners are dealt out, and the set of a goes to every part of them.
    """
    num, den = threshold.numerator, threshold.denominator

    def shares(col: str) -> DataFrame:
        return pairs.groupBy(col).agg(F.ceil(F.count(F.lit(1)) / F.lit(PARTNERS)).cast("int").alias(f"k{col}"))

    counts = write_table(shares("a"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("ka")).cast("int").alias("salt"))
    # Who has many partners as b is listed in several rows.
    many = _small(write_table(shares("b").where("kb > 1").withColumnRenamed("b", "m")), BROADCAST_IDS)
    as_b = dealt.join(many, F.col("b") == F.col("m"), "left").select(F.col("b").alias("id"), F.coalesce(F.pmod(F.xxhash64("a"), F.col("kb")), F.lit(0)).cast("int").alias("row"), F.struct("a", "salt", F.lit(True).alias("partner")).alias("to"))
    salts = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("ka") - 1)).alias("salt"))
    as_a = salts.select(F.col("a").alias("id"), F.floor(F.col("salt") / PARTNERS).cast("int").alias("row"), F.struct("a", "salt", F.lit(False).alias("partner")).alias("to"))
    wanted = write_table(as_b.unionByName(as_a).groupBy("id", "row").agg(F.collect_list("to").alias("to")).select("id", "to"))
    right = F.broadcast(wanted) if pairs.count() <= BROADCAST_IDS else wanted
    texts = docs.join(right, docs["doc_id"] == wanted["id"]).select("id", "text", "to")
    kinds = {"a": pa.int64(), "salt": pa.int32(), "partner": pa.bool_(), "id": pa.int64(), "hashes": pa.binary()}

    def sets(batches):
        shingles = shingler(n)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) if rows else [[]] * 5, kinds.values())], list(kinds))

        for b in slices(batches, 200):
            rows, size = [], 0
            for i, t, to in zip(*[c.to_pylist() for c in b.columns]):
                raw = shingles(t).tobytes()
                for x in to:
                    rows.append((x["a"], x["salt"], x["partner"], i, raw))
                    size += len(raw)
                    if size > BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
            yield batch(rows)

    sent = texts.mapInArrow(sets, "a long, salt int, partner boolean, id long, hashes binary")

    def compare(batches):
        key, own = None, []
        for b in batches:
            found = []
            for a, salt, partner, i, h in zip(*[b.column(k).to_pylist() for k in range(4)], b.column(4)):
                h = np.frombuffer(h.as_buffer(), np.uint64)
                if (a, salt) != key:
                    key, own = (a, salt), []
                if not partner:  # they sort before the partners
                    own.append(h)
                    continue
                for x in own:
                    at = np.minimum(np.searchsorted(x, h), len(x) - 1)
                    both = int((x[at] == h).sum())
                    if den * both >= num * (len(x) + len(h) - both):
                        found.append((a, i))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], schema=_PAIR)

    return sent.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "partner").mapInArrow(compare, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component, by alternating stars over (a, b) links.

    Each step is an aggregation and a join on nodes, written to the shared folder; the number of
    steps grows with the logarithm of the longest chain.
    """
    edges = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # Every node's larger neighbours to its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write_table(large)
        # Every node's smaller neighbours, and itself, to the smallest.
        least = write_table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = write_table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _linked(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """doc_id, n_shingles, component_id of rows (doc_id, text) whose ids are unique and known."""
    spark: SparkSession = docs.sparkSession
    parts = partitions(spark)
    num, den = threshold.numerator, threshold.denominator
    sketch = spark.sparkContext.broadcast(_sketch(docs, n))
    every = write_table(_prefixes(docs, n, threshold, sketch))

    # 1: classes of equal sets; 3: groups of equal prefix and size.
    some = every.where("n_shingles > 0")
    classes = write_table(some.groupBy("n_shingles", "sig").agg(F.min("doc_id").alias("rep"), F.first("pkey").alias("pkey")))
    groups = write_table(classes.groupBy("n_shingles", "pkey").agg(F.min("rep").alias("gid"), (F.count(F.lit(1)) > 1).alias("several")))
    member = classes.join(groups.where("several"), ["n_shingles", "pkey"]).select("gid", "rep", F.col("n_shingles").alias("n"))
    member = write_table(member)
    size, first = F.col("n"), F.lit(0)

    # 4, first round: pairs of groups, expanded to their members.
    held = groups.select("gid", "several", F.col("n_shingles").alias("n"), F.col("pkey").alias("k"))
    prefixes = some.join(held, (F.col("doc_id") == F.col("gid")) & (F.col("pkey") == F.col("k"))).select("gid", "n", "prefix", "several")
    found = write_table(_first_round(write_table(prefixes), sketch, threshold, parts))
    pairs = found.where("pair").select("a", "b").distinct()
    partners = pairs.join(member.select(F.col("gid").alias("g"), "rep"), F.col("b") == F.col("g"), "left").select("a", F.coalesce("rep", "b").alias("b"))
    inside = member.where(_passing(size, first, size, first, num, den))
    tried = write_table(partners.unionByName(inside.select(F.col("gid").alias("a"), F.col("rep").alias("b"))).where("a <> b").distinct())
    links = write_table(_verify(docs, tried, n, threshold, parts))
    roots = connected(links)

    # 4, second round: everything in the longer lists, and in groups, that is not connected yet.
    lists = found.where("NOT pair").select(F.col("a").alias("token"), F.col("b").alias("g"), "n", "pos")
    lists = lists.join(member.select(F.col("gid").alias("m"), "rep"), F.col("g") == F.col("m"), "left").select("token", F.coalesce("rep", "g").alias("gid"), "n", "pos")
    # Members stand in the list of their group, at position 0.
    lists = lists.unionByName(inside.select(F.xxhash64("gid", F.lit("members")).alias("token"), F.col("rep").alias("gid"), "n", F.lit(0).cast("int").alias("pos")))
    placed = write_table(lists.join(roots, F.col("gid") == F.col("node"), "left").select("token", "gid", "n", "pos", F.coalesce("root", "gid").alias("root")))
    both = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = write_table(_cross_pairs(placed, threshold, parts).join(both, ["a", "b"], "left_anti"))
    more = write_table(_verify(docs, rest, n, threshold, parts))
    if not more.isEmpty():
        roots = connected(links.unionByName(more))

    ends = write_table(classes.select(F.col("n_shingles").alias("cn"), F.col("sig").alias("cs"), "rep").join(roots, F.col("rep") == F.col("node"), "left").select("cn", "cs", F.coalesce("root", "rep").alias("root")))
    joined = every.join(ends, (F.col("n_shingles") == F.col("cn")) & (F.col("sig") == F.col("cs")), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def _clear(docs: DataFrame, id_col: str) -> bool:
    """Whether every row has an id of its own."""
    return docs.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty()


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written, with a column that numbers its rows, and that column's name."""
    key = "_nj_key"
    while key in docs.columns:
        key += "_"
    return write_table(docs.withColumn(key, F.monotonically_increasing_id())), key


def components(docs: DataFrame, n: int, threshold: Fraction, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if _clear(docs, "doc_id"):
        return _linked(docs, n, threshold)
    # Ids that are missing or repeated name no row: rows are numbered, and components named at the end.
    rows, key = _numbered(docs)
    found = write_table(_linked(rows.select(F.col(key).alias("doc_id"), "text"), n, threshold)).withColumnRenamed("doc_id", "_row")
    found = found.join(rows.select(key, "doc_id"), F.col("_row") == F.col(key))
    least = found.groupBy(F.col("component_id").alias("_at")).agg(F.min("doc_id").alias("_least"))
    return found.join(least, F.col("component_id") == F.col("_at")).select("doc_id", "n_shingles", F.col("_least").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null last, then by a hash of the row). Other rows stay, whatever their ids."""
    clear = _clear(docs, id_col)
    rows, key = (docs, id_col) if clear else _numbered(docs)
    found = write_table(_linked(rows.select(F.col(key).cast("long").alias("doc_id"), F.col(text_col).alias("text")), n, threshold))
    if clear:
        gone = found.where("component_id <> doc_id")
    else:
        order = rows.select(F.col(key).alias("_nj_row"), F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*docs.columns), F.col(key)).alias("_nj_order"))
        best = found.join(order, F.col("doc_id") == F.col("_nj_row")).groupBy("component_id").agg(F.min_by("doc_id", "_nj_order").alias("_nj_best"))
        gone = found.join(best, "component_id").where("doc_id <> _nj_best")
    left = rows.join(write_table(gone.select(F.col("doc_id").alias("_nj_gone"))), F.col(key) == F.col("_nj_gone"), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir), 3, Fraction(9, 10))


def brute_force(rows: list[tuple[int | None, str | None]], n: int, threshold: Fraction) -> list[tuple[int | None, int, int | None]]:
    """The same from Python sets of word tuples and all pairs."""
    import re

    lower = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and threshold.denominator * both >= threshold.numerator * (len(sets[i]) + len(sets[j]) - both) and sets[j]:
                root[top(i)] = top(j)
    least: dict[int, int | None] = {}
    for i, (d, _) in enumerate(rows):
        own = least.get(top(i))
        least[top(i)] = d if own is None else own if d is None else min(d, own)
    return sorted(((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0))
