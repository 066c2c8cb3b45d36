"""Language identification of multilingual documents by mixture inference.

Training counts hashed character 1- to 4-grams of each language over labelled documents and keeps,
for every bucket, the log-probability in each language. For a document, the proportions of a set of
languages maximise the mixture likelihood of its n-grams and are found by expectation-maximisation.
The set itself is grown from the best single language as long as another language raises the
log-likelihood by more than a penalty, which grows with the logarithm of the document's size.

Defined results: ``und`` with score 0 where the text is null or has no letter, and where nothing
was learned; ties go to the language that sorts first; whole texts are read, of any length;
repeated rows give repeated results; an empty table gives an empty result; other columns are
ignored. The training bound is ``TRAIN_DOCS`` documents a language, chosen by the hash of their id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, slices
from .workspace import kept

BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
#: Labelled documents of each language that training reads at most, about.
TRAIN_DOCS = 4000
SMOOTHING = 0.5
STEPS = 30
#: A further language must raise the log-likelihood by so many times the log of the n-gram count.
PENALTY = 12.0
#: Of an n-gram's likelihood, what is left for text in no learned language.
NOISE = 1e-3
UNDETERMINED = "und"
#: Log-likelihood of an n-gram under the document's mixture, over that under no language, below which a
#: document is in none of the learned languages. Measured on the quarter of sf0.1 with ids 1 modulo 4: 2.9 to 4.1 for
#: all but 2 of 2,500 documents (1.6 and 2.1, short ones that are mostly a key), 3.1 for four languages in equal
#: parts, 1.4 and less for markup names, 1.0 for random letters, below 0 for other scripts.
LEAST_GAIN = 1.5
#: Code points taken at once from a long text.
_SLICE = 1 << 18
_PRIMES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in the lower-cased letters and blanks of a text, and how often."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters(points)
    # Everything else becomes one blank between words, and blanks bound the text.
    points = np.where(letters, points, np.uint32(32))
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    points = np.concatenate((np.array([32], np.uint32), points[keep], np.array([32], np.uint32)))
    total: np.ndarray | None = None
    found = []
    for lo in range(0, len(points), _SLICE):
        part = points[lo : lo + _SLICE + ORDERS[-1] - 1]
        h = np.zeros(len(part), np.uint32)
        hashes = []
        for k in range(ORDERS[-1]):
            n = len(part) - k
            if n <= 0:
                break
            h = (h[:n] ^ part[k:]) * np.uint32(_PRIMES[k])
            h ^= h >> np.uint32(15)
            own = h[: min(n, _SLICE)]
            if k == 0:
                own = own[part[: len(own)] != 32]
            hashes.append(own & np.uint32(BUCKETS - 1))
        joined = np.concatenate(hashes)
        if len(points) > _SLICE:
            total = np.bincount(joined, minlength=BUCKETS) + (0 if total is None else total)
        else:
            found.append(joined)
    if total is not None:
        used = np.flatnonzero(total)
        return used, total[used].astype(np.float64)
    used, n = np.unique(found[0], return_counts=True)
    return used.astype(np.int64), n.astype(np.float64)


_known = np.zeros(0x110000, np.uint8)  # 1: a letter or mark, 2: neither


def _letters(points: np.ndarray) -> np.ndarray:
    kind = _known[points]
    if (kind == 0).any():
        for p in np.unique(points[kind == 0]).tolist():
            c = chr(p)
            _known[p] = 1 if c.isalpha() or 0x300 <= p <= 0x36F else 2
        kind = _known[points]
    return kind == 1


class Model:
    """Languages and P(bucket | language), of shape (BUCKETS, languages); ``noise`` is P(bucket) in no language."""

    def __init__(self, languages: list[str], probability: np.ndarray, noise: float = 1.0):
        self.languages, self.probability, self.noise = languages, probability, noise

    def parts(self) -> tuple:
        return self.languages, self.probability, self.noise

    def read(self, text: str | None) -> tuple[list[tuple[str, float]], float]:
        """The document's languages and their proportions, largest first, and the mean gain of an n-gram; ([], 0) if undetermined."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return [], 0.0
        used, n = ngram_counts(text)
        p = self.probability[used].astype(np.float64)
        chosen, weights = self._choose(p, n)
        gain = float(n @ np.log(p[:, chosen] @ weights / self.noise) / n.sum())
        order = sorted(range(len(chosen)), key=lambda i: (-weights[i], chosen[i]))
        return [(self.languages[chosen[i]], float(weights[i])) for i in order], gain

    def mixture(self, text: str | None) -> list[tuple[str, float]]:
        return self.read(text)[0]

    def explains(self, text: str | None, least_gain: float = LEAST_GAIN) -> bool:
        """Whether the learned languages together explain the text."""
        found, gain = self.read(text)
        return bool(found) and gain >= least_gain

    def _choose(self, p: np.ndarray, n: np.ndarray) -> tuple[list[int], np.ndarray]:
        single = n @ np.log(p)
        chosen = [int(np.argmax(single))]
        best, weights = float(single[chosen[0]]), np.ones(1)
        penalty = PENALTY * np.log(1 + n.sum())
        while len(chosen) < p.shape[1]:
            mix = p[:, chosen] @ weights
            # The slope at weight 0 bounds what a language can add; without one there is no gain.
            slope = n @ (p / mix[:, None]) - n.sum()
            slope[chosen] = -np.inf
            new = int(np.argmax(slope))
            if slope[new] <= penalty:
                break
            trial = [*chosen, new]
            w, likelihood = self._em(p[:, trial], n, np.append(weights * 0.8, 0.2))
            if likelihood - best <= penalty:
                break
            chosen, weights, best = trial, w, likelihood
        return chosen, weights

    @staticmethod
    def _em(p: np.ndarray, n: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
        total, before = n.sum(), -np.inf
        for _ in range(STEPS):
            mix = p @ weights
            likelihood = float(n @ np.log(mix))
            if likelihood - before < 1e-3:
                break
            before = likelihood
            weights = weights * ((n / mix) @ p) / total
        return weights, before


def training_rows(docs: DataFrame, id_col="doc_id") -> Column:
    """True for the documents that training may see."""
    return F.crc32(F.col(id_col).cast("string")) % 3 != 1


def train(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", most: int = TRAIN_DOCS) -> Model:
    """A model from the labelled training documents, at most about ``most`` of a language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(training_rows(docs, id_col), F.lit(True)))
    # A row a language; the share of each that is read follows from its count.
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0)))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, most / n))]), F.col(lang_col))
    drawn = (F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < share

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, 500):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                used, n = ngram_counts(text)
                if lang not in total:
                    total[lang] = np.zeros(BUCKETS)
                total[lang][used] += n
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(n[used].astype(np.int64))], ["lang", "bucket", "n"])

    sums = rows.where(drawn).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most BUCKETS rows a language, whatever the corpus.
    got = sums.toArrow()
    languages = sorted(counts)
    n = np.zeros((BUCKETS, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    n[got["bucket"].to_numpy(), np.array([place[x] for x in got["lang"].to_pylist()], np.int64)] = got["n"].to_numpy()
    seen = n.sum(axis=1) > 0
    p = (n + SMOOTHING) / (n.sum(axis=0) + SMOOTHING * max(1, seen.sum()))
    noise = 1.0 / max(1, seen.sum())
    p = (1 - NOISE) * p + NOISE * noise
    # Buckets that no training text had tell nothing.
    p[~seen] = noise
    return Model(languages, p.astype(np.float32), noise)


def identify(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lang_pred, score and mixture: the languages of every document with their proportions."""
    held = docs.sparkSession.sparkContext.broadcast(model.parts())
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        kept("languages", dict)
        m = Model(*held.value)
        for b in slices(batches, 500):
            found = [m.mixture(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0][0] if x else UNDETERMINED for x in found], pa.string()), pa.array([min(1.0, x[0][1]) if x else 0.0 for x in found], pa.float64()), pa.array([[{"lang": a, "share": s} for a, s in x] for x in found], kind)],
                ["doc_id", "lang_pred", "score", "mixture"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def keep_identified(docs: DataFrame, model: Model, text_col="text", least_gain: float = LEAST_GAIN) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the learned languages explain, however many of them it mixes.

    Texts without a letter go, and those in other scripts or in no language.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.parts())
    names = docs.columns

    def run(batches):
        kept("languages", dict)
        m = Model(*held.value)
        for b in slices(batches, 500):
            b = b.select(names)
            yield b.filter(pa.array([m.explains(t, least_gain) for t in b.column(names.index(text_col)).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = identify(docs, train(docs))
    return out.select("doc_id", (~F.coalesce(training_rows(out), F.lit(True))).alias("held_out"), "lang_pred", "score", F.to_json("mixture").alias("mixture"))
