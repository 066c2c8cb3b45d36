r"""Secret scans: fixed patterns, and strings in a sensitive context that nothing around explains.

Base spans come from three patterns. The method adds ``novel`` spans: candidates are all long runs of
key characters, with a digit and a letter, soon after a sensitive word, on its line or below, and
soon after a run already reported, so lists of keys and PEM bodies are followed to their end.
zstandard is primed with dictionaries of identifiers, common ones and those the corpus uses most
(``identifiers``), and with the text around the candidate, and the candidate's marginal compressed bytes are counted against those of a random string of its
length and alphabet. Names, paths and words repeat what the dictionary or the surroundings hold and
shrink; random keys do not, and those are reported, however long.

Spans are code points, end exclusive. Defined results: null and empty texts have no spans; whole
texts are scanned, of any length; repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored. A candidate that overlaps a base span adds nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate
from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Runs are matched whole, so a least length in the pattern drops just the shorter runs.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_CONTEXT = re.compile(r"passw|passphrase|pwd|secret|token|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|credential|bearer|authorization|_auth|client[\x20_-]?id", re.IGNORECASE | re.ASCII)
#: Code points, blanks aside, from the end of the word that holds the sensitive term in which a candidate must begin.
REACH = 48
_NEAR = re.compile(r"(?:\s*+\S){0,%d}+\s*+" % REACH)
_NAME = re.compile(r"[A-Za-z0-9_-]*+")
#: What hangs on a sensitive term and is the rest of a name: words and short numbers between ``_`` or ``-``.
_REST = re.compile(r"[_-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[_-]+|\Z))++")
#: Shortest candidate.
LEAST = 16
_RUN = re.compile(r"[A-Za-z0-9+/_=~-]{%d,}" % LEAST)
_PART = re.compile(r"[^=]{%d,}(?:=+\Z)?" % LEAST)
#: Share of the marginal compressed bytes of a random string, as long and of the same alphabet, from which a candidate counts as novel.
#: On sf0.01, names and paths of the corpus' own words with a number come to 0.87 at most, random keys of 16 to 128 to 0.95 at least.
NOVELTY = 0.9
#: Alphabets of keys, narrow to wide; a candidate has the first that holds it.
ALPHABETS = tuple(
    x + "=" for x in ("0123456789abcdef", "0123456789ABCDEF", ascii_uppercase + "234567", ascii_lowercase + "234567", digits + ascii_uppercase, digits + ascii_lowercase, digits + ascii_letters, digits + ascii_letters + "+/_~-")
)
#: Code points of surroundings on either side that prime the compressor.
AROUND = 400

#: Identifiers of the corpus that prime the compressor: the commonest, a bound on the dictionary alone.
LEARNED = 1000

IDENTIFIERS = (
    "password passwd secret token apikey api_key access_key private_key client_id client_secret credential credentials authorization "
    "bearer authenticate authentication username user_name account identifier config configuration settings environment variable "
    "process.env os.environ getenv string integer boolean default example sample placeholder changeme undefined null none true false "
    "public private protected static final const class function return import export from include require module package namespace "
    "http https www com org net localhost example.com index.html request response header content type application json text plain "
    "session cookie database connection server client service manager controller repository handler factory provider interface "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 0000000000000000 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX "
    "index html page main test name file path data code link user login profile image static assets version update _0001 _config1 "
    "aaaaaaaaaaaaaaaa ffffffffffffffff 1111111111111111 the and for that with this from have not are was were you your which their would there"
)


def _marginal(candidate: str, around: str, dictionary: str) -> int:
    """Bytes that the candidate adds to its surroundings, both primed with the dictionary and the surroundings.

    The surroundings come first in what is compressed, so that what a frame and its first matches cost
    is in both sizes, and a short candidate that repeats known words is seen to.
    """
    primed = zstandard.ZstdCompressionDict(f"{dictionary}\n{around}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)
    return len(packer.compress(f"{around}\n{candidate}".encode())) - len(packer.compress(f"{around}\n".encode()))


@lru_cache(4096)
def _random_size(n: int, alphabet: str, dictionary: str) -> float:
    """Marginal bytes of a random string of that length and alphabet, which nothing explains."""
    if n > 4096:
        return _random_size(4096, alphabet, dictionary) * n / 4096
    r, around = random.Random(n), dictionary[-AROUND:]
    return sum(_marginal("".join(r.choices(alphabet, k=n)), around, dictionary) for _ in range(4)) / 4


def novelty(candidate: str, around: str, dictionary: str = IDENTIFIERS) -> float:
    """Marginal compressed bytes against those of a random string of the same length and alphabet."""
    alphabet = next(x for x in ALPHABETS if set(candidate) <= set(x))
    return _marginal(candidate, around, dictionary) / _random_size(len(candidate), alphabet, dictionary)


def identifiers(docs: DataFrame, text_col="text", most: int = LEARNED) -> str:
    """The names and words of 4 to 40 letters or underscores that the texts hold most often, the commonest last.

    Names with digits are left out: a key that many copies repeat must not explain itself.
    """
    words = docs.select(F.explode(F.split(F.col(text_col), "[^A-Za-z_]+")).alias("word")).where(F.length("word").between(4, 40))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most).collect()
    return " ".join(r.word for r in reversed(top))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end), in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], least: float = NOVELTY, dictionary: str = IDENTIFIERS) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], bool] = {}
    starts = [x for x, _, _ in base]
    ends = list(accumulate((y for _, _, y in base), max))

    terms = [(m.end(), len(m.group())) for m in _CONTEXT.finditer(text)]
    term_ends = [e for e, _ in terms]

    def known(a, b):
        k = bisect_left(starts, b)
        return k > 0 and ends[k - 1] > a

    def new(a, b):
        """Whether any key of the run is reported, or held by a base span."""
        # ``name=key`` are runs of their own; ``=`` at the end pads.
        parts = [(a + p.start(), a + p.end()) for p in _PART.finditer(text[a:b])] or [(a, b)]
        yes = False
        for a, b in parts:
            if (a, b) not in found:
                word = text[a:b]
                mixed = any(map(str.isdigit, word)) and any(map(str.isalpha, word))
                k = bisect_left(term_ends, a)
                named = k < len(term_ends) and term_ends[k] == a and _REST.fullmatch(word)
                found[a, b] = mixed and not named and not known(a, b) and novelty(word, text[max(0, a - AROUND) : a] + "\n" + text[b : b + AROUND], dictionary) >= least
            yes |= found[a, b] or known(a, b)
        return yes

    def after_name(a, b):
        """Where the run begins once a name that ends in a sensitive term is taken off, if a key can follow it."""
        k = bisect_right(term_ends, a)
        e, size = terms[k] if k < len(terms) else (b, 0)
        name = text[a : min(e - size, a + LEAST)]
        return e if e + LEAST <= b and (len(name) < LEAST or not any(map(str.isdigit, text[a:e]))) else a

    # One pass: runs from ``at`` on are not yet tried, ``run`` is the next, ``name`` ends the last term's word, ``told`` the last run reported.
    at = name = told = 0
    run = _RUN.search(text)
    for e in term_ends:
        name = name if e <= name else _NAME.match(text, e).end()
        until = _NEAR.match(text, name).end()
        if told <= e < at:
            # Inside a run that was tried whole and not reported.
            own = _RUN.match(text, e)
            if own and after_name(*own.span()) == e and new(*own.span()):
                told = own.end()
                until = max(until, _NEAR.match(text, told).end())
        at = max(at, e)
        while run:
            run = run if run.start() >= at else _RUN.search(text, at)
            if not run or run.start() > until:
                break
            at = after_name(*run.span())
            if at > run.start():
                continue
            at = run.end()
            if new(*run.span()):
                told = at
                until = max(until, _NEAR.match(text, at).end())
    return [(a, 3, b) for (a, b), yes in found.items() if yes]


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, id_col="doc_id", text_col="text", least: float = NOVELTY, learned: str = "") -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end); base has the fixed patterns' only. ``learned``: more identifiers."""
    dictionary = f"{learned} {IDENTIFIERS}" if learned else IDENTIFIERS
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(spans):
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)]

    def run(batches):
        for b in batches:
            base, every = [], []
            for t in b.column(1).to_pylist():
                own = base_spans(t) if t else []
                base.append(rows(own))
                every.append(rows(own + novel_spans(t, own, least, dictionary)) if t else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(every, kind)], ["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scan(docs, learned=identifiers(docs))

    def text(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """n_assign, n_access, n_hex and base_sha256 with the patterns as they are stated."""
    text, spans = text or "", []
    for k, (pattern, flags, group, least) in enumerate([(_ASSIGN.pattern, re.I | re.A, 2, 6), ("AKIA[A-Z0-9]+", 0, 0, 20), ("[0-9a-f]+", 0, 0, 24)]):
        spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    n = [sum(k == j for _, k, _ in spans) for j in range(3)]
    return *n, hashlib.sha256(render(spans).encode()).hexdigest()
