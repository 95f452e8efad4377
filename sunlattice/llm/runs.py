"""Periodic runs of words: Kolpakov and Kucherov's algorithm on the stretches of a text where a run can lie.

A run of period q and length >= max(24, 3q) is at least 2q + 8 words long, so each of its 8-word windows occurs twice in
it. Stretches of words covered by windows that occur twice in their text therefore hold every run whole; they are found
for all texts of an Arrow batch at once, by sorting window hashes (a hash shared by chance only lengthens a stretch).
Each stretch is then factorised (Lempel and Ziv's factors, from a suffix automaton), runs that touch the border of two
factors are found by Main's comparison of prefixes and suffixes, and runs strictly inside a factor are copied from the
factor's earlier occurrence. All steps are linear in the stretch.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from fractions import Fraction
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by contract: the shortest run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of a window that occurs twice in any run.
WINDOW = 8
#: Letters that no sequence holds: between two sequences that are compared, and after the last word.
BETWEEN, END = -1, -2
#: Bytes of text whose windows are sorted at once.
BATCH_BYTES = 4 << 20


class _Automaton:
    """Suffix automaton of a sequence of small integers.

    States 1..n are the prefixes and go on to the next one with the next letter; only other transitions are stored.
    """

    def __init__(self, s: list[int]) -> None:
        self.s, n = s, len(s)
        self.length, self.link, self.end = array("q", range(n + 1)), array("q", [-1]) * (n + 1), array("q", range(-1, n))
        self.more: dict[int, dict[int, int]] = {}
        for i in range(n):
            self._extend(i)

    def step(self, state: int, c: int) -> int:
        """The state after c, or -1."""
        if state < len(self.s) and self.s[state] == c and self.done > state:
            return state + 1
        out = self.more.get(state)
        return out.get(c, -1) if out else -1

    done = 0  # states up to this one have their next letter

    def _extend(self, i: int) -> None:
        c, new, p = self.s[i], i + 1, self.link[i]
        self.done = i + 1
        more, link, length, step = self.more, self.link, self.length, self.step
        while p >= 0 and (q := step(p, c)) < 0:
            more.setdefault(p, {})[c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        elif length[q] == length[p] + 1:
            link[new] = q
        else:
            twin = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            self.end.append(self.end[q])
            out = dict(more.get(q, {}))
            if q < len(self.s) and q <= i:
                out[self.s[q]] = q + 1
            more[twin] = out
            while p >= 0 and step(p, c) == q:
                more.setdefault(p, {})[c] = twin
                p = link[p]
            link[q] = link[new] = twin


def lz_factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, earlier start or -1): each factor is the longest prefix of the rest that starts earlier too, or a new letter."""
    automaton, found, b, n = _Automaton(s), [], 0, len(s)
    while b < n:
        state, at, source = 0, b, -1
        while at < n:
            after = automaton.step(state, s[at])
            if after < 0 or (start := automaton.end[after] - (at - b)) >= b:
                break
            state, at, source = after, at + 1, start
        found.append((b, max(at, b + 1), source))
        b = found[-1][1]
    return found


def _z(s: list[int]) -> list[int]:
    """For each place, how many letters from there on equal the first ones; the length of s at 0."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _touching(s: list[int], lo: int, b: int, e: int) -> Iterator[tuple[int, int, int]]:
    """(start, last, period) of the stretches of s[lo:e] that touch the border before b and have the length of a run."""
    u, v = s[lo:b], s[b:e]
    ahead = _z(v)  # of v and its own suffixes
    behind = _z([*u[::-1], BETWEEN, *v[::-1], *u[::-1]])  # suffixes of u and of what ends before each place
    forward = _z([*v, BETWEEN, *u, *v])
    nu, nv = len(u), len(v)
    for q in range(1, nv + 1):  # b and b + q
        suffix = behind[nu + 1 + nv - q] if nu else 0
        prefix = ahead[q] if q < nv else 0
        if q + suffix + prefix >= max(LEAST_WORDS, LEAST_PERIODS * q):
            yield b - suffix, b + q + prefix - 1, q
    for q in range(1, nu + 1):  # b - q and b
        suffix = behind[nu + 1 + nv + q] if q < nu else 0
        prefix = forward[nv + 1 + nu - q] if nv else 0
        if q + suffix + prefix >= max(LEAST_WORDS, LEAST_PERIODS * q):
            yield b - q - suffix, b + prefix - 1, q


def runs(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of s with at least LEAST_WORDS and LEAST_PERIODS periods, in order."""
    s = [*s, END]
    n, period, starts = len(s), {}, {}

    def add(x: int, y: int, q: int) -> None:
        if (x, y) not in period:
            starts.setdefault(x, []).append(y)
        period[x, y] = min(q, period.get((x, y), q))

    before = 0
    for b, e, source in lz_factors(s):
        lo = max(0, b - 2 * before - (e - b))
        for x, y, q in _touching(s, lo, b, e) if b and e - lo >= LEAST_WORDS else ():
            whole = (x > lo or lo == 0 or s[lo - 1] != s[lo - 1 + q]) and (y < e - 1 or e == n or s[e] != s[e - q])
            if whole:  # else it goes on beyond the window, and a later border finds it
                add(x, y, q)
        if source >= 0:
            shift = b - source
            for x in range(source + 1, e - shift - LEAST_WORDS):
                for y in starts.get(x, ()):
                    if y + shift < e - 1:
                        add(x + shift, y + shift, period[x, y])
        before = e - b
    return sorted(((x, y - x + 1, q) for (x, y), q in period.items()), key=lambda r: (r[0], r[2]))


def _stretches(ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the stretches of LEAST_WORDS words or more that windows found twice in their text cover."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return []
    odd = np.random.default_rng(12).integers(0, 1 << 63, WINDOW + 2, np.uint64) * np.uint64(2) + np.uint64(1)
    code = ids.astype(np.uint64) * odd[-1]
    code ^= code >> np.uint64(29)
    hashed = doc[:n].astype(np.uint64) * odd[-2]
    for k in range(WINDOW):
        hashed += code[k : k + n] * odd[k]
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    order = inside[np.argsort(hashed[inside], kind="stable")]
    equal = hashed[order][1:] == hashed[order][:-1]
    twice = np.zeros(n + 2, np.int8)
    twice[1:-1][order[1:][equal]] = 1
    twice[1:-1][order[:-1][equal]] = 1
    # windows that follow each other form a stretch; the windows of two texts never do, as those across their border are left out
    edge = np.flatnonzero(np.diff(twice))
    pairs = zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)
    return [(a, z + WINDOW - 1) for a, z in pairs if z + WINDOW - 1 - a >= LEAST_WORDS]


def rewritten(h: int, n: int) -> np.ndarray | None:
    """Places of the original words for the n words of a text of key h, if h asks for a rewriting."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


OUT = pa.schema(
    [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("collapsed_text", pa.string())]
)


def _judged(words: list[bytes], found: list[tuple[int, int, int]], with_text: bool) -> tuple:
    """The results of one text, in the order of OUT."""
    kept: list[bytes] = []
    at = 0
    for lo, hi in sorted((x + q, x + size) for x, size, q in found):
        kept += words[at:lo]
        at = max(at, hi)
    text = b" ".join([*kept, *words[at:]])
    listed = "".join(f"{x},{size},{q}\n" for x, size, q in found)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digests = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
    return (len(found), *top, *digests, text.decode() if with_text else None)


def _batch(texts: list[str | None], keys: list[int | None], with_text: bool) -> pa.Table:
    numbers: dict[bytes, int] = {}
    all_words, all_ids = [], []
    for text, h in zip(texts, keys, strict=True):
        words = text.encode().split() if text else []
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        if h is not None and (at := rewritten(h, len(words))) is not None:
            words, ids = [words[i] for i in at.tolist()], ids[at]
        all_words.append(words)
        all_ids.append(ids)
    sizes = np.array([len(x) for x in all_ids])
    base = np.concatenate([[0], np.cumsum(sizes)])
    ids, doc = np.concatenate(all_ids), np.repeat(np.arange(len(sizes)), sizes)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for lo, hi in _stretches(ids, doc):
        d = int(doc[lo])
        _, small = np.unique(ids[lo:hi], return_inverse=True)
        found.setdefault(d, []).extend((x + lo - int(base[d]), size, q) for x, size, q in runs(small.tolist()))
    rows = [_judged(words, found.get(d, []), with_text) for d, words in enumerate(all_words)]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)


def _cuts(sizes: list[int]) -> list[int]:
    """Borders of runs of rows of about BATCH_BYTES."""
    borders, total = [0], 0
    for i, size in enumerate(sizes):
        if total and total + size > BATCH_BYTES:
            borders.append(i)
            total = 0
        total += size
    return [*borders, len(sizes)]


def find_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rewrite: bool = False, with_text: bool = True) -> DataFrame:
    """`df` with n_runs, the run of the greatest exponent (start, length, period, exponent_milli; nulls without a run),
    runs_sha256, collapsed_sha256 and collapsed_text, the text with each run cut down to its first period. Without
    `with_text` the text and the collapsed text are left out.

    A word is what lies between spaces, tabs, newlines, vertical tabs, form feeds and carriage returns. Null and empty
    texts have no words, no runs, and an empty collapsed text. `rewrite` makes every tenth text periodic by the crc32 of
    its id (a rule to test with); texts with a null id stay as they are. Every row is judged alone, so repeated rows have
    equal results; columns of `df` named as the results are replaced, and an empty table gives an empty one.
    """
    held = df.drop(*OUT.names)
    others = [c for c in held.columns if c != text]
    h = F.crc32(F.col(doc_id).cast("string").cast("binary")) if rewrite else F.lit(None).cast("long")
    rows = held.select(F.struct(*others, F.lit(0).alias("_")).alias("row"), F.col(text).cast("string").alias("text"), h.alias("h"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("h")
            sizes = pc.binary_length(texts).fill_null(0).to_pylist()
            for lo, hi in pairwise(_cuts(sizes)):
                if hi > lo:
                    made = _batch(texts[lo:hi].to_pylist(), keys[lo:hi].to_pylist(), with_text)
                    source = {"row": batch.column("row")[lo:hi]} | ({"text": texts[lo:hi]} if with_text else {})
                    columns = [*source.values(), *[c.combine_chunks() for c in made.columns]]
                    yield pa.RecordBatch.from_arrays(columns, names=[*source, *OUT.names])

    kinds = [f"row {rows.schema['row'].dataType.simpleString()}", *["text string"] * with_text]
    kinds += [f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in OUT]
    out = rows.mapInArrow(judge, ", ".join(kinds))
    found = [c for c in OUT.names if with_text or c != "collapsed_text"]
    return out.select(*[F.col("text" if c == text else f"row.`{c}`").alias(c) for c in held.columns if with_text or c != text], *found)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_runs(docs, rewrite=True, with_text=False)
