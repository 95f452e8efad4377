"""Fuzzy line deduplication.

Lines are normalised (lower case, runs of anything but letters and digits become one space). Equal normalised lines are
one class. Longer lines get a 64-bit SimHash whose four blocks of 16 bits are the SimHashes of four parts of the line: its
first two and its last two runs of words of a common width. An edit changes the blocks of the parts it falls into, so by
the pigeonhole principle two lines that differ in two places or fewer agree in two blocks at least; classes meet in the
buckets of pairs of blocks and are confirmed by edit similarity. (A SimHash over all words of a line moves by about 10 of
64 bits when one word of twelve is replaced; blocks of such a hash, and a limit of 3 bits, found 1 to 18 % of the links
among lines of 8 to 20 words.) Of each connected group the first occurrence by (doc_id, line number) stays. Texts of lines
are shuffled only for pairs to confirm, those of documents only where a line goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.llm.hashes import short_hashes
from sunlattice.llm.links import linked_groups
from sunlattice.llm.scratch import cut, maybe_in, owner, reducer, remove, split_by
from sunlattice.llm.words import lines_of

MIN_SIMILARITY = 0.9
#: Lines of MIN_WORDS words or more are hashed by words; shorter ones of MIN_CHARS characters or more (such as lines
#: without spaces) by pairs of characters; what is shorter still takes part by equality only.
MIN_WORDS, MIN_CHARS = 8, 24
PARTS = 4
#: Lines are in bands by their number of words (or pairs); a band begins at this ratio to the one before.
BAND_RATIO = 1.6
#: Lines of at most so many characters that bounds don't settle are compared by Spark's own edit distance, longer ones in Arrow batches.
SHORT_CHARS = 2_000
TEXT_BYTES = 4_000_000
#: Bins in which pairs of characters of a line are counted before it is compared across groups.
PAIR_BINS = 128
_NOT_WORD = re.compile(r"[\W_]+")
#: The same for bytes: ASCII letters to lower case, digits and newlines stay, other ASCII becomes a space.
_TABLE = bytes(
    c if c > 127 or chr(c).isdigit() or c == 10 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256)
)
_ASCII_BYTES = bytes(range(128))
#: For each byte that starts a character, one of eight byte-wide counters; the bytes that continue one count nothing.
_SHAPE = np.array([0 if 0x80 <= c < 0xC0 else 1 << (8 * (c % 8)) for c in range(256)], np.uint64)
_STARTS = np.array([0 if 0x80 <= c < 0xC0 else 1 for c in range(256)], np.int64)
#: For each byte, its eight bits as eight byte-wide counters.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def normal_form(line: str) -> str:
    return _NOT_WORD.sub(" ", line.lower()).strip()


def _lower(text: bytes) -> bytes:
    """A text of which _TABLE leaves the normal forms of its lines, but for runs of spaces and spaces at their ends."""
    if text.isascii():
        return text
    lower = text.decode().lower()
    for c in set(lower.encode().translate(None, _ASCII_BYTES).decode()):
        if not c.isalnum():
            lower = lower.replace(c, " ")
    return lower.encode()


class NormalLines:
    """The lines of some texts that have a letter or digit, cut into words for all texts at once.

    row: the text of each line; number: its place there; begin: its first word; n: its number of words; flat, length: its
    normal form, one after the other. Words lie in `letters` without what parts them, up to `ends`.
    """

    def __init__(self, texts: list[bytes]):
        texts = list(map(_lower, texts))
        text = np.frombuffer(b"\n".join([b"", *texts, b""]).translate(_TABLE), np.uint8)
        breaks = text == 10
        apart = breaks | (text == 32)
        starts, ends = (np.flatnonzero(x) + 1 for x in (apart[:-1] & ~apart[1:], apart[1:] & ~apart[:-1]))
        line = np.searchsorted(np.flatnonzero(breaks), starts) - 1
        self.begin = np.flatnonzero(np.diff(line, prepend=-1))
        self.n = np.diff(self.begin, append=len(line))
        # of what parts words, one byte stays between two of a line
        last = self.begin + self.n - 1
        self.letters, self.ends = text[~apart], np.cumsum(ends - starts)
        apart[np.delete(ends, last)] = False
        self.flat = text[~apart]
        self.length = np.add.reduceat(ends - starts, self.begin) + self.n - 1 if len(line) else self.n
        per_text = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
        first = np.cumsum(per_text) - per_text
        self.row = np.repeat(np.arange(len(texts)), per_text)[line[self.begin]]
        self.number = line[self.begin] - first[self.row]

    def forms(self) -> list[bytes]:
        flat, ends = self.flat.tobytes(), np.cumsum(self.length)
        return [flat[a:b] for a, b in zip((ends - self.length).tolist(), ends.tolist(), strict=True)]

    def word_hashes(self, words: dict[bytes, int]) -> np.ndarray:
        """The hash of each word; `words` is asked for long ones."""
        found, left = short_hashes(self.letters, self.ends)
        for i, end, start in zip(left.tolist(), self.ends[left].tolist(), self.ends[left - 1].tolist(), strict=True):
            found[i] = words[self.letters[start if i else 0 : end].tobytes()]
        return found


def _pieces(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of given lengths cut into pieces of 255 (what a byte-wide counter holds): run, start, first piece of a run."""
    starts = np.cumsum(lengths) - lengths
    parts = -(-lengths // 255)
    run = np.repeat(np.arange(len(lengths)), parts)
    firsts = np.cumsum(parts) - parts
    return run, starts[run] + 255 * (np.arange(len(run)) - np.repeat(firsts, parts)), firsts


def shapes(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each form, of so many bytes: characters in each of eight classes, 255 at most, as one long; and its number of characters.

    One edit changes two of the counts by one at most, so forms whose counts differ by more than twice a distance in
    total are further apart than it.
    """
    _, starts, firsts = _pieces(lengths)
    counts = np.add.reduceat(_SHAPE[flat], starts).view(np.uint8).reshape(-1, 8)
    counts = np.add.reduceat(counts, firsts, axis=0, dtype=np.int64)
    packed = np.minimum(counts, 255).astype(np.uint8)
    return np.ascontiguousarray(packed).view(np.int64).ravel(), np.add.reduceat(_STARTS[flat], np.cumsum(lengths) - lengths)


def band_of(n: np.ndarray) -> np.ndarray:
    """The band of a line of n words (or pairs), MIN_WORDS or more; the first is 0."""
    return np.floor(np.log(n / MIN_WORDS) / log(BAND_RATIO) + 1e-9).astype(np.int64)


def part_width(band: np.ndarray) -> np.ndarray:
    """Words a part: a quarter of the band's least number, so that all lines of a band are parted alike."""
    return np.ceil(MIN_WORDS * BAND_RATIO**band - 1e-6).astype(np.int64) // PARTS


def simhashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, band: np.ndarray) -> np.ndarray:
    """The SimHash of each of some runs of token hashes: 16 bits for each of four parts as wide as the band has them."""
    width = part_width(band)
    begins = np.stack([starts, starts + width, ends - 2 * width, ends - width], 1)
    borders = np.stack([begins, begins + width[:, None]], 2).ravel()
    low = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.empty((len(starts) * PARTS, 16), np.int64)
    for k in range(2):
        lanes = np.append(_LANES[low[:, k]], np.uint64(0))
        counts[:, 8 * k : 8 * k + 8] = np.ascontiguousarray(np.add.reduceat(lanes, borders)[::2]).view(np.uint8).reshape(-1, 8)
    wide = np.flatnonzero(np.repeat(width > 255, PARTS))  # more than a byte-wide counter holds
    for i in wide.tolist():
        a, b = borders[2 * i], borders[2 * i + 1]
        counts[i] = np.unpackbits(low[a:b, :2], axis=1).sum(axis=0)
    bits = (2 * counts > np.repeat(width, PARTS)[:, None]).astype(np.uint8)
    return np.packbits(bits.reshape(len(starts), 64), axis=1).view(np.int64).ravel()


def pair_hashes(form: bytes) -> np.ndarray:
    """A 64-bit hash for each pair of neighbouring characters."""
    from sunlattice.llm.minhash import _mix

    codes = np.frombuffer(form.decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    return _mix(_mix(codes[:-1] << np.uint64(32) | codes[1:]) + np.uint64(1))


_LINES = (
    "doc_id long, text_hash long, line_no int, again boolean, line_hi long, line_lo long, simhash long, below long, "
    "band int, shape long, n_chars int"
)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """One row a line with a letter or digit, of documents with an id; again: an equal line is above it in its text.

    simhash and band are null for lines that take part by equality only; lines hashed by pairs have negative bands. A
    line of the least number of words of its band also has a SimHash by the band below, where it meets shorter ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from sunlattice.llm.minhash import Words

        words = Words()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(sizes) - sizes) // TEXT_BYTES
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
            for a, b in zip(edges, edges[1:], strict=False):
                found = NormalLines(pc.fill_null(batch.column(2).slice(a, b - a).cast(pa.binary()), b"").to_pylist())
                if not len(found.n):
                    continue
                forms = found.forms()
                digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, forms)), np.int64).reshape(-1, 2)
                order = np.lexsort((digest[:, 1], digest[:, 0], found.row))
                alike = (np.diff(digest[order], axis=0) == 0).all(axis=1) & (np.diff(found.row[order]) == 0)
                again = np.zeros(len(forms), bool)
                again[order[1:][alike]] = True
                shape, chars = shapes(found.flat, found.length)
                by_words = found.n >= MIN_WORDS
                by_pairs = np.flatnonzero(~by_words & (chars >= MIN_CHARS))
                pairs = [pair_hashes(forms[i]) for i in by_pairs.tolist()]
                tokens = np.where(by_words, found.n, 0)
                tokens[by_pairs] = chars[by_pairs] - 1
                fuzzy = tokens > 0
                similar, below = np.zeros(len(forms), np.int64), np.zeros(len(forms), np.int64)
                band, low = np.zeros(len(forms), np.int64), np.zeros(len(forms), bool)
                band[fuzzy] = band_of(tokens[fuzzy])
                low[fuzzy] = (band[fuzzy] > 0) & (band_of(np.maximum(tokens[fuzzy] - 1, MIN_WORDS)) < band[fuzzy])
                begin = found.begin.copy()
                begin[by_pairs] = np.cumsum(tokens[by_pairs]) - tokens[by_pairs]
                for flat, of in ((found.word_hashes(words), by_words), (np.concatenate([*pairs, np.zeros(0, np.uint64)]), fuzzy & ~by_words)):
                    for into, some, bands in ((similar, of, band), (below, of & low, band - 1)):
                        if some.any():
                            into[some] = simhashes(flat, begin[some], (begin + tokens)[some], bands[some])
                band = np.where(by_words, band, -1 - band)
                take = pa.array(found.row + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array(found.number.astype(np.int32)),
                        pa.array(again),
                        pa.array(np.ascontiguousarray(digest[:, 0])),
                        pa.array(np.ascontiguousarray(digest[:, 1])),
                        pa.array(similar, mask=~fuzzy),
                        pa.array(below, mask=~low),
                        pa.array(band.astype(np.int32), mask=~fuzzy),
                        pa.array(shape),
                        pa.array(chars.astype(np.int32)),
                    ],
                    names=["doc_id", "text_hash", "line_no", "again", "line_hi", "line_lo", "simhash", "below", "band", "shape", "n_chars"],
                )

    return _identified(docs).select("doc_id", "text_hash", "text").mapInArrow(run, _LINES)


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (together they are a document) and text of the rows that take part."""
    rows = docs.where("doc_id is not null and text is not null")
    return rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")


def _place() -> Column:
    """A line's place in the corpus, as a hash."""
    return F.xxhash64("doc_id", "text_hash", "line_no").alias("place")


def block_keys(simhash: Column, below: Column, band: Column) -> Column:
    """One long for each pair of blocks: the pair's number, the band, the bits of both blocks; none without a SimHash."""

    def keys(bits: Column, at: Column) -> Column:
        part = [F.shiftrightunsigned(bits, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(PARTS)]
        made = []
        for number, (i, j) in enumerate(combinations(range(PARTS), 2)):
            both = F.shiftleft(part[i], 16).bitwiseOR(part[j])
            place = F.shiftleft((F.pmod(at, F.lit(256)) + F.lit(256 * number)).cast("long"), 32)
            made.append(both.bitwiseOR(place))
        return F.array(*made)

    lower = F.when(band < 0, band + 1).otherwise(band - 1)
    none = F.array().cast("array<long>")
    own = F.when(simhash.isNotNull(), keys(simhash, band)).otherwise(none)
    return F.when(below.isNotNull(), F.concat(own, keys(below, lower))).otherwise(own)


def _most(a: Column, b: Column, similarity: float) -> Column:
    """The most edits between lines of so many characters."""
    return F.floor((1 - similarity) * F.greatest(a, b) + F.lit(1e-9)).cast("int")


def _close(similarity: float):
    def condition(a: str, b: str) -> Column:
        # a distance of d needs lengths that differ by d at most, and class counts that differ by 2 d at most in total
        most = _most(F.col(f"{a}n_chars"), F.col(f"{b}n_chars"), similarity)
        apart = F.lit(0)
        for i in range(8):
            counts = [F.shiftrightunsigned(F.col(f"{x}shape"), 8 * i).bitwiseAND(F.lit(255)) for x in (a, b)]
            apart = apart + F.abs(counts[0] - counts[1])
        return (F.abs(F.col(f"{a}n_chars") - F.col(f"{b}n_chars")) <= most) & (apart <= 2 * most)

    return condition


def _shared_start(a: str, b: str) -> int:
    """How many characters at the start are equal, by bisection over comparisons of slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def _differing(a: str, b: str) -> tuple[str, str]:
    """Both without what their ends have in common."""
    start = _shared_start(a, b)
    a, b = a[start:], b[start:]
    end = _shared_start(a[::-1], b[::-1])
    return a[: len(a) - end], b[: len(b) - end]


def _pair_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.bincount((codes[:-1] * np.uint32(37) + codes[1:]) % np.uint32(1024), minlength=1024)


def within(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance is at most `most`; exact distances only where simple bounds don't settle it.

    What is left between equal ends bounds it from above, and so does replacing word by word. It is bounded from below
    by the counts of pairs of neighbouring characters: an edit changes two pairs at most in either text.
    """
    near, a, b = _settled(a, b, most)
    return edit_distance(a, b, most) <= most if near is None else near


def _settled(a: str, b: str, most: int) -> tuple[bool | None, str, str]:
    """What bounds tell of the distance (null: nothing), and the texts without what their ends have in common."""
    if abs(len(a) - len(b)) > most:
        return False, a, b
    a, b = _differing(a, b)
    if max(len(a), len(b)) <= most:
        return True, a, b
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(v), len(w)) for v, w in zip(x, y, strict=True) if v != w) <= most:
        return True, a, b
    if np.abs(_pair_counts(a) - _pair_counts(b)).sum() > 4 * most:
        return False, a, b
    return None, a, b


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance by bit-parallel columns (Myers), after what the ends have in common; if it is above `most`, some
    number above that. A column lowers the distance by one at most."""
    a, b = _differing(a, b)
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    give_up = 2 * (len(a) + len(b)) if most is None else most + len(b)
    for column, c in enumerate(b):
        if score + column > give_up:
            return score + column - len(b)
        eq = where.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        score += bool(up & last) - bool(down & last)
        up = (up << 1 | 1) & full
        plus, minus = (down << 1 | ~(diagonal | up)) & full, up & diagonal
    return score


def _forms(docs: DataFrame, at: DataFrame) -> DataFrame:
    """(place, form): the normal forms of the lines at some (doc_id, place), and of others, which a join on place drops."""
    # most documents have none of these lines and are not split
    some = maybe_in(_identified(docs), "doc_id", at.select("doc_id"))
    split = some.select("doc_id", "text_hash", lines_of(F.col("text")).alias("lines"))
    # outer, though no text is without lines: else Spark asks of every text of the corpus first whether its split is empty
    lines = split.select("doc_id", "text_hash", F.posexplode_outer("lines").alias("line_no", "line")).select(_place(), "line")
    form = F.trim(F.regexp_replace(F.lower("line"), r"[^\p{L}\p{N}]+", " "))
    return maybe_in(lines, "place", at.select("place")).select("place", form.alias("form")).dropDuplicates(["place"])


def pair_bins(form: str) -> np.ndarray:
    """Counts of pairs of neighbouring characters in PAIR_BINS bins, 255 at most, eight to a long."""
    codes = np.frombuffer(form.encode("utf-32-le"), np.uint32)
    bins = (codes[:-1] * np.uint32(37) + codes[1:]) % np.uint32(PAIR_BINS)
    return np.minimum(np.bincount(bins, minlength=PAIR_BINS), 255).astype(np.uint8).view(np.int64)


def _bring(docs: DataFrame, classes: DataFrame):
    """For linked_groups: the lines that stand for some classes."""

    def bring(uids: DataFrame) -> DataFrame:
        own = maybe_in(classes.select("uid", "doc_id", "place"), "uid", uids)
        own = cut(own.join(uids, "uid"))
        return own.join(_forms(docs, own), "place").select("uid", "form")

    return bring


def _judge(similarity: float):
    """For linked_groups: edit distances of the lines of a tile, in which counts of pairs of characters come first."""

    def judge(table: pa.Table):
        forms = table["form"].to_pylist()
        sizes = np.fromiter(map(len, forms), np.int64, len(forms))
        bins = np.stack([pair_bins(form) for form in forms]).view(np.uint8).astype(np.int16) if len(forms) > 8 else None

        def may(i: int, others: np.ndarray) -> np.ndarray:
            most = np.floor((1 - similarity) * np.maximum(sizes[i], sizes[others]) + 1e-9)
            near = np.abs(sizes[others] - sizes[i]) <= most
            others, most = others[near], most[near]
            if bins is None or not len(others):
                return others
            # an edit takes two pairs away and adds two at most
            return others[np.abs(bins[others] - bins[i]).sum(axis=1) <= 4 * most]

        def linked(i: int, j: int) -> bool:
            return within(forms[i], forms[j], int((1 - similarity) * max(sizes[i], sizes[j]) + 1e-9))

        return may, linked

    return judge


def _confirm(docs: DataFrame, classes: DataFrame, similarity: float):
    """Links among pairs of classes, by the edit distance of their first lines, which are moved for pairs only."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, xs, ys, limits = [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_py(), y.as_py()
                longer = max(len(x), len(y))
                most = int((1 - similarity) * longer + 1e-9)
                near, x, y = _settled(x, y, most)
                if near is None and longer > SHORT_CHARS:
                    near = edit_distance(x, y, most) <= most
                keep.append(near is not False)
                if near is not False:  # null if it is settled
                    xs.append(None if near else x)
                    ys.append(None if near else y)
                    limits.append(most)
            ends = batch.select([0, 1]).filter(pa.array(keep, pa.bool_())).columns
            yield pa.RecordBatch.from_arrays([*ends, pa.array(xs, pa.string()), pa.array(ys, pa.string()), pa.array(limits, pa.int32())], names=["a", "b", "x", "y", "most"])

    def verify(pairs: DataFrame) -> DataFrame:
        own = maybe_in(classes.select("uid", "doc_id", "place"), "uid", pairs.select(F.explode(F.array("a", "b")).alias("uid")))

        def side(name: str) -> DataFrame:
            return own.select(F.col("uid").alias(name), F.col("place").alias(f"at_{name}"), F.col("doc_id").alias(f"doc_{name}"))

        placed = cut(pairs.join(side("a"), "a").join(side("b"), "b"))
        ends = placed.select(F.inline(F.array(*[F.struct(F.col(f"doc_{x}").alias("doc_id"), F.col(f"at_{x}").alias("place")) for x in "ab"])))
        lines = cut(_forms(docs, ends))

        def forms(name: str, to: str) -> DataFrame:
            return lines.select(F.col("place").alias(f"at_{name}"), F.col("form").alias(to))

        both = placed.join(forms("b", "y"), "at_b").join(forms("a", "x"), "at_a")
        open_pairs = both.select("a", "b", "x", "y").mapInArrow(settle, "a long, b long, x string, y string, most int")
        return open_pairs.where("x is null or levenshtein(x, y, most) >= 0").select("a", "b")

    return verify


def removed_lines(docs: DataFrame, similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, drop): the numbers of the lines (from 0) that repeat an earlier one, where there are any."""
    lines = cut(hashed_lines(docs))
    once = lines.where("not again").withColumn("place", _place())
    classes = once.groupBy("line_hi", "line_lo").agg(
        F.min("doc_id").alias("doc_id"),
        F.min_by("line_no", "doc_id").alias("line_no"),
        F.min_by("place", "doc_id").alias("place"),
        F.first("simhash").alias("simhash"),
        F.first("below").alias("below"),
        F.first("band").alias("band"),
        F.first("shape").alias("shape"),
        F.first("n_chars").alias("n_chars"),
        F.count("*").alias("n"),
    )
    classes = cut(classes.select(F.monotonically_increasing_id().alias("uid"), "*"))
    fuzzy = classes.where("simhash is not null")
    members = fuzzy.select("uid", block_keys(F.col("simhash"), F.col("below"), F.col("band")).alias("keys"), "shape", "n_chars")
    groups = linked_groups(members, _close(similarity), _confirm(docs, classes, similarity), _bring(docs, classes), _judge(similarity))

    own = maybe_in(classes.select(F.col("uid").alias("node"), "doc_id", "line_no"), "node", groups.select("node"))
    grouped = cut(groups.join(own, "node").select("node", "label", F.struct("doc_id", "line_no", "node").alias("own")))
    least = cut(grouped.groupBy("label").agg(F.min("own").alias("least")))
    gone = cut(grouped.join(least, "label").where("own <> least").select(F.col("node").alias("uid")))
    # of a class that goes no line stays, of one that occurs more than once its own line stays
    may_go, stays = split_by(classes.select("uid", "line_hi", "line_lo", "place", "n"), "uid", reducer(gone))
    marked = may_go.join(gone.withColumn("gone", F.lit(True)), "uid", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    every = marked.unionByName(stays.withColumn("gone", F.lit(False))).where("gone or n > 1")
    every = cut(every.select("line_hi", "line_lo", F.when(~F.col("gone"), F.col("place")).alias("stay")))
    some = maybe_in(once, "line_lo", every.select("line_lo")).join(every, ["line_hi", "line_lo"])
    some = some.where("stay is null or place <> stay").select("doc_id", "text_hash", "line_no")
    again = lines.where("again").select("doc_id", "text_hash", "line_no")
    return some.unionByName(again).groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("drop"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """`docs` with repeated lines removed from the text, and n_lines and n_removed (long).

    Lines without a letter or digit never take part. Rows with equal doc_id and text are one document: a line kept in one
    of them is kept in all. Of rows that share a doc_id but not the text, a line that they have in common stays in one.
    Rows with a null doc_id or null text pass unchanged; null text has no lines. A document may end up with an empty text.
    An empty table gives an empty one; other columns pass through, and columns named n_lines or n_removed are replaced.
    """
    with owner() as tables:
        drops = cut(removed_lines(docs, **options).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("drop").alias("_drop")))
        remove(docs.sparkSession, tables, (drops,))
        known = reducer(drops.select(F.xxhash64("_id", "_hash").alias("_doc")))
    base = docs.drop("n_lines", "n_removed").withColumn("n_lines", _line_count(F.col("text")))
    own = {"_own": F.col("doc_id").cast("long"), "_text": F.xxhash64("text")}
    base = base.withColumns(own).withColumn("_doc", F.xxhash64("_own", "_text"))
    touched, untouched = split_by(base, "_doc", known)
    same = untouched.withColumn("n_removed", F.lit(0).cast("long")).drop("_own", "_text", "_doc")
    left = F.transform(F.array(lines_of(F.col("text"))), _without)[0]
    # merged at every size: the lists grow with the corpus and are never broadcast
    changed = (
        touched.join(drops.hint("merge"), (F.col("_own") == F.col("_id")) & (F.col("_text") == F.col("_hash")), "left")
        .withColumn("n_removed", F.coalesce(F.size("_drop"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("_drop").isNull() | F.col("text").isNull(), F.col("text")).otherwise(left))
    )
    return same.unionByName(changed.select(same.columns))


def _line_count(text: Column) -> Column:
    """The number of lines, without making an array of them; null has none."""
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.coalesce(breaks + 1, F.lit(0)).cast("long")


def _without(lines: Column) -> Column:
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_drop")
    return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
