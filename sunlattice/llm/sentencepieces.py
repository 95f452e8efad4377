"""SentencePiece encoding and decoding as relations.

Texts are cut into units that no piece of the model spans, so that units can be encoded apart: in front of each run of
spaces and, if the model's pieces allow it, between ASCII letters and other ASCII characters. Texts are cut, counted and
looked up as whole Arrow columns. Distinct units are encoded once each: their substrings of bounded
length are exploded, joined to the piece table on equality, grouped by unit into a lattice of edges, and a higher-order
aggregate folds the lattice into ids. Occurrences are then joined to the table of units: short units that make up one in
FREQUENT of all occurrences or more, KEPT of them at most, are broadcast and looked up as arrays, so no frequent unit is
shuffled; the rest goes through a shuffle join.

Folds. For unigram models the fold is Viterbi over edge scores. The models whose pieces have merge ranks as scores
(byte-pair models) are not encoded by the best sum of scores: on the test corpus Viterbi gives other ids than the
library for 59 % of distinct words. For these the fold replays the merges on the same lattice: edges in the order of
rank, start and length; the state is a long whose bits are the borders between symbols, and an edge that spans exactly
two symbols removes the border between them. One pass in that order is the library's encoding if no merge enables
another that comes before it. What can be merged inside a piece doesn't depend on its surroundings, so this is decided
for each piece by encoding it alone; units that hold a piece for which it isn't so (runs of spaces, in the model at
hand) are folded by looking for the best edge anew after each merge.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.llm.scratch import cut, discard
from sunlattice.llm.words import bound

MARK = "▁"
#: Units that make up at least this part of all occurrences and are of at most so many characters are broadcast, and no
#: more than KEPT of them (below 30 MB with their ids).
FREQUENT, FREQUENT_CHARS, KEPT = 1 << 22, 32, 1 << 18
#: Bytes of text that a Python worker takes at once.
TEXT_BYTES = 4_000_000
#: The class of each byte of a text: part of a character beyond ASCII, ASCII letter, other ASCII character, space.
_CLASS = np.array([3 if b == 32 else 0 if b > 127 else 1 if chr(b).isalpha() else 2 for b in range(256)], np.uint8)
#: Whether a text is cut between bytes of two classes (4 * first + second): before spaces, or by the finer rule also
#: between ASCII letters and other ASCII characters.
_COARSE = np.array([b == 3 and a != 3 for a in range(4) for b in range(4)])
_FINE = _COARSE | np.array([(a, b) in ((1, 2), (2, 1)) for a in range(4) for b in range(4)])
#: Longer units are merged apart: the borders of a unit have to fit the bits of a long.
LONG_WORD = 60
#: Units a task: some 25 edges each, which are grouped in memory then.
WORDS_A_TASK = 20_000
#: An edge is a long: rank, start from 0, length, id; these are the widths of the last three.
_START, _LENGTH, _ID = 6, 6, 20
#: Set in an edge whose piece one pass in the order of ranks may miss.
_ODD = 1 << 62


class Model:
    """The piece table of a SentencePiece model file."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        size = library.get_piece_size()
        self.bytes = {}
        self.pieces = []
        for i in range(size):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.pieces.append((piece, i, library.get_score(i)))
        #: The score of a character without a piece.
        self.unknown = min(s for _, _, s in self.pieces if s > -1e6) - 10.0
        #: Pieces that a unit of LONG_WORD characters can hold; only these are edges.
        self.longest = min(LONG_WORD, max(len(p) for p, _, _ in self.pieces))
        if any(MARK in p.lstrip(MARK) for p, _, _ in self.pieces):
            raise ValueError("a piece spans the start of a word")
        if size > 1 << _ID or len({s for _, _, s in self.pieces}) >= 1 << (62 - _START - _LENGTH - _ID):
            raise ValueError("the model has more pieces than an edge can number")
        uncut = _units(pa.array([p.lstrip(MARK) for p, _, _ in self.pieces]), _FINE)[1] < 2
        #: Where texts are cut.
        self.cuts = _FINE if uncut.all() else _COARSE

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score, edge); its size is the model's vocabulary, and so broadcast.

        The empty piece stands for a word's own row in the lattice, so that a word without pieces has one. Characters of
        one byte that have no piece (such as newlines) are rows with the id of their byte.
        """
        order = {score: rank for rank, score in enumerate(sorted({-s for _, _, s in self.pieces}))}
        merges = Merges(self)
        shift = _START + _LENGTH + _ID
        rows = [("", 0, 0.0, 0)]
        for piece, i, score in self.pieces:
            if len(piece) > LONG_WORD:
                continue
            edge = (order[-score] << shift) + (len(piece) << _ID) + i
            rows.append((piece, i, score, edge if merges.in_order(piece) else edge + _ODD))
        known = {piece for piece, _, _ in self.pieces}
        single = {chr(b): i for b, i in self.bytes.items() if b < 128 and chr(b) not in known}
        rows += [(c, i, self.unknown, (1 << _ID) + i) for c, i in single.items()]
        return spark.createDataFrame(rows, "piece string, id int, score double, edge long")

    def byte_ids(self) -> Column:
        return F.array(*[F.lit(self.bytes[b]) for b in range(256)])

    def spelled(self) -> Column:
        """The UTF-8 bytes of every id in hexadecimal, as one constant array; its size is the vocabulary's."""
        texts = {i: p.encode().hex() for p, i, _ in self.pieces} | {i: f"{b:02x}" for b, i in self.bytes.items()}
        return F.split(F.lit(",".join(texts.get(i, "") for i in range(max(texts) + 1))), ",")


def _units(texts: pa.Array, cuts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The units of some texts in order, with a space in front of each text that isn't empty; units a text."""
    texts = pc.fill_null(texts, "")
    some = pc.greater(pc.binary_length(texts), 0)
    spaced = pc.binary_join_element_wise("", texts.filter(some), " ").cast(pa.string())
    sizes = np.zeros(len(texts), np.int64)
    if not len(spaced):
        return pa.array([], pa.string()), sizes
    _, offsets, data = spaced.buffers()
    offsets = np.frombuffer(offsets, np.int32)[spaced.offset : spaced.offset + len(spaced) + 1]
    classes = _CLASS[np.frombuffer(data, np.uint8)[: offsets[-1]]]
    borders = np.zeros(len(classes), bool)
    borders[1:] = cuts[4 * classes[:-1] + classes[1:]]
    borders[offsets[:-1]] = True
    starts = np.flatnonzero(borders).astype(np.int32)
    ends = np.append(starts, np.int32(len(classes)))
    sizes[some.to_numpy(zero_copy_only=False)] = np.diff(np.searchsorted(ends, offsets))
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), data), sizes


def _spread(which: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For rows that stand for a run of places each, which of them: the places of row which[0], of which[1], .."""
    n = sizes[which]
    ends = np.cumsum(n)
    starts = np.cumsum(sizes) - sizes
    return np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about TEXT_BYTES of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // TEXT_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def count_units(docs: DataFrame, model: Model) -> DataFrame:
    """(word, n): the distinct units of all texts and how often they occur."""
    cuts = model.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 0):
                units = _units(part.column(0), cuts)[0].dictionary_encode()
                n = np.bincount(units.indices.to_numpy(), minlength=len(units.dictionary))
                yield pa.RecordBatch.from_arrays([units.dictionary, pa.array(n, pa.int64())], names=["word", "n"])

    found = docs.select("text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def lattice(words: DataFrame, model: Model, tasks: int | None = None) -> DataFrame:
    """`words` (distinct units, other columns pass) with all pieces that are substrings of the word.

    These are two arrays of equal order: edges (longs) and ways (score, start from 1, length n, id); what isn't used of
    them isn't gathered. Dealt by word once; the substrings stay where their word is.
    """
    length = F.length("word")
    others = [c for c in words.columns if c != "word"]
    dealt = words.select("word", F.struct(F.lit(0).alias("_"), *others).alias("others"))
    dealt = dealt.repartition(tasks, "word") if tasks else dealt.repartition("word")
    starts = dealt.select("*", F.explode(F.sequence(F.lit(1), length)).alias("start"))
    most = F.least(F.lit(model.longest), length - F.col("start") + 1)
    least = F.when(F.col("start") == 1, 0).otherwise(1)
    subs = starts.select("*", F.explode(F.sequence(least, most)).alias("n"))
    subs = subs.withColumn("piece", F.substring(F.col("word"), F.col("start"), F.col("n")))
    # joined on a long, which Spark looks up faster than a string; equal hashes are confirmed on the strings
    table = model.table(words.sparkSession).withColumnRenamed("piece", "own")
    same = (F.xxhash64("piece") == F.col("key")) & (F.col("n") == F.length("own")) & F.startswith("piece", "own")
    joined = subs.join(F.broadcast(table.withColumn("key", F.xxhash64("own"))), same)
    placed = F.col("edge") + F.shiftleft((F.col("start") - 1).cast("long"), _LENGTH + _ID)
    way = F.struct("start", "n", "score", "id")
    gathered = joined.groupBy("word").agg(
        F.first("others").alias("others"), F.collect_list(placed).alias("edges"), F.collect_list(way).alias("ways")
    )
    return gathered.select("word", *[f"others.{c}" for c in others], "edges", "ways")


def _shift(direction: str, value: Column, by: Column) -> Column:
    return F.call_function(f"shift{direction}", value, by.cast("int"))


def _start(edge: Column) -> Column:
    return F.shiftright(edge, _LENGTH + _ID).bitwiseAND(F.lit((1 << _START) - 1))


def _length(edge: Column) -> Column:
    return F.shiftright(edge, _ID).bitwiseAND(F.lit((1 << _LENGTH) - 1))


def _borders_in(borders: Column, edge: Column) -> Column:
    """The bits of `borders` from the edge's start to its end, the start's as the lowest."""
    mask = _shift("left", F.lit(2).cast("long"), _length(edge)) - 1
    return _shift("right", borders, _start(edge)).bitwiseAND(mask)


def _ends(edge: Column) -> Column:
    return _shift("left", F.lit(1).cast("long"), _length(edge)) + 1


def _one_pass(word: Column, edges: Column) -> Column:
    """The borders of a word's symbols after all merges, as bits; `edges` are longs in order."""

    def step(borders: Column, edge: Column) -> Column:
        inside, ends = _borders_in(borders, edge), _ends(edge)
        two = (F.bit_count(inside) == 3) & (inside.bitwiseAND(ends) == ends)
        return F.when(two, borders - _shift("left", inside - ends, _start(edge))).otherwise(borders)

    every = _shift("left", F.lit(2).cast("long"), F.length(word)) - 1
    return F.aggregate(F.filter(edges, lambda e: _length(e) > 1), every, step)


def _best_first(word: Column, edges: Column) -> Column:
    """The same as `_one_pass`, for any edges: the first one that spans two symbols is looked for anew in each step."""

    def step(borders: Column, _: Column) -> Column:
        def two(edge: Column) -> Column:
            inside, ends = _borders_in(borders, edge), _ends(edge)
            return (F.bit_count(inside) == 3) & (inside.bitwiseAND(ends) == ends)

        def applied(edge: Column) -> Column:
            inside, ends = _borders_in(borders, edge), _ends(edge)
            return F.when(edge.isNull(), borders).otherwise(borders - _shift("left", inside - ends, _start(edge)))

        return bound(F.get(F.filter(edges, two), F.lit(0)), applied)

    every = _shift("left", F.lit(2).cast("long"), F.length(word)) - 1
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), every, step)


def _merged(word: Column, edges: Column, byte_ids: Column) -> Column:
    """Ids after all merges. The edges that are symbols, in the order of starts; if they leave characters, with bytes."""

    def folded(own: Column) -> Column:
        # an edge with the mark for a second look is above all others
        odd = F.get(own, F.size(own) - 1) >= _ODD
        plain = F.sort_array(F.transform(own, lambda e: e.bitwiseAND(F.lit(_ODD - 1))))
        return F.when(odd, bound(plain, lambda p: _best_first(word, p))).otherwise(_one_pass(word, own))

    def spelled(borders: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.length(word)), lambda i: F.getbit(borders, i) == 1)
        ways = F.transform(
            edges,
            lambda e: F.struct(
                (_start(e) + 1).alias("start"), _length(e).alias("n"), e.bitwiseAND(F.lit((1 << _ID) - 1)).cast("int").alias("id")
            ),
        )
        return bound(ways, lambda w: _ids(word, w, F.transform(starts, lambda i: i + 1), byte_ids))

    def ids(own: Column, borders: Column) -> Column:
        low = F.lit((1 << (_START + _LENGTH + _ID)) - 1)
        symbols = F.filter(own, lambda e: (_length(e) > 0) & (_borders_in(borders, e) == _ends(e)))

        def chosen(found: Column) -> Column:
            those = F.transform(
                F.sort_array(F.transform(found, lambda e: e.bitwiseAND(low))),
                lambda e: e.bitwiseAND(F.lit((1 << _ID) - 1)).cast("int"),
            )
            return F.when(F.size(found) == F.bit_count(borders) - 1, those).otherwise(spelled(borders))

        return bound(symbols, chosen)

    return bound(F.sort_array(edges), lambda own: bound(folded(own), lambda borders: ids(own, borders)))


def _viterbi(word: Column, edges: Column, unknown: float) -> Column:
    """Symbol starts, closed by the end, of the path with the best sum of scores.

    The state holds, for each position reached so far, the best score and where its last edge starts; a character
    without a piece is an edge of the score `unknown`.
    """
    n = F.length(word)

    def step(best: Column, end: Column) -> Column:
        here = F.filter(edges, lambda e: e["start"] + e["n"] == end + 1)
        ways = F.transform(
            here, lambda e: F.struct((F.get(best, e["start"] - 1)["s"] + e["score"]).alias("s"), (-e["start"]).alias("from"))
        )
        other = F.struct((F.get(best, end - 1)["s"] + F.lit(unknown)).alias("s"), (-end).alias("from"))
        return F.concat(best, F.array(F.array_max(F.concat(ways, F.array(other)))))

    first = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("from")))
    ways = F.aggregate(F.sequence(F.lit(1), n), first, step)

    def back(w: Column) -> Column:
        def previous(path: Column, _: Column) -> Column:
            at = F.get(path, F.lit(0))
            return F.when(at <= 1, path).otherwise(F.concat(F.array(-F.get(w, at - 1)["from"]), path))

        return F.aggregate(F.sequence(F.lit(1), n), F.array(n + 1), previous)

    return bound(ways, back)


def _ids(word: Column, edges: Column, starts: Column, byte_ids: Column) -> Column:
    """Ids of the symbols between starts; a symbol without a piece is spelled in bytes."""

    def of(i: Column) -> Column:
        low, high = F.get(starts, i), F.get(starts, i + 1)
        hit = F.get(F.filter(edges, lambda e: (e["start"] == low) & (e["n"] == high - low)), F.lit(0))
        raw = F.hex(F.substring(word, low, high - low).cast("binary"))
        spelled = F.transform(
            F.sequence(F.lit(1), (F.length(raw) / 2).cast("int")),
            lambda b: F.get(byte_ids, F.conv(F.substring(raw, 2 * b - 1, F.lit(2)), 16, 10).cast("int")),
        )
        return F.when(hit.isNotNull(), F.array(hit["id"])).otherwise(spelled)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts) - 2), of))


def encode_words(words: DataFrame, model: Model, fold: str = "merges", tasks: int | None = None) -> DataFrame:
    """`words` (distinct units, other columns pass) with ids: lattice, fold, byte fallback. fold: "merges" or "viterbi".

    Merges are for words of LONG_WORD characters at most. tasks: into how many the words are dealt, if not the usual number.
    """
    built = lattice(words, model, tasks)
    word, byte_ids = F.col("word"), model.byte_ids()
    if fold == "merges":
        ids = _merged(word, F.col("edges"), byte_ids)
    else:
        ids = bound(_viterbi(word, F.col("ways"), model.unknown), lambda s: _ids(word, F.col("ways"), s, byte_ids))
    return built.withColumn("ids", ids).drop("edges", "ways")


class Merges:
    """Exact merges of single words, with a heap, for words too long for a fold and for checks of pieces."""

    def __init__(self, model: Model):
        self.ranks = {p: (-s, i) for p, i, s in model.pieces}
        self.of_byte = model.bytes

    def run(self, word: str) -> tuple[list[str], list[tuple[float, int, int]]]:
        """The symbols that are left, and the merges as (negative score, start, length) in the order they took place."""
        symbols, left, right = list(word), list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
        heap, done = [], []

        def offer(a: int) -> None:
            b = right[a]
            if b >= 0 and (rank := self.ranks.get(symbols[a] + symbols[b])):
                heapq.heappush(heap, (rank[0], a, b, symbols[a] + symbols[b]))

        for k in range(len(symbols) - 1):
            offer(k)
        while heap:
            score, a, b, piece = heapq.heappop(heap)
            if right[a] != b or symbols[a] + symbols[b] != piece or not symbols[a]:
                continue
            done.append((score, a, len(piece)))
            symbols[a], symbols[b], right[a] = piece, "", right[b]
            if right[b] >= 0:
                left[right[b]] = a
            right[b] = -2
            if left[a] >= 0:
                offer(left[a])
            offer(a)
        return [s for s in symbols if s], done

    def in_order(self, piece: str) -> bool:
        """Whether the merge that ends in the whole piece comes after all merges it needs, in the order of edges."""
        symbols, done = self.run(piece)
        return len(symbols) > 1 or len(done) < 2 or done[-1] > max(done[:-1])

    def encode(self, word: str) -> list[int]:
        out = []
        for s in self.run(word)[0]:
            if s in self.ranks:
                out.append(self.ranks[s][1])
            else:
                out += [self.of_byte[x] for x in s.encode()]
        return out


def word_table(docs: DataFrame, model: Model) -> DataFrame:
    """(word, n, ids, ids_hash, exact) for the distinct units of all texts, spaces and not marks in them: n occurrences;
    exact if the ids decode to the unit (not so if it holds the mark itself); ids_hash has 31 bits."""
    spark = docs.sparkSession
    counted = cut(count_units(docs, model))
    usual = (F.length("word") <= LONG_WORD) & ~F.contains("word", F.lit(MARK))
    marked = counted.where(usual).select(F.replace(F.col("word"), F.lit(" "), F.lit(MARK)).alias("word"), "n")
    short = encode_words(marked, model, tasks=-(-counted.count() // WORDS_A_TASK) or None)
    encoder = spark.sparkContext.broadcast(Merges(model))

    def other_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = encoder.value.encode
        for batch in batches:
            found = [encode_one(w.replace(" ", MARK)) for w in batch.column(0).to_pylist()]
            ids = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["word", "n", "ids"])

    others = counted.where(~usual).mapInArrow(other_ids, "word string, n long, ids array<int>")
    both = short.select(F.replace(F.col("word"), F.lit(MARK), F.lit(" ")).alias("word"), "n", "ids").unionByName(others)
    exact = F.col("word") == decoded(F.col("ids"), model)
    both = both.select("*", F.pmod(F.xxhash64("ids"), F.lit(1 << 31)).alias("ids_hash"), exact.alias("exact"))
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    usually = spark.conf.get(name)
    spark.conf.set(name, 4 * WORDS_A_TASK)  # the edges of a task's units are gathered in memory, without a sort
    try:
        table = cut(both)
    finally:
        spark.conf.set(name, usually)
    discard(counted)
    return table


def _least_kept(table: DataFrame) -> int:
    """The least number of occurrences of a unit that is broadcast: one in FREQUENT, and KEPT units or fewer have it."""
    total = table.agg(F.sum("n")).first()[0] or 0
    step = F.floor(F.log2("n") * 16).cast("int")
    short = table.where((F.length("word") <= FREQUENT_CHARS) & (F.col("n") * FREQUENT >= total))
    counts = short.groupBy(step.alias("step")).agg(F.count("*").alias("units"), F.min("n").alias("n"))
    least, held = (1 << 62), 0
    for row in counts.orderBy(F.desc("step")).collect():  # 16 rows for each power of two
        held += row["units"]
        if held > KEPT:
            break
        least = row["n"]
    return least


class _Known:
    """The frequent units (KEPT at most) as arrays."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        lists = rows["ids"].combine_chunks() if len(rows) else pa.array([], pa.list_(pa.int32()))
        self.words = rows["word"].combine_chunks().cast(pa.string()) if len(rows) else pa.array([], pa.string())
        self.ids = lists.flatten().to_numpy().astype(np.int32)
        self.sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.hashes = rows["ids_hash"].to_numpy().astype(np.int64)
        self.exact = rows["exact"].to_numpy().astype(bool)


_PART = "doc_id long, text_hash long, word_no int, n_words int, word string, ids array<int>, checksum long, exact boolean"


def _parts(docs: DataFrame, model: Model, known, rare: bool) -> DataFrame:
    """Runs of frequent units with their ids, or (rare) the other units without."""
    cuts = model.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            for part in _slices(batch, 2):
                flat, per_doc = _units(part.column(2), cuts)
                units = flat.dictionary_encode()
                place = pc.fill_null(pc.index_in(units.dictionary, table.words), -1).to_numpy()
                at = place[units.indices.to_numpy()]  # where each occurring unit is in the table
                pick = np.flatnonzero(at < 0 if rare else at >= 0)
                row = np.repeat(np.arange(len(per_doc), dtype=np.int32), per_doc)[pick]
                number = pick - (np.cumsum(per_doc) - per_doc)[row]
                if rare:
                    n, spelled = np.ones(len(pick), np.int32), flat.take(pa.array(pick))
                    ids, checksum, exact = (pa.nulls(len(pick), t) for t in (pa.list_(pa.int32()), pa.int64(), pa.bool_()))
                else:
                    at = at[pick]
                    new = np.ones(len(pick), bool)
                    new[1:] = (np.diff(pick) > 1) | (np.diff(row) > 0)
                    begin = np.flatnonzero(new)
                    ends = np.append(begin, len(pick))
                    n, spelled = np.diff(ends).astype(np.int32), pa.nulls(len(begin), pa.string())
                    pieces = np.concatenate([[0], np.cumsum(table.sizes[at])])
                    ids = pa.ListArray.from_arrays(pa.array(pieces[ends].astype(np.int32)), pa.array(table.ids[_spread(at, table.sizes)]))
                    sums = (table.hashes[at] * (2 * number + 1)) & ((1 << 31) - 1)
                    checksum = pa.array(np.add.reduceat(sums, begin) if len(begin) else np.zeros(0, np.int64))
                    exact = pa.array(np.logical_and.reduceat(table.exact[at], begin) if len(begin) else np.zeros(0, bool))
                    row, number = row[begin], number[begin]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(number.astype(np.int32)), pa.array(n), spelled, ids, checksum, exact],
                    names=["doc_id", "text_hash", "word_no", "n_words", "word", "ids", "checksum", "exact"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, _PART)


def encode(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The ids of all texts in parts: doc_id, text_hash, word_no, n_words, ids, checksum, exact.

    A part is a run of frequent units or one other unit: word_no is the number (from 0) of its first unit in the text and
    n_words how many it has. A text's ids are those of its parts in order. checksum is the sum, over the part's units, of
    31 bits of (2 * unit number + 1) * (hash of the unit's ids), so sums over a text don't depend on where parts end;
    exact says that the ids decode to the part's text (never so in a text that holds the mark itself).

    Null and empty texts have no rows; rows with a null doc_id are encoded too; rows that repeat a doc_id each have
    theirs, those of equal texts with the same text_hash; an empty table gives an empty one; other columns are dropped.
    """
    model = model or Model()
    spark = docs.sparkSession
    table = word_table(docs, model)
    often = (F.length("word") <= FREQUENT_CHARS) & (F.col("n") >= _least_kept(table))
    known = spark.sparkContext.broadcast(_Known(table.where(often).drop("n").toArrow()))  # KEPT rows at most
    checksum = F.pmod(F.col("ids_hash") * (2 * F.col("word_no") + 1), F.lit(1 << 31))
    others = _parts(docs, model, known, rare=True).select("doc_id", "text_hash", "word_no", "n_words", "word")
    others = others.join(table.where(~often).drop("n"), "word").withColumn("checksum", checksum)
    columns = ["doc_id", "text_hash", "word_no", "n_words", "ids", "checksum", "exact"]
    return _parts(docs, model, known, rare=False).select(columns).unionByName(others.select(columns))


def decoded(ids: Column, model: Model) -> Column:
    """The text of ids: the bytes of each piece in order, read as UTF-8, with spaces for marks."""
    spelled = model.spelled()
    text = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(spelled, i)), "")), "UTF-8")
    return F.replace(text, F.lit(MARK), F.lit(" "))


def decode(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """`rows` (with ids: array<int>) and `decoded`, the text of the ids; null ids give null, no ids an empty text."""
    return rows.withColumn("decoded", decoded(F.col("ids"), model or Model()))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: units, pieces, an order-sensitive checksum of its ids, and whether decoding gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sums = encode(docs).groupBy("doc_id", "text_hash").agg(
        F.sum((F.col("word_no") == 0).cast("long")).alias("rows"),
        F.sum(F.col("n_words").cast("long")).alias("n_words"),
        F.sum(F.size("ids").cast("long")).alias("n_pieces"),
        F.sum("checksum").alias("ids_checksum"),
        F.min("exact").alias("round_trip"),
    )
    # rows of equal doc_id and text were summed together; each of them has one part of number 0
    shared = [F.expr(f"{c} div rows").alias(c) for c in ("n_words", "n_pieces", "ids_checksum")]
    per_row = sums.select("doc_id", *shared, "round_trip", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_")).drop("_")
    none = docs.where(F.coalesce(F.length("text"), F.lit(0)) == 0)
    zeros = [F.lit(0).cast("long").alias(c) for c in ("n_words", "n_pieces", "ids_checksum")]
    return per_row.unionByName(none.select("doc_id", *zeros, F.lit(True).alias("round_trip")))
