"""Near-duplicate documents by b-bit MinHash.

Every document's word shingles are hashed to PERMUTATIONS minima. The first BANDS * ROWS of them, in bands, are bucket
keys; the low BITS bits of all of them are packed into bit planes, and for a pair of candidates the similarity is
estimated from counted differing positions, corrected for chance matches of b-bit values. Pairs that pass are confirmed
on their full sets of shingles. Documents with equal sets are one class from the start.

At a similarity of 0.8 a pair shares no band with a probability of (1 - 0.8^5)^30 = 7e-6 and is estimated below the
margin (four standard deviations) with 3e-5; both fall steeply above 0.8. Where a large group of near copies has
neighbours just below the threshold, bitmaps of hashed sets come before their texts are compared. A bit that only one of
two bitmaps has is at least one shingle that the other set lacks, so bitmaps bound the similarity from above and lose no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.llm.links import linked_groups
from sunlattice.llm.scratch import cut, maybe_in, owner, remove

PERMUTATIONS, ROWS, BANDS, BITS = 256, 5, 30, 4
#: Bits of the bitmaps of sets of documents in buckets that hold several groups, a power of two.
SET_BITS = 1 << 13
THRESHOLD_PERCENT = 80
#: Words that a Python worker keeps hashed, and bytes of text that it takes at once.
KEPT_WORDS, TEXT_BYTES = 500_000, 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """64-bit hashes of words, computed once."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, k: int, words: Words) -> np.ndarray:
    """The distinct k-word shingles of a text as sorted 64-bit hashes; with fewer words, all of them as one."""
    hashed = np.fromiter(map(words.__getitem__, (text or "").encode().lower().split()), dtype=np.uint64)
    if not len(hashed):
        return hashed
    width = min(k, len(hashed))
    out = _mix(hashed[: len(hashed) - width + 1] + np.uint64(width))
    for j in range(1, width):
        out = _mix(out * _ODD + hashed[j : len(hashed) - width + 1 + j])
    return np.unique(out)


class _Minima:
    """Minima of hashed shingles under fixed permutations, and their packed low bits."""

    def __init__(self, permutations: int):
        seeds = np.random.default_rng(20240229)
        self.flip = seeds.integers(0, 1 << 32, (permutations, 1), dtype=np.uint32)
        self.odd = seeds.integers(0, 1 << 32, (permutations, 1), dtype=np.uint32) | np.uint32(1)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        short, least = (shingles >> np.uint64(32)).astype(np.uint32), None
        step = max(1, (1 << 19) // len(self.flip))
        for at in range(0, len(short), step):  # a slice of a long text at a time
            now = ((short[at : at + step][None, :] ^ self.flip) * self.odd).min(axis=1)
            least = now if least is None else np.minimum(least, now)
        return least

    @staticmethod
    def planes(minima: np.ndarray) -> np.ndarray:
        low = minima ^ (minima >> np.uint32(15))
        low = low * np.uint32(0x2C1B3C6D)
        low ^= low >> np.uint32(12)
        bits = np.stack([(low >> np.uint32(p)) & np.uint32(1) for p in range(BITS)], axis=1).astype(np.uint8)
        return np.packbits(bits.reshape(len(minima), -1), axis=1).view(np.int64)


def set_bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit for each value of the leading bits of the hashes of a set."""
    bits = np.zeros(SET_BITS, np.uint8)
    bits[(shingles >> np.uint64(65 - SET_BITS.bit_length())).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _lists(x: np.ndarray, mask: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x[mask]).view(np.int64).ravel())
    ends = np.concatenate([[0], np.cumsum(mask * x.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), flat)


_SIGNED = "doc_id long, text_hash long, n_shingles long, set_hi long, set_lo long, keys array<long>, planes array<long>"


def signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """For each row: the size and a 128-bit digest of its shingle set, its band keys and bit planes (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words = Words()
        permuted = _Minima(PERMUTATIONS)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(sizes) - sizes) // TEXT_BYTES
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
            for a, b in zip(edges, edges[1:], strict=False):
                n, digests = np.zeros(b - a, np.int64), np.zeros((b - a, 2), np.int64)
                minima = np.zeros((b - a, PERMUTATIONS), np.uint32)
                for i, text in enumerate(batch.column(2).slice(a, b - a)):
                    found = shingle_set(text.as_py(), shingle_words, words)
                    n[i] = len(found)
                    if len(found):
                        digests[i] = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                        minima[i] = permuted.of(found)
                keys = np.zeros((b - a, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    keys = _mix(keys * _ODD + minima[:, r : ROWS * BANDS : ROWS].astype(np.uint64))
                planes = permuted.planes(minima)
                mask = n > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(n),
                        pa.array(np.ascontiguousarray(digests[:, 0])),
                        pa.array(np.ascontiguousarray(digests[:, 1])),
                        _lists(keys, mask),
                        _lists(planes, mask),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "set_hi", "set_lo", "keys", "planes"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, _SIGNED)


def _bring(docs: DataFrame, classes: DataFrame):
    """For linked_groups: the texts that stand for some classes."""

    def bring(uids: DataFrame) -> DataFrame:
        own = cut(maybe_in(classes.select("uid", "own.doc_id", "own.text_hash"), "uid", uids).join(uids, "uid"))
        bodies = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
        bodies = maybe_in(bodies, "doc_id", own.select("doc_id")).dropDuplicates(["doc_id", "text_hash"])
        return bodies.join(own, ["doc_id", "text_hash"]).select("uid", "text")

    return bring


def _judge(shingle_words: int, percent: int):
    """For linked_groups: similarities of the full sets of a tile, in which bitmaps of hashed sets come first."""

    def judge(table: pa.Table):
        texts, words = table["text"].to_pylist(), Words()
        sets = [shingle_set(text, shingle_words, words) for text in texts]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        bits = np.stack([set_bitmap(s) for s in sets]) if len(sets) > 8 else None
        filled = np.bitwise_count(bits).sum(axis=1, dtype=np.int64) if bits is not None else None

        def may(i: int, others: np.ndarray) -> np.ndarray:
            others = others[100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others])]
            if bits is None or not len(others):
                return others
            # shingles of one set less the bits that only it has
            both = np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
            most = np.minimum(n[i] - filled[i], n[others] - filled[others]) + both
            return others[(100 + percent) * most >= percent * (n[i] + n[others])]

        def linked(i: int, j: int) -> bool:
            # equal shingles have equal hashes, so hashed sets have at least as much in common
            if (100 + percent) * len(np.intersect1d(sets[i], sets[j], True)) < percent * (n[i] + n[j]):
                return False
            return _similar(_full_set(texts[i], shingle_words), _full_set(texts[j], shingle_words), percent)

        return may, linked

    return judge


def _full_set(text: str, shingle_words: int) -> set:
    w = text.encode().lower().split()
    return set(zip(*[w[i:] for i in range(shingle_words)], strict=False)) if len(w) >= shingle_words else {tuple(w)}


def _similar(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def most_differing(threshold: float, permutations: int = PERMUTATIONS, deviations: float = 4.0) -> int:
    """Differing b-bit positions that a pair at the threshold exceeds only beyond so many standard deviations."""
    chance = 1 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return int(permutations * (1 - p) + deviations * sqrt(permutations * p * (1 - p)))


def _close(percent: int):
    limit, longs = most_differing(percent / 100), PERMUTATIONS // 64

    def condition(a: str, b: str) -> Column:
        small, large = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
        differing = None
        for i in range(longs):
            planes = [F.get(f"{a}planes", F.lit(p * longs + i)).bitwiseXOR(F.get(f"{b}planes", F.lit(p * longs + i))) for p in range(BITS)]
            either = planes[0]
            for p in planes[1:]:
                either = either.bitwiseOR(p)
            differing = F.bit_count(either) if differing is None else differing + F.bit_count(either)
        return (100 * small >= percent * large) & (differing <= limit)

    return condition


def _confirm(docs: DataFrame, classes: DataFrame, shingle_words: int, percent: int):
    """Links among pairs of classes, by the full sets of their texts, which are moved for pairs only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, kept = [], None, set()
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, kept = a, _full_set(ta.as_py(), shingle_words)
                keep.append(_similar(kept, _full_set(tb.as_py(), shingle_words), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("uid")).distinct().unionByName(pairs.select(F.col("b").alias("uid")).distinct())
        own = maybe_in(classes.select("uid", "own"), "uid", ends)

        def side(name: str) -> DataFrame:
            return own.select(
                F.col("uid").alias(name), F.col("own.doc_id").alias(f"doc_{name}"), F.col("own.text_hash").alias(f"hash_{name}")
            )

        placed = cut(pairs.join(side("a"), "a").join(side("b"), "b"))
        bodies = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
        bodies = maybe_in(bodies, "doc_id", own.join(ends.distinct(), "uid").select("own.doc_id"))
        bodies = bodies.dropDuplicates(["doc_id", "text_hash"])

        def texts(name: str) -> DataFrame:
            return bodies.select(
                F.col("doc_id").alias(f"doc_{name}"), F.col("text_hash").alias(f"hash_{name}"), F.col("text").alias(f"t{name}")
            )

        joined = placed.join(texts("b"), ["doc_b", "hash_b"]).join(texts("a"), ["doc_a", "hash_a"])
        return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")

    return verify


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row a row of `docs`: doc_id, n_shingles, component_id, kept, text_hash.

    Links join documents whose shingle sets have a Jaccard similarity of percent / 100 or more; component_id is the
    smallest doc_id of the component. Documents without words are linked with nothing and stay. Repeated rows have equal
    results; rows that share a doc_id but not the text are judged by their texts. A row with a null doc_id has the
    component of rows with equal sets if these have ids, else null, and isn't kept. An empty table gives an empty one.
    """
    with owner() as tables:
        result = cut(_near_duplicates(docs, shingle_words, percent))
        remove(docs.sparkSession, tables, (result,))
    return result


def _near_duplicates(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    signed = cut(signatures(docs, shingle_words))
    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("set_hi", "set_lo").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("own"),
        F.first("n_shingles").alias("n"),
        F.first("keys").alias("keys"),
        F.first("planes").alias("planes"),
    )
    classes = cut(classes.select(F.monotonically_increasing_id().alias("uid"), "*"))
    members = classes.select("uid", "keys", "n", "planes")
    groups = linked_groups(members, _close(percent), _confirm(docs, classes, shingle_words, percent), _bring(docs, classes), _judge(shingle_words, percent))
    own = classes.select(F.col("uid").alias("node"), F.col("own.doc_id").alias("first"))
    named_groups = groups.join(own, "node")
    least = cut(named_groups.groupBy("label").agg(F.min("first").alias("component_id")))
    component = named_groups.join(least, "label").select(F.col("node").alias("uid"), "component_id")
    of_class = (
        classes.select("uid", "set_hi", "set_lo", "own.doc_id")
        .join(component, "uid", "left")
        .select("set_hi", "set_lo", F.coalesce("component_id", "doc_id").alias("component_id"))
    )
    result = signed.select("doc_id", "text_hash", "n_shingles", "set_hi", "set_lo").join(
        cut(of_class), ["set_hi", "set_lo"], "left"
    )
    component_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component_id, F.lit(False)).alias("kept")
    return result.select("doc_id", "n_shingles", component_id.alias("component_id"), kept, "text_hash")


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w]
                                 ELSE list_transform(range(1, len(w)), lambda i: w[i:i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS c FROM s GROUP BY g HAVING c > 1),
r AS MATERIALIZED (SELECT doc_id, s.g, row_number() OVER (PARTITION BY doc_id ORDER BY f.c, s.g) AS k FROM s JOIN f ON s.g = f.g),
c AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b
  FROM r a JOIN n na ON na.doc_id = a.doc_id JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE a.k <= na.n - ceil(na.n * 8 / 10) + 1 AND b.k <= nb.n - ceil(nb.n * 8 / 10) + 1
    AND 10 * least(na.n, nb.n) >= 8 * greatest(na.n, nb.n)),
e AS MATERIALIZED (
  SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND x.g = y.g
  JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b
  GROUP BY c.a, c.b, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t(a, b) AS (SELECT a, b FROM u UNION SELECT t.a, u.b FROM t JOIN u ON t.b = u.a),
m AS (SELECT a, min(b) AS b FROM t GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m.b, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""
