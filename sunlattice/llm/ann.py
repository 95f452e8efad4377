"""Approximate nearest neighbours: inverted file, product-quantised residuals, asymmetric distances, exact reranking.

Equal vectors are one item of the index (with the k + 1 smallest ids, more can't be among the k nearest), so a vector
that many rows share takes one place in candidate lists. Coarse centroids and codebooks are fitted on TRAIN items chosen
by hash; every item is indexed. The index works on vectors that are moved by the median of those items and scaled by a
power of two to the size of their median, so that its results don't depend on where and how large vectors are. How many lists are probed and how many items reranked is measured on the table: the exact
neighbours of SAMPLE queries chosen by hash are found by brute force, and the numbers are the least (PROBES and RERANK at
least) that find a share of TARGET of them; of equally distant items the smaller ids count, and items that the codes don't
tell apart from a neighbour count as before it. A query probes its nearest lists until they are so many and hold as many items
as are reranked. Lists and the queries that probe them are dealt out in blocks, so a list with a third of all items is
searched by many tasks, and each task returns the best items of each query by asymmetric distance, as many as are reranked
and none beyond what the fitted items show to be too far. Those are reranked on original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunlattice.llm.scratch import cut

#: Lists, codebooks a vector, codes a codebook, fitted items and rounds.
LISTS, PARTS, CODES, TRAIN, ROUNDS = 128, 16, 256, 16_384, 8
PROBES, RERANK = 32, 200
#: Queries by which probes and reranked items are chosen, and the share of their neighbours to be found.
SAMPLE, TARGET = 256, 0.99
#: Items and queries of one search task.
ITEM_BLOCK, QUERY_BLOCK = 8_192, 1_024


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


class Model:
    """Coarse centroids and, for each part of a residual, a codebook. All but `inner` take vectors that `inner` gave."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        middle = np.median(sample, axis=0)
        with np.errstate(over="ignore"):
            size = np.median(np.abs(sample - middle).max(1))
        self.scale = 2.0 ** -np.clip(np.frexp(size)[1], -1000, 1000) if 0 < size < np.inf else 1.0
        self.middle = middle * self.scale
        sample = self.inner(sample)
        self.centres = k_means(sample, LISTS, ROUNDS, seed)
        residual = sample - self.centres[_nearest(sample, self.centres)]
        self.edges = [a[0] for a in np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))] + [sample.shape[1]]
        self.books = [
            k_means(residual[:, a:b], CODES, ROUNDS, seed + 1 + i)
            for i, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False))
        ]
        self.fitted = self.encode(sample)

    def inner(self, x: np.ndarray) -> np.ndarray:
        return x * self.scale - self.middle

    def parts(self) -> Iterator[tuple[int, int, np.ndarray]]:
        return zip(self.edges, self.edges[1:], self.books, strict=False)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = _nearest(x, self.centres)
        residual = x - self.centres[lists]
        return lists, np.stack([_nearest(residual[:, a:b], book) for a, b, book in self.parts()], 1).astype(np.uint8)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for; distances to them are the asymmetric distances."""
        return self.centres[lists] + np.concatenate([book[codes[:, j]] for j, (_, _, book) in enumerate(self.parts())], 1)

    def bounds(self, queries: np.ndarray, probed: np.ndarray, n: int) -> np.ndarray:
        """For each query, at least the n-th least asymmetric distance in its probed lists: that among fitted items."""
        lists, codes = self.fitted
        out = np.full(len(queries), np.inf)
        if len(lists) >= n:
            vectors = self.decode(lists, codes)
            for i in range(0, len(queries), 128):
                q = queries[i : i + 128]
                d = np.where(probed[i : i + 128][:, lists], _distances(q, vectors), np.inf)
                nth = np.partition(d, n - 1, axis=1)[:, n - 1]
                out[i : i + 128] = nth * (1 + 1e-5) + 1e-9 * (q * q).sum(1)  # distances of items are summed in another order
        return out

    def asymmetric(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coded items of list `at`, from one table a part."""
        residual = queries - self.centres[at]
        total = np.zeros((len(queries), len(codes)))
        for j, (a, b, book) in enumerate(self.parts()):
            total += _distances(residual[:, a:b], book)[:, codes[:, j]]
        return total


def usable(vector: Column, dimension: int) -> Column:
    """Not null, of the dimension, not zero, and without null or non-finite components."""
    d = vector.cast("array<double>")
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dimension) & finite & F.exists(d, lambda x: x != 0.0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def effort(asked: np.ndarray, items: DataFrame, coded: DataFrame, model, k: int) -> tuple[int, int]:
    """(probes, reranked): the least, PROBES and RERANK at least, that find TARGET of the k nearest items of `asked`.

    `asked` are vectors of items. One pass over the items finds the exact neighbours of each, a second one the places of
    those by asymmetric distance among all items.
    """
    asked = model.value.inner(asked)
    norms = (asked * asked).sum(1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int32, np.float64)]
        for batch in batches:
            x, ids = model.value.inner(_matrix(batch.column(1))), batch.column(0).to_numpy()
            if not len(x):
                continue
            # own vector included: it is always the first; distances that differ by rounding only are equal
            grain = 1e-12 * norms[:, None] + np.finfo(float).tiny
            d = np.round(np.maximum(_distances(asked, x), 0) / grain) * grain
            last = min(k, len(x) - 1)
            s, i = np.nonzero(d <= np.partition(d, last, axis=1)[:, last][:, None])
            of, far = np.concatenate([kept[0], s]), np.concatenate([kept[1], d[s, i]])
            at = np.concatenate([np.full(len(kept[0]), -1), i])
            order = np.lexsort((np.concatenate([kept[2], ids[i]]), far, of))
            sizes = np.bincount(of, minlength=len(asked))
            order = order[np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes) <= k]
            old, new = order[at[order] < 0], order[at[order] >= 0]
            lists, codes = model.value.encode(x[at[new]])
            coarse = ((asked[of[new]] - model.value.decode(lists, codes)) ** 2).sum(1)
            fresh = [of[new], far[new], ids[at[new]], lists.astype(np.int32), coarse]
            kept = [np.concatenate([column[old], more]) for column, more in zip(kept, fresh, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], names=["s", "d", "id", "list", "coarse"])

    found = items.select(F.array_min("ids"), "v").mapInArrow(nearest, "s long, d double, id long, list int, coarse double")
    nth = F.row_number().over(Window.partitionBy("s").orderBy("d", "id"))
    near = found.withColumn("n", nth).where(F.col("n").between(2, k + 1)).select("s", "list", "coarse").collect()
    if not near:
        return PROBES, RERANK
    of, lists, coarse = (np.array([r[c] for r in near]) for c in ("s", "list", "coarse"))

    reach = coarse * (1 + 1e-9) + 1e-11 * norms[of]

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(of), np.int64)
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                at = batch.column(0).to_numpy()
                for i in range(0, len(at), 4096):
                    d = np.sort(_distances(asked, model.value.decode(at[i : i + 4096], codes[i : i + 4096])), axis=1)
                    for s in np.unique(of):
                        total[of == s] += np.searchsorted(d[s], reach[of == s], side="right")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(of))), pa.array(total)], names=["i", "n"])

    counts = coded.select("list", "code").mapInArrow(ahead, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    before = np.zeros(len(of), np.int64)
    for row in counts.collect():  # SAMPLE * k rows at most
        before[row["i"]] = row["n"] - 1
    places = _distances(asked, model.value.centres).argsort(1, kind="stable").argsort(1)[of, lists]

    def least(needed: np.ndarray, share: float) -> int:
        return int(np.sort(needed)[int(np.ceil(share * len(needed))) - 1]) + 1

    rerank = max(RERANK, least(before, (1 + TARGET) / 2))
    return max(PROBES, least(np.where(before < rerank, places, len(model.value.centres)), TARGET)), rerank


_RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, is_query: Column, k: int = 10, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest found of every row for which `is_query` holds: query_id, rank (from 1), vec_id, score.

    score is the Euclidean distance of original vectors in double precision; ties go to the smaller id; a row is never
    its own neighbour; queries with fewer than k candidates get them all. Rows with a null id, and vectors that are null,
    zero, not of the most frequent length, or hold null or non-finite components take no part. Rows that repeat an id
    count once, at their nearest vector. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    ).where("id is not null and v is not null")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], _RESULT)
    clean = rows.where(usable(F.col("v"), lengths["n"]))
    keyed = clean.select("id", "v", F.xxhash64("v").alias("h"))
    ranks = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("id"))
    smallest = keyed.withColumn("r", ranks).where(F.col("r") <= k + 1)
    distinct = smallest.groupBy("h", "v").agg(F.collect_set("id").alias("ids"))
    items = cut(distinct.select(F.monotonically_increasing_id().alias("uid"), "h", "v", "ids"))

    sample = [r["v"] for r in items.select("h", "v").orderBy("h", "v").limit(TRAIN).toLocalIterator()]
    if not sample:
        return spark.createDataFrame([], _RESULT)
    model = spark.sparkContext.broadcast(Model(np.asarray(sample, np.float64)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, codes = model.value.encode(model.value.inner(_matrix(batch.column(1))))
            coded = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lists.astype(np.int32)), coded], names=["uid", "list", "code"]
            )

    coded = cut(items.select("uid", "v").mapInArrow(index, "uid long, list int, code binary"))
    sizes = dict(coded.groupBy("list").count().collect())  # a row a list
    item_blocks = {n: -(-c // ITEM_BLOCK) for n, c in sizes.items()}

    queries = clean.where("q").select("id", "v").distinct()
    queries = cut(queries.select(F.monotonically_increasing_id().alias("qid"), "id", "v"))
    some = queries.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    if not some:
        return spark.createDataFrame([], _RESULT)
    n_probes, n_rerank = effort(np.asarray([r["v"] for r in some], np.float64), items, coded, model, k)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.array([sizes.get(n, 0) for n in range(len(model.value.centres))])
        for batch in batches:
            asking = model.value.inner(_matrix(batch.column(1)))
            away = _distances(asking, model.value.centres)
            order = away.argsort(1, kind="stable")
            before = held[order].cumsum(1) - held[order]
            take = ((np.arange(order.shape[1])[None, :] < n_probes) | (before < n_rerank)) & (held[order] > 0)
            row, nth = np.nonzero(take)
            probed = np.zeros(take.shape, bool)
            probed[row, order[row, nth]] = True
            bound = model.value.bounds(asking, probed, n_rerank) if len(asking) else np.zeros(0)
            columns = [batch.column(0).take(pa.array(row)), pa.array(order[row, nth].astype(np.int32)), pa.array(bound[row])]
            yield pa.RecordBatch.from_arrays(columns, names=["qid", "list", "bound"])

    probes = cut(queries.select("qid", "v").mapInArrow(probe, "qid long, list int, bound double"))
    asked = dict(probes.groupBy("list").count().collect())
    query_blocks = {n: -(-c // QUERY_BLOCK) for n, c in asked.items()}

    def blocks(of: dict[int, int]) -> Column:
        pairs = [F.lit(x) for pair in of.items() for x in pair] or [F.lit(-1), F.lit(1)]
        return F.coalesce(F.create_map(*pairs)[F.col("list")], F.lit(1))

    def own(key: str, of: dict[int, int]) -> Column:
        return F.pmod(F.xxhash64(key), blocks(of).cast("long")).cast("int")

    def every(of: dict[int, int]) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks(of) - 1))

    placed_items = (
        coded.where(F.col("list").isin(list(asked)))
        .withColumn("ib", own("uid", item_blocks))
        .withColumn("qb", every(query_blocks))
    )
    placed_queries = (
        probes.join(queries.select("qid", "v"), "qid")
        .withColumn("qb", own("qid", query_blocks))
        .withColumn("ib", every(item_blocks))
    )

    def search_block(key: tuple, asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return pd.DataFrame({"qid": [], "uid": [], "d": []})
        codes = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1)
        uids, qids = held["uid"].to_numpy(), asking["qid"].to_numpy()
        out = []
        for at in range(0, len(asking), 128):
            vectors = model.value.inner(np.stack(asking["v"].iloc[at : at + 128]).astype(np.float64))
            d = model.value.asymmetric(vectors, int(key[0]), codes)
            whole = d.shape[1] <= n_rerank
            best = np.tile(np.arange(d.shape[1]), (len(d), 1)) if whole else np.argpartition(d, n_rerank - 1, axis=1)[:, :n_rerank]
            least = np.take_along_axis(d, best, 1)
            near = least <= asking["bound"].to_numpy()[at : at + 128][:, None]
            out.append(
                pd.DataFrame(
                    {"qid": np.repeat(qids[at : at + 128], near.sum(1)), "uid": uids[best[near]], "d": least[near]}
                )
            )
        return pd.concat(out)

    keys = ["list", "ib", "qb"]
    found = (
        placed_queries.groupBy(*keys)
        .cogroup(placed_items.groupBy(*keys))
        .applyInPandas(search_block, "qid long, uid long, d double")
    )
    best = F.row_number().over(Window.partitionBy("qid").orderBy("d", "uid"))
    candidates = found.withColumn("n", best).where(F.col("n") <= n_rerank)
    exact = F.sqrt(
        F.aggregate(
            F.zip_with("v", "qv", lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))),
            F.lit(0.0),
            lambda total, x: total + x,
        )
    )
    scored = (
        candidates.select("qid", "uid")
        .join(items.select("uid", "v", "ids"), "uid")
        .join(queries.select("qid", F.col("id").alias("query_id"), F.col("v").alias("qv")), "qid")
        .select("query_id", "ids", exact.alias("score"))
        .select("query_id", "score", F.explode("ids").alias("vec_id"))
        .where("vec_id <> query_id")
        .groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % 100 == 0)


#: Exact neighbours, which the index finds on the test tables (it is approximate, so no SQL is registered for it).
EXACT_SQL = r"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
