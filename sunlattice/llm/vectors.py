"""Near-duplicate vectors: int8 tile products with error bounds, full precision only where a pair may be a link.

Equal vectors of a group are one class, so thousands of copies are one row of a tile. Classes of a group are dealt into
blocks of bounded bytes, and each pair of blocks of a group is one tile: a task holds two blocks, whatever the group's
size, and a hot group is spread over all its tiles. A vector x of length 1 is kept as s*q + e with q in int8, and since
|xy - st*qr| <= |e| + |f| + |e||f| for the error vectors e and f, pairs below that bound are certainly no links. The
rest of a tile is computed in double precision there. A tile returns one row for each class with a link (links counted,
and the class that stands for it in the tile's forest), never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunlattice.llm.components import connected_components
from sunlattice.llm.scratch import cut

#: Bytes of codes and originals that a block holds at most (about: blocks are dealt by hash), and its most vectors.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 8192
#: Rows of a block that are multiplied at once.
STEP = 512
#: Components whose int8 products are summed exactly in single precision: 127 * 127 * 1024 < 2 ** 24.
EXACT_DIMS = 1024
#: Covers the rounding of lengths, scales and errors, which are some 1e-15.
SLACK = 1e-12
#: Share of a strip's pairs from which the whole strip is multiplied in double precision instead of single pairs.
DENSE = 0.02


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes int8, scale, error) of the vectors divided by their lengths; error bounds the length of what is lost."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = unit - codes * scale[:, None]
    return codes, scale, np.sqrt((lost * lost).sum(axis=1)) + SLACK


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """In double precision, each row times a power of two that brings it near 1: cosines stay the same, to the bit."""
    wide = vectors.astype(np.float64)
    return np.ldexp(wide, -np.frexp(np.abs(wide).max(axis=1))[1][:, None])


class _Block:
    """The vectors of a block: numbers, copies, codes with their errors, and originals."""

    def __init__(self, row: dict) -> None:
        self.uid, self.copies = np.frombuffer(row["uids"], "<i8"), np.frombuffer(row["copies"], "<i8")
        self.scale, self.error = np.frombuffer(row["scales"], "<f8"), np.frombuffer(row["errors"], "<f8")
        shape = (len(self.uid), row["dim"])
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(shape).astype(np.float32)
        self.exact = _scaled(np.frombuffer(row["vectors"], "<f8" if row["wide"] else "<f4").reshape(shape))
        self.length = np.sqrt(np.einsum("ij,ij->i", self.exact, self.exact))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of integer codes, exact: sums of at most EXACT_DIMS components in single precision, the rest in double."""
    parts = range(0, a.shape[1], EXACT_DIMS)
    return sum((a[:, k : k + EXACT_DIMS] @ b[:, k : k + EXACT_DIMS].T).astype(np.float64) for k in parts)


def tile_links(a: _Block, b: _Block, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links (places in a, places in b) of a tile, strip by strip; of a block with itself each pair once."""
    for lo in range(0, len(a.uid), STEP):
        rows = slice(lo, lo + STEP)
        most = _products(a.codes[rows], b.codes) * a.scale[rows, None] * b.scale
        most += a.error[rows, None] + b.error + a.error[rows, None] * b.error
        i, j = np.nonzero(most >= threshold - SLACK)
        if same:
            i, j = i[i + lo < j], j[i + lo < j]
        if len(i) > DENSE * most.size:
            dots = (a.exact[rows] @ b.exact.T)[i, j]
        else:
            dots = np.einsum("ij,ij->i", a.exact[rows][i], b.exact[j])
        i = i + lo
        link = dots / (a.length[i] * b.length[j]) >= threshold
        if link.any():
            yield i[link], j[link]


def _joined(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The forest `parent` (each node points at its root) after the edges (u, v)."""
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


FOUND = pa.schema([("uid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links and forest of one tile: of its one block with itself, or of its two blocks."""
    blocks = [_Block(r) for r in sorted(table.to_pylist(), key=lambda r: r["block"])]
    a, b, same = blocks[0], blocks[-1], len(blocks) == 1
    shift = 0 if same else len(a.uid)
    uid = a.uid if same else np.concatenate([a.uid, b.uid])
    links, parent = np.zeros(len(uid), np.int64), np.arange(len(uid))
    for i, j in tile_links(a, b, same, threshold):
        links += np.bincount(i, b.copies[j], len(uid)).astype(np.int64)
        links += np.bincount(j + shift, a.copies[i], len(uid)).astype(np.int64)
        parent = _joined(parent, i, j + shift)
    some = np.flatnonzero(links)
    return pa.table([uid[some], links[some], uid[parent[some]]], schema=FOUND)


def _packed(table: pa.Table, wide: bool) -> dict:
    """The one row of a block."""
    uid = table["uid"].to_numpy()
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vectors = flat.reshape(len(uid), -1)
    codes, scale, error = quantise(_scaled(vectors))
    return {
        "uids": uid.astype("<i8").tobytes(),
        "copies": table["copies"].to_numpy().astype("<i8").tobytes(),
        "codes": codes.tobytes(),
        "scales": scale.astype("<f8").tobytes(),
        "errors": error.astype("<f8").tobytes(),
        "vectors": vectors.astype("<f8" if wide else "<f4").tobytes(),
    }


def _usable(v: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    real = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(real & F.exists(v, lambda x: x != 0), F.lit(False))


def class_links(classes: DataFrame, group: str, wide: bool, threshold: float) -> DataFrame:
    """(uid, links, root) of all tiles. classes: `group`, v, uid and copies (the number of equal vectors)."""
    size = F.size("v")
    width = classes.withColumn("dim", size)
    rows = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (F.col("dim") * (9 if wide else 5)))))
    counts = width.groupBy(group, "dim").agg(F.count("*").alias("n")).select(group, "dim", F.ceil(F.col("n") / rows).alias("blocks"))
    dealt = width.join(counts, [group, "dim"]).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))

    kind = classes.schema[group].dataType
    packed_type = T.StructType(
        [T.StructField("g", kind), T.StructField("dim", T.IntegerType()), T.StructField("wide", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in ("block", "blocks")]
        + [T.StructField(c, T.BinaryType()) for c in ("uids", "copies", "codes", "scales", "errors", "vectors")]
    )

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        row = {"dim": [table["dim"][0].as_py()], "wide": [wide]}
        row |= {k: [table[k][0].as_py()] for k in ("block", "blocks")}
        row |= {k: [x] for k, x in _packed(table, wide).items()}
        kinds = {"dim": pa.int32(), "wide": pa.bool_(), "block": pa.int64(), "blocks": pa.int64()}
        arrays = [table[group].slice(0, 1).combine_chunks()] + [pa.array(x, kinds.get(k, pa.binary())) for k, x in row.items()]
        return pa.table(arrays, names=["g", *row])

    blocks = dealt.select(group, "dim", "block", "blocks", "uid", "copies", "v").groupBy(group, "dim", "block").applyInArrow(pack, packed_type)
    other = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = other.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return tiles.groupBy("g", "dim", "low", "high").applyInArrow(lambda table: _compare(table, threshold), "uid long, links long, root long")


def near_duplicate_vectors(df: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", group: str = "label") -> DataFrame:
    """`df` with n_links (other vectors linked directly), component_id (smallest id reachable by links, its own included)
    and kept (vec_id = component_id), links being pairs of equal `group` with a cosine of `threshold` or more.

    Vectors with a null group, and those that are null, empty, zero or hold null or non-finite components, have no links;
    nor are vectors of different lengths linked. Every row is a vector of its own: repeated rows are linked with each
    other, each counted. A null id is no candidate for component_id; a component of null ids has a null component_id, and
    its rows are kept. Columns of `df` named as the results are replaced, and an empty table gives an empty one.
    """
    wide = not isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    held = df.drop("n_links", "component_id", "kept")
    v = F.col(vector).cast("array<double>") if wide else F.col(vector)
    rows = held.select(F.struct(*held.columns).alias("row"), F.col(group).alias("g"), F.col(vec_id).alias("id"), v.alias("v"))
    usable = F.col("g").isNotNull() & _usable(F.col("v"))
    grouped = rows.where(usable).groupBy("g", "v").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    classes = cut(grouped.withColumn("uid", F.monotonically_increasing_id()))

    found = cut(class_links(classes, "g", wide, threshold))
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("uid").alias("u"), F.col("root").alias("v")))
    known = (
        classes.join(links, "uid", "left")
        .join(parts.select(F.col("node").alias("uid"), "label"), "uid", "left")
        .withColumn("part", F.coalesce("label", "uid"))
        .select("g", "v", "part", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    known = cut(known)
    least = known.groupBy("part").agg(F.min("first_id").alias("component_id"))
    verdict = known.join(least, "part").select(F.xxhash64("g", "v").alias("_k"), F.col("g").alias("_g"), F.col("v").alias("_v"), "n_links", "component_id", F.lit(True).alias("_in"))
    own = F.when(usable, F.xxhash64("g", "v"))
    joined = rows.withColumn("k", own).join(verdict, (F.col("k") == F.col("_k")) & (F.col("g") == F.col("_g")) & (F.col("v") == F.col("_v")), "left")
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("id"))
    return joined.select(
        *[F.col("row")[c].alias(c) for c in held.columns],
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def op11_int8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return near_duplicate_vectors(vectors).select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), "kept")


OP11_SQL = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS MATERIALIZED (
  SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM g AS a JOIN g AS b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach(a, id) AS (
  SELECT r, vec_id FROM v UNION SELECT l.b, reach.id FROM reach JOIN l ON l.a = reach.a),
c AS (SELECT a, min(id) AS id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, id AS component_id, vec_id IS NOT DISTINCT FROM id AS kept
FROM v JOIN c ON c.a = v.r LEFT JOIN n ON n.a = v.r
"""
