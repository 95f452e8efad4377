"""Slope classes, their statistics, connected regions and outlines."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunlattice.functions.numeric import is_value
from sunlattice.operators.graph import connected_components
from sunlattice.sources.tables import cut

#: Cells a side of a tile.
TILE = 256


def slope_class(value: Column, threshold: float = 0.1, use_abs: bool = True, parity: bool = False) -> Column:
    """0 below the threshold, 1 otherwise; missing values have no class, or class 1 with parity."""
    v = F.abs(value) if use_abs else value
    known = F.when(v < threshold, 0).otherwise(1)
    return F.when(is_value(value), known).otherwise(F.lit(1) if parity else F.lit(None).cast("int"))


def class_statistics(df: DataFrame, column: str = "slope_class", keys: tuple[str, ...] = ()) -> DataFrame:
    """Total, count and percent of each class; zeros for an empty table."""
    gentle, steep = F.count_if(F.col(column) == 0), F.count_if(F.col(column) == 1)
    total = F.count(column)
    share = lambda c: F.coalesce(F.try_divide(100.0 * c, total), F.lit(0.0))
    aggregated = df.groupBy(*keys) if keys else df
    return aggregated.agg(
        total.alias("total"),
        gentle.alias("gentle_count"),
        steep.alias("steep_count"),
        share(gentle).alias("gentle_percent"),
        share(steep).alias("steep_percent"),
    )


def _united(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The roots of 0..n-1 (each the smallest of its part) once u and v are joined, pair by pair."""
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up


#: Neighbours that come after a cell in scan order.
_LATER = ((0, 1), (1, -1), (1, 0), (1, 1))


def _dense(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row numbers on the box of the cells, with a border of -1."""
    at = np.full((y.max() - y.min() + 3, x.max() - x.min() + 3), -1)
    at[y - y.min() + 1, x - x.min() + 1] = np.arange(len(y))
    return at


def _tile_parts(table: pa.Table, column: str) -> pa.Table:
    """The cells of a tile in scan order with `part`: the number of the first cell of their 8-connected part of equal class."""
    table = table.sort_by([("yi", "ascending"), ("xi", "ascending")])
    y, x, c = (table[n].to_numpy().astype(np.int64) for n in ("yi", "xi", column))
    at, parent = _dense(y, x), np.arange(len(y))
    ends = []
    for dy, dx in _LATER:
        a, b = at[1:-1, 1:-1], at[1 + dy : at.shape[0] - 1 + dy, 1 + dx : at.shape[1] - 1 + dx]
        some = (a >= 0) & (b >= 0)
        u, v = a[some], b[some]
        same = c[u] == c[v]
        ends.append((u[same], v[same]))
    parent = _united(parent, np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))
    number = y * (1 << 32) + x
    return table.append_column("part", pa.array(number[parent], pa.int64()))


def components8(df: DataFrame, column: str = "slope_class", keys: tuple[str, ...] = ("raster_id",), tile: int = TILE) -> DataFrame:
    """Adds `label`: the smallest cell number of the 8-connected region of equal class; NULL where the class is.

    Parts are found in tiles of tile x tile cells, whatever a raster's or a region's size. Only cells at the borders of tiles
    meet their neighbours in a join, and only the numbers of parts that touch there are components of a graph. A cell's
    number is yi * (largest xi + 1) + xi.
    """
    k = list(keys)
    spots = {"_ty": F.floor(F.col("yi") / tile), "_tx": F.floor(F.col("xi") / tile)}
    known = df.where(F.col(column).isNotNull()).withColumns({"yi": F.col("yi").cast("int"), "xi": F.col("xi").cast("int")} | spots)
    schema = T.StructType([*known.schema.fields, T.StructField("part", T.LongType())])
    parts = cut(known.groupBy(*k, "_ty", "_tx").applyInArrow(lambda t: _tile_parts(t, column), schema).drop("_ty", "_tx"))

    edge = [F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1) for c in ("yi", "xi")]
    border = parts.where(edge[0] | edge[1]).select(*k, "yi", "xi", column, "part")
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _LATER])
    toward = border.select("*", F.explode(steps).alias("s")).withColumns({"ny": F.col("yi") + F.col("s.dy"), "nx": F.col("xi") + F.col("s.dx")})
    crossing = [F.floor(F.col(a) / tile) != F.floor(F.col(b) / tile) for a, b in (("yi", "ny"), ("xi", "nx"))]
    toward = toward.where(crossing[0] | crossing[1]).select(*k, column, "ny", "nx", F.col("part").alias("_u"))
    there = border.select(*k, column, F.col("yi").alias("ny"), F.col("xi").alias("nx"), F.col("part").alias("_v"))
    touching = cut(toward.join(there, [*k, column, "ny", "nx"]).select(*k, "_u", "_v").distinct(), n=F.count("*"))
    node = lambda n: F.struct(*k, F.col(n).alias("part"))
    low = parts
    if touching.noted["n"]:
        regions = connected_components(touching.select(node("_u").alias("u"), node("_v").alias("v")))
        found = regions.select(*[F.col("node")[c].alias(c) for c in (*k, "part")], F.col("label")["part"].alias("_low"))
        low = parts.join(found, [*k, "part"], "left").withColumn("part", F.coalesce("_low", "part")).drop("_low")
    widths = df.groupBy(*k).agg((F.max("xi") + 1).cast("long").alias("_w"))
    # the number of a part has xi in its low half, signed
    y = F.shiftright(F.col("part") + (1 << 31), 32)
    labelled = low.join(widths, k).withColumn("label", y * F.col("_w") + F.col("part") - y * (1 << 32))
    without = df.where(F.col(column).isNull()).withColumn("label", F.lit(None).cast("long"))
    return labelled.select(*df.columns, "label").unionByName(without)


def cluster_ids(df: DataFrame, min_pixels: int = 5, column: str = "slope_class", keys: tuple[str, ...] = ("raster_id",), parity: bool = False) -> DataFrame:
    """Adds cluster_id: 1, 2, .. for gentle regions and -1, -2, .. for steep ones in scan order; 0 for small or no class.

    With parity the gentle and the steep region of one number share their size and their removal. Regions are numbered in
    blocks of labels, whose counts are summed on their own, so a raster of very many regions isn't one task.
    """
    k = list(keys)
    labelled = components8(df, column, keys)
    sizes = labelled.where("label is not null").groupBy(*k, column, "label").agg(F.count("*").alias("size"))
    blocked = sizes.withColumn("_block", F.shiftright("label", 16))
    counts = blocked.groupBy(*k, column, "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*k, column).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*k, column, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*k, column, "_block").orderBy("label")
    numbered = blocked.join(before, [*k, column, "_block"]).withColumn("nth", F.row_number().over(inside) + F.col("_before"))
    if parity:
        totals = numbered.groupBy(*k, "nth").agg(F.sum("size").alias("_total"))
        numbered = numbered.join(totals, [*k, "nth"])
    else:
        numbered = numbered.withColumn("_total", F.col("size"))
    sign = F.when(F.col(column) == 0, 1).otherwise(-1)
    ids = F.when(F.col("_total") >= min_pixels, sign * F.col("nth")).otherwise(0).cast("int")
    found = numbered.select(*k, column, "label", ids.alias("cluster_id"))
    out = labelled.join(found, [*k, column, "label"], "left")
    return out.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0)))


#: Sides of a cell, clockwise: where each starts (corner of the cell), the step along it, and the cell on its other side.
_SIDES = (((0, 0), (0, 1), (-1, 0)), ((0, 1), (1, 0), (0, 1)), ((1, 1), (0, -1), (1, 0)), ((1, 0), (-1, 0), (0, -1)))
_ROW = 1 << 34  # the number of a side is row * _ROW + column * 4 + side


def _tile_paths(table: pa.Table, top: int, left: int, tile: int) -> dict[str, list]:
    """The outlines of a tile's clusters as far as they run in the tile: closed rings, and paths that go on elsewhere.

    At the end of a side the outline turns right onto the next side of its cell if the cell ahead is no part of the
    cluster (so parts that touch at a corner are apart), left if that and the one beside it are, and else goes on.
    """
    y, x, own = (table[n].to_numpy().astype(np.int64) for n in ("yi", "xi", "cluster_id"))
    ids = np.zeros((tile + 2, tile + 2), np.int64)
    ids[y - top + 1, x - left + 1] = own
    inner = ids[1:-1, 1:-1]
    at = lambda dy, dx: ids[1 + dy : 1 + dy + tile, 1 + dx : 1 + dx + tile]
    number, after, cluster = [], [], []
    for side, (_, (ay, ax), (oy, ox)) in enumerate(_SIDES):
        edge = (inner != 0) & (at(oy, ox) != inner)
        r, c = np.nonzero(edge)
        ahead, beside = at(ay, ax)[r, c] == inner[r, c], at(ay + oy, ax + ox)[r, c] == inner[r, c]
        r, c = r + top, c + left
        turn_right = r * _ROW + c * 4 + (side + 1) % 4
        straight = (r + ay) * _ROW + (c + ax) * 4 + side
        turn_left = (r + ay + oy) * _ROW + (c + ax + ox) * 4 + (side + 3) % 4
        number.append(r * _ROW + c * 4 + side)
        after.append(np.where(ahead, np.where(beside, turn_left, straight), turn_right))
        cluster.append(inner[r - top, c - left])
    number, after, cluster = (np.concatenate(v) for v in (number, after, cluster))
    order = np.argsort(number)
    number, after, cluster = number[order], after[order], cluster[order]
    spot = np.searchsorted(number, after)
    spot[spot == len(number)] = 0
    follow = np.where(number[spot] == after, spot, -1) if len(number) else spot
    first = np.ones(len(number), bool)
    first[follow[follow >= 0]] = False
    heads = np.concatenate([np.flatnonzero(first), np.flatnonzero(~first)]).tolist()
    nums, nxt = number.tolist(), follow.tolist()
    done = bytearray(len(nums))
    out: dict[str, list] = {n: [] for n in ("cluster_id", "first", "next", "first_side", "last_side", "ys", "xs")}
    for head in heads:  # open paths first; what is left are rings
        if done[head]:
            continue
        ys, xs, here, side = [], [], head, nums[head] & 3
        while True:
            done[here] = 1
            following = nxt[here]
            if following < 0 or following == head:
                break
            here = following
            if nums[here] & 3 != side:
                side = nums[here] & 3
                oy, ox = _SIDES[side][0]
                row, rest = divmod(nums[here] + (_ROW >> 1), _ROW)
                ys.append(row + oy)
                xs.append(((rest - (_ROW >> 1)) >> 2) + ox)
        for n, value in zip(out, (int(cluster[head]), nums[head], int(after[here]), nums[head] & 3, side, ys, xs), strict=True):
            out[n].append(value)
    return out


def _stitched(paths: dict[int, dict]) -> tuple[list[int], list[int]]:
    """(ys, xs) of the corners of the ring that paths, by the number of their first side, make up; from the smallest corner."""
    start = here = min(paths)
    ys, xs = [], []
    before = next(p for p in paths.values() if p["next"] == start)
    while True:
        path = paths[here]
        if before["last_side"] != path["first_side"]:
            (oy, ox), number = _SIDES[path["first_side"]][0], path["first"]
            row, rest = divmod(number + (_ROW >> 1), _ROW)
            ys.append(row + oy)
            xs.append(((rest - (_ROW >> 1)) >> 2) + ox)
        ys += path["ys"]
        xs += path["xs"]
        before, here = path, path["next"]
        if here == start:
            break
    turn = min(range(len(ys)), key=lambda i: (ys[i], xs[i]))
    return ys[turn:] + ys[:turn], xs[turn:] + xs[:turn]


def _doubled_area(ys: list[int], xs: list[int]) -> int:
    return sum(a * d - c * b for a, b, c, d in zip(xs, ys, xs[1:] + xs[:1], ys[1:] + ys[:1], strict=True))


def _closed(made: dict[str, list]) -> dict[str, list]:
    """The paths of a tile with area2; those that close in it are whole rings already, the others have none."""
    made["area2"] = [None] * len(made["first"])
    for i, (first, after) in enumerate(zip(made["first"], made["next"], strict=True)):
        if first == after:
            ys, xs = _stitched({first: {n: v[i] for n, v in made.items()}})
            made["ys"][i], made["xs"][i], made["area2"][i] = ys, xs, _doubled_area(ys, xs)
    return made


def outlines(df: DataFrame, keys: tuple[str, ...] = ("raster_id",), tile: int = TILE) -> DataFrame:
    """keys, cluster_id, ys, xs and area2: every ring of every cluster (not of cluster 0) as the corners where it turns, in
    units of cells, and twice its area: above 0 for outer rings, below for holes.

    Sides are chained in tiles of bounded size, where most rings close; the paths that cross tiles are joined by their ends; so a cluster as
    large as its raster is traced by all tasks, and only the turns of a ring, which are the result, come together.
    """
    k = list(keys)

    def tiles(c: str) -> Column:
        return F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile) for d in (-1, 0, 1)]))

    marked = df.where("cluster_id <> 0").select(*k, F.col("yi").cast("int").alias("yi"), F.col("xi").cast("int").alias("xi"), F.col("cluster_id").cast("int").alias("cluster_id"))
    dealt = marked.select("*", F.explode(tiles("yi")).alias("_ty")).select("*", F.explode(tiles("xi")).alias("_tx"))
    fields = {f.name: f for f in marked.schema.fields}
    numbers = T.ArrayType(T.LongType())
    kinds = {"cluster_id": T.IntegerType(), "first": T.LongType(), "next": T.LongType(), "first_side": T.IntegerType(), "last_side": T.IntegerType(), "ys": numbers, "xs": numbers, "area2": T.LongType()}
    schema = T.StructType([*[fields[c] for c in k], *[T.StructField(n, t) for n, t in kinds.items()]])
    arrow = {"cluster_id": pa.int32(), "first_side": pa.int32(), "last_side": pa.int32(), "ys": pa.list_(pa.int64()), "xs": pa.list_(pa.int64())}

    def trace(table: pa.Table) -> pa.Table:
        made = _closed(_tile_paths(table, int(table["_ty"][0].as_py()) * tile, int(table["_tx"][0].as_py()) * tile, tile))
        n = len(made["first"])
        same = [pa.array([table[c][0].as_py()] * n, table[c].type) for c in k]
        return pa.table([*same, *[pa.array(v, arrow.get(c, pa.int64())) for c, v in made.items()]], names=[*k, *made])

    paths = cut(dealt.groupBy(*k, "_ty", "_tx").applyInArrow(trace, schema), crossing=F.count_if(F.col("area2").isNull()))
    closed = paths.where("area2 is not null").select(*k, "cluster_id", "ys", "xs", "area2")
    if not paths.noted["crossing"]:
        return closed
    crossing = paths.where("area2 is null").drop("area2")
    node = lambda n: F.struct(*k, F.col(n).alias("side"))
    joined = connected_components(crossing.select(node("first").alias("u"), node("next").alias("v")))
    found = joined.select(*[F.col("node")[c].alias(c) for c in k], F.col("node")["side"].alias("first"), F.col("label")["side"].alias("_ring"))
    crossing = crossing.join(found, [*k, "first"])

    def stitch(table: pa.Table) -> pa.Table:
        ys, xs = _stitched({p["first"]: p for p in table.select([n for n in kinds if n not in ("cluster_id", "area2")]).to_pylist()})
        area = _doubled_area(ys, xs)
        head = [table[c].slice(0, 1).combine_chunks() for c in (*k, "cluster_id")]
        return pa.table([*head, pa.array([ys], arrow["ys"]), pa.array([xs], arrow["xs"]), pa.array([area], pa.int64())], names=[*k, "cluster_id", "ys", "xs", "area2"])

    out = T.StructType([*[fields[c] for c in (*k, "cluster_id")], T.StructField("ys", numbers), T.StructField("xs", numbers), T.StructField("area2", T.LongType())])
    return closed.unionByName(crossing.groupBy(*k, "cluster_id", "_ring").applyInArrow(stitch, out))


def polygons(df: DataFrame, cell_area: float = 1.0, keys: tuple[str, ...] = ("raster_id",), tile: int = TILE) -> DataFrame:
    """One row an outer ring: class, name, area, and the closed ring of (x, y) corners in units of cells. Holes are lost."""
    rings = outlines(df, keys, tile).where("area2 > 0")
    corners = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.struct(p["xs"].cast("double").alias("x"), p["ys"].cast("double").alias("y")))
    steep = (F.col("cluster_id") < 0).cast("int")
    return rings.select(
        *keys,
        "cluster_id",
        steep.alias("class"),
        F.when(steep == 1, "Steep").otherwise("Gentle").alias("class_name"),
        (F.col("area2") / 2.0 * cell_area).alias("area"),
        F.concat(corners, F.slice(corners, 1, 1)).alias("ring"),
    )


def _crosses(points: np.ndarray) -> bool:
    """Whether sides of a closed ring that don't follow each other touch. Sides are compared in the squares they run through."""
    ends = np.roll(points, -1, axis=0)
    n = len(points)
    side = max(float(np.abs(ends - points).max()), 1e-300)
    squares: dict[tuple[int, int], list[int]] = {}
    low, high = np.floor(np.minimum(points, ends) / side).astype(np.int64), np.floor(np.maximum(points, ends) / side).astype(np.int64)
    for i in range(n):
        for a in range(low[i, 0], high[i, 0] + 1):
            for b in range(low[i, 1], high[i, 1] + 1):
                squares.setdefault((a, b), []).append(i)

    def turn(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))

    for held in squares.values():
        if len(held) > 1:
            at = np.array(held)
            i, j = np.triu_indices(len(at), 1)
            i, j = at[i], at[j]
            far = ((j - i) % n > 1) & ((i - j) % n > 1)
            i, j = i[far], j[far]
            p, q, r, s = points[i], ends[i], points[j], ends[j]
            straddle = (turn(p, q, r) * turn(p, q, s) <= 0) & (turn(r, s, p) * turn(r, s, q) <= 0)
            boxes = np.all((np.minimum(p, q) <= np.maximum(r, s)) & (np.minimum(r, s) <= np.maximum(p, q)), axis=1)
            if np.any(straddle & boxes):
                return True
    return False


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A ring (not closed, n x 2) without the corners that lie within the tolerance of what is left (Douglas and Peucker, from
    the first corner and the one farthest from it); at least four corners stay of four or more.

    A ring that would touch itself is simplified by half the tolerance instead, and so on; rings that touch themselves from
    the start stay as they are.
    """
    n = len(points)
    if tolerance <= 0 or n <= 4 or _crosses(points):
        return points
    for _ in range(12):
        kept, closed = np.zeros(n, bool), np.vstack([points, points[:1]])
        far = int(np.argmax(((points - points[0]) ** 2).sum(axis=1)))
        kept[[0, far]] = True
        todo = [(0, far), (far, n)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            p, q, mid = closed[a], closed[b], closed[a + 1 : b]
            length = float(((q - p) ** 2).sum())
            along = np.clip(((mid - p) @ (q - p)) / length, 0, 1) if length else np.zeros(len(mid))
            gap = np.sqrt(((mid - p - along[:, None] * (q - p)) ** 2).sum(axis=1))
            top = int(np.argmax(gap))
            if gap[top] > tolerance:
                kept[a + 1 + top] = True
                todo += [(a, a + 1 + top), (a + 1 + top, b)]
        out = points[kept]
        if len(out) >= 4 and not _crosses(out):
            return out
        tolerance /= 2
    return points


def polygons_in_degrees(df: DataFrame, frame: DataFrame, tolerance: float = 1e-4, keys: tuple[str, ...] = ("raster_id",), tile: int = TILE) -> DataFrame:
    """keys, cluster_id, class, class_name, area_deg2 and the closed ring of (x, y) in degrees: outer rings, simplified.

    frame: keys, lon0, lat0 (of the first cell), lon1, lat1 (of the last one), rows, columns. A cell is (last - first) / number
    of cells wide, and the first corner is at the first cell's place. Rings without an area are left out.
    """
    k = list(keys)
    rings = outlines(df, keys, tile).where("area2 > 0").join(frame, k)
    point = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))

    @F.pandas_udf(point)
    def ring_of(rows: pd.DataFrame) -> pd.Series:
        made = []
        for r in rows.itertuples(index=False):
            x = r.lon0 + np.asarray(r.xs, float) * (r.lon1 - r.lon0) / r.columns
            y = r.lat0 + np.asarray(r.ys, float) * (r.lat1 - r.lat0) / r.rows
            ring = simplified(np.column_stack([x, y]), tolerance)
            made.append([{"x": a, "y": b} for a, b in [*ring.tolist(), ring[0].tolist()]])
        return pd.Series(made)

    shaped = rings.withColumn("ring", ring_of(F.struct("xs", "ys", "lon0", "lat0", "lon1", "lat1", "rows", "columns")))
    steep = (F.col("cluster_id") < 0).cast("int")
    out = shaped.select(*k, "cluster_id", steep.alias("class"), F.when(steep == 1, "Steep").otherwise("Gentle").alias("class_name"), ring_area(F.col("ring")).alias("area_deg2"), "ring")
    return out.where("area_deg2 > 0")


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring of (x, y)."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)) / 2
