"""Rasters moved from one grid to another, whose projections are columns: scenes of several zones on one grid, elevation
to metres and back to its own cells.

A frame is a row a raster: zone and south (a UTM zone, or null for degrees), x0 and y0 (the centre of cell 0, 0), dx and
dy (steps; dy negative from the north), rows and columns. Target cells are made from the target frame, bounded by what the
source covers, mapped back to the source, and joined to source cells by integer indices: all bands in one join.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunlattice.operators import denoise as dn
from sunlattice.operators.resample import ALPHA, BETA, DELTA, EASTING, K0, RADIUS, SOUTH, N, utm_epsg, utm_zone

FRAME = ("zone", "south", "x0", "y0", "dx", "dy", "rows", "columns")
#: Places along each side of a raster that are mapped to find what it covers, and the cells added around that.
SIDE, MARGIN = 16, 1
#: Digits of a place in cell units, so that rounding never asks for a neighbour of no weight.
DIGITS = 9


def _staged(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """Columns in steps, so that a value that the next step uses often is computed once a row."""
    for step in steps:
        df = df.withColumns(step)
    return df


def moved(df: DataFrame, x: Column, y: Column, p: str, q: str, names: tuple[str, str] = ("mx", "my")) -> DataFrame:
    """`df` with the map coordinates x, y of its frame with the prefix p in those of its frame with the prefix q.

    Northings go on through the equator: the frame says which offset holds. In one projection coordinates stay as they are.
    """
    zone, other = F.col(f"{p}zone"), F.col(f"{q}zone")
    offset = {n: F.when(F.coalesce(F.col(f"{n}south"), F.lit(False)), SOUTH).otherwise(0.0) for n in (p, q)}
    same = zone.eqNullSafe(other) & (offset[p] == offset[q])
    c = F.col
    u, v = c("_u"), c("_v")
    deg = _staged(
        df,
        {"_x": x, "_y": y},
        {"_u": (c("_y") - offset[p]) / (K0 * RADIUS), "_v": (c("_x") - EASTING) / (K0 * RADIUS)},
        {
            "_s": sum((-b * F.sin(2 * j * u) * F.cosh(2 * j * v) for j, b in enumerate(BETA, 1)), u),
            "_t": sum((-b * F.cos(2 * j * u) * F.sinh(2 * j * v) for j, b in enumerate(BETA, 1)), v),
        },
        {"_c": F.asin(F.sin("_s") / F.cosh("_t")), "_l": F.degrees(F.atan2(F.sinh("_t"), F.cos("_s"))) + 6.0 * zone - 183.0},
        {"_p": F.degrees(sum((d * F.sin(2 * j * c("_c")) for j, d in enumerate(DELTA, 1)), c("_c")))},
        {"_lon": F.when(zone.isNull(), c("_x")).otherwise(c("_l")), "_lat": F.when(zone.isNull(), c("_y")).otherwise(c("_p"))},
    )
    k = 2 * sqrt(N) / (1 + N)
    sine = F.sin(F.radians("_lat"))
    out = _staged(
        deg,
        {"_t": F.sinh(F.atanh(sine) - k * F.atanh(k * sine)), "_l": F.radians("_lon") - F.radians(6.0 * other - 183.0)},
        {"_u": F.atan2(c("_t"), F.cos("_l")), "_v": F.atanh(F.sin("_l") / F.sqrt(1 + c("_t") * c("_t")))},
        {
            "_s": sum((a * F.sin(2 * j * u) * F.cosh(2 * j * v) for j, a in enumerate(ALPHA, 1)), u),
            "_t": sum((a * F.cos(2 * j * u) * F.sinh(2 * j * v) for j, a in enumerate(ALPHA, 1)), v),
        },
        {
            names[0]: F.when(same, c("_x")).when(other.isNull(), c("_lon")).otherwise(EASTING + K0 * RADIUS * c("_t")),
            names[1]: F.when(same, c("_y")).when(other.isNull(), c("_lat")).otherwise(offset[q] + K0 * RADIUS * c("_s")),
        },
    )
    return out.drop("_x", "_y", "_u", "_v", "_s", "_t", "_c", "_l", "_p", "_lon", "_lat")


def outline(frames: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each of the places on the outer edge of every frame's cells: the frame, a and b (shares of its width and
    height), and the place in the target's map coordinates, ex and ey."""
    at = [i / SIDE for i in range(SIDE + 1)]
    spots = sorted({(a, b) for s in at for a, b in ((s, 0.0), (s, 1.0), (0.0, s), (1.0, s))})
    places = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in spots])
    rows = frames.select("*", F.explode(places).alias("_e")).select("*", "_e.*").drop("_e")
    x = F.col("x0") + (F.col("columns") * F.col("a") - 0.5) * F.col("dx")
    y = F.col("y0") + (F.col("rows") * F.col("b") - 0.5) * F.col("dy")
    return moved(rows, x, y, "", "t_", ("ex", "ey"))


def target_cells(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys, yi, xi (target indices), fy, fx (the place in source cell units), rows and columns (of the source) of the target
    cells in the box of what the source covers.

    frames: keys (a row each), FRAME of the source, and FRAME with the prefix `t_` of the target; t_rows and t_columns may
    be null, and then nothing but the source bounds the target.
    """
    places = outline(frames, keys).withColumns({"tx": (F.col("ex") - F.col("t_x0")) / F.col("t_dx"), "ty": (F.col("ey") - F.col("t_y0")) / F.col("t_dy")})
    ends = [f(F.col(c)).cast("int").alias(n) for c, n, f in (("tx", "_x_lo", lambda v: F.floor(F.min(v)) - MARGIN), ("tx", "_x_hi", lambda v: F.ceil(F.max(v)) + MARGIN), ("ty", "_y_lo", lambda v: F.floor(F.min(v)) - MARGIN), ("ty", "_y_hi", lambda v: F.ceil(F.max(v)) + MARGIN))]
    seen = frames.join(places.groupBy(*keys).agg(*ends), keys)

    def between(axis: str, size: str) -> Column:
        low, high, limit = F.col(f"_{axis}_lo"), F.col(f"_{axis}_hi"), F.col(size).cast("int")
        low = F.when(limit.isNull(), low).otherwise(F.greatest(low, F.lit(0)))
        high = F.when(limit.isNull(), high).otherwise(F.least(high, limit - 1))
        return F.when(low <= high, F.sequence(low, high))

    rows = seen.select("*", F.explode(between("y", "t_rows")).alias("yi"))
    cells = rows.select("*", F.explode(between("x", "t_columns")).alias("xi"))
    x, y = F.col("mx"), F.col("my")
    cells = moved(cells, F.col("t_x0") + F.col("xi") * F.col("t_dx"), F.col("t_y0") + F.col("yi") * F.col("t_dy"), "t_", "")
    place = cells.select(*keys, "yi", "xi", "rows", "columns", F.round((y - F.col("y0")) / F.col("dy"), DIGITS).alias("fy"), F.round((x - F.col("x0")) / F.col("dx"), DIGITS).alias("fx"))
    return place


def warp(cells: DataFrame, frames: DataFrame, bands: list[str], nearest: tuple[str, ...] = (), keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """keys, yi, xi of the target grid with bands interpolated bilinearly and `nearest` columns taken from the nearest cell.

    A band is NULL where one of the source cells it needs is missing, outside the raster or NULL; a nearest column is that of
    the nearest cell, if there is one (half way: the cell of the larger index). Target cells without any of their source
    cells have no row. Sources without a frame have no rows. cells: keys, yi, xi and the columns; `frames`: see `target_cells`.
    """
    k = list(keys)
    targets = target_cells(frames, k)
    # what a cell needs is judged after the corners are made, in one condition: pushed below, it would hold the projection many times
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    spread = targets.select("*", F.explode(corners).alias("c"))
    v, u = F.col("fy") - F.floor("fy"), F.col("fx") - F.floor("fx")
    sy, sx = F.floor("fy") + F.col("c.a"), F.floor("fx") + F.col("c.b")
    weight = F.when(F.col("c.a") == 1, v).otherwise(1 - v) * F.when(F.col("c.b") == 1, u).otherwise(1 - u)
    near = (F.floor(F.col("fy") + 0.5) == sy) & (F.floor(F.col("fx") + 0.5) == sx)
    far = (F.col("fy") <= -1) | (F.col("fy") >= F.col("rows")) | (F.col("fx") <= -1) | (F.col("fx") >= F.col("columns"))
    spread = spread.where(F.when(far, False).otherwise((weight > 0) | near))
    spread = spread.select(*k, "yi", "xi", sy.cast("int").alias("sy"), sx.cast("int").alias("sx"), weight.alias("w"), near.alias("near"))
    source = cells.select(*k, F.col("yi").alias("sy"), F.col("xi").alias("sx"), *[F.col(b).alias(f"_{b}") for b in (*bands, *nearest)], F.lit(True).alias("_some"))
    met = spread.join(source, [*k, "sy", "sx"], "left")
    used = F.col("w") > 0
    made = [F.when(F.count_if(used) == F.count_if(used & F.col(f"_{b}").isNotNull()), F.sum(F.when(used, F.col("w") * F.col(f"_{b}")))).alias(b) for b in bands]
    made += [F.max(F.when(F.col("near"), F.col(f"_{b}"))).alias(b) for b in nearest]
    out = met.groupBy(*k, "yi", "xi").agg(*made, F.max("_some").alias("_some")).where("_some")
    return out.drop("_some")


def onto(frames: DataFrame, **target) -> DataFrame:
    """`frames` with one target frame for all: zone, south, x0, y0, dx, dy and, if it is bounded, rows and columns."""
    kinds = {"zone": "int", "south": "boolean", "rows": "int", "columns": "int"}
    return frames.withColumns({f"t_{c}": F.lit(target.get(c)).cast(kinds.get(c, "double")) for c in FRAME})


def utm_frames(frames: DataFrame, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """Frames in degrees with, as their target, the metric frame of the zone of their middle.

    The target covers the source; its square cells have the size that leaves as many of them on the diagonal as the source has.
    """
    mid_x = F.col("x0") + (F.col("columns") - 1) / 2.0 * F.col("dx")
    mid_y = F.col("y0") + (F.col("rows") - 1) / 2.0 * F.col("dy")
    zoned = frames.withColumns({"t_zone": utm_zone(mid_x, mid_y), "t_south": utm_epsg(mid_y, mid_x) >= 32700})

    places = outline(zoned.withColumns({f"t_{c}": F.lit(None) for c in ("x0", "y0", "dx", "dy")}), list(keys))
    corner = lambda c, at: F.max(F.when((F.col("a") == at) & (F.col("b") == at), F.col(c)))
    span = [corner(c, 1.0) - corner(c, 0.0) for c in ("ex", "ey")]
    found = places.groupBy(*keys).agg(
        *[f(c).alias(f"_{n}_{c}") for c in ("ex", "ey") for n, f in (("lo", F.min), ("hi", F.max))], F.sqrt(span[0] * span[0] + span[1] * span[1]).alias("_span")
    )
    joined = zoned.join(found, list(keys))
    cell = F.col("_span") / F.sqrt((F.col("rows") * F.col("rows") + F.col("columns") * F.col("columns")).cast("double"))
    sized = joined.withColumn("_cell", cell)
    return sized.withColumns(
        {
            "t_x0": F.col("_lo_ex") + F.col("_cell") / 2,
            "t_y0": F.col("_hi_ey") - F.col("_cell") / 2,
            "t_dx": F.col("_cell"),
            "t_dy": -F.col("_cell"),
            "t_rows": F.ceil((F.col("_hi_ey") - F.col("_lo_ey")) / F.col("_cell")).cast("int"),
            "t_columns": F.ceil((F.col("_hi_ex") - F.col("_lo_ex")) / F.col("_cell")).cast("int"),
        }
    ).drop("_lo_ex", "_hi_ex", "_lo_ey", "_hi_ey", "_span", "_cell")


def turned(frames: DataFrame) -> DataFrame:
    """Frames with source and target changed for one another."""
    names = {c: f"t_{c}" for c in FRAME} | {f"t_{c}": c for c in FRAME}
    return frames.select([F.col(c).alias(names.get(c, c)) for c in frames.columns])


def denoise_round_trip(cells: DataFrame, frames: DataFrame, method: str = "feature_preserving", value: str = "elevation", keys: tuple[str, ...] = ("raster_id",), **options) -> DataFrame:
    """`cells` with <value>_denoised: rasters in degrees are moved to metres, filtered there and moved back to their own
    cells; rasters in metres are filtered as they are.

    Cells whose value is lost at a border (a source cell is missing on one of the ways) have NULL, and so have rasters
    without a frame. Other columns of the cells stay.
    """
    k = list(keys)
    degrees, metres = frames.where("zone is null"), frames.where("zone is not null")
    there = utm_frames(degrees, keys)
    flat = warp(cells.select(*k, "yi", "xi", value), there, [value], (), keys)
    quiet = dn.denoise(flat, method, value, keys=keys, **options).select(*k, "yi", "xi", F.col(f"{value}_denoised").alias(value))
    back = warp(quiet, turned(there), [value], (), keys)
    own = cells.select(*k, "yi", "xi", value).join(metres.select(*k), k, "left_semi")
    straight = dn.denoise(own, method, value, keys=keys, **options).select(*k, "yi", "xi", F.col(f"{value}_denoised").alias(value))
    done = back.select(*k, "yi", "xi", value).unionByName(straight).withColumnRenamed(value, f"{value}_denoised")
    return cells.join(done, [*k, "yi", "xi"], "left")
