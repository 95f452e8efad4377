"""Requests of areas as plans: export tiles within limits, elevation with a halo, terrain cropped to what was asked, and
embedding rasters brought onto the terrain's grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunlattice.operators import terrain as tr
from sunlattice.operators import warp
from sunlattice.operators.areas import area_strips, cells_of
from sunlattice.operators.resample import M_PER_DEGREE, MAX_SIDE, max_pixels_one_request

#: Fixed value: how often a split is refined before it is given up.
REFINED = 512
BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def _pixels(metres: Column, scale: float) -> Column:
    return F.greatest(F.ceil(metres / scale), F.lit(1))


def _rows_between(low: Column, high: Column, k: Column, n: Column) -> tuple[Column, Column]:
    return low + (high - low) * k / n, low + (high - low) * (k + 1) / n


def tile_counts(scale: float, bands: int = 1, max_side: int = MAX_SIDE) -> Column:
    """struct(tx, ty): into how many columns and rows of tiles the box of a row is split, so that no tile's side or area is
    over the limits. The split grows along the side that breaks the limit, the longer one if it is the area.

    All tiles are as wide; the widest in pixels are those of the row nearest to the equator, so only that one is looked at.
    """
    lon0, lat0, lon1, lat1 = (F.col(c) for c in BOX)
    most = max_pixels_one_request(bands)

    def across(south: Column, north: Column, width: Column) -> Column:
        return _pixels(width * (M_PER_DEGREE * F.cos(F.radians((south + north) / 2.0))), scale)

    def refined(s: Column, _: Column) -> Column:
        near = F.least(F.greatest(F.floor(-lat0 / (lat1 - lat0) * s["ty"]), F.lit(0)), s["ty"] - 1)
        south, north = _rows_between(lat0, lat1, near, s["ty"])
        nx = across(south, north, (lon1 - lon0) / s["tx"])
        ny = _pixels((lat1 - lat0) / s["ty"] * M_PER_DEGREE, scale)
        wide = (nx > max_side) | ((ny <= max_side) & (nx * ny > most) & (nx >= ny))
        fits = (nx <= max_side) & (ny <= max_side) & (nx * ny <= most)
        one = F.lit(1).cast("long")
        grown = F.struct((s["tx"] + F.when(wide, one).otherwise(0)).alias("tx"), (s["ty"] + F.when(wide, F.lit(0)).otherwise(one)).alias("ty"), F.lit(False).alias("done"))
        return F.when(s["done"], s).when(fits, F.struct(s["tx"].alias("tx"), s["ty"].alias("ty"), F.lit(True).alias("done"))).otherwise(grown)

    first = F.struct(
        F.ceil(across(lat0, lat1, lon1 - lon0) / max_side).alias("tx"), F.ceil(_pixels((lat1 - lat0) * M_PER_DEGREE, scale) / max_side).alias("ty"), F.lit(False).alias("done")
    )
    split = F.aggregate(F.sequence(F.lit(1), F.lit(REFINED)), first, refined)
    failed = F.raise_error(F.lit("the box can't be split within the limits")).cast("struct<tx:bigint,ty:bigint,done:boolean>")
    return F.when((lon1 > lon0) & (lat1 > lat0), F.when(split["done"], split).otherwise(failed))


def request_tiles(areas: DataFrame, scale: float = 30.0, bands: int = 1, max_side: int = MAX_SIDE) -> DataFrame:
    """A row a tile: the columns of `areas`, with the box of the tile in place of theirs, and tile_x, tile_y (from the
    south-west). Areas with an empty box, or one with a null side, have no tiles; one that can't be split is an error."""
    split = areas.withColumn("_split", tile_counts(scale, bands, max_side))
    rows = split.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_split.ty") - 1)).alias("tile_y"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_split.tx") - 1)).alias("tile_x"))
    lon = _rows_between(F.col("min_lon"), F.col("max_lon"), F.col("tile_x"), F.col("_split.tx"))
    lat = _rows_between(F.col("min_lat"), F.col("max_lat"), F.col("tile_y"), F.col("_split.ty"))
    return cells.withColumns(dict(zip(BOX, (lon[0], lat[0], lon[1], lat[1]), strict=True))).drop("_split")


def area_elevation(elevation: DataFrame, frames: DataFrame, areas: DataFrame, keys: tuple[str, ...] = ("area_id",), halo: int = 45, cell: float = 30.0) -> DataFrame:
    """The cells of each area's box and a halo of `halo` cells of `cell` metres around it: `elevation` with the keys of the
    areas, lon, lat, and `inside`, which tells the box from its halo.

    areas: keys, raster_id and the box in degrees; frames: raster_id, x0, y0, dx, dy in degrees (of the centre of cell 0, 0).
    Cells meet areas by strips of rows, so an area reads no more of a raster than it asks for.
    """
    k = list(keys)
    around = halo * cell / M_PER_DEGREE
    place = areas.join(frames.select("raster_id", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "dx", "dy")]), "raster_id")

    def corner(lon: Column, lat: Column) -> Column:
        return F.struct(((lon - F.col("_x0")) / F.col("_dx")).alias("x"), ((lat - F.col("_y0")) / F.col("_dy")).alias("y"))

    lon0, lat0, lon1, lat1 = F.col("min_lon") - around, F.col("min_lat") - around, F.col("max_lon") + around, F.col("max_lat") + around
    ring = F.array(corner(lon0, lat0), corner(lon1, lat0), corner(lon1, lat1), corner(lon0, lat1), corner(lon0, lat0))
    asked = place.where(F.least(*BOX).isNotNull()).select(*k, "raster_id", ring.alias("ring"), F.lit(True).alias("rectangle"))
    strips = area_strips(asked, [*k, "raster_id"], rectangle="rectangle")
    cells = cells_of(elevation, strips, "raster_id").drop("inside")
    bounds = place.select(*k, "raster_id", "_x0", "_y0", "_dx", "_dy", *[F.col(c).alias(f"_{c}") for c in BOX])
    located = cells.join(bounds, [*k, "raster_id"]).withColumns({"lon": F.col("_x0") + F.col("xi") * F.col("_dx"), "lat": F.col("_y0") + F.col("yi") * F.col("_dy")})
    inside = F.col("lon").between(F.col("_min_lon"), F.col("_max_lon")) & F.col("lat").between(F.col("_min_lat"), F.col("_max_lat"))
    return located.withColumn("inside", inside).drop("_x0", "_y0", "_dx", "_dy", *[f"_{c}" for c in BOX])


def area_terrain(elevation: DataFrame, frames: DataFrame, areas: DataFrame, keys: tuple[str, ...] = ("area_id",), halo: int = 45, cell: float = 30.0) -> DataFrame:
    """Terrain attributes of each area: computed with the halo, then cropped to the box. A cell that many areas ask for is a
    row for each; a raster of a single cell has its elevation and no attributes."""
    cells = area_elevation(elevation, frames, areas, keys, halo, cell)
    return tr.terrain(cells, cell, (*keys, "raster_id")).where("inside").drop("inside")


# --- arrays ----------------------------------------------------------------------------------------------------------


def _spread(df: DataFrame, column: str, size: int) -> tuple[DataFrame, list[str]]:
    """The elements of an array as columns: rows stay rows, however many bands there are."""
    names = [f"_{column}_{i}" for i in range(size)]
    return df.select(*[c for c in df.columns if c != column], *[F.get(column, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]), names


def _gathered(df: DataFrame, names: list[str], column: str) -> DataFrame:
    """Columns as an array again, NULL where all of them are."""
    some = F.coalesce(*names)
    return df.select(*[c for c in df.columns if c not in names], F.when(some.isNotNull(), F.array(*names)).alias(column))


def mosaic_arrays(tiles: DataFrame, column: str, order: str, keys: tuple[str, ...] = ("raster_id", "yi", "xi")) -> DataFrame:
    """Of overlapping tiles, the first array of each cell by `order` (ties: the smallest array); NULL where all are."""
    first = F.min(F.when(F.col(column).isNotNull(), F.struct(F.col(order).alias("o"), F.col(column).alias("v"))))
    return tiles.groupBy(*keys).agg(first.alias("_m")).select(*keys, F.col("_m.v").alias(column))


def block_mean_arrays(cells: DataFrame, column: str, size: int, block: int, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """Element by element, the mean over blocks of block x block cells; nulls are left out."""
    flat, names = _spread(cells, column, size)
    rows = [F.floor(F.col(c) / block).cast("int").alias(c) for c in ("yi", "xi")]
    return _gathered(flat.groupBy(*keys, *rows).agg(*[F.avg(n).alias(n) for n in names]), names, column)


def arrays_on_grid(tiles: DataFrame, frames: DataFrame, column: str, size: int, order: str, block: int = 1, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """keys, yi, xi and the array of each cell of the target grid: tiles are mosaicked, averaged over blocks of cells and then
    interpolated bilinearly, element by element.

    tiles: keys, yi, xi, `order`, `column`; frames: those of `warp` for the grid of single cells (its target is the grid asked
    for). Arrays are columns on the way, so no band is a row of its own.
    """
    k = list(keys)
    whole = mosaic_arrays(tiles, column, order, (*k, "yi", "xi"))
    mean = block_mean_arrays(whole, column, size, block, keys)
    coarse = frames.withColumns(
        {
            "x0": F.col("x0") + F.col("dx") * ((block - 1) / 2),
            "y0": F.col("y0") + F.col("dy") * ((block - 1) / 2),
            "dx": F.col("dx") * block,
            "dy": F.col("dy") * block,
            "rows": F.ceil(F.col("rows") / block).cast("int"),
            "columns": F.ceil(F.col("columns") / block).cast("int"),
        }
    )
    flat, names = _spread(mean, column, size)
    return _gathered(warp.warp(flat, coarse, names, (), keys), names, column)
