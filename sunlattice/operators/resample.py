"""Projection and resampling: UTM by Krüger series, bilinear and block means, mosaics, export tiles."""

from __future__ import annotations

from math import ceil, cos, radians, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: WGS84 and the UTM grid.
A, FLAT, K0, EASTING, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 1e7
N = FLAT / (2 - FLAT)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)
#: Limits of one export request.
MAX_SIDE, MAX_BYTES, SAFETY = 32_600, 50_331_648, 0.88
M_PER_DEGREE = 111_320.0


def utm_zone(lon: Column, lat: Column | None = None) -> Column:
    """The zone of a longitude; with a latitude, also by the exceptions of south-west Norway and Svalbard."""
    plain = F.least(F.floor((lon + 180.0) / 6.0) + 1, F.lit(60))
    if lat is None:
        return plain.cast("int")
    norway = (lat >= 56.0) & (lat < 64.0) & (lon >= 3.0) & (lon < 12.0)
    svalbard = (lat >= 72.0) & (lat <= 84.0) & (lon >= 0.0) & (lon < 42.0)
    far = F.when(lon < 9.0, 31).when(lon < 21.0, 33).when(lon < 33.0, 35).otherwise(37)
    return F.when(norway, 32).when(svalbard, far).otherwise(plain).cast("int")


def utm_epsg(lat: Column, lon: Column) -> Column:
    return (F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon, lat)).cast("int")


def utm_forward(lat: Column, lon: Column, zone: Column | None = None) -> dict[str, Column]:
    """easting and northing in metres."""
    zone = utm_zone(lon) if zone is None else zone
    phi, lam = F.radians(lat), F.radians(lon) - F.radians(6.0 * zone - 183.0)
    s = 2 * sqrt(N) / (1 + N)
    t = F.sinh(F.atanh(F.sin(phi)) - s * F.atanh(s * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e, n = eta, xi
    for j, a in enumerate(ALPHA, 1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    north = F.when(lat >= 0, 0.0).otherwise(SOUTH)
    return {"easting": EASTING + K0 * RADIUS * e, "northing": north + K0 * RADIUS * n}


def utm_inverse(easting: Column, northing: Column, zone: Column, south: Column) -> dict[str, Column]:
    xi = (northing - F.when(south, SOUTH).otherwise(0.0)) / (K0 * RADIUS)
    eta = (easting - EASTING) / (K0 * RADIUS)
    x, y = xi, eta
    for j, b in enumerate(BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(y), F.cos(x))
    return {"lat": F.degrees(phi), "lon": F.degrees(lam) + 6.0 * zone - 183.0}


def bilinear(grid: DataFrame, targets: DataFrame, value: str = "elevation", keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """`targets` (raster_id, fy, fx in cell units) with the bilinear value; NULL unless all four corners exist.

    Each target makes four rows with integer cell keys, which are joined on equality and added up with their weights.
    """
    k = list(keys)
    y0, x0 = F.floor("fy"), F.floor("fx")
    v, u = F.col("fy") - y0, F.col("fx") - x0
    corners = F.array(
        *[
            F.struct((y0 + dy).cast("int").alias("yi"), (x0 + dx).cast("int").alias("xi"), w.alias("w"))
            for dy, dx, w in ((0, 0, (1 - v) * (1 - u)), (0, 1, (1 - v) * u), (1, 0, v * (1 - u)), (1, 1, v * u))
        ]
    )
    # a corner of weight zero isn't needed
    spread = targets.select("*", F.explode(F.filter(corners, lambda c: c["w"] > 0)).alias("c")).select("*", "c.yi", "c.xi", "c.w").drop("c")
    joined = spread.join(grid.select(*k, "yi", "xi", F.col(value).alias("_z")), [*k, "yi", "xi"], "left")
    whole = F.count("*") == F.count("_z")
    return joined.groupBy(*targets.columns).agg(F.when(whole, F.sum(F.col("w") * F.col("_z"))).alias(value))


def reproject(grid: DataFrame, frame: dict[str, float], zone: int, south: bool, value: str = "elevation", keys: tuple[str, ...] = ("raster_id",), cell_m: float = 30.0) -> DataFrame:
    """A longitude/latitude grid on the metric UTM grid that covers it: bilinear, NULL without four source cells.

    frame: lon0, lat0 (the centre of cell 0, 0), dlon, dlat (steps, dlat negative from the north). Target cells are made
    by range from the extent of each raster, mapped back to source cells and joined on integer indices.
    """
    k = list(keys)
    lon, lat = frame["lon0"] + F.col("xi") * frame["dlon"], frame["lat0"] + F.col("yi") * frame["dlat"]
    metres = grid.select(*k, *[c.alias(n) for n, c in utm_forward(lat, lon, F.lit(zone)).items()])
    box = metres.groupBy(*k).agg(
        *[F.floor(F.min(c) / cell_m).cast("int").alias(f"lo_{c}") for c in ("easting", "northing")],
        *[F.floor(F.max(c) / cell_m).cast("int").alias(f"hi_{c}") for c in ("easting", "northing")],
    )
    rows = box.select("*", F.explode(F.sequence("lo_northing", "hi_northing")).alias("n"))
    cells = rows.select(*k, "n", "hi_northing", "lo_easting", F.explode(F.sequence("lo_easting", "hi_easting")).alias("e"))
    back = utm_inverse((F.col("e") + 0.5) * cell_m, (F.col("n") + 0.5) * cell_m, F.lit(zone), F.lit(south))
    targets = cells.select(
        *k,
        (F.col("hi_northing") - F.col("n")).alias("row"),
        (F.col("e") - F.col("lo_easting")).alias("column"),
        ((F.col("e") + 0.5) * cell_m).alias("easting"),
        ((F.col("n") + 0.5) * cell_m).alias("northing"),
        ((back["lat"] - frame["lat0"]) / frame["dlat"]).alias("fy"),
        ((back["lon"] - frame["lon0"]) / frame["dlon"]).alias("fx"),
    )
    made = bilinear(grid, targets, value, keys)
    return made.select(*k, F.col("row").alias("yi"), F.col("column").alias("xi"), "easting", "northing", value)


def spacing(df: DataFrame, axis: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The median distance of neighbouring coordinates of an axis (its resolution), for each key."""
    k = list(keys)
    places = df.select(*k, axis).where(F.col(axis).isNotNull()).distinct()
    step = F.abs(F.col(axis) - F.lag(axis).over(Window.partitionBy(*(k or [F.lit(0)])).orderBy(axis)))
    return places.withColumn("step", step).groupBy(*k).agg(F.median("step").alias("resolution"))


def to_long(df: DataFrame, bands: list[str], keys: list[str], band: str = "band", value: str = "value", row: str | None = None) -> DataFrame:
    """A row a band instead of a column a band. With `row` each row gets a number of that name, which keeps rows of equal
    keys apart on the way back; without it keys are meant to be unique."""
    numbered = df.withColumn(row, F.monotonically_increasing_id()) if row else df
    return numbered.unpivot([*keys, *([row] if row else [])], bands, band, value)


def to_wide(df: DataFrame, bands: list[str], keys: list[str], band: str = "band", value: str = "value", row: str | None = None) -> DataFrame:
    """A column a band instead of a row a band; the bands are given, so no pass looks for them.

    `row` is the number that `to_long` gave. Without it each key must have one value a band: a second one is an error,
    as there is no telling which rows belong together.
    """
    if row:
        # one aggregation, whose first half puts the bands of a row together before anything is shuffled
        return df.groupBy(*keys, row).agg(*[F.first(F.when(F.col(band) == b, F.col(value)), True).alias(b) for b in bands]).drop(row)
    counts = df.groupBy(*keys, band).agg(F.first(value).alias(value), F.count("*").alias("_n"))
    repeated = F.raise_error(F.lit(f"rows repeat a key of {', '.join(keys)}: give a row number"))
    single = counts.withColumn(value, F.when(F.col("_n") == 1, F.col(value)).otherwise(repeated))
    return single.groupBy(*keys).pivot(band, bands).agg(F.first(value))


def block_mean(grid: DataFrame, k: int, value: str = "elevation", keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    rows, columns = F.floor(F.col("yi") / k).cast("int").alias("yi"), F.floor(F.col("xi") / k).cast("int").alias("xi")
    return grid.groupBy(*keys, rows, columns).agg(F.avg(value).alias(value))


def mosaic_first(tiles: DataFrame, value: str, order: str, keys: tuple[str, ...] = ("yi", "xi")) -> DataFrame:
    """Of overlapping tiles, the first valid value of each cell."""
    valid = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    return tiles.groupBy(*keys).agg(F.min(valid).alias("_m")).select(*keys, F.col("_m.v").alias(value))


def export_pixels(box: dict[str, Column], scale_m: float) -> dict[str, Column]:
    """Columns and rows of an export of the box."""
    mid = F.radians((box["min_lat"] + box["max_lat"]) / 2.0)
    width = (box["max_lon"] - box["min_lon"]) * (M_PER_DEGREE * F.cos(mid))
    height = (box["max_lat"] - box["min_lat"]) * M_PER_DEGREE
    return {"nx": F.greatest(F.ceil(width / scale_m), F.lit(1)), "ny": F.greatest(F.ceil(height / scale_m), F.lit(1))}


def max_pixels_one_request(bands: int) -> int:
    return max(256, int(MAX_BYTES * SAFETY / (8 * max(1, bands))))


def export_tiles(box: tuple[float, float, float, float], scale_m: float, bands: int = 1, max_side: int = MAX_SIDE) -> list[tuple[float, float, float, float]]:
    """Equal tiles of a (min_lon, min_lat, max_lon, max_lat) box that all keep to the side and size limits.

    The split is refined along the side that breaks a limit, the longer one if the size does.
    """
    min_lon, min_lat, max_lon, max_lat = box
    if max_lon <= min_lon or max_lat <= min_lat:
        raise ValueError("the box is empty")
    most = max_pixels_one_request(bands)

    def pixels(lo: float, la: float, hi: float, ha: float) -> tuple[int, int]:
        x = (hi - lo) * M_PER_DEGREE * cos(radians((la + ha) / 2))
        return max(1, ceil(x / scale_m)), max(1, ceil((ha - la) * M_PER_DEGREE / scale_m))

    wide, high = pixels(*box)
    across, up = max(1, ceil(wide / max_side)), max(1, ceil(high / max_side))
    for _ in range(512):
        dx, dy = (max_lon - min_lon) / across, (max_lat - min_lat) / up
        rows = [(min_lat + dy * j, min_lat + dy * (j + 1)) for j in range(up)]
        sizes = [pixels(min_lon, a, min_lon + dx, b) for a, b in rows]
        x, y = max(s[0] for s in sizes), max(s[1] for s in sizes)
        area = max(a * b for a, b in sizes)
        if x <= max_side and y <= max_side and area <= most:
            return [(min_lon + dx * i, a, min_lon + dx * (i + 1), b) for i in range(across) for a, b in rows]
        if x > max_side or (y <= max_side and x >= y):
            across += 1
        else:
            up += 1
    raise RuntimeError("the box can't be split within the limits")


def point_raster(lat: Column, lon: Column, resolution_m: float = 30.0) -> dict[str, Column]:
    """The bounds of the one cell about a point."""
    half = resolution_m / M_PER_DEGREE / 2
    return {"min_lon": lon - half, "min_lat": lat - half, "max_lon": lon + half, "max_lat": lat + half}
