"""End-to-end plans: from requests to responses, from a scene table to cloud statistics, from elevation to terrain,
from an insolation series to a gap-free one. Each maps DataFrames to a DataFrame lazily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.functions import finance, scoring, spectral
from sunlattice.operators import areas as area_cells
from sunlattice.operators import features, focal, scenes, segments, series, terrain
from sunlattice.plans.fixtures import cube, grid, sites, table

TERRAIN = (
    "reprojected_dem",
    "slope",
    "hillshade",
    "aspect",
    "curvature",
    "planform_curvature",
    "profile_curvature",
    "max_curvature",
    "topographic_position_index",
    "terrain_ruggedness_index",
    "roughness",
    "rugosity",
)


def evaluate(requests: DataFrame, vectors: DataFrame, cf: Column) -> DataFrame:
    """Valid requests (site_id, lat, lon, power_kw, tariff) with their features, scored and priced: one plan for all sites."""
    ok = finance.valid_request(F.col("lat"), F.col("lon"), F.col("power_kw"), F.col("tariff"))
    valid = requests.where(ok).withColumn("tariff", F.coalesce("tariff", F.lit(finance.DEFAULT_TARIFF)))
    extra = vectors.drop(*[c for c in vectors.columns if c in requests.columns and c != "site_id"])
    scored = valid.join(extra, "site_id", "left").withColumn("_cf", cf)
    money = finance.rounded_response(F.col("_cf"), F.col("power_kw"), F.col("tariff"))
    first = {k: money.pop(k) for k in ("cf", "cf_percent")}
    columns = first | scoring.classify(F.col("_cf")) | money
    return scored.select("site_id", "lat", "lon", *[c.alias(k) for k, c in columns.items()])


def terrain_rows(elevation: DataFrame, cell: float = 30.0) -> DataFrame:
    """Grid rows with all terrain variables."""
    return terrain.terrain(elevation, cell)


def fill_gaps(cube: DataFrame, method: str, keys: list[str], t: str, value: str, max_gap: int = 3) -> DataFrame:
    """drop, interpolate (along t, at most max_gap cells a gap), fill (previous, then next) or zero; others: unchanged."""
    if method == "drop":
        return series.drop_missing(cube, t, keys, value)
    if method == "interpolate":
        with_x = cube.withColumn("_x", series.seconds(F.col(t)))
        return series.interpolate(with_x, keys, "_x", value, "_f", max_gap).drop(value, "_x").withColumnRenamed("_f", value)
    if method == "fill":
        return series.ffill_bfill(cube, keys, t, value, "_f").drop(value).withColumnRenamed("_f", value)
    return series.fill_zero(cube, value, value) if method == "zero" else cube


def insolation(areas: DataFrame, points: DataFrame, slices: DataFrame, small: float = 0.1) -> DataFrame:
    """site_id, time, latitude, longitude, solar_radiation of each area, from one of two sources.

    areas: site_id and its box. Where both spans are at most `small` degrees and there is a point series (site_id, time,
    solar_radiation), that is taken, at the middle of the box; elsewhere the grid slices (site_id, time, latitude,
    longitude, ssrd; several a time), averaged for each time and cell. Slices without a value have failed and are left out.
    """
    box = areas.select("site_id", "min_lat", "max_lat", "min_lon", "max_lon")
    narrow = (F.col("max_lat") - F.col("min_lat") <= small) & (F.col("max_lon") - F.col("min_lon") <= small)
    middle = [((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(n) for c, n in (("lat", "latitude"), ("lon", "longitude"))]
    series_ = points.join(box.where(narrow).select("site_id", *middle), "site_id")
    gridded = slices.join(series_.select("site_id").distinct(), "site_id", "left_anti").join(box.select("site_id"), "site_id", "left_semi")
    value = F.when(~F.isnan("ssrd"), F.col("ssrd"))
    averaged = gridded.groupBy("site_id", "time", "latitude", "longitude").agg(F.avg(value).alias("solar_radiation")).where("solar_radiation is not null")
    columns = ["site_id", "time", "latitude", "longitude", "solar_radiation"]
    return series_.select(columns).unionByName(averaged.select(columns))


def interpolate_space(cube: DataFrame, t: str, value: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Along longitude, then along latitude, extrapolating at the ends."""
    out = cube
    for along, across in ((lon, lat), (lat, lon)):
        out = series.interpolate(out, [t, across], along, value, "_f").drop(value).withColumnRenamed("_f", value)
    return out


def cloud_statistics(
    items: DataFrame, pixels: DataFrame, targets: DataFrame, max_cloud: float, r: int, mode: str = "balanced", min_valid: int = 50, alpha: float = 0.1, nominal_days: float = 1.0
) -> DataFrame:
    """items (id, datetime, cloud) and pixels (scene_id, yi, xi, bands, fmask) to the final average of each cell.

    Scenes are chosen before any pixel is read: the choice is a semi join on the scene id ahead of the pixel plan.
    """
    usable = items.where(F.col("cloud") <= max_cloud)
    chosen = scenes.select_by_schedule(usable, targets).select(F.col("id").alias("scene_id"), F.col("datetime").alias("t"))
    read = pixels.join(chosen, "scene_id")
    made = read.withColumns(spectral.indices())
    parts = {k: c.cast("int") for k, c in spectral.hybrid_parts(mode).items()}
    flagged = made.withColumns(parts | {"valid": spectral.valid_observation()}).select("scene_id", "t", "yi", "xi", "valid", *parts)
    masked = focal.hybrid_mask(flagged, ("scene_id",))
    percent = focal.cloud_percentage(masked, r, min_valid, ("scene_id",))
    steps = series.alpha_eff(chosen.select("t").distinct(), "t", alpha, nominal_days)
    return series.ewma_final(percent.join(F.broadcast(steps), "t"), ["yi", "xi"], "t", "cloud_percentage_local")


def area_cloud_statistics(
    areas: DataFrame, targets: DataFrame, items: DataFrame, pixels: DataFrame, max_cloud: float, r: int, mode: str = "balanced", min_valid: int = 50, days: int = 20, alpha: float = 0.1, nominal_days: float = 1.0
) -> DataFrame:
    """area_id, yi, xi and the final cloud average of each cell of every area's box: one plan for all areas.

    areas: area_id, tile, ring (in cell units of the tile), rectangle; targets: area_id, target; items: tile, id, datetime,
    cloud; pixels: scene_id, yi, xi, bands, fmask. Each target takes the nearest scene of the area's tile within `days`
    (`nearest_in_window`), each scene of an area counts once. Masks are made on the whole box; outside the ring bands are
    then missing and the mask is 0, so those cells are no valid ones of a neighbourhood. Areas without a scene have no rows.
    """
    tiles = areas.select("area_id", "tile").distinct()
    asked = targets.join(tiles, "area_id")
    nearest = area_cells.nearest_in_window(items, asked.select("tile", "target").distinct(), "tile", days, max_cloud)
    chosen = asked.join(nearest.where("scene_id is not null"), ["tile", "target"])
    chosen = chosen.select("area_id", "tile", "scene_id", F.col("scene_time").alias("t")).distinct()
    strips = area_cells.area_strips(areas, ["area_id", "tile"], rectangle="rectangle").join(chosen, ["area_id", "tile"]).drop("tile")
    cells = area_cells.cells_of(pixels, strips, "scene_id")
    keys = ("area_id", "scene_id")
    made = cells.withColumns(spectral.indices())
    parts = {k: c.cast("int") for k, c in spectral.hybrid_parts(mode).items()}
    flagged = made.withColumns(parts | {"valid": spectral.valid_observation()}).select(*keys, "t", "yi", "xi", "inside", "valid", *parts)
    masked = focal.hybrid_mask(flagged, keys)
    masked = masked.withColumns({"mask": F.when(F.col("inside"), F.col("mask")).otherwise(0), "valid": F.col("valid") & F.col("inside")})
    percent = focal.cloud_percentage(masked, r, min_valid, keys)
    steps = series.alpha_eff(chosen.select("area_id", "t").distinct(), "t", alpha, nominal_days, ("area_id",))
    return series.ewma_final(percent.join(steps, ["area_id", "t"]), ["area_id", "yi", "xi"], "t", "cloud_percentage_local")


def classify_regions(terrain_table: DataFrame, variable: str = "max_curvature", threshold: float = 0.1, min_pixels: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells with class and cluster, class statistics, polygons)."""
    name = variable if variable in terrain_table.columns else {"maximum_curvature": "max_curvature"}.get(variable, variable)
    if name not in terrain_table.columns:
        raise ValueError(f"no variable {variable}")
    classed = terrain_table.withColumn("slope_class", segments.slope_class(F.col(name), threshold))
    clustered = segments.cluster_ids(classed, min_pixels)
    return clustered, segments.class_statistics(classed), segments.polygons(clustered)


def collect_features(base: DataFrame, parts: list[tuple[DataFrame, list[str], Column]], key: str = "site_id") -> DataFrame:
    """`base` (a row a site) with the five statistics of every part's variables; of equal names the last part's stays.

    A part is a table with a `zone`, its variables, and the zone that a site sees, as a column of `base`. A zone that
    many sites see is reduced once and joined to all of them; a site without a zone of a part has NULL there.
    """
    out = base
    for table_, variables, zone in parts:
        stats = features.five_stats(table_, variables, ["zone"])
        seen = base.select(key, zone.alias("zone")).join(stats, "zone").drop("zone")
        out = features.merge_right_wins(out, seen, key)
    return out


def embedding_columns(df: DataFrame, column: str, size: int, prefix: str = "emb_A") -> tuple[DataFrame, list[str]]:
    """`df` with the elements of an array column as columns of their own, and the names of these."""
    names = [f"{prefix}{i:02d}" for i in range(size)]
    return df.select("*", *[F.get(column, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]), names


EMBEDDING = 64


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with terrain, insolation, cloud and embedding statistics on the driver tables.

    A site sees one row of the grid, the events of its own number, a fiftieth of the cloud cube's cells and the
    embeddings of one label.
    """
    s, i = sites(spark, sf_dir), F.col("site_id")
    elevation = grid(spark, sf_dir)
    ground = terrain_rows(elevation).withColumn("zone", F.col("yi").cast("long"))
    n_rows = elevation.agg(F.max("yi") + 1).scalar()
    sun = table(spark, sf_dir, "events").select(F.col("user_id").alias("zone"), F.col("value").alias("solar_radiation"))
    clouds = cube(spark, sf_dir)
    steps = series.alpha_eff(clouds.select("t").distinct(), "t", 0.1, 1.0)
    final = series.ewma_final(clouds.join(steps, "t"), ["pixel"], "t", "pct")
    final = final.select((F.col("pixel") % 50).alias("zone"), F.col("ewma_final").alias("ewma_perc"))
    vectors, names = embedding_columns(table(spark, sf_dir, "embeddings"), "embedding", EMBEDDING)
    labels = vectors.agg(F.max("label") + 1).scalar()
    base = s.withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    return collect_features(
        base,
        [
            (ground, list(TERRAIN), F.pmod(i, n_rows)),
            (sun, ["solar_radiation"], i),
            (final, ["ewma_perc"], i % 50),
            (vectors.withColumn("zone", F.col("label").cast("long")), names, F.pmod(i, labels)),
        ],
    )


SURROGATE_SQL = "0.12::DOUBLE + coalesce(solar_radiation_mean, 0) / 2500.0::DOUBLE + cos(radians(lat)) * 0.05::DOUBLE - coalesce(slope_mean, 0) / 2000.0::DOUBLE"


def evaluate_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("site_id")
    requests = sites(spark, sf_dir).select(
        "site_id", "lat", "lon", (1.0 + i % 400).cast("double").alias("power_kw"), F.when(i % 5 > 0, 1.0 + i % 12).cast("double").alias("tariff")
    )
    raw = (
        F.lit(0.12)
        + F.coalesce("solar_radiation_mean", F.lit(0.0)) / 2500.0
        + F.cos(F.radians("lat")) * 0.05
        - F.coalesce("slope_mean", F.lit(0.0)) / 2000.0
    )
    return evaluate(requests, feature_vectors(spark, sf_dir), scoring.surrogate_cf(raw))
