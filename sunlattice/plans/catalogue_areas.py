"""Registered queries over many areas, scenes of several zones and tiled rasters, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sunlattice.functions import aoi
from sunlattice.operators import areas, features, requests, resample, scenes, segments, warp
from sunlattice.plans import pipeline
from sunlattice.plans.catalogue import _CELL_INDEX, _COMPONENTS, _DENOISE_SQL, _FOLD, _classes, _scene_stencil, _z_sql
from sunlattice.plans.fixtures import GRID, PIXELS, SCENES, SITES, WIDTH, grid, pixels, scene_cells, scene_items, sites, table
from sunlattice.plans.registry import register
from sunlattice.sources import geotiff, netcdf, sinks, stac
from sunlattice.sources.tables import shared_folder

#: Outline of the areas of suppliers, about their middle and in units of their radius; not convex.
_OUTLINE = ((-1.0, -0.9), (0.2, -0.35), (1.1, -0.8), (0.6, 0.3), (0.9, 1.0), (-0.7, 0.75), (-1.0, -0.9))


def _rings(s, d, middle_x, middle_y, radius, **columns):
    """A ring a supplier, in cell units, with more columns."""
    points = F.array(*[F.struct((middle_x + radius * F.lit(a)).alias("x"), (middle_y + radius * F.lit(b)).alias("y")) for a, b in _OUTLINE])
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("area_id"), points.alias("ring"), *[c.alias(n) for n, c in columns.items()])


def _edges_sql(middle_x: str, middle_y: str, radius: str) -> str:
    """(area_id, x1, y1, x2, y2) of the same rings."""
    edges = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(_OUTLINE, _OUTLINE[1:], strict=False))
    return f"""edges AS (SELECT s_suppkey AS area_id, {middle_x} + {radius} * a AS x1, {middle_y} + {radius} * b AS y1, {middle_x} + {radius} * c AS x2, {middle_y} + {radius} * d AS y2
      FROM supplier, (VALUES {edges}) o(a, b, c, d)),
    box AS (SELECT area_id, min(x1) AS x_lo, max(x1) AS x_hi, min(y1) AS y_lo, max(y1) AS y_hi FROM edges GROUP BY area_id)"""


_INSIDE = "(SELECT count(*) FILTER ((y1 > yi) <> (y2 > yi) AND xi < (x2 - x1) * (yi - y1) / (y2 - y1) + x1) % 2 = 1 FROM edges WHERE edges.area_id = c.area_id)"


@register(
    "area_masks",
    f"""WITH {PIXELS}, {_edges_sql("(s_suppkey * 37 % 100)::DOUBLE", "(s_suppkey * 53 % 100)::DOUBLE", "(3.37::DOUBLE + s_suppkey % 17)")},
    p AS (SELECT l_suppkey % 10 AS raster_id, l_orderkey % 100 AS yi, l_partkey % 100 AS xi, b04, fmask FROM pixels),
    c AS (SELECT area_id, p.* FROM p JOIN box ON box.area_id % 10 = p.raster_id AND xi BETWEEN x_lo AND x_hi AND yi BETWEEN y_lo AND y_hi),
    m AS (SELECT c.*, {_INSIDE} AS inside FROM c)
    SELECT area_id, count(*) AS cells, count(*) FILTER (inside) AS inside, round(avg(b04) FILTER (inside), 12) AS b04_mean,
      sum(CASE WHEN inside THEN fmask ELSE 0 END)::BIGINT AS mask_sum FROM m GROUP BY area_id""",
)
def area_masks(s, d):
    k = F.col("s_suppkey")
    rings = _rings(s, d, (k * 37 % 100).cast("double"), (k * 53 % 100).cast("double"), 3.37 + k % 17, raster_id=k % 10)
    cells = pixels(s, d).select(
        (F.col("l_suppkey") % 10).alias("raster_id"), (F.col("l_orderkey") % 100).cast("int").alias("yi"), (F.col("l_partkey") % 100).cast("int").alias("xi"), "b04", "fmask"
    )
    # pixels of one cell are added up first: areas then meet cells, whose number the rasters bound, and not pixels
    cells = cells.groupBy("raster_id", "yi", "xi").agg(
        F.count("*").alias("n"), F.count("b04").alias("b04_n"), F.sum("b04").alias("b04"), F.sum("fmask").alias("fmask")
    )
    masked = areas.masked_cells(cells, areas.area_strips(rings, ["area_id", "raster_id"]), "raster_id", ["b04", "b04_n"], "fmask")
    mean = F.try_divide(F.sum("b04"), F.sum("b04_n"))
    return masked.groupBy("area_id").agg(
        F.sum("n").alias("cells"), F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.round(mean, 12).alias("b04_mean"), F.sum("fmask").alias("mask_sum")
    )


@register(
    "areas_on_scenes",
    """WITH a AS (SELECT s_suppkey AS k, -60 + (s_suppkey * 7919 % 12000) / 100.0::DOUBLE AS y, -180 + (s_suppkey * 104729 % 36000) / 100.0::DOUBLE AS x FROM supplier),
    b AS (SELECT c_custkey AS k, -60 + (c_custkey * 613 % 12000) / 100.0::DOUBLE AS y, -180 + (c_custkey * 7919 % 36000) / 100.0::DOUBLE AS x FROM customer)
    SELECT a.k AS site_id, count(*) AS scenes, min(b.k) AS first_scene, max(b.k) AS last_scene FROM a JOIN b
      ON a.x - 0.4::DOUBLE <= b.x + 1.7::DOUBLE AND b.x <= a.x + 0.4::DOUBLE AND a.y - 0.4::DOUBLE <= b.y + 1.7::DOUBLE AND b.y <= a.y + 0.4::DOUBLE GROUP BY a.k""",
)
def areas_on_scenes(s, d):
    near = sites(s, d).select("site_id", *[(F.col(k) + e).alias(f"{m}_{k}") for k in ("lat", "lon") for m, e in (("min", -0.4), ("max", 0.4))])
    k = F.col("c_custkey")
    scenes = table(s, d, "customer").select(
        k.alias("id"), (-60 + F.pmod(k * 613, F.lit(12000)) / 100.0).alias("min_lat"), (-180 + F.pmod(k * 7919, F.lit(36000)) / 100.0).alias("min_lon")
    )
    scenes = scenes.withColumns({"max_lat": F.col("min_lat") + 1.7, "max_lon": F.col("min_lon") + 1.7})
    met = areas.box_join(near, scenes)
    return met.groupBy("site_id").agg(F.count("*").alias("scenes"), F.min("r_id").alias("first_scene"), F.max("r_id").alias("last_scene"))


_TILED_ITEMS = "items AS (SELECT o_orderkey AS id, o_custkey % 7 AS tile, o_orderdate::TIMESTAMP AS datetime, CASE WHEN o_orderkey % 11 > 0 THEN ((o_orderkey * 37) % 101)::DOUBLE END AS cloud FROM orders)"


def _tiled_items(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(
        k.alias("id"),
        (F.col("o_custkey") % 7).alias("tile"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("datetime"),
        F.when(k % 11 > 0, F.pmod(k * 37, F.lit(101)).cast("double")).alias("cloud"),
    )


@register(
    "nearest_scene_of_sites",
    f"""WITH {_TILED_ITEMS}, asked AS (SELECT c_custkey AS site_id, c_custkey % 8 AS tile, TIMESTAMP '1991-12-20' + to_hours((c_custkey * 7919) % 62000) AS target FROM customer),
    near AS (SELECT site_id, id, datetime, items.cloud, abs(epoch(datetime) - epoch(target)) AS gap, coalesce(items.cloud <= 2, false) AS clear
      FROM asked JOIN items ON items.tile = asked.tile AND abs(epoch(datetime) - epoch(target)) <= 20 * 86400),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY clear DESC, gap, cloud NULLS LAST, id) AS k FROM near)
    SELECT asked.site_id, target, id AS scene_id, cloud AS scene_cloud, gap::BIGINT AS gap_s FROM asked LEFT JOIN ranked ON ranked.site_id = asked.site_id AND k = 1""",
)
def nearest_scene_of_sites(s, d):
    k = F.col("c_custkey")
    at = F.timestamp_add("HOUR", F.pmod(k * 7919, F.lit(62000)), F.lit("1991-12-20").cast("timestamp_ntz"))
    asked = table(s, d, "customer").select(k.alias("site_id"), (k % 8).alias("tile"), at.alias("target"))
    found = areas.nearest_in_window(_tiled_items(s, d), asked, "tile", 20, 2.0)
    return found.select("site_id", "target", "scene_id", "scene_cloud", "gap_s")


def _area_stencils() -> str:
    steps = (("p", "cloud", "c1", -1, 1, False), ("c1", "cloud", "c2", -1, 1, True), ("c2", "cloud", "c3", 0, 1, False), ("p", "shadow", "s1", -1, 1, False), ("s1", "shadow", "s2", -1, 1, True), ("p", "haze", "h1", -1, 0, True), ("h1", "haze", "h2", 0, 1, False))
    keyed = ", ".join(_scene_stencil(*x) for x in steps)
    return keyed.replace("SELECT a.scene_id,", "SELECT a.area_id, a.scene_id,").replace("ON b.scene_id = a.scene_id", "ON b.area_id = a.area_id AND b.scene_id = a.scene_id")


@register(
    "area_cloud_statistics",
    f"""WITH {SCENES}, {_edges_sql("(s_suppkey * 7 % 12)::DOUBLE", "(s_suppkey * 5 % 12)::DOUBLE", "(2.37::DOUBLE + s_suppkey % 4)")},
    asked AS (SELECT s_suppkey AS area_id, TIMESTAMP '2018-01-01' + to_hours((s_suppkey * 977 % 9000 + 700 * n)::BIGINT) AS target FROM supplier, range(3) r(n)),
    ranked AS (SELECT asked.area_id, target, id, datetime, row_number() OVER (PARTITION BY asked.area_id, target ORDER BY cloud <= 40 DESC, abs(epoch(datetime) - epoch(target)), cloud, id) AS k
      FROM asked JOIN items ON id % 3 = asked.area_id % 3 AND abs(epoch(datetime) - epoch(target)) <= 40 * 86400),
    chosen AS (SELECT DISTINCT area_id, id AS scene_id, datetime AS t FROM ranked WHERE k = 1),
    c AS (SELECT chosen.area_id, t, cells.* FROM cells JOIN chosen ON chosen.scene_id = cells.scene_id JOIN box ON box.area_id = chosen.area_id AND xi BETWEEN x_lo AND x_hi AND yi BETWEEN y_lo AND y_hi),
    read AS (SELECT c.*, area_id % 4 = 0 OR {_INSIDE} AS inside FROM c), {_CELL_INDEX},
    f AS (SELECT *, coalesce(fmask & 3 > 0 OR (vis_mean > 0.23 AND b02 > 0.20 AND hot > 0.04 AND blue_nir > 0.90 AND whiteness < 0.28), false) AS is_cloud, fmask & 15 > 0 AS qa FROM i),
    p AS (SELECT *, is_cloud::INT AS cloud, ((fmask >> 3) & 1)::INT AS shadow, coalesce((((b01 > 0.075 AND b02 > 0.070 AND coastal_swir > 0.55)
      OR (hot > -0.01 AND blue_nir > 0.58 AND b11 < 0.20)) AND whiteness < 0.40 AND vis_mean > 0.07) AND ((fmask >> 6) = 3 OR ((fmask >> 6) = 2 AND hot > 0))
      AND NOT (fmask & 48 > 0 OR ndwi > 0.12) AND NOT (qa OR is_cloud), false)::INT AS haze, (b01 + b02 + b03 + b04 + b8a + b11 + b12) IS NOT NULL AND inside AS valid FROM f),
    {_area_stencils()},
    m AS (SELECT p.area_id, p.scene_id, p.t, p.yi, p.xi, valid::INT AS valid, greatest(c3.cloud, s2.shadow, h2.haze) * valid::INT AS hit FROM p JOIN c3 USING (area_id, scene_id, yi, xi) JOIN s2 USING (area_id, scene_id, yi, xi) JOIN h2 USING (area_id, scene_id, yi, xi)),
    k AS (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE dy * dy + dx * dx <= 1),
    e AS (SELECT area_id, scene_id, min(yi) AS y0, max(yi) AS y1, min(xi) AS x0, max(xi) AS x1 FROM m GROUP BY ALL),
    j AS (SELECT a.area_id, a.t, a.yi, a.xi, sum(b.hit) AS c, sum(b.valid) AS v FROM m a JOIN e USING (area_id, scene_id), k JOIN m b ON b.area_id = a.area_id AND b.scene_id = a.scene_id AND b.yi = greatest(y0, least(y1, a.yi + dy)) AND b.xi = greatest(x0, least(x1, a.xi + dx)) GROUP BY ALL),
    al AS (SELECT area_id, t, CASE WHEN lag(t) OVER w IS NOT NULL THEN 1 - (1 - 0.1::DOUBLE) ** ((epoch(t) - epoch(lag(t) OVER w)) / 86400.0::DOUBLE / 30.0::DOUBLE) END AS a FROM (SELECT DISTINCT area_id, t FROM chosen) WINDOW w AS (PARTITION BY area_id ORDER BY t)),
    l AS (SELECT j.area_id, yi, xi, list_prepend(struct_pack(v := NULL::DOUBLE, a := 0::DOUBLE), list(struct_pack(v := CASE WHEN j.v >= 3 THEN 100.0::DOUBLE * c / j.v END, a := al.a) ORDER BY j.t)) AS l FROM j JOIN al ON al.area_id = j.area_id AND al.t = j.t GROUP BY j.area_id, yi, xi)
    SELECT area_id, yi::INTEGER AS yi, xi::INTEGER AS xi, round(list_reduce(l, {_FOLD}).v, 6) AS ewma_perc FROM l""",
)
def area_cloud_statistics(s, d):
    k = F.col("s_suppkey")
    rings = _rings(s, d, (k * 7 % 12).cast("double"), (k * 5 % 12).cast("double"), 2.37 + k % 4, tile=k % 3, rectangle=k % 4 == 0)
    first = F.timestamp_add("HOUR", k * 977 % 9000, F.lit("2018-01-01").cast("timestamp_ntz"))
    asked = table(s, d, "supplier").select(k.alias("area_id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda n: F.timestamp_add("HOUR", n * 700, first))).alias("target"))
    items = scene_items(s, d).withColumn("tile", F.col("id") % 3)
    final = pipeline.area_cloud_statistics(rings, asked, items, scene_cells(s, d), 40.0, 1, min_valid=3, days=40, nominal_days=30.0)
    return final.select("area_id", "yi", "xi", F.round("ewma_final", 6).alias("ewma_perc"))


# --- grids of several projections ------------------------------------------------------------------------------------

_SCALE = resample.K0 * resample.RADIUS


def _forward_sql(name: str, source: str, zone: str, south: str = "false") -> str:
    """CTEs up to `name`: the columns of `source` (with lat and lon), easting and northing."""
    e = " + ".join(["ee"] + [f"({a!r}::DOUBLE * cos({2 * j} * xx) * sinh({2 * j} * ee))" for j, a in enumerate(resample.ALPHA, 1)])
    n = " + ".join(["xx"] + [f"({a!r}::DOUBLE * sin({2 * j} * xx) * cosh({2 * j} * ee))" for j, a in enumerate(resample.ALPHA, 1)])
    k = 2 * resample.N**0.5 / (1 + resample.N)
    return f"""{name}_1 AS (SELECT *, sinh(atanh(sin(radians(lat))) - {k!r}::DOUBLE * atanh({k!r}::DOUBLE * sin(radians(lat)))) AS tt, radians(lon) - radians(6.0::DOUBLE * {zone} - 183.0::DOUBLE) AS ll FROM {source}),
    {name}_2 AS (SELECT *, atan2(tt, cos(ll)) AS xx, atanh(sin(ll) / sqrt(1 + tt * tt)) AS ee FROM {name}_1),
    {name} AS (SELECT * EXCLUDE (tt, ll, xx, ee), 500000.0::DOUBLE + {_SCALE!r}::DOUBLE * ({e}) AS easting, CASE WHEN {south} THEN 1e7::DOUBLE ELSE 0 END + {_SCALE!r}::DOUBLE * ({n}) AS northing FROM {name}_2)"""


def _inverse_sql(name: str, source: str, zone: str, south: str = "false") -> str:
    """CTEs up to `name`: the columns of `source` (with px and py in metres), lat and lon."""
    x = " - ".join(["xx"] + [f"({b!r}::DOUBLE * sin({2 * j} * xx) * cosh({2 * j} * ee))" for j, b in enumerate(resample.BETA, 1)])
    y = " - ".join(["ee"] + [f"({b!r}::DOUBLE * cos({2 * j} * xx) * sinh({2 * j} * ee))" for j, b in enumerate(resample.BETA, 1)])
    phi = " + ".join(["chi"] + [f"({d!r}::DOUBLE * sin({2 * j} * chi))" for j, d in enumerate(resample.DELTA, 1)])
    return f"""{name}_1 AS (SELECT *, (py - CASE WHEN {south} THEN 1e7::DOUBLE ELSE 0 END) / {_SCALE!r}::DOUBLE AS xx, (px - 500000.0::DOUBLE) / {_SCALE!r}::DOUBLE AS ee FROM {source}),
    {name}_2 AS (SELECT *, {x} AS x2, {y} AS y2 FROM {name}_1), {name}_3 AS (SELECT *, asin(sin(x2) / cosh(y2)) AS chi FROM {name}_2),
    {name} AS (SELECT * EXCLUDE (xx, ee, x2, y2, chi), degrees({phi}) AS lat, degrees(atan2(sinh(y2), cos(x2))) + 6.0::DOUBLE * {zone} - 183.0::DOUBLE AS lon FROM {name}_3)"""


def _corners_sql(name: str, source: str, keys: str) -> str:
    """CTE of (keys, yi, xi, sy, sx, w, near) from places fy, fx."""
    return f"""{name} AS (SELECT {keys}, yi, xi, floor(fy) + a AS sy, floor(fx) + b AS sx, (CASE a WHEN 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE b WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS w,
      floor(fy + 0.5) = floor(fy) + a AND floor(fx + 0.5) = floor(fx) + b AS near FROM {source}, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(a, b))"""


_SCENE_FRAMES = "frames AS (SELECT s_suppkey AS scene_id, 31 + s_suppkey % 3 AS zone, CASE s_suppkey % 3 WHEN 0 THEN 690000.0::DOUBLE WHEN 1 THEN 500000.0::DOUBLE ELSE 270000.0::DOUBLE END + s_suppkey % 5 * 2900 AS x0, 5300000.0::DOUBLE + s_suppkey % 7 * 3100 AS y0 FROM supplier)"


@register(
    "scenes_on_one_grid",
    f"""WITH {SCENES}, {_SCENE_FRAMES}, mid AS (SELECT *, x0 + 16500 AS px, y0 - 16500 AS py FROM frames), {_inverse_sql("middeg", "mid", "zone")}, {_forward_sql("midto", "middeg", "32")},
    cand AS (SELECT scene_id, zone, x0, y0, (round((6000000.0::DOUBLE - northing) / 3000) + a)::INTEGER AS yi, (round((easting - 1500.0::DOUBLE) / 3000) + b)::INTEGER AS xi FROM midto, range(-14, 15) p(a), range(-14, 15) q(b)),
    spot AS (SELECT *, 1500.0::DOUBLE + xi * 3000.0::DOUBLE AS px, 6000000.0::DOUBLE - yi * 3000.0::DOUBLE AS py FROM cand), {_inverse_sql("deg", "spot", "32")}, {_forward_sql("met0", "deg", "zone")},
    place AS (SELECT scene_id, yi, xi, round((CASE zone WHEN 32 THEN py ELSE northing END - y0) / -3000.0::DOUBLE, 9) AS fy, round((CASE zone WHEN 32 THEN px ELSE easting END - x0) / 3000.0::DOUBLE, 9) AS fx FROM met0), {_corners_sql("corner", "place", "scene_id")},
    met AS (SELECT corner.*, sqrt(cells.b04 + 0.1::DOUBLE) AS b04, cells.fmask, cells.scene_id IS NOT NULL AS hit FROM corner LEFT JOIN cells ON cells.scene_id = corner.scene_id AND cells.yi = sy AND cells.xi = sx WHERE w > 0 OR near)
    SELECT scene_id, yi, xi, CASE WHEN count(*) FILTER (w > 0) = count(b04) FILTER (w > 0) THEN round(sum(w * b04) FILTER (w > 0), 6) END AS b04, max(fmask) FILTER (near) AS fmask
    FROM met GROUP BY scene_id, yi, xi HAVING bool_or(hit)""",
)
def scenes_on_one_grid(s, d):
    k = F.col("s_suppkey")
    frames = table(s, d, "supplier").select(
        k.alias("scene_id"),
        (31 + k % 3).cast("int").alias("zone"),
        F.lit(False).alias("south"),
        (F.when(k % 3 == 0, 690000.0).when(k % 3 == 1, 500000.0).otherwise(270000.0) + k % 5 * 2900).alias("x0"),
        (5300000.0 + k % 7 * 3100).alias("y0"),
        F.lit(3000.0).alias("dx"),
        F.lit(-3000.0).alias("dy"),
        F.lit(12).alias("rows"),
        F.lit(12).alias("columns"),
    )
    common = warp.onto(frames, zone=32, south=False, x0=1500.0, y0=6000000.0, dx=3000.0, dy=-3000.0)
    moved = warp.warp(scene_cells(s, d).withColumn("b04", F.sqrt(F.col("b04") + 0.1)), common, ["b04"], ("fmask",), ("scene_id",))
    return moved.select("scene_id", "yi", "xi", F.round("b04", 6).alias("b04"), "fmask")


_EDGE = sorted({(a, b) for i in range(warp.SIDE + 1) for a, b in ((i / warp.SIDE, 0.0), (i / warp.SIDE, 1.0), (0.0, i / warp.SIDE), (1.0, i / warp.SIDE))})
_GAUSS = _DENOISE_SQL["gaussian"].replace(f"WITH {GRID}, ", "").replace("grid", "metric").replace("round(", "(").replace(", 6) AS elevation", ") AS elevation")


def _round_trip_sql() -> str:
    image, _, kernel = _GAUSS.partition("\n    SELECT yi, xi, ")
    edge = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in _EDGE)
    return f"""WITH {GRID}, size AS (SELECT max(yi) + 1 AS nrow, {WIDTH} AS ncol FROM grid),
    edge AS (SELECT a, b, nrow, ncol, 9.0::DOUBLE + (ncol * a - 0.5) * 0.0005::DOUBLE AS lon, 48.5::DOUBLE - (nrow * b - 0.5) * 0.0005::DOUBLE AS lat FROM size, (VALUES {edge}) v(a, b)), {_forward_sql("edged", "edge", "32")},
    f AS (SELECT *, x_lo + c / 2 AS x0, y_hi - c / 2 AS y0, ceil((y_hi - y_lo) / c) AS m, ceil((x_hi - x_lo) / c) AS n FROM (
      SELECT min(easting) AS x_lo, max(easting) AS x_hi, min(northing) AS y_lo, max(northing) AS y_hi, any_value(nrow) AS nrow, any_value(ncol) AS ncol,
      sqrt((max(easting) FILTER (a = 1 AND b = 1) - max(easting) FILTER (a = 0 AND b = 0)) ** 2 + (max(northing) FILTER (a = 1 AND b = 1) - max(northing) FILTER (a = 0 AND b = 0)) ** 2) / sqrt(any_value(nrow) ** 2 + any_value(ncol) ** 2) AS c FROM edged)),
    spot AS (SELECT y::INTEGER AS yi, x::INTEGER AS xi, x0 + x * c AS px, y0 - y * c AS py FROM f CROSS JOIN LATERAL (SELECT unnest(range(0, m::BIGINT)) AS y) CROSS JOIN LATERAL (SELECT unnest(range(0, n::BIGINT)) AS x)), {_inverse_sql("deg", "spot", "32")},
    place AS (SELECT yi, xi, round((lat - 48.5::DOUBLE) / -0.0005::DOUBLE, 9) AS fy, round((lon - 9.0::DOUBLE) / 0.0005::DOUBLE, 9) AS fx FROM deg), {_corners_sql("corner", "place", "1 AS k")},
    metric AS (SELECT corner.yi, corner.xi, CASE WHEN count(*) = count(elevation) THEN sum(w * elevation) END AS elevation FROM corner LEFT JOIN grid ON grid.yi = sy AND grid.xi = sx WHERE w > 0
      GROUP BY corner.yi, corner.xi HAVING count(elevation) > 0),
    {image}, quiet AS (SELECT yi, xi, {kernel}),
    own AS (SELECT yi, xi, 9.0::DOUBLE + xi * 0.0005::DOUBLE AS lon, 48.5::DOUBLE - yi * 0.0005::DOUBLE AS lat FROM grid), {_forward_sql("ownto", "own", "32")},
    back AS (SELECT ownto.yi, ownto.xi, round((northing - y0) / -c, 9) AS fy, round((easting - x0) / c, 9) AS fx FROM ownto, f), {_corners_sql("corner2", "back", "1 AS k")}
    SELECT corner2.yi, corner2.xi, CASE WHEN count(*) = count(quiet.elevation) THEN round(sum(w * quiet.elevation), 4) END AS elevation FROM corner2 LEFT JOIN quiet ON quiet.yi = sy AND quiet.xi = sx WHERE w > 0 GROUP BY corner2.yi, corner2.xi"""


@register("denoise_utm_round_trip", _round_trip_sql())
def denoise_utm_round_trip(s, d):
    cells = grid(s, d).select("raster_id", "yi", "xi", "elevation")
    sizes = cells.groupBy("raster_id").agg((F.max("yi") + 1).alias("rows"))
    place = {"zone": F.lit(None).cast("int"), "south": F.lit(False), "x0": F.lit(9.0), "y0": F.lit(48.5), "dx": F.lit(0.0005), "dy": F.lit(-0.0005), "columns": F.lit(WIDTH)}
    frames = sizes.withColumns(place)
    return warp.denoise_round_trip(cells, frames, "gaussian").select("yi", "xi", F.round("elevation_denoised", 4).alias("elevation"))


# --- outlines of regions ---------------------------------------------------------------------------------------------


@register(
    "region_outlines",
    f"""{_COMPONENTS}, z AS (SELECT slope_class, label, count(*) AS size FROM n JOIN r ON r.id = n.id GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY slope_class ORDER BY label) AS nth FROM z),
    c AS MATERIALIZED (SELECT n.yi, n.xi, (CASE WHEN n.slope_class = 0 THEN nth ELSE -nth END)::INTEGER AS cluster_id FROM n JOIN r ON r.id = n.id JOIN m ON m.slope_class = n.slope_class AND m.label = r.label WHERE size >= 5),
    sides AS (SELECT c.cluster_id, count(*) AS perimeter FROM c CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx) WHERE NOT EXISTS (FROM c o WHERE o.cluster_id = c.cluster_id AND o.yi = c.yi + dy AND o.xi = c.xi + dx) GROUP BY ALL),
    quads AS (SELECT cluster_id, yi + a AS y, xi + b AS x, count(*) AS k, sum(CASE WHEN a = b THEN 1 ELSE -1 END) AS lean FROM c CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) q(a, b) GROUP BY ALL),
    turns AS (SELECT cluster_id, sum(CASE WHEN k % 2 = 1 THEN 1 WHEN k = 2 AND abs(lean) = 2 THEN 2 ELSE 0 END) AS corners FROM quads GROUP BY cluster_id)
    SELECT cluster_id, count(*) AS cells, any_value(perimeter)::BIGINT AS perimeter, any_value(corners)::BIGINT AS corners FROM c JOIN sides USING (cluster_id) JOIN turns USING (cluster_id) GROUP BY cluster_id""",
)
def region_outlines(s, d):
    rings = segments.outlines(segments.cluster_ids(_classes(s, d), 5))

    def steps(c):
        near = F.col(c)
        moved = F.zip_with(near, F.concat(F.slice(near, 2, F.size(near)), F.slice(near, 1, 1)), lambda a, b: F.abs(b - a))
        return F.aggregate(moved, F.lit(0).cast("long"), lambda t, v: t + v)

    return rings.groupBy("cluster_id").agg(
        F.expr("sum(area2) div 2").alias("cells"), F.sum(steps("ys") + steps("xs")).alias("perimeter"), F.sum(F.size("ys")).cast("long").alias("corners")
    )


@register("polygons_simplified")
def polygons_simplified(s, d):
    classes = _classes(s, d)
    cells = segments.cluster_ids(classes, 5)
    size = classes.groupBy("raster_id").agg((F.max("yi") + 1).alias("rows"), (F.max("xi") + 1).alias("columns"))
    frame = size.withColumns({"lon0": F.lit(9.0), "lat0": F.lit(48.5), "lon1": F.lit(9.0) + (F.col("columns") - 1) * 0.0003, "lat1": F.lit(48.5) - (F.col("rows") - 1) * 0.0003})
    return segments.polygons_in_degrees(cells, frame).select("cluster_id", "class", "class_name", F.round("area_deg2", 12).alias("area_deg2"), "ring")


# --- raster files ----------------------------------------------------------------------------------------------------


@register(
    "geotiff_round_trip",
    f"""WITH {GRID}, b AS (SELECT 'g' || yi // 20 AS raster_id, yi % 20 AS yi, xi, elevation FROM grid),
    size AS (SELECT raster_id, max(yi) + 1 AS rows FROM b GROUP BY raster_id), every AS (SELECT raster_id, y AS yi, x AS xi, rows FROM size, range(20) a(y), range({WIDTH}) c(x) WHERE y < rows)
    SELECT e.raster_id, e.yi::INTEGER AS yi, e.xi::INTEGER AS xi, elevation AS value, 9.0::DOUBLE + 0.25::DOUBLE * e.xi AS lon, 'part' AS origin FROM every e
    LEFT JOIN b ON b.raster_id = e.raster_id AND b.yi = e.yi AND b.xi = e.xi WHERE e.yi BETWEEN 3 AND 16 AND e.xi >= 5""",
)
def geotiff_round_trip(s, d):
    cells = grid(s, d).select(F.concat(F.lit("g"), F.floor(F.col("yi") / 20).cast("string")).alias("raster_id"), (F.col("yi") % 20).alias("yi"), "xi", "elevation")
    sizes = cells.groupBy("raster_id").agg((F.max("yi") + 1).alias("rows"))
    place = {"columns": F.lit(WIDTH), "x0": F.lit(9.0), "y0": F.lit(48.5), "dx": F.lit(0.25), "dy": F.lit(-0.25), "epsg": F.lit(4326), "tags": F.create_map(F.lit("origin"), F.lit("part"))}
    path = f"{shared_folder(s)}/rasters/{uuid.uuid4().hex}"
    geotiff.write_geotiff(cells, sizes.withColumns(place), path, "elevation")
    frames = geotiff.geotiff_frames(s, path)
    read = geotiff.read_geotiff(s, path, top=3, bottom=16, left=5)
    named = frames.select("raster_id", "x0", "dx", F.col("tags")["origin"].alias("origin"))
    return read.join(named, "raster_id").select("raster_id", "yi", "xi", "value", (F.col("x0") + F.col("xi") * F.col("dx")).alias("lon"), "origin")


# --- requests in tiles -----------------------------------------------------------------------------------------------

def _degree_frame(cells, step=0.0003):
    """The frame of the grid in degrees, from 9 E and 48 N on."""
    sizes = cells.groupBy("raster_id").agg((F.max("yi") + 1).alias("rows"))
    place = {"zone": F.lit(None).cast("int"), "south": F.lit(False), "x0": F.lit(9.0), "y0": F.lit(48.0), "dx": F.lit(step), "dy": F.lit(-step), "columns": F.lit(WIDTH)}
    return sizes.withColumns(place)


@register("terrain_on_tiles", f"WITH {GRID}, {_z_sql()} SELECT yi, xi, round(sqrt({' + '.join(f'(z{i} - z5) ** 2' for i in (1, 2, 3, 4, 6, 7, 8, 9))}), 6) + 0.0::DOUBLE AS tri FROM z")
def terrain_on_tiles(s, d):
    cells = grid(s, d).select("raster_id", "yi", "xi", "elevation")
    frames = _degree_frame(cells)
    edge = {"min_lon": F.col("x0") - 0.00015, "max_lon": F.col("x0") + (F.col("columns") - 0.5) * 0.0003, "max_lat": F.col("y0") + 0.00015, "min_lat": F.col("y0") - (F.col("rows") - 0.5) * 0.0003}
    tiles = requests.request_tiles(frames.select("raster_id", *[c.alias(n) for n, c in edge.items()]), max_side=11)
    made = requests.area_terrain(cells, frames, tiles, ("tile_x", "tile_y"), halo=3)
    order = F.col("tile_y") * 1000 + F.col("tile_x")
    joined = resample.mosaic_first(made.withColumn("o", order), "terrain_ruggedness_index", "o", ("yi", "xi"))
    return joined.select("yi", "xi", (F.round("terrain_ruggedness_index", 6) + F.lit(0.0)).alias("tri"))


@register(
    "request_tiles",
    f"""WITH RECURSIVE {SITES}, b AS (SELECT site_id, lon AS lon0, lat AS lat0, lon + 1 + site_id % 7 AS lon1, lat + 1 + site_id % 5 AS lat1 FROM sites),
    g(site_id, lon0, lat0, lon1, lat1, tx, ty, done) AS (
      SELECT *, greatest(1, ceil(greatest(ceil((lon1 - lon0) * (111320.0::DOUBLE * cos(radians((lat0 + lat1) / 2.0::DOUBLE))) / 30.0::DOUBLE), 1) / 4000))::BIGINT, greatest(1, ceil(greatest(ceil((lat1 - lat0) * 111320.0::DOUBLE / 30.0::DOUBLE), 1) / 4000))::BIGINT, false FROM b
      UNION ALL
      SELECT site_id, lon0, lat0, lon1, lat1, CASE WHEN fits THEN tx WHEN nx > 4000 OR (ny <= 4000 AND nx >= ny) THEN tx + 1 ELSE tx END, CASE WHEN fits THEN ty WHEN nx > 4000 OR (ny <= 4000 AND nx >= ny) THEN ty ELSE ty + 1 END, fits
      FROM (SELECT *, nx <= 4000 AND ny <= 4000 AND nx * ny <= {resample.max_pixels_one_request(2)} AS fits FROM (
        SELECT g.*, (SELECT max(greatest(ceil((lon1 - lon0) / tx * (111320.0::DOUBLE * cos(radians(lat0 + (lat1 - lat0) * (j + 0.5::DOUBLE) / ty))) / 30.0::DOUBLE), 1)) FROM range(200) r(j) WHERE j < ty) AS nx,
          greatest(ceil((lat1 - lat0) / ty * 111320.0::DOUBLE / 30.0::DOUBLE), 1) AS ny FROM g WHERE NOT done)))
    SELECT site_id, x AS tile_x, y AS tile_y, round(lon0 + (lon1 - lon0) * x / tx, 6) AS min_lon, round(lat0 + (lat1 - lat0) * y / ty, 6) AS min_lat, round(lon0 + (lon1 - lon0) * (x + 1) / tx, 6) AS max_lon, round(lat0 + (lat1 - lat0) * (y + 1) / ty, 6) AS max_lat
    FROM g, range(200) a(x), range(200) b(y) WHERE done AND x < tx AND y < ty""",
)
def request_tiles(s, d):
    box = {"min_lon": F.col("lon"), "min_lat": F.col("lat"), "max_lon": F.col("lon") + 1 + F.col("site_id") % 7, "max_lat": F.col("lat") + 1 + F.col("site_id") % 5}
    tiles = requests.request_tiles(sites(s, d).select("site_id", *[c.alias(n) for n, c in box.items()]), bands=2, max_side=4000)
    return tiles.select("site_id", "tile_x", "tile_y", *[F.round(c, 6).alias(c) for c in requests.BOX])


def _array_grid_sql() -> str:
    n = pipeline.EMBEDDING
    mean, value = (", ".join(x(i) for i in range(n)) for x in (lambda i: f"avg(v[{i + 1}]::DOUBLE) AS e{i}", lambda i: f"CASE WHEN count(*) = count(e{i}) THEN round(sum(w * e{i}), 6) END"))
    return f"""WITH t AS (SELECT (vec_id % 400) // 20 AS yi, vec_id % 20 AS xi, vec_id AS o, embedding AS v FROM embeddings WHERE vec_id % 23 > 0),
    m AS (SELECT yi, xi, arg_min(v, o) AS v FROM t GROUP BY yi, xi), c AS (SELECT yi // 2 AS sy, xi // 2 AS sx, {mean} FROM m GROUP BY ALL),
    place AS (SELECT y AS yi, x AS xi, round((y * 0.7::DOUBLE + 1.3::DOUBLE - 0.5::DOUBLE) / 2, 9) AS fy, round((x * 0.7::DOUBLE + 0.9::DOUBLE - 0.5::DOUBLE) / 2, 9) AS fx FROM range(26) p(y), range(26) q(x)),
    {_corners_sql("corner", "place", "1 AS k")}
    SELECT corner.yi::INTEGER AS yi, corner.xi::INTEGER AS xi, [{value}] AS embedding FROM corner LEFT JOIN c ON c.sy = corner.sy AND c.sx = corner.sx WHERE w > 0 GROUP BY corner.yi, corner.xi HAVING count(e0) > 0"""


@register("embeddings_on_terrain_grid", _array_grid_sql())
def embeddings_on_terrain_grid(s, d):
    v = F.col("vec_id")
    tiles = table(s, d, "embeddings").where(v % 23 > 0).select(F.lit("e").alias("raster_id"), F.floor(v % 400 / 20).cast("int").alias("yi"), (v % 20).cast("int").alias("xi"), v.alias("o"), "embedding")
    frame = {"zone": F.lit(None).cast("int"), "south": F.lit(False), "x0": F.lit(0.0), "y0": F.lit(0.0), "dx": F.lit(1.0), "dy": F.lit(-1.0), "rows": F.lit(20), "columns": F.lit(20)}
    frames = warp.onto(tiles.select("raster_id").distinct().withColumns(frame), zone=None, south=False, x0=0.9, y0=-1.3, dx=0.7, dy=-0.7, rows=26, columns=26)
    on_grid = requests.arrays_on_grid(tiles, frames, "embedding", pipeline.EMBEDDING, "o", 2)
    rounded = F.transform("embedding", lambda e: F.round(e, 6))
    return on_grid.select("yi", "xi", F.coalesce(rounded, F.array_repeat(F.lit(None).cast("double"), pipeline.EMBEDDING)).alias("embedding"))


@register(
    "netcdf_series_round_trip",
    """SELECT user_id::VARCHAR AS site, date_trunc('hour', ts) AS time, round(sum(value), 2)::FLOAT AS solar_radiation FROM events GROUP BY ALL""",
)
def netcdf_series_round_trip(s, d):
    hourly = table(s, d, "events").groupBy(F.col("user_id").alias("site_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).agg(F.round(F.sum("value"), 2).alias("solar_radiation"))
    path = f"{shared_folder(s)}/series/{uuid.uuid4().hex}"
    netcdf.write_series(hourly, path).agg(F.sum("n")).collect()
    read = netcdf.insolation_series(s, path)
    return read.select(F.regexp_extract("path", r"([^/]+)\.nc$", 1).alias("site"), "time", "solar_radiation")


# --- operators that had no query of their own ------------------------------------------------------------------------


@register(
    "series_requests",
    f"""WITH {SITES}, e AS (SELECT site_id, lat, lon, CASE WHEN site_id % 3 = 0 THEN 0 ELSE 60 / 111320.0::DOUBLE END AS dy, CASE WHEN site_id % 3 = 0 THEN 0 ELSE 60 / (111320.0::DOUBLE * cos(radians(lat))) END AS dx FROM sites)
    SELECT site_id, round(lon - dx, 9) AS min_lon, round(lat - dy, 9) AS min_lat, round(lon + dx, 9) AS max_lon, round(lat + dy, 9) AS max_lat,
      CASE WHEN site_id % 3 = 0 THEN 2 ELSE 121 // (6 + site_id % 5) + 1 END::BIGINT AS times,
      CASE WHEN site_id % 3 = 0 THEN TIMESTAMP '2020-03-04' ELSE TIMESTAMP '2020-01-01' + to_hours(((121 // (6 + site_id % 5)) * (6 + site_id % 5))::BIGINT) END AS last_time FROM e""",
)
def series_requests(s, d):
    i = F.col("site_id")
    step = F.concat(F.lit("PT"), (6 + i % 5).cast("string"), F.lit("H59M"))
    spot = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    day = F.struct(F.array(F.lit("2020-01-02"), F.lit("2020-03-04")).alias("time"))
    point = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(F.struct(spot.alias("geometry"), day.alias("properties"))).alias("features")))
    square = F.regexp_replace(aoi.station_geojson(F.col("lat"), F.col("lon"), "2020-01-01", "2020-01-06T01:00:00", "STEP"), F.lit("STEP"), step)
    asked = sites(s, d).select("site_id", F.when(i % 3 == 0, point).otherwise(square).alias("json"))
    found = asked.select("site_id", *[c.alias(n) for n, c in aoi.series_request(F.col("json")).items()])
    return found.select("site_id", *[F.round(c, 9).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")], F.size("times").cast("long").alias("times"), F.array_max("times").alias("last_time"))


@register(
    "axes_swapped",
    f"WITH {SITES} SELECT site_id, round(CASE WHEN site_id % 2 = 0 AND greatest(abs(lon), abs(lon + 0.5)) > 90 THEN lon WHEN site_id % 2 = 0 THEN lat ELSE lon END, 6) AS x, translate('2018-01-01T00:00:' || (site_id % 60)::VARCHAR, ':T', '-_') AS name FROM sites",
)
def axes_swapped(s, d):
    """Rings of odd sites have longitudes first, those of even ones latitudes; a second coordinate beyond 90 gives it away."""
    i, lon, lat = F.col("site_id"), F.col("lon"), F.col("lat")
    pair = lambda k: F.when(i % 2 == 0, F.array(lat + k, lon + k)).otherwise(F.array(lon + k, lat + k))
    ring = F.array(pair(0.0), pair(0.5), pair(0.0))
    name = aoi.safe_filename(F.concat(F.lit("2018-01-01T00:00:"), (i % 60).cast("string")))
    return sites(s, d).select("site_id", F.round(aoi.swap_if_latitudes_first(ring)[0][0], 6).alias("x"), name.alias("name"))


@register("scenes_head", f"WITH {SCENES} SELECT id, datetime, cloud FROM items WHERE cloud IS NOT NULL ORDER BY datetime, id LIMIT 25")
def scenes_head(s, d):
    return scenes.head(scene_items(s, d), 25)


@register(
    "cloud_cover_missing",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 4 - 1) * 10.5::DOUBLE END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 + 0.25::DOUBLE END AS b FROM orders)
    SELECT o_orderkey, coalesce(a, b) AS cloud, coalesce(nullif(a, 0), b) AS parity FROM o""",
)
def cloud_cover_missing(s, d):
    k = F.col("o_orderkey")
    first, last = F.when(k % 4 > 0, (k % 4 - 1) * 10.5).cast("string"), F.when(k % 3 == 0, k % 50 + 0.25).cast("string")
    found = table(s, d, "orders").select("o_orderkey", F.create_map(F.lit("eo:cloud_cover"), first, F.lit("cloud_cover"), last).alias("p"))
    return found.select("o_orderkey", scenes.cloud_cover(F.col("p"), None).alias("cloud"), scenes.cloud_cover(F.col("p"), None, parity=True).alias("parity"))


@register(
    "interpolate_in_space",
    f"""WITH {GRID}, g AS (SELECT yi % 3 AS t, yi // 3 AS latitude, xi AS longitude, CASE WHEN (yi * 7 + xi * 3) % 5 > 0 THEN elevation END AS v FROM grid WHERE yi < (SELECT max(yi) // 3 * 3 FROM grid)),
    p AS (SELECT *, row_number() OVER (PARTITION BY t, latitude ORDER BY longitude) AS k, count(*) OVER (PARTITION BY t, latitude) AS n FROM g WHERE v IS NOT NULL),
    b AS (SELECT g.*, (SELECT max(k) FROM p WHERE p.t = g.t AND p.latitude = g.latitude AND p.longitude <= g.longitude) AS lo, (SELECT max(n) FROM p WHERE p.t = g.t AND p.latitude = g.latitude) AS n FROM g),
    e AS (SELECT *, CASE WHEN lo IS NULL THEN 1 WHEN lo >= n THEN n - 1 ELSE lo END AS a FROM b)
    SELECT e.t, e.latitude, e.longitude, round(CASE WHEN e.v IS NOT NULL THEN e.v ELSE p.v + (q.v - p.v) * (e.longitude - p.longitude) / (q.longitude - p.longitude) END, 6) AS v
    FROM e LEFT JOIN p ON p.t = e.t AND p.latitude = e.latitude AND p.k = e.a LEFT JOIN p q ON q.t = e.t AND q.latitude = e.latitude AND q.k = e.a + 1""",
)
def interpolate_in_space(s, d):
    g = grid(s, d)
    whole = g.where(F.col("yi") < F.lit(g.agg(F.floor(F.max("yi") / 3) * 3).scalar()))
    y, x = F.col("yi"), F.col("xi")
    cells = whole.select((y % 3).alias("t"), F.floor(y / 3).alias("latitude"), x.alias("longitude"), F.when((y * 7 + x * 3) % 5 > 0, F.col("elevation")).alias("v"))
    return pipeline.interpolate_space(cells, "t", "v").select("t", "latitude", "longitude", F.round("v", 6).alias("v"))


@register(
    "region_features",
    f"""{_COMPONENTS}, z AS (SELECT slope_class, label, count(*) AS size FROM n JOIN r ON r.id = n.id GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY slope_class ORDER BY label) AS nth FROM z)
    SELECT (CASE WHEN slope_class = 0 THEN nth ELSE -nth END)::INTEGER AS cluster_id, CASE WHEN slope_class = 0 THEN 'Gentle' ELSE 'Steep' END AS class_name, 'Polygon' AS geometry, true AS closed FROM m WHERE size >= 5""",
)
def region_features(s, d):
    """GeoJSON features of the outer rings, read back from their text: one row a cluster."""
    rings = segments.polygons(segments.cluster_ids(_classes(s, d), 5))
    text = rings.select(sinks.feature(F.col("ring"), cluster_id=F.col("cluster_id"), class_name=F.col("class_name")).alias("json"))
    read = text.select(F.from_json("json", "type string, geometry struct<type:string,coordinates:array<array<array<double>>>>, properties struct<cluster_id:int,class_name:string>").alias("f"))
    ends = F.col("f.geometry.coordinates")[0]
    return read.groupBy(F.col("f.properties.cluster_id").alias("cluster_id"), F.col("f.properties.class_name").alias("class_name"), F.col("f.geometry.type").alias("geometry")).agg(
        F.every(ends[0] == F.element_at(ends, -1)).alias("closed")
    )


@register(
    "grid_layers",
    f"WITH {GRID}, o AS (SELECT yi, xi, p_size AS size, elevation + 1 AS elevation FROM grid WHERE xi % 3 > 0) SELECT grid.yi, grid.xi, grid.elevation, o.size FROM grid LEFT JOIN o ON o.yi = grid.yi AND o.xi = grid.xi",
)
def grid_layers(s, d):
    g = grid(s, d)
    other = g.where("xi % 3 > 0").select("raster_id", "yi", "xi", F.col("p_size").alias("size"), (F.col("elevation") + 1).alias("elevation"))
    return features.merge_grids(g.drop("p_size"), other).select("yi", "xi", "elevation", "size")


@register(
    "catalogue_window",
    """SELECT o_orderkey::VARCHAR AS id, o_orderdate::TIMESTAMP AS datetime, (o_orderkey * 37 % 101)::DOUBLE AS cloud FROM orders
    WHERE o_orderdate >= DATE '1994-01-01' AND o_orderdate <= DATE '1995-06-30' AND o_orderkey * 37 % 101 <= 30 AND o_custkey * 7 % 300 - 150 <= 40 AND o_custkey * 7 % 300 - 149 >= -60""",
)
def catalogue_window(s, d):
    k, x = F.col("o_orderkey"), F.col("o_custkey") * 7 % 300 - 150
    items = table(s, d, "orders").select(
        k.alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("datetime"), (k * 37 % 101).cast("double").alias("cloud"), x.alias("min_lon"), F.lit(10).alias("min_lat"), (x + 1).alias("max_lon"), F.lit(11).alias("max_lat")
    )
    path = f"{shared_folder(s)}/catalogues/{uuid.uuid4().hex}"
    stac.write_catalogue(items, path)
    found = stac.catalogue_pages(s, f"{path}/index-0.json", (-60.0, 0.0, 40.0, 20.0), "1994-01-01", "1995-06-30", 30.0)
    return found.select("id", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "cloud")
