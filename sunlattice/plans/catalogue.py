"""The catalogue of registered queries: name -> (plan, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.functions import aoi, finance, numeric, scoring, spectral
from sunlattice.operators import denoise as dn
from sunlattice.operators import features, focal, resample, scenes, segments, series, terrain, zonal
from sunlattice.plans import pipeline
from sunlattice.plans.fixtures import CUBE, GRID, ITEMS, PIXELS, SCENES, SITES, cube, grid, items, pixels, scene_cells, scene_items, sites, table
from sunlattice.plans.registry import ORACLE, PLANS, register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from sunlattice.plans import catalogue_areas  # its SQL is made of this module's parts

    assert catalogue_areas
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)


def r6(**columns) -> list:
    """Columns rounded to six digits, named; a negative zero becomes zero."""
    return [(F.round(c, 6) + F.lit(0.0)).alias(k) for k, c in columns.items()]


# --- business formulae and scoring ---------------------------------------------------------------------------------

_CF_SQL = "0.01::DOUBLE + (c_custkey * 7919 % 1000) / 2500.0::DOUBLE"


def _customers(s, d):
    c = table(s, d, "customer")
    return c.select(
        "c_custkey",
        (0.01 + F.pmod(F.col("c_custkey") * 7919, F.lit(1000)) / 2500.0).alias("cf"),
        (0.1 + (F.col("c_custkey") % 500)).cast("double").alias("p"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit(8.5)).otherwise(0.5 + (F.col("c_custkey") % 30)).cast("double").alias("tariff"),
    )


@register(
    "payback_sites",
    f"""WITH c AS (SELECT c_custkey, {_CF_SQL} AS cf, 0.1::DOUBLE + c_custkey % 500 AS p,
      CASE WHEN c_custkey % 7 = 0 THEN 8.5::DOUBLE ELSE 0.5::DOUBLE + c_custkey % 30 END AS tariff FROM customer),
    m AS (SELECT *, 75000.0::DOUBLE * p AS capex, 1000.0::DOUBLE * p AS opex, cf * 8760.0::DOUBLE * p * tariff AS rev FROM c)
    SELECT c_custkey, round(cf, 6) AS cf, round(cf * 100, 2) AS cf_percent, round(capex, 2) AS capex_rub,
      round(opex, 2) AS opex_year_rub, round(rev, 2) AS revenue_year_rub,
      CASE WHEN rev - opex > 0 THEN round(capex / (rev - opex), 3) END AS payback_years,
      CASE WHEN rev - opex > 0 THEN '{finance.NOTE_DONE}' ELSE '{finance.NOTE_NEVER}' END AS payback_note FROM m""",
)
def payback_sites(s, d):
    c = _customers(s, d)
    return c.select("c_custkey", *[v.alias(k) for k, v in finance.rounded_response(F.col("cf"), F.col("p"), F.col("tariff")).items()])


@register(
    "classify_cf",
    f"""WITH c AS (SELECT c_custkey, {_CF_SQL} AS cf FROM customer)
    SELECT c_custkey, CASE WHEN cf < {scoring.LOW}::DOUBLE THEN 'low' WHEN cf < {scoring.HIGH}::DOUBLE THEN 'medium' ELSE 'high' END AS cf_category,
      CASE WHEN cf < {scoring.LOW}::DOUBLE THEN 'Низкий CF: ниже 16.7%.' WHEN cf < {scoring.HIGH}::DOUBLE THEN 'Средний CF: от 16.7% до 20.8%.'
      ELSE 'Высокий CF: выше 20.8%.' END AS cf_explanation FROM c""",
)
def classify_cf(s, d):
    return _customers(s, d).select("c_custkey", *[v.alias(k) for k, v in scoring.classify(F.col("cf")).items()])


@register(
    "valid_requests",
    """SELECT c_custkey, c_acctbal / 50 BETWEEN -90 AND 90 AND (c_custkey % 400) - 200 BETWEEN -180 AND 180
      AND (c_custkey % 600)::DOUBLE BETWEEN 0.1 AND 586 AND coalesce(CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 5) - 1 END, 8.5) > 0 AS valid FROM customer""",
)
def valid_requests(s, d):
    c, k = table(s, d, "customer"), F.col("c_custkey")
    ok = finance.valid_request(F.col("c_acctbal") / 50, (k % 400) - 200, (k % 600).cast("double"), F.when(k % 3 > 0, (k % 5) - 1))
    return c.select("c_custkey", ok.alias("valid"))


@register(
    "trig_features",
    f"""WITH {SITES} SELECT site_id, round(sin(radians(lat)), 6) + 0.0::DOUBLE AS lat_sin, round(cos(radians(lat)), 6) + 0.0::DOUBLE AS lat_cos,
      round(sin(radians(lon)), 6) + 0.0::DOUBLE AS lon_sin, round(cos(radians(lon)), 6) + 0.0::DOUBLE AS lon_cos FROM sites""",
)
def trig_features(s, d):
    return sites(s, d).select("site_id", *r6(**scoring.trig(F.col("lat"), F.col("lon"))))


_FOREST = {
    "bias": 0.15,
    "scale": 1.0,
    "trees": [
        {"splits": [["lat_sin", 0.1], ["lon_cos", 0.0]], "leaves": [0.01, 0.02, -0.03, 0.04]},
        {"splits": [["lat_cos", 0.8], ["lon_sin", -0.2], ["lat_sin", -0.4]], "leaves": [0.0, 0.01, 0.02, 0.03, 0.04, 0.05, -0.02, 0.06]},
    ],
}


@register(
    "tree_scores",
    f"""WITH {SITES}, f AS (SELECT site_id, sin(radians(lat)) AS a, cos(radians(lat)) AS b, sin(radians(lon)) AS c, cos(radians(lon)) AS e FROM sites)
    SELECT site_id, round(0.15::DOUBLE + ([0.01, 0.02, -0.03, 0.04])[1 + (a > 0.1)::INT + 2 * (e > 0)::INT]
      + ([0.0, 0.01, 0.02, 0.03, 0.04, 0.05, -0.02, 0.06])[1 + (b > 0.8)::INT + 2 * (c > -0.2)::INT + 4 * (a > -0.4)::INT], 6) AS score,
      1::INTEGER AS features_missing FROM f""",
)
def tree_scores(s, d):
    raw = sites(s, d).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    made = scoring.build_features(raw, ["lat_sin", "lat_cos", "lon_sin", "lon_cos", "absent"])
    return made.select("site_id", F.round(scoring.oblivious_trees(_FOREST), 6).alias("score"), "features_missing")


# --- reductions ------------------------------------------------------------------------------------------------------


def _five_sql(v: str) -> str:
    return (
        f"round(avg({v}), 6) AS {v}_mean, round(quantile_cont({v}, 0.5), 6) AS {v}_median, round(stddev_pop({v}), 6) AS {v}_std, "
        f"min({v}) AS {v}_min, max({v}) AS {v}_max"
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c.endswith(("_mean", "_median", "_std")) else F.col(c) for c in df.columns])


@register(
    "five_stats_by_group",
    f"SELECT l_suppkey, {_five_sql('l_quantity')}, {_five_sql('l_extendedprice')} FROM lineitem GROUP BY l_suppkey",
)
def five_stats_by_group(s, d):
    return _rounded(features.five_stats(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_suppkey"]))


@register(
    "five_stats_missing",
    """WITH x AS (SELECT l_suppkey, CASE WHEN l_orderkey % 3 > 0 THEN l_tax END AS v FROM lineitem)
    SELECT l_suppkey, round(avg(v), 6) AS v_mean, round(quantile_cont(v, 0.5), 6) AS v_median, round(stddev_pop(v), 6) AS v_std,
      min(v) AS v_min, max(v) AS v_max FROM x GROUP BY l_suppkey""",
)
def five_stats_missing(s, d):
    v = F.when(F.col("l_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return _rounded(features.five_stats(table(s, d, "lineitem").select("l_suppkey", v.alias("v")), ["v"], ["l_suppkey"]))


@register(
    "embedding_stats",
    """WITH e AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS value FROM embeddings)
    SELECT label, 'emb_A' || lpad(i::VARCHAR, 2, '0') AS band, round(avg(value), 6) AS value_mean, round(quantile_cont(value, 0.5), 6) AS value_median,
      round(stddev_pop(value), 6) AS value_std, min(value) AS value_min, max(value) AS value_max FROM e GROUP BY ALL""",
)
def embedding_stats(s, d):
    return _rounded(features.array_stats(table(s, d, "embeddings"), "embedding", "emb_A", ["label"]))


# --- spectral --------------------------------------------------------------------------------------------------------


@register(
    "fmask_bits",
    f"""WITH {PIXELS} SELECT fmask, count(*) AS n, (fmask & 1) = 1 AS cirrus, ((fmask >> 1) & 1) = 1 AS cloud, ((fmask >> 2) & 1) = 1 AS adjacent,
      ((fmask >> 3) & 1) = 1 AS shadow, ((fmask >> 4) & 1) = 1 AS snow, ((fmask >> 5) & 1) = 1 AS water,
      (fmask >> 6) = 2 AS aerosol_moderate, (fmask >> 6) = 3 AS aerosol_high FROM pixels GROUP BY fmask""",
)
def fmask_bits(s, d):
    counted = pixels(s, d).groupBy("fmask").agg(F.count("*").alias("n"))
    return counted.select("fmask", "n", *[v.alias(k) for k, v in spectral.qa_bits(F.col("fmask")).items()])


@register(
    "fmask_qa_share",
    f"WITH {PIXELS} SELECT l_suppkey, round(avg(CASE WHEN fmask & 15 > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM pixels GROUP BY l_suppkey",
)
def fmask_qa_share(s, d):
    return pixels(s, d).groupBy("l_suppkey").agg(F.round(F.avg(spectral.qa_mask(F.col("fmask"))), 6).alias("share"))


_INDEX = f"""{PIXELS}, v AS (SELECT *, (b01 + b02 + b03 + b04) / 4.0::DOUBLE AS vis_mean FROM pixels),
x AS (SELECT *, sqrt(((b01 - vis_mean) ** 2 + (b02 - vis_mean) ** 2 + (b03 - vis_mean) ** 2 + (b04 - vis_mean) ** 2) / 4.0::DOUBLE) AS vis_std FROM v),
i AS (SELECT *, (b03 - b8a) / greatest(b03 + b8a, 1e-6::DOUBLE) AS ndwi, b02 - 0.5::DOUBLE * b04 - 0.08::DOUBLE AS hot,
  vis_std / greatest(vis_mean + 1e-6::DOUBLE, 1e-6::DOUBLE) AS whiteness, b02 / greatest(b8a + 1e-6::DOUBLE, 1e-6::DOUBLE) AS blue_nir,
  b01 / greatest(b11 + 1e-6::DOUBLE, 1e-6::DOUBLE) AS coastal_swir FROM x)"""


@register(
    "spectral_indices",
    f"""WITH {_INDEX} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ndwi, 6) + 0.0::DOUBLE AS ndwi, round(hot, 6) + 0.0::DOUBLE AS hot, round(vis_mean, 6) + 0.0::DOUBLE AS vis_mean,
      round(vis_std, 6) + 0.0::DOUBLE AS vis_std, round(whiteness, 6) + 0.0::DOUBLE AS whiteness, round(blue_nir, 6) + 0.0::DOUBLE AS blue_nir, round(coastal_swir, 6) + 0.0::DOUBLE AS coastal_swir FROM i""",
)
def spectral_indices(s, d):
    return pixels(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *r6(**spectral.indices()))


def _mask_query(mode: str):
    level = {
        "strict": "(fmask >> 6) = 3",
        "haze_sensitive": "(fmask >> 6) >= 2",
        "balanced": "((fmask >> 6) = 3 OR ((fmask >> 6) = 2 AND hot > 0))",
    }[mode]
    sql = f"""WITH {_INDEX}, c AS (SELECT *, vis_mean > 0.23 AND b02 > 0.20 AND hot > 0.04 AND blue_nir > 0.90 AND whiteness < 0.28 AS spec,
      ((b01 > 0.075 AND b02 > 0.070 AND coastal_swir > 0.55) OR (hot > -0.01 AND blue_nir > 0.58 AND b11 < 0.20)) AND whiteness < 0.40 AND vis_mean > 0.07 AS haze0 FROM i)
    SELECT l_suppkey, count(*) FILTER (fmask & 3 > 0 OR spec) AS cloud, count(*) FILTER ((fmask >> 3) & 1 = 1) AS shadow,
      count(*) FILTER (haze0 AND {level} AND NOT (fmask & 48 > 0 OR ndwi > 0.12) AND NOT (fmask & 15 > 0 OR spec)) AS haze FROM c GROUP BY l_suppkey"""

    @register(f"hybrid_mask_{mode}", sql)
    def plan(s, d):
        made = pixels(s, d).withColumns(spectral.indices())
        return made.groupBy("l_suppkey").agg(*[F.count_if(c).alias(k) for k, c in spectral.hybrid_parts(mode).items()])

    return plan


for _mode in ("balanced", "strict", "haze_sensitive"):
    _mask_query(_mode)


@register(
    "valid_observation",
    f"""WITH {PIXELS} SELECT l_suppkey, count(*) FILTER (l_orderkey % 11 > 0 AND l_partkey % 13 > 0) AS valid, count(*) AS n FROM pixels GROUP BY l_suppkey""",
)
def valid_observation(s, d):
    p = pixels(s, d)
    p = p.withColumn("b03", F.when(F.col("l_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("b03")))
    p = p.withColumn("b12", F.when(F.col("l_partkey") % 13 > 0, F.col("b12")))
    return p.groupBy("l_suppkey").agg(F.count_if(spectral.valid_observation()).alias("valid"), F.count("*").alias("n"))


# --- areas and times -------------------------------------------------------------------------------------------------


@register(
    "station_box",
    f"""WITH {SITES} SELECT site_id, round(lon - 60 / (111320.0::DOUBLE * cos(radians(lat))), 6) AS min_lon, round(lat - 60 / 111320.0::DOUBLE, 6) AS min_lat,
      round(lon + 60 / (111320.0::DOUBLE * cos(radians(lat))), 6) AS max_lon, round(lat + 60 / 111320.0::DOUBLE, 6) AS max_lat FROM sites""",
)
def station_box(s, d):
    return sites(s, d).select("site_id", *r6(**aoi.station_box(F.col("lat"), F.col("lon"))))


@register(
    "bbox_from_km",
    f"""WITH {SITES} SELECT site_id, round(lon - 6.0::DOUBLE / (111.32::DOUBLE * cos(radians(lat))), 6) AS min_lon, round(lat - 5.0::DOUBLE / 111.32::DOUBLE, 6) AS min_lat,
      round(lon + 6.0::DOUBLE / (111.32::DOUBLE * cos(radians(lat))), 6) AS max_lon, round(lat + 5.0::DOUBLE / 111.32::DOUBLE, 6) AS max_lat FROM sites""",
)
def bbox_from_km(s, d):
    return sites(s, d).select("site_id", *r6(**aoi.bbox_from_km(F.col("lat"), F.col("lon"), 10.0, 12.0)))


@register(
    "adjust_area",
    f"""WITH {SITES}, b AS (SELECT site_id, lat AS a1, lat + (site_id % 3) * 0.08::DOUBLE AS a2, lon AS o1, lon + (site_id % 4) * 0.07::DOUBLE AS o2 FROM sites),
    m AS (SELECT *, (a1 + a2) / 2 AS am, (o1 + o2) / 2 AS om, 0.1::DOUBLE / cos(radians((a1 + a2) / 2)) AS w FROM b)
    SELECT site_id, round(CASE WHEN a2 - a1 < 0.1 THEN am - 0.05::DOUBLE ELSE a1 END, 6) AS lat_min, round(CASE WHEN a2 - a1 < 0.1 THEN am + 0.05::DOUBLE ELSE a2 END, 6) AS lat_max,
      round(CASE WHEN o2 - o1 < w THEN om - w / 2 ELSE o1 END, 6) AS lon_min, round(CASE WHEN o2 - o1 < w THEN om + w / 2 ELSE o2 END, 6) AS lon_max FROM m""",
)
def adjust_area(s, d):
    lat, lon, i = F.col("lat"), F.col("lon"), F.col("site_id")
    return sites(s, d).select("site_id", *r6(**aoi.adjust_area(lat, lat + (i % 3) * 0.08, lon, lon + (i % 4) * 0.07)))


@register(
    "export_pixels",
    f"""WITH {SITES}, b AS (SELECT site_id, lon - 0.2::DOUBLE AS o1, lat - 0.2::DOUBLE AS a1, lon + 0.2::DOUBLE AS o2, lat + 0.2::DOUBLE AS a2 FROM sites)
    SELECT site_id, greatest(ceil((o2 - o1) * (111320.0::DOUBLE * cos(radians((a1 + a2) / 2.0::DOUBLE))) / 30.0::DOUBLE), 1)::BIGINT AS nx,
      greatest(ceil((a2 - a1) * 111320.0::DOUBLE / 30.0::DOUBLE), 1)::BIGINT AS ny FROM b""",
)
def export_pixels(s, d):
    box = aoi.bounding_box(F.col("lat"), F.col("lon"), 0.2)
    return sites(s, d).select("site_id", *[c.cast("long").alias(k) for k, c in resample.export_pixels(box, 30.0).items()])


@register(
    "utm_zone",
    f"""WITH {SITES} SELECT site_id, least(floor((lon + 180) / 6) + 1, 60)::INTEGER AS zone,
      (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32
      WHEN lat BETWEEN 72 AND 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END
      ELSE least(floor((lon + 180) / 6) + 1, 60) END)::INTEGER AS epsg FROM sites""",
)
def utm_zone(s, d):
    return sites(s, d).select("site_id", resample.utm_zone(F.col("lon")).alias("zone"), resample.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))


def _utm_sql() -> str:
    e = " + ".join(["eta"] + [f"({a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta))" for j, a in enumerate(resample.ALPHA, 1)])
    n = " + ".join(["xi"] + [f"({a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta))" for j, a in enumerate(resample.ALPHA, 1)])
    s = 2 * resample.N**0.5 / (1 + resample.N)
    scale = resample.K0 * resample.RADIUS
    return f"""WITH {SITES}, p AS (SELECT site_id, lat, radians(lat) AS phi, radians(lon) - radians(6.0::DOUBLE * least(floor((lon + 180) / 6) + 1, 60) - 183.0::DOUBLE) AS lam FROM sites),
    t AS (SELECT *, sinh(atanh(sin(phi)) - {s!r}::DOUBLE * atanh({s!r}::DOUBLE * sin(phi))) AS t FROM p),
    x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
    SELECT site_id, round(500000.0::DOUBLE + {scale!r}::DOUBLE * ({e}), 3) AS easting,
      round(CASE WHEN lat >= 0 THEN 0 ELSE 1e7::DOUBLE END + {scale!r}::DOUBLE * ({n}), 3) AS northing FROM x"""


@register("utm_forward", _utm_sql())
def utm_forward(s, d):
    return sites(s, d).select("site_id", *[F.round(c, 3).alias(k) for k, c in resample.utm_forward(F.col("lat"), F.col("lon")).items()])


@register("utm_round_trip", f"WITH {SITES} SELECT site_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM sites")
def utm_round_trip(s, d):
    m = sites(s, d).withColumn("zone", resample.utm_zone(F.col("lon"))).withColumns(resample.utm_forward(F.col("lat"), F.col("lon")))
    return m.select("site_id", *r6(**resample.utm_inverse(F.col("easting"), F.col("northing"), F.col("zone"), F.col("lat") < 0)))


@register(
    "parse_iso_duration",
    """WITH k AS (SELECT o_orderkey, o_orderkey % 9 AS d, o_orderkey % 23 AS h, o_orderkey % 57 AS m, o_orderkey % 6 AS kind FROM orders)
    SELECT o_orderkey, nullif(CASE kind WHEN 0 THEN 86400 * d WHEN 1 THEN 3600 * h + 60 * m WHEN 2 THEN 86400 * d + 3600 * h WHEN 3 THEN 60 * m + 15 END, 0)::BIGINT AS seconds FROM k""",
)
def parse_iso_duration(s, d):
    k = F.col("o_orderkey")
    days, hours, minutes = ((k % n).cast("string") for n in (9, 23, 57))
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("P"), days, F.lit("D")))
        .when(k % 6 == 1, F.concat(F.lit("PT"), hours, F.lit("H"), minutes, F.lit("M")))
        .when(k % 6 == 2, F.concat(F.lit("P"), days, F.lit("DT"), hours, F.lit("H")))
        .when(k % 6 == 3, F.concat(F.lit("PT"), minutes, F.lit("M15S")))
        .when(k % 6 == 4, F.concat(F.lit("P"), days, F.lit("W")))
        .otherwise(F.concat(F.lit("-P"), days, F.lit("D")))
    )
    return table(s, d, "orders").select("o_orderkey", aoi.duration_seconds(text).alias("seconds"))


@register(
    "schedule_points",
    """SELECT o_orderkey, unnest(generate_series(o_orderdate::TIMESTAMP, o_orderdate::TIMESTAMP + to_days((o_orderkey % 90)::INTEGER), to_days((10 + o_orderkey % 30)::INTEGER))) AS target FROM orders""",
)
def schedule_points(s, d):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    start, end = day.cast("string"), F.date_add(day, (k % 90).cast("int")).cast("string")
    step = F.concat(F.lit("P"), (10 + k % 30).cast("string"), F.lit("D"))
    points = aoi.schedule(aoi.parse_time(start), aoi.parse_time(end), aoi.duration(step))
    return table(s, d, "orders").select("o_orderkey", F.explode(points).alias("target"))


@register(
    "geojson_round_trip",
    f"""WITH {SITES} SELECT site_id, true AS rectangle, lon - 60 / (111320.0::DOUBLE * cos(radians(lat))) >= -180 AS valid, 'range' AS mode, 2592000::BIGINT AS step_seconds, round(lat, 6) AS center_lat, round(lon, 6) AS center_lon FROM sites""",
)
def geojson_round_trip(s, d):
    made = sites(s, d).withColumn("json", aoi.station_geojson(F.col("lat"), F.col("lon")))
    f = made.withColumn("f", aoi.single_feature(F.col("json")))
    f = f.withColumn("ring", aoi.ring_of(F.col("f.geometry.coordinates")))
    f = f.withColumns(aoi.parse_time_property(F.col("f.properties.time"))).withColumns(aoi.ring_bbox(F.col("ring")))
    return f.select(
        "site_id",
        aoi.is_axis_aligned(F.col("ring")).alias("rectangle"),
        (aoi.valid_ring(F.col("ring")) & aoi.consistent(F.col("f.geometry.type"), F.col("f.properties.is_rectangle"), F.col("ring"), F.lit(False), F.col("mode"))).alias("valid"),
        "mode",
        "step_seconds",
        F.round("center_lat", 6).alias("center_lat"),
        F.round("center_lon", 6).alias("center_lon"),
    )


@register(
    "ring_compare",
    f"""WITH {SITES} SELECT site_id, site_id % 4 <> 3 AS equal, CASE site_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 5e-8 WHEN 3 THEN 0.001 END::DOUBLE AS difference FROM sites""",
)
def ring_compare(s, d):
    m = sites(s, d).withColumn("a", aoi.box_ring(aoi.bounding_box(F.col("lat"), F.col("lon"), 0.5)))
    kind = F.col("site_id") % 4
    move = F.when(kind == 1, 5e-8).when(kind == 3, 1e-3).otherwise(0.0)
    shifted = F.transform("a", lambda p: F.when(kind == 2, F.array(p[1], p[0])).otherwise(F.array(p[0] + move, p[1])))
    m = m.withColumn("b", shifted)
    gap = F.when(kind != 2, F.round(aoi.ring_difference(F.col("a"), F.col("b")), 9))
    return m.select("site_id", aoi.rings_equal(F.col("a"), F.col("b")).alias("equal"), gap.alias("difference"))


# --- scenes ----------------------------------------------------------------------------------------------------------


@register("scene_filter_sorted", f"WITH {ITEMS} SELECT id, datetime, cloud FROM items WHERE cloud <= 20 ORDER BY datetime, id")
def scene_filter_sorted(s, d):
    return scenes.filter_sorted(items(s, d), 20.0)


@register(
    "nearest_scene",
    f"""WITH {ITEMS} SELECT id, datetime, cloud, abs(epoch(datetime) - epoch(TIMESTAMP '1996-06-15'))::BIGINT AS gap_s FROM items
    WHERE abs(epoch(datetime) - epoch(TIMESTAMP '1996-06-15')) <= 20 * 86400 ORDER BY cloud > 50, gap_s, cloud, id LIMIT 1""",
)
def nearest_scene(s, d):
    return scenes.nearest_scene(items(s, d), F.lit("1996-06-15").cast("timestamp_ntz"), 20, 50.0)


@register(
    "schedule_nearest_scene",
    f"""WITH {ITEMS}, t AS (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-01-01', INTERVAL 30 DAY)) AS target),
    s AS (SELECT datetime, min(id) AS id FROM items GROUP BY datetime),
    r AS (SELECT target, id, datetime, row_number() OVER (PARTITION BY target ORDER BY abs(epoch(datetime) - epoch(target)), datetime) AS k FROM s, t)
    SELECT DISTINCT id, datetime FROM r WHERE k = 1""",
)
def schedule_nearest_scene(s, d):
    span = s.range(1).select(F.explode(F.expr("sequence(timestamp_ntz'1995-01-01', timestamp_ntz'1996-01-01', interval 30 days)")).alias("target"))
    return scenes.select_by_schedule(items(s, d), span)


@register(
    "scene_cloud_cover",
    f"""WITH {ITEMS} SELECT id, CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN cloud WHEN 2 THEN cloud ELSE 1e9 END::DOUBLE AS cloud,
      CASE id % 4 WHEN 0 THEN 1e9 WHEN 1 THEN coalesce(nullif(cloud, 0), 1e9) WHEN 2 THEN coalesce(nullif(cloud, 0), 1e9) ELSE 1e9 END::DOUBLE AS parity,
      CASE WHEN id % 2 = 0 THEN 32637 ELSE 32719 END AS epsg FROM items""",
)
def scene_cloud_cover(s, d):
    i = items(s, d)
    kind, text = F.col("id") % 4, F.col("cloud").cast("string")
    props = (
        F.when(kind == 0, F.create_map(F.lit("eo:cloud_cover"), F.lit("0")))
        .when(kind == 1, F.create_map(F.lit("CLOUD_COVERAGE"), text))
        .when(kind == 2, F.create_map(F.lit("cloud_cover"), text))
        .otherwise(F.create_map(F.lit("other"), text))
    )
    name = F.when(F.col("id") % 2 == 0, "HLS.S30.T37UDB.2018001T1.v2.0").otherwise("HLS.S30.T19KAA.2018001T1.v2.0")
    return i.select("id", scenes.cloud_cover(props).alias("cloud"), scenes.cloud_cover(props, parity=True).alias("parity"), scenes.item_epsg(name).alias("epsg"))


# --- series ----------------------------------------------------------------------------------------------------------


@register(
    "asof_nearest_tolerance",
    """WITH g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 HOUR)) AS target),
    k AS (SELECT DISTINCT user_id FROM events), l AS (SELECT user_id, target FROM k, g),
    j AS (SELECT l.user_id, l.target, e.value, row_number() OVER (PARTITION BY l.user_id, l.target
      ORDER BY abs(epoch_us(e.ts) - epoch_us(l.target)), e.ts DESC, e.value) AS n FROM l LEFT JOIN events e ON e.user_id = l.user_id AND abs(epoch_us(e.ts) - epoch_us(l.target)) <= 1800000000)
    SELECT user_id, target, value FROM j WHERE n = 1""",
)
def asof_nearest_tolerance(s, d):
    e = table(s, d, "events")
    hours = F.expr("sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-30', interval 1 hour)")
    left = e.select("user_id").distinct().select("user_id", F.explode(hours).alias("target"))
    return series.asof_nearest(left, e, ["user_id"], "target", "ts", "value", 1800)


_ALPHA = f"""{CUBE}, sc AS (SELECT DISTINCT t FROM daily WHERE day(t) % 5 <> 3),
al AS (SELECT t, CASE WHEN lag(t) OVER (ORDER BY t) IS NOT NULL THEN 1 - (1 - 0.1::DOUBLE) ** ((t - lag(t) OVER (ORDER BY t)) / 1.0::DOUBLE) END AS alpha_eff FROM sc)"""


def _scene_cube(s, d):
    c = cube(s, d).where(F.dayofmonth("t") % 5 != 3)
    days = series.alpha_eff(c.select("t").distinct(), "t", 0.1, 1.0)
    return c.join(F.broadcast(days), "t"), days


@register("alpha_eff", f"WITH {_ALPHA} SELECT t, round(alpha_eff, 9) AS alpha_eff FROM al")
def alpha_eff(s, d):
    return _scene_cube(s, d)[1].select("t", F.round("alpha_eff", 9).alias("alpha_eff"))


_FOLD = "lambda e, x: struct_pack(v := CASE WHEN x.v IS NULL THEN e.v WHEN e.v IS NULL THEN x.v ELSE (1 - x.a) * e.v + x.a * x.v END, a := 0::DOUBLE)"
_SEEN = "list_prepend(struct_pack(v := NULL::DOUBLE, a := 0::DOUBLE), list(struct_pack(v := pct, a := alpha_eff) ORDER BY cube.t))"


@register(
    "ewma_final",
    f"""WITH {_ALPHA}, f AS (SELECT pixel, {_SEEN} AS l FROM cube JOIN al ON al.t = cube.t GROUP BY pixel)
    SELECT pixel, list_reduce(l, {_FOLD}).v::FLOAT AS ewma_final FROM f""",
)
def ewma_final(s, d):
    return series.ewma_final(_scene_cube(s, d)[0], ["pixel"], "t", "pct").select("pixel", F.col("ewma_final").cast("float").alias("ewma_final"))


@register(
    "ewma_history",
    f"""WITH {_ALPHA}, f AS (SELECT a.pixel, a.t, {_SEEN.replace("pct", "cube.pct").replace("alpha_eff", "al.alpha_eff")} AS l FROM cube a JOIN al aa ON aa.t = a.t
      JOIN cube ON cube.pixel = a.pixel AND cube.t <= a.t JOIN al ON al.t = cube.t GROUP BY a.pixel, a.t)
    SELECT pixel, t, list_reduce(l, {_FOLD}).v::FLOAT AS ewma FROM f""",
)
def ewma_history(s, d):
    return series.ewma_history(_scene_cube(s, d)[0], ["pixel"], "t", "pct").select("pixel", "t", F.col("ewma").cast("float").alias("ewma"))


@register(
    "gapfill_ffill_bfill",
    f"""WITH {CUBE} SELECT pixel, t, round(coalesce(last_value(pct IGNORE NULLS) OVER (PARTITION BY pixel ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(pct IGNORE NULLS) OVER (PARTITION BY pixel ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS filled FROM cube""",
)
def gapfill_ffill_bfill(s, d):
    return series.ffill_bfill(cube(s, d), ["pixel"], "t", "pct", "filled").select("pixel", "t", F.round("filled", 6).alias("filled"))


@register(
    "insolation_switch",
    f"""WITH {SITES}, b AS (SELECT site_id, lat - 0.02::DOUBLE * (site_id % 4) AS a1, lat + 0.02::DOUBLE * (site_id % 4) AS a2, lon - 0.02::DOUBLE * (site_id % 3) AS o1, lon + 0.02::DOUBLE * (site_id % 3) AS o2 FROM sites),
    h AS (SELECT user_id AS site_id, date_trunc('hour', ts) AS time, value, event_id FROM events),
    p AS (SELECT site_id, time, avg(value) AS v FROM h WHERE site_id % 5 > 0 GROUP BY ALL),
    s AS (SELECT p.site_id, p.time, (a1 + a2) / 2 AS latitude, (o1 + o2) / 2 AS longitude, v FROM p JOIN b ON b.site_id = p.site_id WHERE a2 - a1 <= 0.1 AND o2 - o1 <= 0.1),
    g AS (SELECT h.site_id, time, (event_id % 2)::DOUBLE AS latitude, (event_id % 3)::DOUBLE AS longitude, avg(CASE WHEN event_id % 7 > 0 THEN value END) AS v FROM h
      WHERE h.site_id IN (SELECT site_id FROM b) AND h.site_id NOT IN (SELECT site_id FROM s) GROUP BY ALL HAVING v IS NOT NULL)
    SELECT site_id, time, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(v, 6) AS solar_radiation FROM (FROM s UNION ALL FROM g)""",
)
def insolation_switch(s, d):
    i = F.col("site_id")
    box = {"min_lat": F.col("lat") - 0.02 * (i % 4), "max_lat": F.col("lat") + 0.02 * (i % 4), "min_lon": F.col("lon") - 0.02 * (i % 3), "max_lon": F.col("lon") + 0.02 * (i % 3)}
    h = table(s, d, "events").select(F.col("user_id").alias("site_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), "value", "event_id")
    points = h.where("site_id % 5 > 0").groupBy("site_id", "time").agg(F.avg("value").alias("solar_radiation"))
    e = F.col("event_id")
    slices = h.select("site_id", "time", (e % 2).cast("double").alias("latitude"), (e % 3).cast("double").alias("longitude"), F.when(e % 7 > 0, F.col("value")).alias("ssrd"))
    found = pipeline.insolation(sites(s, d).withColumns(box), points, slices)
    return found.select("site_id", "time", *[F.round(c, 6).alias(c) for c in ("latitude", "longitude", "solar_radiation")])


@register("gapfill_zero", f"WITH {CUBE} SELECT pixel, t, round(coalesce(pct, 0), 6) AS filled FROM cube")
def gapfill_zero(s, d):
    return series.fill_zero(cube(s, d), "pct", "filled").select("pixel", "t", F.round("filled", 6).alias("filled"))


@register(
    "gapfill_interpolate",
    f"""WITH {CUBE}, x AS (SELECT pixel, t, epoch(t)::DOUBLE AS x, pct AS v FROM cube), p AS (SELECT pixel, x, v, row_number() OVER (PARTITION BY pixel ORDER BY x) AS k, count(*) OVER (PARTITION BY pixel) AS n FROM x WHERE v IS NOT NULL),
    b AS (SELECT x.*, (SELECT max(k) FROM p WHERE p.pixel = x.pixel AND p.x <= x.x) AS lo FROM x),
    e AS (SELECT b.*, n.n, CASE WHEN lo IS NULL THEN 1 WHEN lo >= n.n THEN n.n - 1 ELSE lo END AS a FROM b JOIN (SELECT pixel, max(n) AS n FROM p GROUP BY pixel) n ON n.pixel = b.pixel)
    SELECT e.pixel, e.t, round(CASE WHEN e.v IS NOT NULL THEN e.v WHEN e.n < 2 THEN NULL ELSE p.v + (q.v - p.v) * (e.x - p.x) / (q.x - p.x) END, 6) AS filled
    FROM e LEFT JOIN p ON p.pixel = e.pixel AND p.k = e.a LEFT JOIN p q ON q.pixel = e.pixel AND q.k = e.a + 1""",
)
def gapfill_interpolate(s, d):
    c = cube(s, d).withColumn("x", F.unix_seconds(F.col("t").cast("timestamp")).cast("double"))
    return series.interpolate(c, ["pixel"], "x", "pct", "filled").select("pixel", "t", F.round("filled", 6).alias("filled"))


@register(
    "gapfill_drop",
    f"""WITH {CUBE}, m AS (SELECT pixel, t, CASE WHEN day(t) % 7 > 0 AND pixel % 5 > 0 THEN pct END AS v FROM cube)
    SELECT pixel, t, round(v, 6) AS v FROM m WHERE day(t) % 7 > 0 AND pixel % 5 > 0""",
)
def gapfill_drop(s, d):
    keep = (F.dayofmonth("t") % 7 > 0) & (F.col("pixel") % 5 > 0)
    m = cube(s, d).select("pixel", "t", F.when(keep, F.col("pct")).alias("v"))
    return series.drop_missing(m, "t", ["pixel"], "v").select("pixel", "t", F.round("v", 6).alias("v"))


# --- neighbourhoods --------------------------------------------------------------------------------------------------

_FLAG = f"{GRID}, m AS (SELECT yi, xi, (p_size > 25)::INTEGER AS f FROM grid)"


def _stencil(name: str, source: str, target: str, low: int, high: int, erode: bool) -> str:
    value = f"CASE WHEN count(*) = {(high - low + 1) ** 2} THEN min(b.f) ELSE 0 END" if erode else "max(b.f)"
    return (
        f"{target} AS (SELECT a.yi, a.xi, ({value})::INTEGER AS f FROM {source} a JOIN {source} b ON b.yi BETWEEN a.yi + {low} AND a.yi + {high} "
        f"AND b.xi BETWEEN a.xi + {low} AND a.xi + {high} GROUP BY a.yi, a.xi)"
    )


def _flags(s, d):
    return grid(s, d).withColumn("f", (F.col("p_size") > 25).cast("int"))


@register("closing3", f"WITH {_FLAG}, {_stencil('', 'm', 'x', -1, 1, False)}, {_stencil('', 'x', 'y', -1, 1, True)} SELECT yi, xi, f FROM y")
def closing3(s, d):
    return focal.closing3(_flags(s, d), "f").select("yi", "xi", "f")


@register("dilate2", f"WITH {_FLAG}, {_stencil('', 'm', 'x', 0, 1, False)} SELECT yi, xi, f FROM x")
def dilate2(s, d):
    return focal.dilate2(_flags(s, d), "f").select("yi", "xi", "f")


@register("opening2", f"WITH {_FLAG}, {_stencil('', 'm', 'x', -1, 0, True)}, {_stencil('', 'x', 'y', 0, 1, False)} SELECT yi, xi, f FROM y")
def opening2(s, d):
    return focal.opening2(_flags(s, d), "f").select("yi", "xi", "f")


@register(
    "disc_percentage",
    f"""WITH {_FLAG}, w AS (SELECT m.yi, m.xi, f AS mask, (p_size % 9 > 0)::INTEGER AS valid FROM m JOIN grid ON grid.yi = m.yi AND grid.xi = m.xi),
    n AS (SELECT max(yi) AS my, max(xi) AS mx FROM w),
    k AS (SELECT dy, dx FROM range(-3, 4) a(dy), range(-3, 4) b(dx) WHERE dy * dy + dx * dx <= 9),
    j AS (SELECT a.yi, a.xi, sum(b.mask * b.valid) AS c, sum(b.valid) AS v FROM w a, k, n JOIN w b ON b.yi = greatest(0, least(my, a.yi + dy)) AND b.xi = greatest(0, least(mx, a.xi + dx)) GROUP BY a.yi, a.xi)
    SELECT yi, xi, CASE WHEN v >= 20 THEN round(100.0::DOUBLE * c / v, 6) END AS pct FROM j""",
)
def disc_percentage(s, d):
    w = _flags(s, d).select("raster_id", "yi", "xi", F.col("f").alias("mask"), (F.col("p_size") % 9 > 0).alias("valid"))
    return focal.cloud_percentage(w, 3, 20).select("yi", "xi", F.round("cloud_percentage_local", 6).alias("pct"))


def _z_sql() -> str:
    parts = [(i + 1, dy, dx) for i, (dy, dx) in enumerate((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1))]
    cols = ", ".join(f"max(b.elevation) FILTER (b.yi = a.yi + {dy} AND b.xi = a.xi + {dx}) AS z{i}" for i, dy, dx in parts)
    return f"z AS (SELECT a.yi, a.xi, {cols} FROM grid a JOIN grid b ON b.yi BETWEEN a.yi - 1 AND a.yi + 1 AND b.xi BETWEEN a.xi - 1 AND a.xi + 1 GROUP BY a.yi, a.xi)"


_WHOLE = "z1 + z2 + z3 + z4 + z6 + z7 + z8 + z9"
_HORN = f"{GRID}, {_z_sql()}, h AS (SELECT *, ((z3 + 2 * z6 + z9) - (z1 + 2 * z4 + z7)) / 240.0::DOUBLE AS p, ((z7 + 2 * z8 + z9) - (z1 + 2 * z2 + z3)) / 240.0::DOUBLE AS q FROM z)"
_ZT = f"""{GRID}, {_z_sql()}, h AS (SELECT *, ((z4 + z6) / 2 - z5) / 900 AS d, ((z2 + z8) / 2 - z5) / 900 AS e, (-z1 + z3 + z7 - z9) / 3600 AS f, (-z4 + z6) / 60 AS g, (z2 - z8) / 60 AS hh FROM z),
c AS (SELECT *, -2 * (d + e) * 100 AS cur, CASE WHEN g * g + hh * hh = 0 THEN 0 ELSE 2 * (d * g * g + e * hh * hh + f * g * hh) / (g * g + hh * hh) * 100 END AS prof,
  CASE WHEN g * g + hh * hh = 0 THEN 0 ELSE -2 * (d * hh * hh + e * g * g - f * g * hh) / (g * g + hh * hh) * 100 END AS plan, {_WHOLE} IS NOT NULL AS w FROM h)"""


def _rugosity_sql() -> str:
    ring = ["z1", "z2", "z3", "z6", "z9", "z8", "z7", "z4"]
    cols, areas = [], []
    for i, a in enumerate(ring):
        b = ring[(i + 1) % 8]
        far_a, far_b = ("1800" if i % 2 == 0 else "900"), ("1800" if (i + 1) % 8 % 2 == 0 else "900")
        cols.append(f"sqrt({far_a} + ({a} - z5) ** 2) / 2 AS a{i}, sqrt({far_b} + ({b} - z5) ** 2) / 2 AS b{i}, sqrt(900 + ({a} - {b}) ** 2) / 2 AS c{i}")
        h = f"((a{i} + b{i} + c{i}) / 2)"
        areas.append(f"sqrt(greatest({h} * ({h} - a{i}) * ({h} - b{i}) * ({h} - c{i}), 0))")
    return f"WITH {GRID}, {_z_sql()}, s AS (SELECT yi, xi, {_WHOLE} AS w, {', '.join(cols)} FROM z) SELECT yi, xi, CASE WHEN w IS NOT NULL THEN round(({' + '.join(areas)}) / 900, 6) + 0.0::DOUBLE END AS v FROM s"


#: The SQL of each attribute without rounding.
_ATTRIBUTE: dict[str, str] = {}


def _terrain_query(name: str, column: str, sql: str):
    _ATTRIBUTE[column] = sql.replace("round(", "(").replace(", 6) + 0.0::DOUBLE", ")")

    @register(name, sql)
    def plan(s, d):
        made = terrain.neighbours(grid(s, d))
        return made.select("yi", "xi", (F.round(terrain.attributes()[column], 6) + F.lit(0.0)).alias("v"))

    return plan


_terrain_query("terrain_slope", "slope", f"WITH {_HORN} SELECT yi, xi, round(degrees(atan(sqrt(p * p + q * q))), 6) + 0.0::DOUBLE AS v FROM h")
_terrain_query(
    "terrain_aspect", "aspect", f"WITH {_HORN} SELECT yi, xi, round(CASE WHEN degrees(atan2(-p, q)) + 360 >= 360 THEN degrees(atan2(-p, q)) ELSE degrees(atan2(-p, q)) + 360 END, 6) + 0.0::DOUBLE AS v FROM h"
)
_terrain_query(
    "terrain_hillshade",
    "hillshade",
    f"""WITH {_HORN}, a AS (SELECT *, atan(sqrt(p * p + q * q)) AS s, atan2(-p, q) AS asp FROM h)
    SELECT yi, xi, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN round(greatest(255 * (cos(radians(45)) * cos(s) + sin(radians(45)) * sin(s) * cos(radians(315) - asp)), 0), 6) + 0.0::DOUBLE END AS v FROM a""",
)
_terrain_query("terrain_curvature", "curvature", f"WITH {_ZT} SELECT yi, xi, round(cur, 6) + 0.0::DOUBLE AS v FROM c")
_terrain_query("terrain_profile_curvature", "profile_curvature", f"WITH {_ZT} SELECT yi, xi, CASE WHEN w THEN round(prof, 6) + 0.0::DOUBLE END AS v FROM c")
_terrain_query("terrain_planform_curvature", "planform_curvature", f"WITH {_ZT} SELECT yi, xi, CASE WHEN w THEN round(plan, 6) + 0.0::DOUBLE END AS v FROM c")
_terrain_query("terrain_max_curvature", "max_curvature", f"WITH {_ZT} SELECT yi, xi, CASE WHEN w THEN round(CASE WHEN abs(plan) > abs(prof) THEN plan ELSE prof END, 6) + 0.0::DOUBLE END AS v FROM c")
_terrain_query("terrain_tpi", "topographic_position_index", f"WITH {GRID}, {_z_sql()} SELECT yi, xi, round(z5 - ({_WHOLE}) / 8, 6) + 0.0::DOUBLE AS v FROM z")
_terrain_query(
    "terrain_tri",
    "terrain_ruggedness_index",
    f"WITH {GRID}, {_z_sql()} SELECT yi, xi, round(sqrt({' + '.join(f'(z{i} - z5) ** 2' for i in (1, 2, 3, 4, 6, 7, 8, 9))}), 6) + 0.0::DOUBLE AS v FROM z",
)
_terrain_query(
    "terrain_roughness",
    "roughness",
    f"WITH {GRID}, {_z_sql()} SELECT yi, xi, CASE WHEN {_WHOLE} IS NOT NULL THEN round(greatest(z1, z2, z3, z4, z5, z6, z7, z8, z9) - least(z1, z2, z3, z4, z5, z6, z7, z8, z9), 6) + 0.0::DOUBLE END AS v FROM z",
)
_terrain_query("terrain_rugosity", "rugosity", _rugosity_sql())


# --- resampling and zones --------------------------------------------------------------------------------------------


@register(
    "bands_long_and_wide",
    f"WITH {PIXELS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(b01, 6) AS b01, round(b02, 6) AS b02, round(b8a, 6) AS b8a FROM pixels",
)
def bands_long_and_wide(s, d):
    keys, bands = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["b01", "b02", "b8a"]
    long = resample.to_long(pixels(s, d).select(*keys, *bands), bands, keys, row="n")
    return resample.to_wide(long, bands, keys, row="n").select(*keys, *[F.round(b, 6).alias(b) for b in bands])


@register(
    "axis_spacing",
    f"""WITH {SITES}, u AS (SELECT DISTINCT site_id % 7 AS g, lat FROM sites), d AS (SELECT g, abs(lat - lag(lat) OVER (PARTITION BY g ORDER BY lat)) AS step FROM u)
    SELECT g, round(quantile_cont(step, 0.5), 6) AS resolution FROM d GROUP BY g""",
)
def axis_spacing(s, d):
    return resample.spacing(sites(s, d).withColumn("g", F.col("site_id") % 7), "lat", ("g",)).select("g", F.round("resolution", 6).alias("resolution"))


@register("block_mean", f"WITH {GRID} SELECT (yi // 4)::INTEGER AS yi, (xi // 4)::INTEGER AS xi, round(avg(elevation), 6) AS elevation FROM grid GROUP BY ALL")
def block_mean(s, d):
    return resample.block_mean(grid(s, d), 4).select("yi", "xi", F.round("elevation", 6).alias("elevation"))


@register(
    "mosaic_first",
    f"""WITH {GRID}, t AS (SELECT yi, xi, 0 AS tile, CASE WHEN p_size % 3 > 0 THEN elevation END AS v FROM grid WHERE xi < 25
      UNION ALL SELECT yi, xi, 1, elevation + 1000 FROM grid WHERE xi >= 15)
    SELECT yi, xi, arg_min(v, tile) FILTER (v IS NOT NULL) AS v FROM t GROUP BY yi, xi""",
)
def mosaic_first(s, d):
    g = grid(s, d)
    west = g.where("xi < 25").select("yi", "xi", F.lit(0).alias("tile"), F.when(F.col("p_size") % 3 > 0, F.col("elevation")).otherwise(float("nan")).alias("v"))
    east = g.where("xi >= 15").select("yi", "xi", F.lit(1).alias("tile"), (F.col("elevation") + 1000).alias("v"))
    return resample.mosaic_first(west.unionByName(east), "v", "tile")


@register(
    "bilinear",
    f"""WITH {GRID}, t AS (SELECT p_size, yi * 0.7::DOUBLE AS fy, xi * 0.9::DOUBLE + 0.3::DOUBLE AS fx FROM grid),
    c AS (SELECT fy, fx, floor(fy) AS y0, floor(fx) AS x0, fy - floor(fy) AS v, fx - floor(fx) AS u FROM t),
    w AS (SELECT fy, fx, y0 + dy AS y, x0 + dx AS x, (CASE dy WHEN 0 THEN 1 - v ELSE v END) * (CASE dx WHEN 0 THEN 1 - u ELSE u END) AS w FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(dy, dx)),
    j AS (SELECT fy, fx, w, elevation FROM w LEFT JOIN grid ON yi = y AND xi = x WHERE w > 0)
    SELECT round(fy, 6) AS fy, round(fx, 6) AS fx, CASE WHEN count(*) = count(elevation) THEN round(sum(w * elevation), 6) END AS elevation FROM j GROUP BY j.fy, j.fx""",
)
def bilinear(s, d):
    g = grid(s, d)
    t = g.select("raster_id", (F.col("yi") * 0.7).alias("fy"), (F.col("xi") * 0.9 + 0.3).alias("fx"))
    return resample.bilinear(g, t).select(F.round("fy", 6).alias("fy"), F.round("fx", 6).alias("fx"), F.round("elevation", 6).alias("elevation"))


_RING = [(-120.0, -40.0), (60.0, -50.0), (150.0, 10.0), (20.0, 5.0), (-10.0, 45.0), (-150.0, 30.0), (-120.0, -40.0)]


@register(
    "points_in_polygon",
    f"""WITH {SITES}, e(x1, y1, x2, y2) AS (VALUES {", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(_RING, _RING[1:], strict=False))})
    SELECT site_id, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1 AS inside FROM sites, e GROUP BY site_id""",
)
def points_in_polygon(s, d):
    ring = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in _RING])
    return sites(s, d).select("site_id", zonal.inside(F.col("lon"), F.col("lat"), ring).alias("inside"))


@register("crop_bounds", f"WITH {SITES} SELECT site_id, lat, lon FROM sites WHERE lat BETWEEN -20 AND 40 AND lon BETWEEN -100 AND 100")
def crop_bounds(s, d):
    return zonal.crop(sites(s, d), -100, -20, 100, 40)


# --- segments --------------------------------------------------------------------------------------------------------


def _classes(s, d):
    return grid(s, d).withColumn("v", F.when(F.col("p_size") % 10 > 0, (F.col("p_size") - 25) / 100.0)).withColumn("slope_class", segments.slope_class(F.col("v")))


_CLASS = f"{GRID}, k AS (SELECT yi, xi, CASE WHEN p_size % 10 = 0 THEN NULL WHEN abs((p_size - 25) / 100.0::DOUBLE) < 0.1 THEN 0 ELSE 1 END::INTEGER AS slope_class FROM grid)"


@register("slope_classes", f"WITH {_CLASS} SELECT yi, xi, slope_class, coalesce(slope_class, 1) AS parity FROM k")
def slope_classes(s, d):
    c = _classes(s, d)
    return c.select("yi", "xi", "slope_class", segments.slope_class(F.col("v"), parity=True).alias("parity"))


@register(
    "class_stats",
    f"""WITH {_CLASS} SELECT count(slope_class) AS total, count(*) FILTER (slope_class = 0) AS gentle_count, count(*) FILTER (slope_class = 1) AS steep_count,
      round(100.0::DOUBLE * count(*) FILTER (slope_class = 0) / count(slope_class), 6) AS gentle_percent,
      round(100.0::DOUBLE * count(*) FILTER (slope_class = 1) / count(slope_class), 6) AS steep_percent FROM k""",
)
def class_stats(s, d):
    c = segments.class_statistics(_classes(s, d))
    return c.select("total", "gentle_count", "steep_count", F.round("gentle_percent", 6).alias("gentle_percent"), F.round("steep_percent", 6).alias("steep_percent"))


_COMPONENTS = f"""WITH RECURSIVE {_CLASS}, n AS MATERIALIZED (SELECT yi * 40 + xi AS id, yi, xi, slope_class FROM k WHERE slope_class IS NOT NULL),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.slope_class = b.slope_class AND abs(a.yi - b.yi) <= 1 AND abs(a.xi - b.xi) <= 1 AND a.id <> b.id),
r(id, label) USING KEY (id) AS (SELECT id, id FROM n UNION SELECT r2.id, min(s.label) FROM e JOIN recurring.r r2 ON r2.id = e.a JOIN r s ON s.id = e.b WHERE s.label < r2.label GROUP BY r2.id)"""


@register("components8", f"{_COMPONENTS} SELECT n.yi, n.xi, n.slope_class, r.label::BIGINT AS label FROM n JOIN r ON r.id = n.id")
def components8(s, d):
    return segments.components8(_classes(s, d)).where("label is not null").select("yi", "xi", "slope_class", "label")


@register(
    "cluster_ids",
    f"""{_COMPONENTS}, z AS (SELECT slope_class, label, count(*) AS size FROM n JOIN r ON r.id = n.id GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY slope_class ORDER BY label) AS nth FROM z)
    SELECT n.yi, n.xi, (CASE WHEN size < 5 THEN 0 WHEN n.slope_class = 0 THEN nth ELSE -nth END)::INTEGER AS cluster_id FROM n JOIN r ON r.id = n.id
    JOIN m ON m.slope_class = n.slope_class AND m.label = r.label""",
)
def cluster_ids(s, d):
    return segments.cluster_ids(_classes(s, d), 5).where("slope_class is not null").select("yi", "xi", "cluster_id")


@register("polygon_area")
def polygon_area(s, d):
    p = segments.polygons(segments.cluster_ids(_classes(s, d), 5))
    return p.groupBy("class_name").agg(F.count("*").alias("polygons"), F.sum("area").alias("area"), F.sum(segments.ring_area(F.col("ring"))).alias("ring_area"))


# --- denoising -------------------------------------------------------------------------------------------------------


_IMAGE = f"""{GRID}, box AS (SELECT min(yi) AS y0, max(yi) AS y1, min(xi) AS x0, max(xi) AS x1, avg(elevation) AS mean FROM grid),
img AS (SELECT y::INTEGER AS yi, x::INTEGER AS xi, coalesce(elevation, mean) AS z, elevation IS NOT NULL AS ok
  FROM box CROSS JOIN LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) CROSS JOIN LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x) LEFT JOIN grid ON grid.yi = y AND grid.xi = x)"""


def _kernel_sql(r: int, value: str) -> str:
    return f"""WITH {_IMAGE}, n AS (SELECT a.yi, a.xi, a.z AS c, b.z AS v, dy, dx FROM img a CROSS JOIN box CROSS JOIN range(-{r}, {r + 1}) p(dy) CROSS JOIN range(-{r}, {r + 1}) q(dx)
      JOIN img b ON b.yi = greatest(y0, least(y1, a.yi + dy)) AND b.xi = greatest(x0, least(x1, a.xi + dx)) WHERE a.ok)
    SELECT yi, xi, round({value}, 6) AS elevation FROM n GROUP BY yi, xi"""


def _mean_sql(weight: str) -> str:
    return f"sum({weight} * v) / sum({weight})"


_NEAR = "(dy * dy + dx * dx) / (2 * 0.75::DOUBLE ** 2)"
_BY_ROW, _BY_COLUMN = "OVER (PARTITION BY yi ORDER BY xi)", "OVER (PARTITION BY xi ORDER BY yi)"
_WHOLE_ROW, _WHOLE_COLUMN = (w[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" for w in (_BY_ROW, _BY_COLUMN))


def _flow_sql(step: str, window: str) -> str:
    d = f"({step}(z) {window} - z)"
    return f"CASE WHEN ok AND coalesce({step}(ok) {window}, false) THEN exp(-(({d} / 30.0::DOUBLE) ** 2)) * {d} ELSE 0 END"


_DENOISE_SQL = {
    "gaussian": _kernel_sql(3, _mean_sql(f"exp(-{_NEAR})")),
    "bilateral": _kernel_sql(3, _mean_sql(f"exp(-{_NEAR} - (v - c) ** 2 / 2.0::DOUBLE)")),
    "adaptive": _kernel_sql(2, "CASE WHEN abs(min(c) - avg(v)) > 2.0::DOUBLE * stddev_pop(v) THEN avg(v) ELSE min(c) END"),
    "anisotropic": f"""WITH RECURSIVE {_IMAGE}, s AS (SELECT 0 AS i, yi, xi, z, ok FROM img
      UNION ALL SELECT i + 1, yi, xi, z + 0.15::DOUBLE * ({" + ".join(_flow_sql(f, w) for f in ("lead", "lag") for w in (_BY_ROW, _BY_COLUMN))}), ok FROM s WHERE i < 20)
    SELECT yi, xi, round(z, 6) AS elevation FROM s WHERE i = 20 AND ok""",
    "tv": f"""WITH RECURSIVE {_IMAGE}, s AS (SELECT 0 AS i, yi, xi, z, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py, ok FROM img
      UNION ALL SELECT i + 1, yi, xi, z + 0.15::DOUBLE * (px - coalesce(lag(px) {_BY_ROW}, last_value(px) {_WHOLE_ROW}) + py - coalesce(lag(py) {_BY_COLUMN}, last_value(py) {_WHOLE_COLUMN})), px, py, ok
      FROM (SELECT i, yi, xi, z, a / greatest(1.0::DOUBLE, sqrt(a * a + b * b)) AS px, b / greatest(1.0::DOUBLE, sqrt(a * a + b * b)) AS py, ok
        FROM (SELECT *, px + 0.125::DOUBLE / 0.15::DOUBLE * (coalesce(lead(z) {_BY_ROW}, first_value(z) {_BY_ROW}) - z) AS a,
          py + 0.125::DOUBLE / 0.15::DOUBLE * (coalesce(lead(z) {_BY_COLUMN}, first_value(z) {_BY_COLUMN}) - z) AS b FROM s WHERE i < 50)))
    SELECT yi, xi, round(z, 6) AS elevation FROM s WHERE i = 50 AND ok""",
}


def _denoise_query(method: str):
    @register(f"denoise_{method}", _DENOISE_SQL.get(method))
    def plan(s, d):
        out = dn.denoise(grid(s, d).select("raster_id", "yi", "xi", "elevation"), method)
        return out.select("yi", "xi", F.round("elevation_denoised", 6).alias("elevation"))

    return plan


for _method in dn.METHODS:
    _denoise_query(_method)


# --- pipelines -------------------------------------------------------------------------------------------------------



def _five(v: str, source: str | None = None) -> str:
    x = source or v
    return f"avg({x}) AS {v}_mean, quantile_cont({x}, 0.5) AS {v}_median, stddev_pop({x}) AS {v}_std, min({x}) AS {v}_min, max({x}) AS {v}_max"


_EMBEDDED = [f"emb_A{i:02d}" for i in range(pipeline.EMBEDDING)]
_VARIABLES = [*pipeline.TERRAIN, "solar_radiation", "ewma_perc", *_EMBEDDED]
_VECTOR = f"""{SITES}, {GRID}, {CUBE},
tr AS (SELECT grid.yi, grid.elevation AS reprojected_dem, {", ".join(f"{c}.v AS {c}" for c in _ATTRIBUTE)} FROM grid {" ".join(f"JOIN ({q}) {c} ON {c}.yi = grid.yi AND {c}.xi = grid.xi" for c, q in _ATTRIBUTE.items())}),
dem AS (SELECT yi AS zone, {", ".join(_five(v) for v in pipeline.TERRAIN)} FROM tr GROUP BY yi),
sun AS (SELECT user_id AS zone, {_five("solar_radiation", "value")} FROM events GROUP BY user_id),
al AS (SELECT t, CASE WHEN lag(t) OVER (ORDER BY t) IS NOT NULL THEN 1 - (1 - 0.1::DOUBLE) ** ((t - lag(t) OVER (ORDER BY t)) / 1.0::DOUBLE) END AS alpha_eff FROM days),
fold AS (SELECT pixel, {_SEEN} AS l FROM cube JOIN al ON al.t = cube.t GROUP BY pixel),
cloud AS (SELECT pixel % 50 AS zone, {_five("ewma_perc", "v")} FROM (SELECT pixel, list_reduce(l, {_FOLD}).v AS v FROM fold) GROUP BY zone),
emb AS (SELECT label AS zone, {", ".join(_five(v, f"embedding[{i + 1}]::DOUBLE") for i, v in enumerate(_EMBEDDED))} FROM embeddings GROUP BY label),
vec AS (SELECT sites.site_id, lat, lon, dem.* EXCLUDE (zone), sun.* EXCLUDE (zone), cloud.* EXCLUDE (zone), emb.* EXCLUDE (zone) FROM sites
  LEFT JOIN dem ON dem.zone = site_id % (SELECT max(yi) + 1 FROM grid) LEFT JOIN sun ON sun.zone = site_id
  LEFT JOIN cloud ON cloud.zone = site_id % 50 LEFT JOIN emb ON emb.zone = site_id % (SELECT max(label) + 1 FROM embeddings))"""


@register(
    "feature_vector",
    f"WITH {_VECTOR} SELECT site_id, lat AS latitude, lon AS longitude, "
    + ", ".join(f"round({v}_{k}, 6) + 0.0::DOUBLE AS {v}_{k}" for v in _VARIABLES for k in features.STATS)
    + " FROM vec",
)
def feature_vector(s, d):
    v = pipeline.feature_vectors(s, d)
    return v.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c.endswith(features.STATS) else F.col(c) for c in v.columns])


@register(
    "evaluate_sites",
    f"""WITH {_VECTOR}, c AS (SELECT site_id, lat, lon, least(greatest({pipeline.SURROGATE_SQL}, {scoring.CF_MIN}::DOUBLE), {scoring.CF_MAX}::DOUBLE) AS cf,
      1.0::DOUBLE + site_id % 400 AS p, CASE WHEN site_id % 5 = 0 THEN 8.5::DOUBLE ELSE 1.0::DOUBLE + site_id % 12 END AS tariff FROM vec),
    m AS (SELECT *, 75000.0::DOUBLE * p AS capex, 1000.0::DOUBLE * p AS opex, cf * 8760.0::DOUBLE * p * tariff AS rev FROM c)
    SELECT site_id, lat, lon, round(cf, 6) AS cf, round(cf * 100, 2) AS cf_percent,
      CASE WHEN cf < {scoring.LOW}::DOUBLE THEN 'low' WHEN cf < {scoring.HIGH}::DOUBLE THEN 'medium' ELSE 'high' END AS cf_category,
      CASE WHEN cf < {scoring.LOW}::DOUBLE THEN 'Низкий CF: ниже 16.7%.' WHEN cf < {scoring.HIGH}::DOUBLE THEN 'Средний CF: от 16.7% до 20.8%.' ELSE 'Высокий CF: выше 20.8%.' END AS cf_explanation,
      round(capex, 2) AS capex_rub, round(opex, 2) AS opex_year_rub, round(rev, 2) AS revenue_year_rub,
      CASE WHEN rev - opex > 0 THEN round(capex / (rev - opex), 3) END AS payback_years,
      CASE WHEN rev - opex > 0 THEN '{finance.NOTE_DONE}' ELSE '{finance.NOTE_NEVER}' END AS payback_note FROM m""",
)
def evaluate_sites(s, d):
    return pipeline.evaluate_sites(s, d)


def _scene_stencil(source: str, column: str, target: str, low: int, high: int, erode: bool) -> str:
    value = f"CASE WHEN count(*) = {(high - low + 1) ** 2} THEN min(b.{column}) ELSE 0 END" if erode else f"max(b.{column})"
    return (
        f"{target} AS (SELECT a.scene_id, a.yi, a.xi, {value} AS {column} FROM {source} a JOIN {source} b ON b.scene_id = a.scene_id "
        f"AND b.yi BETWEEN a.yi + {low} AND a.yi + {high} AND b.xi BETWEEN a.xi + {low} AND a.xi + {high} GROUP BY ALL)"
    )


_CELL_INDEX = _INDEX.replace(f"{PIXELS}, ", "", 1).replace("FROM pixels", "FROM read")


@register(
    "cloud_statistics",
    f"""WITH {SCENES}, target AS (SELECT unnest(generate_series(TIMESTAMP '2018-01-01', TIMESTAMP '2019-01-01', INTERVAL 30 DAY)) AS target),
    ranked AS (SELECT target, id, datetime, row_number() OVER (PARTITION BY target ORDER BY abs(epoch(datetime) - epoch(target)), datetime, id) AS k FROM items, target WHERE cloud <= 60),
    chosen AS (SELECT DISTINCT id AS scene_id, datetime AS t FROM ranked WHERE k = 1),
    read AS (SELECT cells.*, t FROM cells JOIN chosen ON chosen.scene_id = cells.scene_id), {_CELL_INDEX},
    f AS (SELECT *, coalesce(fmask & 3 > 0 OR (vis_mean > 0.23 AND b02 > 0.20 AND hot > 0.04 AND blue_nir > 0.90 AND whiteness < 0.28), false) AS is_cloud, fmask & 15 > 0 AS qa FROM i),
    p AS (SELECT *, is_cloud::INT AS cloud, ((fmask >> 3) & 1)::INT AS shadow, coalesce((((b01 > 0.075 AND b02 > 0.070 AND coastal_swir > 0.55)
      OR (hot > -0.01 AND blue_nir > 0.58 AND b11 < 0.20)) AND whiteness < 0.40 AND vis_mean > 0.07) AND ((fmask >> 6) = 3 OR ((fmask >> 6) = 2 AND hot > 0))
      AND NOT (fmask & 48 > 0 OR ndwi > 0.12) AND NOT (qa OR is_cloud), false)::INT AS haze, (b01 + b02 + b03 + b04 + b8a + b11 + b12) IS NOT NULL AS valid FROM f),
    {_scene_stencil("p", "cloud", "c1", -1, 1, False)}, {_scene_stencil("c1", "cloud", "c2", -1, 1, True)}, {_scene_stencil("c2", "cloud", "c3", 0, 1, False)},
    {_scene_stencil("p", "shadow", "s1", -1, 1, False)}, {_scene_stencil("s1", "shadow", "s2", -1, 1, True)},
    {_scene_stencil("p", "haze", "h1", -1, 0, True)}, {_scene_stencil("h1", "haze", "h2", 0, 1, False)},
    m AS (SELECT p.scene_id, p.t, p.yi, p.xi, valid::INT AS valid, greatest(c3.cloud, s2.shadow, h2.haze) * valid::INT AS hit FROM p JOIN c3 USING (scene_id, yi, xi) JOIN s2 USING (scene_id, yi, xi) JOIN h2 USING (scene_id, yi, xi)),
    k AS (SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE dy * dy + dx * dx <= 4),
    j AS (SELECT a.scene_id, a.t, a.yi, a.xi, sum(b.hit) AS c, sum(b.valid) AS v FROM m a, k JOIN m b ON b.scene_id = a.scene_id AND b.yi = greatest(0, least(11, a.yi + dy)) AND b.xi = greatest(0, least(11, a.xi + dx)) GROUP BY ALL),
    al AS (SELECT t, CASE WHEN lag(t) OVER (ORDER BY t) IS NOT NULL THEN 1 - (1 - 0.1::DOUBLE) ** ((epoch(t) - epoch(lag(t) OVER (ORDER BY t))) / 86400.0::DOUBLE / 30.0::DOUBLE) END AS a FROM chosen),
    l AS (SELECT yi, xi, list_prepend(struct_pack(v := NULL::DOUBLE, a := 0::DOUBLE), list(struct_pack(v := CASE WHEN j.v >= 8 THEN 100.0::DOUBLE * c / j.v END, a := al.a) ORDER BY j.t)) AS l FROM j JOIN al ON al.t = j.t GROUP BY yi, xi)
    SELECT yi::INTEGER AS yi, xi::INTEGER AS xi, round(list_reduce(l, {_FOLD}).v, 6) AS ewma_perc FROM l""",
)
def cloud_statistics(s, d):
    hours = F.expr("sequence(timestamp_ntz'2018-01-01', timestamp_ntz'2019-01-01', interval 30 days)")
    targets = s.range(1).select(F.explode(hours).alias("target"))
    final = pipeline.cloud_statistics(scene_items(s, d), scene_cells(s, d), targets, 60.0, 2, min_valid=8, nominal_days=30.0)
    return final.select("yi", "xi", F.round("ewma_final", 6).alias("ewma_perc"))


@register(
    "ewma_share_statistics",
    f"""WITH {_ALPHA}, f AS (SELECT pixel, {_SEEN} AS l FROM cube JOIN al ON al.t = cube.t GROUP BY pixel), e AS (SELECT pixel, list_reduce(l, {_FOLD}).v AS v FROM f)
    SELECT count(v) AS n, {", ".join(f"round({x}, 6) AS ewma_perc_{k}" for k, x in (("mean", "avg(v)"), ("median", "quantile_cont(v, 0.5)"), ("std", "stddev_pop(v)"), ("min", "min(v)"), ("max", "max(v)")))} FROM e""",
)
def ewma_share_statistics(s, d):
    final = series.ewma_final(_scene_cube(s, d)[0], ["pixel"], "t", "pct").select(F.lit(0).alias("site_id"), F.col("ewma_final").alias("ewma_perc"))
    stats = features.five_stats(final, ["ewma_perc"], ["site_id"])
    n = final.groupBy("site_id").agg(F.count("ewma_perc").alias("n"))
    return stats.join(n, "site_id").select("n", *[F.round(f"ewma_perc_{k}", 6).alias(f"ewma_perc_{k}") for k in features.STATS])


@register("half_precision", "SELECT p_partkey, CASE WHEN p_retailprice = 0 THEN 0 ELSE round_even(p_retailprice / 2 ** (floor(log2(abs(p_retailprice))) - 10), 0) * 2 ** (floor(log2(abs(p_retailprice))) - 10) END::DOUBLE AS v FROM part")
def half_precision(s, d):
    return table(s, d, "part").select("p_partkey", numeric.to_half(F.col("p_retailprice")).alias("v"))
