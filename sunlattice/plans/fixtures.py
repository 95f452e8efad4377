"""Rasters, sites, pixels, scenes and cubes derived from the driver tables, for Spark and, as CTEs, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.lit("g").alias("raster_id"),
        F.floor(F.col("p_partkey") / WIDTH).cast("int").alias("yi"),
        (F.col("p_partkey") % WIDTH).cast("int").alias("xi"),
        (F.col("p_retailprice") + 7.0 * F.col("p_size")).alias("elevation"),
        F.col("p_size").alias("p_size"),
    )


GRID = f"""grid AS (SELECT (p_partkey // {WIDTH})::INTEGER AS yi, (p_partkey % {WIDTH})::INTEGER AS xi,
  p_retailprice + 7.0::DOUBLE * p_size AS elevation, p_size FROM part)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("site_id"),
        (-60 + F.pmod(F.col("s_suppkey") * 7919, F.lit(12000)) / 100.0).alias("lat"),
        (-180 + F.pmod(F.col("s_suppkey") * 104729, F.lit(36000)) / 100.0).alias("lon"),
    )


SITES = """sites AS (SELECT s_suppkey AS site_id, -60 + (s_suppkey * 7919 % 12000) / 100.0::DOUBLE AS lat,
  -180 + (s_suppkey * 104729 % 36000) / 100.0::DOUBLE AS lon FROM supplier)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 31 + F.col("l_partkey"), F.lit(256)).cast("int").alias("fmask"),
        (F.col("l_discount") * 3.0).alias("b01"),
        (F.col("l_tax") * 4.0).alias("b02"),
        (F.col("l_quantity") / 200.0).alias("b03"),
        ((F.col("l_partkey") % 100) / 400.0).alias("b04"),
        ((F.col("l_suppkey") % 50) / 100.0).alias("b8a"),
        ((F.col("l_orderkey") % 40) / 100.0).alias("b11"),
        ((F.col("l_orderkey") % 30) / 100.0).alias("b12"),
    )


PIXELS = """pixels AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  ((l_orderkey * 7 + l_linenumber * 31 + l_partkey) % 256)::INTEGER AS fmask, l_discount * 3.0::DOUBLE AS b01,
  l_tax * 4.0::DOUBLE AS b02, l_quantity / 200.0::DOUBLE AS b03, (l_partkey % 100) / 400.0::DOUBLE AS b04,
  (l_suppkey % 50) / 100.0::DOUBLE AS b8a, (l_orderkey % 40) / 100.0::DOUBLE AS b11,
  (l_orderkey % 30) / 100.0::DOUBLE AS b12 FROM lineitem)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("datetime"),
        F.pmod(F.col("o_orderkey") * 37, F.lit(101)).cast("double").alias("cloud"),
    )


ITEMS = """items AS (SELECT o_orderkey AS id, o_orderdate::TIMESTAMP AS datetime,
  ((o_orderkey * 37) % 101)::DOUBLE AS cloud FROM orders)"""


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixel, t, pct on the full grid of pixels and days; NULL where a day has no event of the pixel."""
    e = table(spark, sf_dir, "events")
    daily = e.groupBy(F.col("user_id").alias("pixel"), F.to_date("ts").alias("t")).agg(F.least(F.lit(100.0), F.avg("value")).alias("pct"))
    span = e.agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))
    days = span.select(F.sequence("lo", "hi").alias("days"))
    full = e.select(F.col("user_id").alias("pixel")).distinct().join(F.broadcast(days)).select("pixel", F.explode("days").alias("t"))
    return full.join(daily, ["pixel", "t"], "left")


CUBE = """daily AS (SELECT user_id AS pixel, ts::DATE AS t, least(100.0::DOUBLE, avg(value)) AS pct FROM events GROUP BY ALL),
days AS (SELECT unnest(generate_series(min(ts::DATE), max(ts::DATE), INTERVAL 1 DAY))::DATE AS t FROM events),
cube AS (SELECT p.pixel, d.t, daily.pct FROM (SELECT DISTINCT user_id AS pixel FROM events) p CROSS JOIN days d
  LEFT JOIN daily ON daily.pixel = p.pixel AND daily.t = d.t)"""


#: Cells a side of a scene.
SCENE = 12
BANDS = ("b01", "b02", "b03", "b04", "b8a", "b11", "b12")


def scene_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, yi, xi, bands, fmask on full squares of SCENE cells; bands are NULL where there is no pixel."""
    p = pixels(spark, sf_dir)
    seen = p.groupBy(
        F.col("l_suppkey").alias("scene_id"), (F.col("l_orderkey") % SCENE).cast("int").alias("yi"), (F.col("l_partkey") % SCENE).cast("int").alias("xi")
    ).agg(*[F.avg(b).alias(b) for b in BANDS], F.max("fmask").alias("fmask"))
    every = p.select(F.col("l_suppkey").alias("scene_id")).distinct().select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(SCENE * SCENE - 1))).alias("c"))
    every = every.select("scene_id", F.floor(F.col("c") / SCENE).cast("int").alias("yi"), (F.col("c") % SCENE).cast("int").alias("xi"))
    return every.join(seen, ["scene_id", "yi", "xi"], "left").withColumn("fmask", F.coalesce("fmask", F.lit(0)))


def scene_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, datetime, cloud of the scenes: one every 77 hours."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    at = F.timestamp_add("HOUR", 77 * k, F.lit("2018-01-01").cast("timestamp_ntz"))
    return s.select(k.alias("id"), at.alias("datetime"), F.pmod(k * 37, F.lit(101)).cast("double").alias("cloud"))


SCENES = f"""{PIXELS},
seen AS (SELECT l_suppkey AS scene_id, l_orderkey % {SCENE} AS yi, l_partkey % {SCENE} AS xi, {", ".join(f"avg({b}) AS {b}" for b in BANDS)}, max(fmask) AS fmask FROM pixels GROUP BY ALL),
cells AS (SELECT e.scene_id, e.yi, e.xi, {", ".join(BANDS)}, coalesce(fmask, 0) AS fmask FROM (SELECT scene_id, yi, xi FROM (SELECT DISTINCT l_suppkey AS scene_id FROM pixels), range({SCENE}) y(yi), range({SCENE}) x(xi)) e
  LEFT JOIN seen ON seen.scene_id = e.scene_id AND seen.yi = e.yi AND seen.xi = e.xi),
items AS (SELECT s_suppkey AS id, TIMESTAMP '2018-01-01' + to_hours(77 * s_suppkey) AS datetime, ((s_suppkey * 37) % 101)::DOUBLE AS cloud FROM supplier)"""
