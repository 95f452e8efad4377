"""Hand-computed values of the scalar families."""

import math

import pytest
from pyspark.sql import functions as F

from sunlattice.functions import aoi, finance, numeric, scoring, spectral
from sunlattice.operators import resample, scenes


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_payback(spark):
    r = one(spark, **finance.rounded_response(F.lit(0.2), F.lit(120.0), F.lit(8.5)))
    assert (r.capex_rub, r.opex_year_rub, r.revenue_year_rub, r.payback_years) == (9_000_000, 120_000, 1_787_040, 5.399)
    r = one(spark, **finance.rounded_response(F.lit(0.01), F.lit(120.0), F.lit(8.5)))
    assert r.payback_years is None and r.payback_note == finance.NOTE_NEVER


def test_request_ranges(spark):
    rows = [(55.0, 37.0, 120.0, 8.5), (91.0, 0.0, 1.0, 1.0), (0.0, 0.0, 0.05, 1.0), (0.0, 0.0, 586.1, 1.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 1.0, None), (None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, p double, t double")
    got = [r[0] for r in df.select(finance.valid_request(F.col("lat"), F.col("lon"), F.col("p"), F.col("t"))).collect()]
    assert got == [True, False, False, False, False, True, False]


def test_class_edges(spark):
    values = [(0.1,), (scoring.LOW,), (scoring.HIGH,), (float("nan"),)]
    df = spark.createDataFrame(values, "cf double").select(scoring.classify(F.col("cf"))["cf_category"].alias("c"))
    assert [r.c for r in df.collect()] == ["low", "medium", "high", "high"]


def test_features_fill_missing_and_infinite(spark):
    df = spark.createDataFrame([(1, 0.0, 90.0, float("inf"))], "site_id long, latitude double, longitude double, a double")
    r = scoring.build_features(df, ["lat_cos", "lon_sin", "a", "b"]).first()
    assert (r.lat_cos, r.lon_sin, r.a, r.b, r.features_missing) == (1.0, 1.0, 0.0, 0.0, 2)


def test_nan_comparisons(spark):
    nan = F.lit(float("nan"))
    r = one(spark, a=numeric.gt(nan, 0.2), b=numeric.lt(nan, 0.2), c=numeric.safe_div(F.lit(1.0), F.lit(-5.0)), d=numeric.to_half(F.lit(3001.7)))
    assert (r.a, r.b, r.c, r.d) == (False, False, 1e6, 3002.0)


def test_quality_bits(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 4, 8, 16, 32, 128, 192, 255, None)], "f int")
    flags = spectral.qa_bits(F.col("f"))
    got = {r.f: [k for k in flags if r[k]] for r in df.select("f", *[c.alias(k) for k, c in flags.items()]).collect()}
    assert got[0] == got[None] == [] and got[1] == ["cirrus"] and got[32] == ["water"]
    assert got[128] == ["aerosol_moderate"] and got[192] == ["aerosol_high"] and "aerosol_moderate" not in got[255]


@pytest.mark.parametrize(
    "text, seconds", [("P1DT12H", 129600), ("P1M", None), ("PT0S", None), ("P30D", 2592000), ("", None), ("PT5M", 300), ("P1W", None)]
)
def test_durations(spark, text, seconds):
    assert one(spark, s=aoi.duration_seconds(F.lit(text))).s == seconds


def test_schedule_includes_the_end(spark):
    r = one(spark, s=F.size(aoi.schedule(aoi.parse_time(F.lit("2018-01-01")), aoi.parse_time(F.lit("2019-01-01")), aoi.duration(F.lit("P30D")))))
    assert r.s == 13


def test_rings(spark):
    def ring(*points):
        return F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in points])

    square = ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    triangle = ring((0, 0), (1, 0), (1, 1), (0, 0))
    unclosed = ring((0, 0), (1, 0), (1, 1), (0, 1))
    swapped = ring((10, 100), (10, 101), (11, 101), (10, 100))
    r = one(
        spark,
        a=aoi.is_axis_aligned(square),
        b=aoi.is_axis_aligned(triangle),
        c=aoi.valid_ring(triangle),
        d=aoi.valid_ring(unclosed),
        e=F.get(F.get(aoi.swap_if_latitudes_first(swapped), F.lit(0)), F.lit(0)),
        f=aoi.safe_filename(F.lit("2018-01-01T00:00")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (True, False, True, False, 100.0, "2018-01-01_00-00")


def test_single_feature_needs_one_feature(spark):
    f = '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"time":null}}'
    two = '{"type":"FeatureCollection","features":[%s,%s]}' % (f, f)
    r = one(spark, a=aoi.single_feature(F.lit(f))["geometry"]["type"], b=aoi.single_feature(F.lit(two))["geometry"])
    assert r.a == "Point" and r.b is None


def test_time_property(spark):
    texts = [(None,), ('"2018-01-01"',), ('["2018-01-01","2019-01-01","P30D"]',), ('["2019-01-01","2018-01-01","P30D"]',), ('["a","b"]',)]
    df = spark.createDataFrame(texts, "t string").select(aoi.parse_time_property(F.col("t"))["mode"].alias("m"))
    assert [r.m for r in df.collect()] == ["null", "instant", "range", "invalid", "invalid"]


def test_utm(spark):
    r = one(spark, **resample.utm_forward(F.lit(45.0), F.lit(3.0)))
    assert abs(r.northing - 4982950.400) < 1e-3 and abs(r.easting - 500000.0) < 1e-6


def test_export_tiles_keep_the_limits():
    tiles = resample.export_tiles((30.0, 50.0, 40.0, 58.0), 30.0, bands=2, max_side=8000)
    assert len(tiles) > 1 and math.isclose(sum((c - a) * (d - b) for a, b, c, d in tiles), 80.0)
    assert resample.max_pixels_one_request(1) == int(50_331_648 * 0.88 / 8)


def test_cloud_cover_and_epsg(spark):
    zero = F.create_map(F.lit("eo:cloud_cover"), F.lit("0"))
    r = one(
        spark,
        a=scenes.cloud_cover(zero),
        b=scenes.cloud_cover(zero, parity=True),
        c=scenes.item_epsg(F.lit("X.T37MDB.1")),
        d=scenes.item_epsg(F.lit("X.T37NDB.1")),
        e=scenes.item_epsg(F.lit("none"), F.lit("32633")),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == (0.0, 1e9, 32737, 32637, 32633)


def test_series_requests(spark):
    import json

    def asked(geometry, time, kind="FeatureCollection"):
        feature = {"type": "Feature", "geometry": geometry, "properties": {"time": time}}
        text = json.dumps({"type": kind, "features": [feature, feature]})
        return one(spark, **aoi.series_request(F.lit(text)))

    square = {"type": "Polygon", "coordinates": [[[1.0, 5.0], [3.0, 5.0], [3.0, 6.0], [1.0, 5.0]]]}
    r = asked(square, ["2018-01-01", "2018-01-02", "PT12H30M"])
    assert (r.min_lon, r.min_lat, r.max_lon, r.max_lat) == (1, 5, 3, 6)
    assert [t.isoformat() for t in r.times] == ["2018-01-01T00:00:00", "2018-01-01T12:00:00", "2018-01-02T00:00:00"]
    r = asked({"type": "Point", "coordinates": [10.0, 20.0]}, ["2018-01-01", "2018-03-05"])
    assert (r.min_lon, r.max_lat) == (10, 20) and [t.day for t in r.times] == [1, 5]
    assert asked(square, ["2018-01-01", "2018-01-02", "PT30M"]).times is None
    assert asked(square, ["2018-01-02", "2018-01-01", "PT1H"]).times is None
    assert asked(square, ["2018-01-01"], "Feature").times is None
