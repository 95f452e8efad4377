"""Rasters moved between projections."""

import pytest
from pyspark.sql import functions as F

from sunlattice.operators import denoise, resample, warp

FRAME = "raster_id string, zone int, south boolean, x0 double, y0 double, dx double, dy double, rows int, columns int"


def raster(spark, rid, rows, columns, value, skip=()):
    return spark.createDataFrame([(rid, y, x, float(value(y, x)), y * 100 + x) for y in range(rows) for x in range(columns) if (y, x) not in skip], "raster_id string, yi int, xi int, v double, q int")


def test_same_grid_is_the_same_raster(spark):
    frames = spark.createDataFrame([("a", 32, False, 500015.0, 5.3e6, 30.0, -30.0, 7, 9)], FRAME)
    cells = raster(spark, "a", 7, 9, lambda y, x: y * x, skip={(3, 3)})
    same = warp.onto(frames, zone=32, south=False, x0=500015.0, y0=5.3e6, dx=30.0, dy=-30.0, rows=7, columns=9)
    got = {(r.yi, r.xi): (r.v, r.q) for r in warp.warp(cells, same, ["v"], ("q",)).collect()}
    assert got == {(r.yi, r.xi): (pytest.approx(r.v), r.q) for r in cells.collect()}


@pytest.mark.parametrize("zone, lat", [(19, -33.0), (33, 0.003)])
def test_there_and_back_over_a_plane(spark, zone, lat):
    lon = 6.0 * zone - 182.0
    frames = spark.createDataFrame([("a", None, None, lon, lat, 0.0004, -0.0004, 20, 24)], FRAME)
    plane = lambda y, x: 3 * (lon + x * 0.0004) - 5 * (lat - y * 0.0004)
    cells = raster(spark, "a", 20, 24, plane)
    there = warp.utm_frames(frames)
    r = there.first()
    assert (r.t_zone, r.t_rows > 15, r.t_columns > 15) == (zone, True, True)
    flat = warp.warp(cells, there, ["v"], ("q",))
    back = {(r.yi, r.xi): r.v for r in warp.warp(flat, warp.turned(there), ["v"]).collect()}
    inner = [(y, x) for y in range(3, 17) for x in range(3, 21)]
    assert all(back[p] == pytest.approx(plane(*p), abs=1e-6) for p in inner) and max(p[0] for p in back) == 19
    # each metric cell has the value of the plane at its own place
    at = flat.join(there, "raster_id").select("yi", "xi", "v", "q", *[c.alias(n) for n, c in resample.utm_inverse(F.col("t_x0") + F.col("xi") * F.col("t_dx"), F.col("t_y0") + F.col("yi") * F.col("t_dy"), F.col("t_zone"), F.col("t_south")).items()])
    for c in at.where("v is not null").collect():
        assert c.v == pytest.approx(3 * c.lon - 5 * c.lat, abs=1e-6)
        assert c.q == int((lat - c.lat) / 0.0004 + 0.5) * 100 + int((c.lon - lon) / 0.0004 + 0.5)


def test_scenes_of_several_zones_meet(spark):
    """The same places seen from two zones have the same values on a common grid."""
    value = lambda lon, lat: 40 * lon + 30 * lat
    frames = spark.createDataFrame([("w", 31, False, 705000.0, 5330000.0, 500.0, -500.0, 40, 40), ("e", 32, False, 275000.0, 5330000.0, 500.0, -500.0, 40, 40), ("none", 33, False, 0.0, 0.0, 30.0, -30.0, 3, 3)], FRAME)
    index = spark.range(1600).select((F.col("id") / 40).cast("int").alias("yi"), (F.col("id") % 40).cast("int").alias("xi"))
    all_ = frames.where("raster_id <> 'none'").join(index)
    places = resample.utm_inverse(F.col("x0") + F.col("xi") * F.col("dx"), F.col("y0") + F.col("yi") * F.col("dy"), F.col("zone"), F.lit(False))
    cells = all_.select("raster_id", "yi", "xi", value(places["lon"], places["lat"]).alias("v"))
    common = warp.onto(frames, zone=None, south=False, x0=5.0, y0=49.0, dx=0.005, dy=-0.005)
    rows = warp.warp(cells, common, ["v"]).where("v is not null").collect()
    seen = {}
    for r in rows:
        assert r.v == pytest.approx(value(5 + r.xi * 0.005, 49 - r.yi * 0.005), abs=1e-3)
        seen.setdefault((r.yi, r.xi), set()).add(r.raster_id)
    assert sum(len(x) == 2 for x in seen.values()) > 50 and len(rows) > 1000


def test_denoise_round_trip_keeps_cells_and_columns(spark):
    frames = spark.createDataFrame([("a", None, None, 9.0, 48.0, 0.0004, -0.0004, 14, 15), ("m", 32, False, 5e5, 5.3e6, 30.0, -30.0, 10, 10)], FRAME)
    cells = raster(spark, "a", 14, 15, lambda y, x: y + x, skip={(5, 5)}).unionByName(raster(spark, "m", 10, 10, lambda y, x: (y * x) % 7)).unionByName(raster(spark, "lost", 2, 2, lambda y, x: 1))
    got = warp.denoise_round_trip(cells, frames, "gaussian", "v")
    assert got.columns == [*cells.columns, "v_denoised"] or sorted(got.columns) == sorted([*cells.columns, "v_denoised"])
    rows = {(r.raster_id, r.yi, r.xi): r.v_denoised for r in got.collect()}
    assert len(rows) == cells.count() and all(rows["lost", y, x] is None for y in range(2) for x in range(2))
    assert rows["a", 10, 10] == pytest.approx(20, abs=0.2)
    plain = {(r.yi, r.xi): r.v_denoised for r in denoise.denoise(cells.where("raster_id = 'm'"), "gaussian", "v").collect()}
    assert all(rows["m", y, x] == pytest.approx(v) for (y, x), v in plain.items())
    assert warp.denoise_round_trip(cells.limit(0), frames, "gaussian", "v").count() == 0
