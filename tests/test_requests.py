"""Tiles of requests, terrain of areas, and arrays on a grid."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunlattice.operators import requests, resample, terrain, warp


def test_request_tiles_are_those_of_the_plain_split(spark):
    rng, boxes = random.Random(4), []
    for i in range(60):
        lon, lat = rng.uniform(-170, 150), rng.uniform(-80, 70)
        boxes.append((i, lon, lat, lon + rng.choice([1e-5, 0.5, 3, 12]), lat + rng.choice([1e-5, 0.5, 3, 9])))
    bad = [(90, 1.0, 1.0, 1.0, 2.0), (91, None, 1.0, 2.0, 2.0), (92, 3.0, 5.0, 4.0, 4.0)]
    df = spark.createDataFrame(boxes + bad, "id int, min_lon double, min_lat double, max_lon double, max_lat double")
    got = {}
    for r in requests.request_tiles(df, 30.0, 3, 5000).collect():
        got.setdefault(r.id, set()).add(tuple(round(v, 9) for v in (r.min_lon, r.min_lat, r.max_lon, r.max_lat)))
    assert set(got) == {b[0] for b in boxes} and max(map(len, got.values())) > 50
    for i, *box in boxes:
        assert got[i] == {tuple(round(v, 9) for v in t) for t in resample.export_tiles(tuple(box), 30.0, 3, 5000)}, box
    with pytest.raises(Exception, match="can't be split"):
        requests.request_tiles(df.where("id = 0").withColumn("max_lon", F.col("min_lon") + 300), 0.01, 1, 50).collect()


def test_terrain_of_areas_is_that_of_the_raster(spark):
    rng = random.Random(6)
    cells = [(k, y, x, rng.uniform(0, 50)) for k in "ab" for y in range(30) for x in range(25)] + [("one", 0, 0, 7.5)]
    elevation = spark.createDataFrame(cells, "raster_id string, yi int, xi int, elevation double")
    step = 0.0003
    frames = spark.createDataFrame([(k, 10.0, 45.0, step, -step) for k in ("a", "b", "one")], "raster_id string, x0 double, y0 double, dx double, dy double")
    areas = [(i, rng.choice("ab"), 10 + step * x, 45 - step * (y + h), 10 + step * (x + w), 45 - step * y) for i in range(12) for x, y, w, h in [(rng.uniform(-3, 22), rng.uniform(-3, 25), rng.uniform(0, 9), rng.uniform(0, 9))]]
    areas += [(50, "one", 9.9, 44.9, 10.1, 45.1), (51, "a", 0.0, 0.0, 1.0, 1.0), (52, "a", None, 0.0, 1.0, 1.0), (53, "none", 9.0, 44.0, 11.0, 46.0)]
    df = spark.createDataFrame(areas, "area_id int, raster_id string, min_lon double, min_lat double, max_lon double, max_lat double")
    whole = {(r.raster_id, r.yi, r.xi): r.slope for r in terrain.terrain(elevation).collect()}
    got = {(r.area_id, r.yi, r.xi): r.slope for r in requests.area_terrain(elevation, frames, df, halo=2).collect()}
    want = {}
    for i, k, lon0, lat0, lon1, lat1 in areas:
        for r, y, x, _ in cells:
            if r == k and lon0 is not None and lon0 <= 10 + x * step <= lon1 and lat0 <= 45 - y * step <= lat1:
                want[i, y, x] = whole[k, y, x]
    assert got == {k: v if v is None else pytest.approx(v) for k, v in want.items()} and len(want) > 200 and got[50, 0, 0] is None
    wide = requests.area_elevation(elevation, frames, df.where("area_id < 12"), halo=2)
    assert wide.count() > sum(k[0] < 12 for k in want) == wide.where("inside").count()


def test_arrays_keep_to_columns(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(9, 8, 5))
    rows = [("a", y, x, t, [float(v) for v in values[y, x] + 100 * (t > 1)] if (y, x, t) != (4, 4, 1) else None) for y in range(9) for x in range(8) for t in ((1, 2) if x > 3 else (1,)) if (y, x) != (0, 0)]
    tiles = spark.createDataFrame(rows, "raster_id string, yi int, xi int, tile int, v array<double>")
    mosaic = values.copy()
    mosaic[4, 4] += 100
    mosaic[0, 0] = np.nan
    frames = warp.onto(spark.createDataFrame([("a", None, None, 0.0, 0.0, 1.0, -1.0, 9, 8)], "raster_id string, zone int, south boolean, x0 double, y0 double, dx double, dy double, rows int, columns int"), zone=None, x0=0.25, y0=-0.75, dx=0.5, dy=-0.5)
    plan = requests.arrays_on_grid(tiles, frames, "v", 5, "tile", 1)
    got = {(r.yi, r.xi): r.v for r in plan.collect()}
    for (yi, xi), v in got.items():
        y, x = 0.75 + 0.5 * yi, 0.25 + 0.5 * xi
        a, b = int(np.floor(y)), int(np.floor(x))
        if 0 <= a < 8 and 0 <= b < 7:
            u, w = y - a, x - b
            want = (1 - u) * ((1 - w) * mosaic[a, b] + w * mosaic[a, b + 1]) + u * ((1 - w) * mosaic[a + 1, b] + w * mosaic[a + 1, b + 1])
            assert (v is None) == bool(np.isnan(want).any()) and (v is None or v == pytest.approx(want.tolist()))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert len(got) > 150 and "posexplode" not in text and text.count("Generate") == text.count("Generate explode")
    means = {(r.yi, r.xi): r.v for r in requests.block_mean_arrays(requests.mosaic_arrays(tiles, "v", "tile"), "v", 5, 4).collect()}
    assert means[1, 1] == pytest.approx(mosaic[4:8, 4:8].reshape(-1, 5).mean(axis=0).tolist()) and means[0, 0] == pytest.approx(np.nanmean(mosaic[:4, :4].reshape(-1, 5), axis=0).tolist())
