"""Areas on rasters, scenes of sites, and boxes, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sunlattice.operators import areas, focal, resample, series, zonal


def odd_even(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def ring_table(spark, rings, extra=""):
    rows = [(*k, [{"x": float(x), "y": float(y)} for x, y in ring] if ring is not None else None) for k, ring in rings]
    return spark.createDataFrame(rows, f"area_id int, raster_id int{extra}, ring array<struct<x:double,y:double>>")


def test_cells_of_many_areas(spark):
    rng, rings = random.Random(3), []
    for area in range(30):
        for _ in range(rng.choice([1, 1, 2])):
            points = [(rng.choice([rng.uniform(-5, 150), float(rng.randint(0, 140))]), rng.choice([rng.uniform(-5, 40), float(rng.randint(0, 30))])) for _ in range(rng.randint(3, 9))]
            rings.append(((area, area % 3), [*points, points[0]]))
    rings += [((90, 0), [(1, 1), (1, 1)]), ((91, 0), []), ((92, 0), None), ((93, 7), [(0, 0), (9, 0), (9, 9), (0, 0)]), ((94, 1), [(2, 2), (8, 2), (8, 8), (2, 8), (2, 2)])]
    cells = [(r, y, x, y * 1000 + x) for r in range(3) for y in range(35) for x in range(0, 145, 1 + r)]
    pixels = spark.createDataFrame(cells, "raster_id int, yi int, xi int, v int")
    strips = areas.area_strips(ring_table(spark, rings), ["area_id", "raster_id"])
    got = {(r.area_id, r.yi, r.xi): r.inside for r in areas.cells_of(pixels, strips, "raster_id").collect()}
    by_area = {}
    for (area, raster), ring in rings:
        if ring:
            by_area.setdefault((area, raster), []).append(ring)
    want = {}
    for (area, raster), own in by_area.items():
        xs, ys = zip(*[p for ring in own for p in ring], strict=True)
        for r, y, x, _ in cells:
            if r == raster and min(xs) <= x <= max(xs) and min(ys) <= y <= max(ys):
                want[area, y, x] = odd_even(x, y, own)
    assert got == want and 1000 < sum(want.values()) < len(want)
    masked = areas.masked_cells(pixels.withColumn("mask", F.lit(1)), strips, "raster_id", ["v"]).collect()
    assert all((r.v is not None) == r.inside and r.mask == int(r.inside) for r in masked) and len(masked) == len(want)
    plan = areas.cells_of(pixels, strips, "raster_id")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert areas.cells_of(pixels.limit(0), strips, "raster_id").count() == 0


def test_rectangles_are_whole(spark):
    ring = [(0.5, 0.5), (9.5, 0.5), (0.5, 9.5), (0.5, 0.5)]
    table = ring_table(spark, [((1, 0), ring), ((2, 0), ring)]).withColumn("rectangle", F.col("area_id") == 1)
    pixels = spark.createDataFrame([(0, y, x) for y in range(12) for x in range(12)], "raster_id int, yi int, xi int")
    strips = areas.area_strips(table, ["area_id", "raster_id"], rectangle="rectangle")
    counts = {r.area_id: (r.n, r.i) for r in areas.cells_of(pixels, strips, "raster_id").groupBy("area_id").agg(F.count("*").alias("n"), F.count_if("inside").alias("i")).collect()}
    assert counts[1] == (81, 81) and counts[2][0] == 81 and counts[2][1] == sum(odd_even(x, y, [ring]) for y in range(12) for x in range(12))


def test_ring_to_cells_agrees_with_the_projection(spark):
    ring = [(9.1, 48.2), (9.4, 48.2), (9.3, 48.5), (9.1, 48.2)]
    table = ring_table(spark, [((1, 0), ring)]).withColumns({"zone": F.lit(32), "x0": F.lit(500015.0), "y0": F.lit(5380000.0)})
    moved = table.select(F.explode(areas.ring_to_cells(F.col("ring"), F.col("zone"), F.col("x0"), F.col("y0"), F.lit(30.0), F.lit(-30.0))).alias("p"))
    metres = resample.utm_forward(F.lit(48.5), F.lit(9.3), F.lit(32))
    at = spark.range(1).select(*[c.alias(k) for k, c in metres.items()]).first()
    third = moved.collect()[2].p
    assert third.x == pytest.approx((at.easting - 500015.0) / 30) and third.y == pytest.approx((5380000.0 - at.northing) / 30)
    inner = zonal.inside(F.lit(9.25), F.lit(48.3), F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    assert table.select(inner).first()[0]


def test_box_join_meets_each_pair_once(spark):
    rng = random.Random(8)

    def boxes(n, size):
        rows = []
        for i in range(n):
            lon, lat = rng.uniform(-12, 12), rng.uniform(-12, 12)
            rows.append((i, lon, lat, lon + rng.uniform(0, size), lat + rng.uniform(0, size)))
        return rows + [(n, None, 0.0, 1.0, 1.0), (n + 1, 5.0, 0.0, -5.0, 1.0)]

    a, b = boxes(80, 3.5), boxes(90, 0.4)
    schema = "id int, min_lon double, min_lat double, max_lon double, max_lat double"
    got = areas.box_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 0.7).select("id", "r_id").collect()
    want = [(p[0], q[0]) for p in a for q in b if None not in p + q and p[1] <= p[3] and q[1] <= q[3] and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 30


@pytest.mark.parametrize("max_cloud", [None, 20.0])
def test_nearest_in_window(spark, max_cloud):
    rng, zero = random.Random(5), datetime(2020, 1, 1)
    items = [(rng.choice(["a", "b", "c"]), i % 70, zero + timedelta(hours=rng.randrange(9000)), rng.choice([None, 5.0, 15.0, 20.0, 60.0, 90.0])) for i in range(140)]
    items += items[:9] + [(None, 1, zero, 1.0), ("a", 2, None, 1.0)]
    asked = [(i, rng.choice(["a", "b", "c", "d"]), zero + timedelta(hours=rng.randrange(-900, 9900))) for i in range(120)]
    asked += [(200, k, t) for k, _, t, _ in items[:30]] + [(300, None, zero), (301, "a", None)]
    got = areas.nearest_in_window(
        spark.createDataFrame(items, "tile string, id int, datetime timestamp_ntz, cloud double"), spark.createDataFrame(asked, "site int, tile string, target timestamp_ntz"), "tile", 10, max_cloud
    )
    rows = [(r.site, r.tile, r.target, r.scene_id, r.scene_time, r.gap_s) for r in got.collect()]
    want = []
    for site, tile, target in asked:
        near = [x for x in items if x[0] == tile and tile and target and x[2] and abs(x[2] - target) <= timedelta(days=10)]
        clear = [x for x in near if max_cloud is None or (x[3] is not None and x[3] <= max_cloud)]
        best = min(clear or near, key=lambda x: (abs(x[2] - target), 1e9 if x[3] is None else x[3], x[1]), default=None)
        want.append((site, tile, target, *((best[1], best[2], int(abs(best[2] - target).total_seconds())) if best else (None,) * 3)))
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_discs_of_rasters_that_start_anywhere(spark):
    cells = [("r", y, x, (y * 7 + x * 3) % 5) for y in range(-3, 5) for x in range(6, 15)]
    df = spark.createDataFrame(cells, "raster_id string, yi int, xi int, v int")
    value = {(y, x): v for _, y, x, v in cells}
    for r in focal.disc_sums(df, ["v"], 2).collect():
        near = [(min(4, max(-3, r.yi + a)), min(14, max(6, r.xi + b))) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4]
        assert r.v_disc == sum(value[p] for p in near)


def test_repeated_keys_keep_their_rows(spark):
    rows = [(1, 1.0, 2.0), (1, 3.0, None), (2, None, None), (None, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    wide = resample.to_wide(resample.to_long(df, ["a", "b"], ["k"], row="n"), ["a", "b"], ["k"], row="n")
    assert sorted(map(tuple, wide.select("k", "a", "b").collect()), key=repr) == sorted(rows, key=repr)
    single = df.where("k = 2 or k is null")
    assert resample.to_wide(resample.to_long(single, ["a", "b"], ["k"]), ["a", "b"], ["k"]).count() == 2
    with pytest.raises(Exception, match="repeat a key"):
        resample.to_wide(resample.to_long(df, ["a", "b"], ["k"]), ["a", "b"], ["k"]).collect()


def test_drop_missing_judges_original_rows(spark):
    rows = [(t, c, None if t == 2 or c == "z" or (t, c) == (1, "x") else 1.0) for t in (1, 2, 3, None) for c in ("x", "y", "z", None)]
    df = spark.createDataFrame(rows, "t int, cell string, v double")
    got = series.drop_missing(df, "t", ["cell"], "v").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((r for r in rows if r[0] != 2 and r[1] != "z"), key=repr)
