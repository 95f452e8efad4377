"""Plans whose work must not grow faster than the input."""

import pytest

from sunlattice.operators import areas, resample, series
from sunlattice.plans import catalogue_areas


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_areas_meet_cells_not_pixels(spark, monkeypatch):
    masked, seen = areas.masked_cells, []

    def counted(pixels, *args):
        seen.append((pixels.count(), pixels.select("raster_id", "yi", "xi").distinct().count()))
        return masked(pixels, *args)

    monkeypatch.setattr(areas, "masked_cells", counted)
    catalogue_areas.area_masks(spark, "/root/testdata/sf0.001")
    assert seen and all(n == cells for n, cells in seen)


@pytest.mark.parametrize("fill", ["interpolate", "ffill_bfill"])
def test_no_frame_shrinks_row_by_row(spark, fill):
    df = spark.range(5).selectExpr("0 AS k", "id AS t", "CASE WHEN id IN (1, 3) THEN id * 2.0D END AS v")
    made = getattr(series, fill)(df, ["k"], "t", "v", "out")
    assert "currentrow$(), unboundedfollowing$()" not in plan(made)
    want = [0.0, 2.0, 4.0, 6.0, 8.0] if fill == "interpolate" else [2.0, 2.0, 2.0, 6.0, 6.0]
    assert [r.out for r in made.orderBy("t").collect()] == want


def test_bands_are_put_together_in_one_exchange(spark):
    df = spark.range(4).selectExpr("id % 2 AS k", "id * 1.0D AS a", "CAST(NULL AS DOUBLE) AS b")
    wide = resample.to_wide(resample.to_long(df, ["a", "b"], ["k"], row="n"), ["a", "b"], ["k"], row="n")
    assert plan(wide).count("Exchange") == 1
    assert sorted(map(tuple, wide.select("k", "a", "b").collect())) == [(0, 0.0, None), (0, 2.0, None), (1, 1.0, None), (1, 3.0, None)]
