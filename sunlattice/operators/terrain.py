"""Terrain attributes from 3x3 neighbourhoods (Horn 1981; Zevenbergen and Thorne 1987; Weiss 2001; Riley 1999;
Dartnell 2000; Jenness 2004). Cells without eight neighbours have NULL attributes."""

from __future__ import annotations

from math import cos, radians, sin, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, value: str = "elevation", keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """Adds z1..z9, row-major from the north-west, NULL outside the raster or beyond a hole.

    One window along rows makes triples, one along columns takes the triples above and below; a lagged cell counts only
    if its index is the adjacent one.
    """
    k = list(keys)
    along = Window.partitionBy(*k, "yi").orderBy("xi")
    down = Window.partitionBy(*k, "xi").orderBy("yi")
    west = F.when(F.lag("xi").over(along) == F.col("xi") - 1, F.lag(value).over(along))
    east = F.when(F.lead("xi").over(along) == F.col("xi") + 1, F.lead(value).over(along))
    row = df.withColumn("_t", F.struct(west.alias("w"), F.col(value).alias("c"), east.alias("e")))
    above = F.when(F.lag("yi").over(down) == F.col("yi") - 1, F.lag("_t").over(down))
    below = F.when(F.lead("yi").over(down) == F.col("yi") + 1, F.lead("_t").over(down))
    full = row.withColumn("_a", above).withColumn("_b", below)
    names = [("_a", "w"), ("_a", "c"), ("_a", "e"), ("_t", "w"), ("_t", "c"), ("_t", "e"), ("_b", "w"), ("_b", "c"), ("_b", "e")]
    return full.withColumns({f"z{i + 1}": F.col(t)[f].cast("double") for i, (t, f) in enumerate(names)}).drop("_t", "_a", "_b")


def _z() -> list[Column]:
    return [F.lit(None)] + [F.col(f"z{i}") for i in range(1, 10)]


def attributes(cell: float = 30.0, azimuth: float = 315.0, altitude: float = 45.0) -> dict[str, Column]:
    """All attributes as columns of z1..z9."""
    z = _z()
    p = ((z[3] + 2 * z[6] + z[9]) - (z[1] + 2 * z[4] + z[7])) / (8 * cell)
    q = ((z[7] + 2 * z[8] + z[9]) - (z[1] + 2 * z[2] + z[3])) / (8 * cell)
    slope = F.atan(F.sqrt(p * p + q * q))
    aspect = F.pmod(F.degrees(F.atan2(-p, q)) + 360.0, F.lit(360.0))
    zenith = radians(90.0 - altitude)
    shade = 255.0 * (cos(zenith) * F.cos(slope) + sin(zenith) * F.sin(slope) * F.cos(F.radians(F.lit(azimuth) - aspect)))
    d = ((z[4] + z[6]) / 2 - z[5]) / (cell * cell)
    e = ((z[2] + z[8]) / 2 - z[5]) / (cell * cell)
    f = (-z[1] + z[3] + z[7] - z[9]) / (4 * cell * cell)
    g = (-z[4] + z[6]) / (2 * cell)
    h = (z[2] - z[8]) / (2 * cell)
    gh = g * g + h * h
    flat = gh == 0
    divisor = F.when(~flat, gh)
    profile = F.when(flat, 0.0).otherwise(2 * (d * g * g + e * h * h + f * g * h) / divisor * 100)
    plan = F.when(flat, 0.0).otherwise(-2 * (d * h * h + e * g * g - f * g * h) / divisor * 100)
    ring = [z[1], z[2], z[3], z[6], z[9], z[8], z[7], z[4]]
    eight = sum(ring[1:], ring[0])
    squares = sum(((r - z[5]) * (r - z[5]) for r in ring[1:]), (ring[0] - z[5]) * (ring[0] - z[5]))
    whole = eight.isNotNull()
    far = [cell * sqrt(2.0) if i % 2 == 0 else cell for i in range(8)]
    area = F.lit(0.0)
    for i in range(8):
        a = F.sqrt(far[i] ** 2 + (ring[i] - z[5]) * (ring[i] - z[5])) / 2
        j = (i + 1) % 8
        b = F.sqrt(far[j] ** 2 + (ring[j] - z[5]) * (ring[j] - z[5])) / 2
        c = F.sqrt(cell**2 + (ring[i] - ring[j]) * (ring[i] - ring[j])) / 2
        s = (a + b + c) / 2
        area = area + F.sqrt(F.greatest(s * (s - a) * (s - b) * (s - c), F.lit(0.0)))
    return {
        "slope": F.degrees(slope),
        "aspect": aspect,
        "hillshade": F.when(whole, F.greatest(shade, F.lit(0.0))),
        "curvature": -2 * (d + e) * 100,
        "planform_curvature": F.when(whole, plan),
        "profile_curvature": F.when(whole, profile),
        "max_curvature": F.when(whole, F.when(F.abs(plan) > F.abs(profile), plan).otherwise(profile)),
        "topographic_position_index": z[5] - eight / 8,
        "terrain_ruggedness_index": F.sqrt(squares),
        "roughness": F.when(whole, F.greatest(*ring, z[5]) - F.least(*ring, z[5])),
        "rugosity": F.when(whole, area / (cell * cell)),
    }


def terrain(df: DataFrame, cell: float = 30.0, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """`df` with all attributes; the elevation column doubles as reprojected_dem."""
    made = neighbours(df, "elevation", keys).withColumns(attributes(cell))
    return made.withColumn("reprojected_dem", F.col("elevation")).drop(*[f"z{i}" for i in range(1, 10)])
