"""Neighbourhood operators on cells with integer indices: separable morphology and disc sums.

Stencils are RANGE windows over the integer index, first along rows, then along columns; a raster is partitioned by
its id and row (or column), so large rasters spread over many tasks.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(df: DataFrame, value: str, keys: list[str], axis: str, other: str, low: int, high: int, erode: bool) -> DataFrame:
    w = Window.partitionBy(*keys, other).orderBy(axis).rangeBetween(low, high)
    flag = F.col(value).cast("int")
    if erode:  # cells outside the raster are clear
        out = F.when(F.count("*").over(w) == high - low + 1, F.min(flag).over(w)).otherwise(0)
    else:
        out = F.max(flag).over(w)
    return df.withColumn(value, out)


def dilate(df: DataFrame, value: str, low: int, high: int, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """OR over the square of offsets low..high."""
    k = list(keys)
    return _along(_along(df, value, k, "xi", "yi", low, high, False), value, k, "yi", "xi", low, high, False)


def erode(df: DataFrame, value: str, low: int, high: int, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """AND over the square of offsets low..high; clear outside the raster."""
    k = list(keys)
    return _along(_along(df, value, k, "xi", "yi", low, high, True), value, k, "yi", "xi", low, high, True)


def closing3(df: DataFrame, value: str, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    return erode(dilate(df, value, -1, 1, keys), value, -1, 1, keys)


def dilate2(df: DataFrame, value: str, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    return dilate(df, value, 0, 1, keys)


def opening2(df: DataFrame, value: str, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    return dilate(erode(df, value, -1, 0, keys), value, 0, 1, keys)


def hybrid_mask(df: DataFrame, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """mask = cloud (closed, then dilated) or shadow (closed) or haze (opened), from the three flags."""
    df = dilate2(closing3(df, "cloud", keys), "cloud", keys)
    df = opening2(closing3(df, "shadow", keys), "haze", keys)
    return df.withColumn("mask", F.greatest("cloud", "shadow", "haze"))


def radius_cells(radius_m: float, resolution_m: float) -> int:
    return max(0, ceil(radius_m / resolution_m))


def disc_sums(df: DataFrame, values: list[str], r: int, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """Sums over the disc x^2 + y^2 <= r^2 with edge cells replicated, for dense rasters: adds <value>_disc.

    By chords: windows along each row give the row's part of a disc for each of the r + 1 half widths; windows along each
    column then add the parts of 2r + 1 rows, so a cell is the sum of 2r + 1 chords instead of all of the disc's cells.
    """
    k = list(keys)
    row = Window.partitionBy(*k, "yi").orderBy("xi")
    whole = Window.partitionBy(*k, "yi")
    widths = [isqrt(r * r - d * d) for d in range(r + 1)]
    parts = df.withColumn("_first", F.min("xi").over(whole)).withColumn("_last", F.max("xi").over(whole))
    for v in values:
        for w in sorted(set(widths)):
            inner = F.sum(v).over(row.rangeBetween(-w, w))
            left = F.greatest(F.col("_first") + w - F.col("xi"), F.lit(0)) * F.first(v).over(row.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            right = F.greatest(F.col("xi") + w - F.col("_last"), F.lit(0)) * F.last(v).over(row.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            parts = parts.withColumn(f"_{v}_{w}", inner + left + right)
    column = Window.partitionBy(*k, "xi").orderBy("yi")
    full = column.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = parts
    for v in values:
        total: Column = F.lit(0)
        for d in range(-r, r + 1):
            name = f"_{v}_{widths[abs(d)]}"
            at = F.lag(name, -d).over(column) if d < 0 else F.lead(name, d).over(column)
            if d < 0:
                at = F.coalesce(F.lag(name, -d).over(column), F.first(name).over(full))
            elif d > 0:
                at = F.coalesce(F.lead(name, d).over(column), F.last(name).over(full))
            else:
                at = F.col(name)
            total = total + at
        out = out.withColumn(f"{v}_disc", total)
    return out.drop("_first", "_last", *[f"_{v}_{w}" for v in values for w in set(widths)])


def cloud_percentage(df: DataFrame, r: int, min_valid: int = 50, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """100 * cloudy valid cells / valid cells of the disc where at least min_valid are valid, else NULL."""
    flagged = df.withColumn("cloud_valid", (F.col("mask") > 0).cast("int") * F.col("valid").cast("int")).withColumn("valid_n", F.col("valid").cast("int"))
    sums = disc_sums(flagged, ["cloud_valid", "valid_n"], r, keys)
    percent = F.when(F.col("valid_n_disc") >= min_valid, 100.0 * F.col("cloud_valid_disc") / F.col("valid_n_disc"))
    return sums.withColumn("cloud_percentage_local", percent)
