"""Reduction of grids and series to one feature row a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunlattice.functions.numeric import nan_to_null

STATS = ("mean", "median", "std", "min", "max")


def five_stats(df: DataFrame, variables: list[str], keys: list[str]) -> DataFrame:
    """{var}_mean, _median (exact), _std (population), _min, _max for each key, missing values left out."""
    out = []
    for v in variables:
        x = nan_to_null(F.col(v).cast("double"))
        out += [
            F.avg(x).alias(f"{v}_mean"),
            F.median(x).alias(f"{v}_median"),
            F.stddev_pop(x).alias(f"{v}_std"),
            F.min(x).alias(f"{v}_min"),
            F.max(x).alias(f"{v}_max"),
        ]
    return df.groupBy(*keys).agg(*out)


def array_stats(df: DataFrame, column: str, prefix: str, keys: list[str]) -> DataFrame:
    """Five statistics of each element of an array column, a row an element: {prefix}{number} in `band`."""
    spread = df.select(*keys, F.posexplode(column).alias("band", "value"))
    return five_stats(spread, ["value"], [*keys, "band"]).withColumn("band", F.format_string(f"{prefix}%02d", "band"))


def merge_right_wins(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """One row a key; where both have a column, the right one's value wins if its row exists."""
    shared = [c for c in right.columns if c != key and c in left.columns]
    return left.drop(*shared).join(right, key, how)


def merge_grids(terrain: DataFrame, other: DataFrame, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """Layers of one grid side by side, joined on integer cells; columns that both have come from the first."""
    extra = [c for c in other.columns if c not in terrain.columns]
    cell = [*keys, "yi", "xi"]
    return terrain.join(other.select(*cell, *extra), cell, "left")
