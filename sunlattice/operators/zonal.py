"""Zonal masks: point in polygon, crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule for a closed ring of [x, y] pairs: the parity of edges that a ray to the right crosses."""
    pairs = F.zip_with(
        F.slice(ring, 1, F.size(ring) - 1),
        F.slice(ring, 2, F.size(ring) - 1),
        lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")),
    )

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        rise = F.when(e["y2"] != e["y1"], e["y2"] - e["y1"])
        return F.coalesce(spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / rise + e["x1"]), F.lit(False))

    return F.aggregate(pairs, F.lit(False), lambda odd, e: odd != crosses(e))


def mask_by_polygon(df: DataFrame, ring: list[tuple[float, float]], bands: list[str], mask: str = "mask") -> DataFrame:
    """Outside the ring bands are NULL and the mask is 0."""
    edge = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ring])
    hit = inside(F.col("x"), F.col("y"), edge)
    return df.withColumns(
        {b: F.when(hit, F.col(b)) for b in bands} | {mask: F.when(hit, F.col(mask)).otherwise(0)}
    )


def crop(df: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows in the box, its edges included; the bounds are pushed down to the scan."""
    return df.where(F.col(lat).between(min_lat, max_lat) & F.col(lon).between(min_lon, max_lon))
