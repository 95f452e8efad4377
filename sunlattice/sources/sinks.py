"""Sinks: Parquet with flattened attributes, GeoJSON lines."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_attributes(attributes: dict[str, Any], prefix: str = "") -> dict[str, str]:
    """Text values only: nested names joined by _, None as "null", truth values as 0 or 1, lists in brackets."""
    out: dict[str, str] = {}
    for key, value in attributes.items():
        name = f"{prefix}{key}"
        if isinstance(value, dict):
            out |= flat_attributes(value, f"{name}_")
        else:
            out[name] = _text(value)
    return out


def _text(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    return "[" + ", ".join(map(_text, value)) + "]" if isinstance(value, (list, tuple)) else str(value)


def write_cube(df: DataFrame, path: str, partition: str = "t", attributes: dict[str, Any] | None = None) -> None:
    """Rows by `partition`, with the cube's attributes as a map column that repeats in every row group's dictionary."""
    flat = flat_attributes(attributes or {})
    pairs = [F.lit(x) for item in flat.items() for x in item]
    tagged = df.withColumn("attrs", F.create_map(*pairs)) if pairs else df
    tagged.write.partitionBy(partition).parquet(path)


def feature(ring: Column, **properties: Column) -> Column:
    """One GeoJSON polygon feature as text."""
    points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    named = F.struct(*[c.alias(k) for k, c in properties.items()])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), named.alias("properties")))


def write_geojson(polygons: DataFrame, path: str) -> None:
    """A feature a line for polygons (cluster_id, class, class_name, area, ring)."""
    columns = {c: F.col(c) for c in ("cluster_id", "class", "class_name", "area")}
    polygons.select(feature(F.col("ring"), **columns).alias("value")).write.text(path)
