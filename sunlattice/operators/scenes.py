"""Catalogue filters and scene selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Property names of cloud cover, in order of preference, and the tile in an item's id.
CLOUD_KEYS = ("eo:cloud_cover", "CLOUD_COVERAGE", "cloud_cover")
TILE_IN_ID = r"\.T(\d{2})([A-Z])[A-Z]{2}\."
UNKNOWN_CLOUD = 1e9


def cloud_cover(properties: Column, default: float | None = UNKNOWN_CLOUD, parity: bool = False) -> Column:
    """The first cloud percentage given; with parity a zero counts as not given."""
    values = [properties[k].try_cast("double") for k in CLOUD_KEYS]
    if parity:
        values = [F.nullif(v, F.lit(0.0)) for v in values]
    return F.coalesce(*values, F.lit(default).cast("double"))


def item_epsg(item_id: Column, property_epsg: Column | None = None, asset_epsg: Column | None = None) -> Column:
    """EPSG code of an item: its assets', its properties', or that of the tile in its id (.TzzB..)."""
    zone = F.regexp_extract(item_id, TILE_IN_ID, 1).try_cast("int")
    band = F.regexp_extract(item_id, TILE_IN_ID, 2)
    from_tile = F.when(band >= "N", 32600 + zone).otherwise(32700 + zone)
    given = [c.cast("int") for c in (asset_epsg, property_epsg) if c is not None]
    return F.coalesce(*given, from_tile)


def filter_sorted(items: DataFrame, max_cloud: float, t: str = "datetime", cloud: str = "cloud") -> DataFrame:
    """Items of at most max_cloud, by time (id breaks ties)."""
    return items.where(F.col(cloud) <= max_cloud).orderBy(t, "id")


def nearest_scene(items: DataFrame, target: Column, days: int = 20, max_cloud: float | None = None, t: str = "datetime") -> DataFrame:
    """The one scene nearest to the target within a window of days: by time distance, then cloud, then id.

    If no scene in the window meets max_cloud, all of the window are considered.
    """
    gap = F.abs(F.unix_timestamp(F.col(t).cast("timestamp")) - F.unix_timestamp(target.cast("timestamp")))
    near = items.withColumn("gap_s", gap).where(F.col("gap_s") <= days * 86400)
    over = F.when(F.col("cloud") <= max_cloud, 0).otherwise(1) if max_cloud is not None else F.lit(0)
    return near.withColumn("_over", over).orderBy("_over", "gap_s", "cloud", "id").limit(1).drop("_over")


def select_by_schedule(items: DataFrame, targets: DataFrame, target: str = "target", t: str = "datetime", id_: str = "id") -> DataFrame:
    """The scenes nearest to any target, each once, ordered by time. Ties go to the earlier scene, then the smaller id.

    Items and targets are merged on one time axis, dealt out by year; a target looks at the last item before it and the
    first one after it, in its year or else in the nearest year that has one. No pairs of items and targets are made.
    """
    kind = dict(items.dtypes)[t]
    scenes = items.groupBy(F.col(t).alias("at")).agg(F.min(id_).alias("id"))
    scene = F.struct("at", "id")
    marks = targets.select(F.col(target).cast(kind).alias("at")).distinct()
    axis = scenes.select("at", scene.alias("item")).unionByName(marks, allowMissingColumns=True)
    axis = axis.withColumn("year", F.year("at"))
    inside = Window.partitionBy("year").orderBy("at", F.col("item").isNull())
    years = axis.groupBy("year").agg(F.min("item").alias("lo"), F.max("item").alias("hi"))
    calendar = Window.orderBy("year")  # a row a year
    years = years.select(
        "year",
        F.last("hi", True).over(calendar.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("lo", True).over(calendar.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    looked = axis.withColumns(
        {
            "before": F.last("item", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            "after": F.first("item", True).over(inside.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).where("item is null")
    ends = looked.join(F.broadcast(years), "year").select(
        "at", F.coalesce("before", "earlier").alias("b"), F.coalesce("after", "later").alias("a")
    )

    def gap(end: str) -> Column:
        return F.abs(F.unix_micros(F.col(end)["at"].cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")))

    after = F.col("b").isNull() | F.coalesce(gap("a") < gap("b"), F.lit(False))
    chosen = ends.select(F.when(after, F.col("a")).otherwise(F.col("b")).alias("c")).where("c is not null").distinct()
    return chosen.select(F.col("c.id").alias(id_), F.col("c.at").alias(t)).orderBy(t, id_)


def head(items: DataFrame, n: int | None, t: str = "datetime") -> DataFrame:
    """The first n items by time; all of them without n."""
    return items.orderBy(t, "id").limit(n) if n else items.orderBy(t, "id")
