"""Sources: catalogue items and areas as JSON, insolation as CSV, rasters as binary files; and a catalogue data source.

Column pruning and filters reach the file scan because every reader is a plain DataFrame plan.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

#: Catalogue providers and their collections.
PROVIDERS = {"pc": "hls2-s30", "nasa": "HLSS30.v2.0"}
ITEM = (
    "id string, properties map<string,string>, assets map<string,struct<href:string,epsg:int>>, bbox array<double>"
)
#: Names of the radiation variable, in order of preference, and of the time column.
RADIATION = ("surface_solar_radiation_downwards", "ssrd", "solar_radiation")
TIMES = ("time", "date", "valid_time")


def provider(name: str) -> str:
    """The collection of a provider; its name may be given in any case and with blanks around it."""
    key = name.strip().lower()
    if key not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(PROVIDERS)}")
    return PROVIDERS[key]


def overlaps(bbox: Column, box: tuple[float, float, float, float]) -> Column:
    """True if [min_lon, min_lat, max_lon, max_lat] meets the box."""
    return (F.get(bbox, F.lit(0)) <= box[2]) & (F.get(bbox, F.lit(2)) >= box[0]) & (F.get(bbox, F.lit(1)) <= box[3]) & (F.get(bbox, F.lit(3)) >= box[1])


def catalogue_items(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Items of JSON-lines files with their time as `datetime`, restricted to a box and a time range."""
    items = spark.read.schema(ITEM).json(path)
    items = items.withColumn("datetime", F.col("properties")["datetime"].try_cast("timestamp").cast("timestamp_ntz"))
    if box:
        items = items.where(overlaps(F.col("bbox"), box))
    if start:
        items = items.where(F.col("datetime") >= F.lit(start).cast("timestamp_ntz"))
    return items.where(F.col("datetime") <= F.lit(end).cast("timestamp_ntz")) if end else items


def pick_radiation(columns: list[str]) -> str:
    """The radiation variable: a preferred name, else the first that contains "radiation"."""
    named = [c for c in RADIATION if c in columns] or [c for c in columns if "radiation" in c.lower()]
    if not named:
        raise ValueError("no radiation variable")
    return named[0]


def insolation_csv(spark: SparkSession, path: str) -> DataFrame:
    """time, solar_radiation of a CSV with a header, in no certain order; text that is no number is NULL."""
    raw = spark.read.option("header", True).csv(path)
    time = next((c for c in TIMES if c in raw.columns), None)
    if time is None:
        raise ValueError("no time column")
    value = F.col(pick_radiation(raw.columns)).try_cast("float").alias("solar_radiation")
    return raw.select(F.col(time).try_cast("timestamp").cast("timestamp_ntz").alias("time"), value)


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """path and whole text of GeoJSON files; see functions.aoi for what is made of them."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def scene_pixels(spark: SparkSession, path: str, bands: tuple[str, ...], scale: float = 10000.0) -> DataFrame:
    """Pixel rows of Parquet scenes with the asked bands as reflectance: unasked bands are never read."""
    raw = spark.read.parquet(path)
    return raw.select("scene_id", "yi", "xi", "fmask", *[(F.col(b) / scale).cast("float").alias(b) for b in bands])


def ascii_grids(spark: SparkSession, path: str) -> DataFrame:
    """raster_id, yi, xi, elevation, lat, lon of ESRI ASCII grids: one file, header of six lines, rows from the north."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("raster_id"), F.split("value", "\n").alias("lines"))
    head = {k: F.split(F.trim(F.get("lines", F.lit(i))), r"\s+")[1].cast("double") for i, k in enumerate(("ncols", "nrows", "xll", "yll", "cell", "nodata"))}
    parts = files.select("raster_id", *[c.alias(k) for k, c in head.items()], F.posexplode(F.slice("lines", F.lit(7), F.size("lines"))).alias("yi", "line"))
    cells = parts.where("trim(line) <> ''").select("*", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("xi", "v"))
    z = F.col("v").cast("double")
    return cells.select(
        "raster_id",
        "yi",
        "xi",
        F.when(z != F.col("nodata"), z).alias("elevation"),
        (F.col("yll") + (F.col("nrows") - F.col("yi") - 0.5) * F.col("cell")).alias("lat"),
        (F.col("xll") + (F.col("xi") + 0.5) * F.col("cell")).alias("lon"),
    )


class CatalogueSource(DataSource):
    """Items of a catalogue given as inline JSON pages, one input partition a page: spark.read.format("catalogue").

    Options: pages (a JSON list of pages, each a list of items with id, datetime, cloud), provider. Failing pages are
    retried by Spark's task retry. With the option pushdown=true (which needs spark.sql.python.filterPushdown.enabled)
    comparisons of `cloud`, `datetime` and `id` with constants are applied while reading; other filters are left to Spark.
    """

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "provider string, id string, datetime string, cloud double"

    def reader(self, schema) -> DataSourceReader:
        pushed = str(self.options.get("pushdown", "false")).lower() == "true"
        return (_FilteringReader if pushed else _CatalogueReader)(self.options)


_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class _CatalogueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.collection = provider(options.get("provider", "pc"))
        self.pages = json.loads(options.get("pages", "[]"))
        self.tests: list[tuple[str, str, object]] = []

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(page) for page in self.pages]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        named = {kind.__name__: test for kind, test in _TESTS.items()}
        for item in partition.value:
            cloud = item.get("cloud")
            row = {"id": str(item["id"]), "datetime": item.get("datetime"), "cloud": None if cloud is None else float(cloud)}
            if all(row[c] is not None and named[kind](row[c], value) for c, kind, value in self.tests):
                yield self.collection, row["id"], row["datetime"], row["cloud"]


class _FilteringReader(_CatalogueReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("cloud",), ("datetime",), ("id",)):
                self.tests.append((f.attribute[0], type(f).__name__, f.value))
            else:
                yield f
