"""Items of a paged scene catalogue: box and time are pushed into the reader, and pages outside them are never opened.

The catalogue is JSON in any store: index pages {"pages": [{"href", "bbox", "interval"}], "next"}, which the driver follows
from one to the next, and item pages {"features": [...]} with the items of a place and time. An index page holds hundreds of
entries of a line each, so planning reads a thousandth of the items or less; item pages are read by tasks alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from sunlattice.operators.scenes import CLOUD_KEYS
from sunlattice.sources.geotiff import opened, with_retries

SIDES = ("min_lon", "min_lat", "max_lon", "max_lat")
ITEMS = f"id string, datetime timestamp, cloud double, {', '.join(f'{s} double' for s in SIDES)}, epsg int, assets map<string,string>, error string"
#: What a comparison keeps: (bound, whether the bound itself stays). Pages are kept if any of their items may stay.
_KEEPS = {GreaterThan: ("low", False), GreaterThanOrEqual: ("low", True), LessThan: ("high", False), LessThanOrEqual: ("high", True)}


def _instant(text: str | None) -> datetime | None:
    if not text:
        return None
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def _ranges(entry: dict) -> dict[str, tuple[Any, Any]]:
    """The least and the greatest value of each column in a page; None for unknown ends."""
    box, (start, end) = entry.get("bbox") or [None] * 4, entry.get("interval") or (None, None)
    out = {"datetime": (_instant(start), _instant(end))}
    for k, axis in enumerate(("lon", "lat")):
        out[f"min_{axis}"] = out[f"max_{axis}"] = (box[k], box[k + 2])
    return out


class CatalogueSource(DataSource):
    """spark.read.format("scene_catalogue"): a row an item. Options: path (the first index page); permits (partitions at most,
    so requests at once; 4), tries (3) and wait (seconds, 0.5) for pages that fail, bad = fail (the default) or skip: a page
    that can't be read is then one row with its `error`. Comparisons of datetime, cloud and the sides of the box with
    constants are applied by the reader, if spark.sql.python.filterPushdown.enabled is set (`catalogue_items` sets it)."""

    @classmethod
    def name(cls) -> str:
        return "scene_catalogue"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.permits = options["path"], max(1, int(options.get("permits", 4)))
        self.tries, self.wait = int(options.get("tries", 3)), float(options.get("wait", 0.5))
        self.skip = options.get("bad", "fail") == "skip"
        self.tests: list[tuple[str, str, bool, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        known = {"datetime", "cloud", *SIDES}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in known and isinstance(f, IsNotNull):
                self.tests.append((name, "some", True, None))
            elif name in known and isinstance(f, EqualTo) and f.value is not None:
                self.tests += [(name, "low", True, f.value), (name, "high", True, f.value)]
            elif name in known and type(f) in _KEEPS and f.value is not None:
                self.tests.append((name, *_KEEPS[type(f)], f.value))
            else:
                yield f

    def _load(self, href: str) -> dict:
        def read() -> dict:
            store, inner = opened(href)
            with store.open_input_file(inner) as file:
                return json.loads(file.read())

        return with_retries(read, self.tries, self.wait)

    def _passes(self, low: Any, high: Any, bound: str, closed: bool, value: Any) -> bool:
        end = high if bound == "low" else low
        if bound == "some" or end is None:
            return True
        if isinstance(value, datetime) and value.tzinfo is None:
            value = value.replace(tzinfo=UTC)
        return (end >= value if closed else end > value) if bound == "low" else (end <= value if closed else end < value)

    def partitions(self) -> list[InputPartition]:
        pages, href = [], self.path
        while href:
            index = self._load(href)
            base = href.rsplit("/", 1)[0]
            for entry in index.get("pages", []):
                held = _ranges(entry)
                if all(self._passes(*held.get(n, (None, None)), bound, closed, value) for n, bound, closed, value in self.tests):
                    pages.append(entry["href"] if "://" in entry["href"] else f"{base}/{entry['href']}")
            more = index.get("next")
            href = (more if "://" in more else f"{base}/{more}") if more else None
        dealt = [pages[k :: self.permits] for k in range(min(self.permits, len(pages)))]
        return [InputPartition(p) for p in dealt] or [InputPartition([])]

    def _row(self, item: dict) -> tuple:
        p, box = item.get("properties") or {}, item.get("bbox") or [None] * 4
        cloud = next((float(p[k]) for k in CLOUD_KEYS if p.get(k) is not None), None)
        sides = [None if v is None else float(v) for v in box]
        assets = {k: v.get("href") for k, v in (item.get("assets") or {}).items()}
        return item["id"], _instant(p.get("datetime")), cloud, *sides, p.get("proj:epsg"), assets, None

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ("id", "datetime", "cloud", *SIDES)
        for href in partition.value:
            try:
                rows = [self._row(i) for i in self._load(href)["features"]]
            except (OSError, ValueError, KeyError, TypeError, AttributeError, pa.ArrowInvalid) as why:
                if not self.skip:
                    raise ValueError(f"{href}: {why}") from why
                yield (None,) * 9 + (f"{href}: {type(why).__name__}: {why}",)
                continue
            for row in rows:
                own = dict(zip(names, row, strict=False))
                if all(own[n] is not None and self._passes(own[n], own[n], bound, closed, value) for n, bound, closed, value in self.tests):
                    yield row


def catalogue_pages(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, start: str | None = None, end: str | None = None, max_cloud: float | None = None, **options) -> DataFrame:
    """The items that meet a box (min_lon, min_lat, max_lon, max_lat) in a span of time, at or below max_cloud.

    All of it is pushed into the reader; with bad="skip" rows of pages that fail come too, whatever is asked for.
    """
    spark.dataSource.register(CatalogueSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    items = spark.read.format("scene_catalogue").options(**options).load(path)
    if box:
        items = items.where((F.col("min_lon") <= box[2]) & (F.col("max_lon") >= box[0]) & (F.col("min_lat") <= box[3]) & (F.col("max_lat") >= box[1]))
    if start:
        items = items.where(F.col("datetime") >= F.lit(start).cast("timestamp"))
    if end:
        items = items.where(F.col("datetime") <= F.lit(end).cast("timestamp"))
    return items.where(F.col("cloud") <= max_cloud) if max_cloud is not None else items


def write_catalogue(items: DataFrame, path: str, page_items: int = 200, index_pages: int = 100) -> int:
    """A catalogue of items (id, datetime, cloud, the sides of their boxes) in the folder `path`; the number of item pages.

    Items are sorted by time, so that a page covers a short span; tasks write the item pages, and the driver the index.
    """

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        store, folder = opened(path)
        store.create_dir(folder, recursive=True)

        def flush() -> pa.RecordBatch:
            features = [
                {"id": str(r["id"]), "bbox": [r[s] for s in SIDES], "properties": {"datetime": r["datetime"].isoformat() + "Z", "eo:cloud_cover": r["cloud"]}, "assets": {}} for r in held
            ]
            times = [f["properties"]["datetime"] for f in features]
            name = f"items-{held[0]['id']}-{held[-1]['id']}.json"
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(json.dumps({"features": features}).encode())
            box = [pick(r[s] for r in held) for s, pick in zip(SIDES, (min, min, max, max), strict=True)]
            return pa.record_batch([[name], [min(times)], [max(times)], [box]], names=["href", "start", "end", "bbox"])

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == page_items:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    plain = items.select("id", F.col("datetime").cast("timestamp_ntz").alias("datetime"), F.col("cloud").cast("double").alias("cloud"), *[F.col(s).cast("double").alias(s) for s in SIDES])
    ordered = plain.repartitionByRange("datetime", "id").sortWithinPartitions("datetime", "id")
    made = ordered.mapInArrow(pages, "href string, start string, end string, bbox array<double>").collect()
    entries = [{"href": r.href, "bbox": list(r.bbox), "interval": [r.start, r.end]} for r in sorted(made, key=lambda r: (r.start, r.href))]
    store, folder = opened(path)
    names = [f"index-{k}.json" for k in range(max(1, -(-len(entries) // index_pages)))]
    for k, name in enumerate(names):
        with store.open_output_stream(f"{folder}/{name}") as out:
            out.write(json.dumps({"pages": entries[k * index_pages : (k + 1) * index_pages], "next": names[k + 1] if k + 1 < len(names) else None}).encode())
    return len(entries)
