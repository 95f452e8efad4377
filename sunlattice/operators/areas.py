"""Many areas on many rasters: which cells lie inside, and which scenes an area takes.

A ring becomes spans of cells, row by row: the crossings of its edges with a row of cell centres, in order, two and two.
That is the even-odd rule of `zonal.inside`, with the same arithmetic, but costs a row for each row of cells an edge
passes instead of a test of every cell against every edge. Spans are dealt into strips of STRIP columns, so cells meet
areas by an equality of (raster, row, strip): no cell meets an area that isn't in its strip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunlattice.operators.resample import utm_forward

#: Columns of a strip.
STRIP = 64


def ring_to_cells(ring: Column, zone: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> Column:
    """A ring of (x, y) longitudes and latitudes in cell units of a UTM raster: the centre of cell (0, 0) is at (x0, y0),
    and dx, dy are the steps of columns and rows (dy negative from the north)."""

    def place(p: Column) -> Column:
        metres = utm_forward(p["y"], p["x"], zone)
        return F.struct(((metres["easting"] - x0) / dx).alias("x"), ((metres["northing"] - y0) / dy).alias("y"))

    return F.transform(ring, place)


def box_join(left: DataFrame, right: DataFrame, side: float = 1.0) -> DataFrame:
    """Pairs of rows whose boxes (min_lon, min_lat, max_lon, max_lat; the right one's columns with the prefix `r_`) meet.

    Boxes are dealt into squares of `side` degrees and joined by equality; a pair counts in one square only, that of the
    lower left corner of what both cover. Boxes with a null side, or a side before the other, meet nothing.
    """

    def dealt(df: DataFrame, p: str) -> DataFrame:
        def across(a: str) -> Column:
            lo, hi = (F.floor(F.col(f"{p}{m}_{a}") / side) for m in ("min", "max"))
            return F.when(lo <= hi, F.sequence(lo, hi))

        rows = df.select("*", F.explode(across("lat")).alias(f"{p}by"))
        return rows.select("*", F.explode(across("lon")).alias(f"{p}bx"))

    a = dealt(left, "")
    b = dealt(right.select([F.col(c).alias(f"r_{c}") for c in right.columns]), "r_")
    corner = {k: F.greatest(F.floor(F.col(f"min_{k}") / side), F.floor(F.col(f"r_min_{k}") / side)) for k in ("lon", "lat")}
    meet = (F.col("bx") == F.col("r_bx")) & (F.col("by") == F.col("r_by"))
    once = (F.col("bx") == corner["lon"]) & (F.col("by") == corner["lat"])
    near = [F.col(f"min_{k}") <= F.col(f"r_max_{k}") for k in ("lon", "lat")] + [F.col(f"r_min_{k}") <= F.col(f"max_{k}") for k in ("lon", "lat")]
    return a.join(b, meet & once & near[0] & near[1] & near[2] & near[3]).drop("bx", "by", "r_bx", "r_by")


def ring_box(ring: Column) -> dict[str, Column]:
    """min_x, max_x, min_y, max_y of a ring."""
    return {f"{m}_{c}": f(ring.getField(c)) for c in ("x", "y") for m, f in (("min", F.array_min), ("max", F.array_max))}


def row_spans(areas: DataFrame, keys: list[str], ring: str = "ring") -> DataFrame:
    """keys, yi and spans: the array of (lo, hi) columns inside the area, of the rows that have any.

    areas: keys and a closed ring of (x, y) in cell units, cell (yi, xi) having its centre at (xi, yi). An area of several
    rows has several rings, and their parity counts together, so an inner ring is a hole. Rings that are null or have
    fewer than two points have no edge.
    """
    ends = F.col(ring)
    count = F.greatest(F.size(ends) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(ends, 1, count), F.slice(ends, 2, count), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    edges = areas.where(ends.isNotNull() & (F.size(ends) > 1)).select(*keys, F.explode(pairs).alias("e")).select(*keys, "e.*").where("y1 <> y2")
    first, last = F.ceil(F.least("y1", "y2")), F.ceil(F.greatest("y1", "y2")) - 1
    rows = edges.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("yi"))
    y = F.col("yi")
    cross = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    crossings = rows.groupBy(*keys, "yi").agg(F.sort_array(F.collect_list(cross)).alias("xs"))
    # a cell is inside if an odd number of crossings lies beyond it, so a span takes its first crossing and not its last
    nth = F.sequence(F.lit(0), F.expr("size(xs) div 2 - 1"))
    spans = F.transform(nth, lambda k: F.struct(F.ceil(F.get("xs", 2 * k)).alias("lo"), (F.ceil(F.get("xs", 2 * k + 1)) - 1).alias("hi")))
    filled = F.filter(F.when(F.size("xs") > 1, spans).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>")), lambda s: s["lo"] <= s["hi"])
    return crossings.select(*keys, F.col("yi").cast("int").alias("yi"), filled.alias("spans")).where(F.size("spans") > 0)


def area_strips(areas: DataFrame, keys: list[str], ring: str = "ring", rectangle: str | None = None) -> DataFrame:
    """keys, yi, strip, lo, hi, spans: every row of every area's box, in strips, with the spans inside the area there.

    Areas whose column `rectangle` is true are their boxes, and so are all inside. Several rings of an area share its box.
    """
    box = ring_box(F.col(ring))
    whole = F.coalesce(F.max(F.col(rectangle).cast("boolean")), F.lit(False)) if rectangle else F.lit(False)
    boxes = areas.select(*areas.columns, *[c.alias(f"_{n}") for n, c in box.items()]).groupBy(*keys).agg(
        F.ceil(F.min("_min_x")).alias("lo"),
        F.floor(F.max("_max_x")).alias("hi"),
        F.ceil(F.min("_min_y")).alias("top"),
        F.floor(F.max("_max_y")).alias("bottom"),
        whole.alias("_whole"),
    )
    rows = boxes.where("lo <= hi and top <= bottom").select(*keys, "lo", "hi", "_whole", F.explode(F.sequence(F.col("top").cast("int"), F.col("bottom").cast("int"))).alias("yi"))
    spans = rows.join(row_spans(areas, keys, ring), [*keys, "yi"], "left")
    all_in = F.array(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi")))
    spans = spans.withColumn("spans", F.when(F.col("_whole"), all_in).otherwise(F.col("spans")))
    strips = F.sequence(F.floor(F.col("lo") / STRIP), F.floor(F.col("hi") / STRIP))
    dealt = spans.select(*keys, "yi", "lo", "hi", "spans", F.explode(strips).alias("strip"))
    here = F.filter("spans", lambda s: (s["hi"] >= F.col("strip") * STRIP) & (s["lo"] < (F.col("strip") + 1) * STRIP))
    return dealt.withColumn("spans", here)


def cells_of(pixels: DataFrame, strips: DataFrame, raster: str) -> DataFrame:
    """The cells of every area's box with `inside`: the columns of `pixels` and the keys of the strips.

    pixels: `raster`, yi, xi and values; strips: rows of `area_strips`, with `raster` among their keys. A cell that many
    areas see is a row for each. Columns of both but `raster` and yi must differ.
    """
    keys = [c for c in strips.columns if c not in ("yi", "lo", "hi", "spans", "strip")]
    dealt = pixels.withColumn("strip", F.floor(F.col("xi") / STRIP))
    met = dealt.join(strips, [raster, "yi", "strip"]).where("xi between lo and hi")
    inside = F.coalesce(F.exists("spans", lambda s: F.col("xi").between(s["lo"], s["hi"])), F.lit(False))
    return met.select(*[c for c in keys if c not in pixels.columns], *pixels.columns, inside.alias("inside"))


def masked_cells(pixels: DataFrame, strips: DataFrame, raster: str, bands: list[str], mask: str | None = "mask") -> DataFrame:
    """`cells_of` with NULL bands and a mask of 0 outside the area."""
    cells = cells_of(pixels, strips, raster)
    out = {b: F.when(F.col("inside"), F.col(b)) for b in bands}
    if mask:
        out[mask] = F.when(F.col("inside"), F.col(mask)).otherwise(0)
    return cells.withColumns(out)


def nearest_in_window(items: DataFrame, targets: DataFrame, key: str, days: int = 20, max_cloud: float | None = None, t: str = "datetime", target: str = "target") -> DataFrame:
    """`targets` with scene_id, scene_time, scene_cloud and gap_s of the nearest item of their key within `days`.

    items: key, id, `t`, cloud. The nearest is that of the smallest distance in time, then cloud, then id. Items over
    max_cloud (or of unknown cloud) are taken only where the window has none at or below it; without any item in the
    window the columns are NULL. Repeated items count once; targets are kept as they are, with null keys or times too.

    Time is dealt into buckets as wide as the window: an item is copied to the buckets on both sides, so a target finds
    the last item before it and the first one after it in its own bucket. No pairs are made, and a key of a third of all
    rows is spread over its buckets.
    """
    width = days * 86_400_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = F.floor(F.col("at") / F.lit(width))
    low = F.coalesce(F.col("cloud") <= max_cloud, F.lit(False)) if max_cloud is not None else F.lit(True)
    scene = F.struct("at", F.coalesce("cloud", F.lit(float("inf"))).alias("c"), "id", F.col(t).alias("time"), F.col("cloud").alias("cloud"))
    seen = items.where(F.col(key).isNotNull() & F.col(t).isNotNull()).withColumn("at", micros(t))
    seen = seen.select(key, "at", low.alias("low"), scene.alias("item"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    # of items at one time the clearest stands for all, among the clear ones and among all
    seen = seen.groupBy(key, "bucket", "at").agg(F.min(F.when(F.col("low"), F.col("item"))).alias("clear"), F.min("item").alias("any"))
    asked = targets.select(F.col(key), F.col(target)).distinct().where(F.col(key).isNotNull() & F.col(target).isNotNull())
    asked = asked.withColumn("at", micros(target)).withColumn("bucket", bucket)
    axis = seen.unionByName(asked, allowMissingColumns=True)
    order = Window.partitionBy(key, "bucket").orderBy("at")
    up_to, from_on = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, Window.unboundedFollowing)
    ends = {f"{c}_{n}": f(c, True).over(w) for c in ("clear", "any") for n, f, w in (("before", F.last, up_to), ("after", F.first, from_on))}
    looked = axis.withColumns(ends).where(F.col(target).isNotNull())

    def ranked(name: str) -> Column:
        s = F.col(name)
        gap = F.abs(s["at"] - F.col("at"))
        return F.when(gap <= width, F.struct(gap.alias("gap"), s["c"].alias("c"), s["id"].alias("id"), s["time"].alias("time"), s["cloud"].alias("cloud")))

    best = F.coalesce(F.least(ranked("clear_before"), ranked("clear_after")), F.least(ranked("any_before"), ranked("any_after")))
    found = looked.select(
        key,
        target,
        best["id"].alias("scene_id"),
        best["time"].alias("scene_time"),
        best["cloud"].alias("scene_cloud"),
        F.floor(best["gap"] / 1_000_000).alias("gap_s"),
    )
    return targets.join(found, [key, target], "left")
