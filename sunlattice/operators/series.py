"""Time-series operators: nearest as-of join with tolerance, gap filling, irregular-step averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Tolerances in a span of an as-of join.
SPAN = 64


def seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def asof_nearest(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: str, tolerance_s: int) -> DataFrame:
    """Each left row with the value of the nearest right row of its key within the tolerance, NULL if there is none.

    Equal distances go to the later right row, of equal times to the smaller value (a missing one last). Both sides are dealt
    by (key, span of SPAN tolerances) and shuffled once; right rows near the border of a span go to the next one too. In a
    span, two windows look back and ahead, so no rows are paired and no key's rows are together.
    """
    most = int(tolerance_s * 1_000_000)
    span = lambda t: F.floor(t / (SPAN * most)).cast("long")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    known = F.col(left_time).isNotNull()
    for c in on:
        known = known & F.col(c).isNotNull()
    v = F.col(value)
    r = right.where(F.col(right_time).isNotNull()).select(*on, micros(right_time).alias("_t"), F.struct(micros(right_time).alias("t"), v.isNull().alias("none"), v.alias("v")).alias("_r"))
    r = r.withColumn("_span", F.explode(F.array_distinct(F.array(*[span(F.col("_t") + d) for d in (-most, 0, most)]))))
    l = left.where(known).withColumns({"_t": micros(left_time), "_left": F.lit(True)})  # noqa: E741
    rows = l.withColumn("_span", span(F.col("_t"))).unionByName(r, allowMissingColumns=True)

    def latest(t: Column) -> Column:
        # of equal times right rows come first, with the value that counts as the last of them
        w = Window.partitionBy(*on, "_span").orderBy(t, F.asc_nulls_first("_left"), F.desc("_r.none"), F.desc("_r.v"))
        return F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))

    seen = rows.withColumn("_b", latest(F.asc("_t"))).withColumn("_a", latest(F.desc("_t"))).where("_left")
    to_b, to_a = F.col("_t") - F.col("_b.t"), F.col("_a.t") - F.col("_t")
    ahead_first = (to_a <= most) & (F.col("_b").isNull() | (to_a <= to_b))
    best = F.when(ahead_first, F.col("_a.v")).when(to_b <= most, F.col("_b.v"))
    found = seen.select(*left.columns, best.alias(value))
    none = left.where(~known).select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias(value))
    return found.unionByName(none)


def _ahead(keys: list[str]) -> WindowSpec:
    """This row and all after it, in the order of the row numbers `_i`: frames that grow from the end, as Spark computes one
    that shrinks towards the end anew for each row."""
    return Window.partitionBy(*keys).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)


def ffill_bfill(df: DataFrame, keys: list[str], t: str, value: str, out: str) -> DataFrame:
    """The last value before, else the first one after."""
    w = Window.partitionBy(*keys).orderBy(t)
    before = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    base = df.withColumn("_before", before).withColumn("_i", F.row_number().over(w))
    after = F.last(value, True).over(_ahead(keys))
    return base.withColumn(out, F.coalesce("_before", after)).drop("_before", "_i")


def fill_zero(df: DataFrame, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.when(~F.isnan(value), F.col(value)), F.lit(0.0)))


def interpolate(df: DataFrame, keys: list[str], x: str, value: str, out: str, limit: int | None = None) -> DataFrame:
    """Linear in x between the nearest values, extrapolated at the ends from the two nearest ones.

    limit fills only the first so many cells of a gap (counted along x). A series with fewer than two values stays.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), _ahead(keys)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(value).alias("v")))
    base = df.withColumn("_p", point).withColumn("_i", F.row_number().over(w))
    base = base.withColumn("_a", F.last("_p", True).over(past)).withColumn("_b", F.last("_p", True).over(future))
    edge = Window.partitionBy(*keys)
    # the second and the last but one points of the series, for extrapolation
    rank_up = F.sum(F.when(F.col("_p").isNotNull(), 1).otherwise(0)).over(past)
    rank_down = F.sum(F.when(F.col("_p").isNotNull(), 1).otherwise(0)).over(future)
    base = base.withColumn("_u", rank_up).withColumn("_d", rank_down)
    second = F.min(F.when(F.col("_p").isNotNull() & (F.col("_u") == 2), F.col("_p"))).over(edge)
    previous = F.min(F.when(F.col("_p").isNotNull() & (F.col("_d") == 2), F.col("_p"))).over(edge)
    last_at = F.max(F.when(F.col("_p").isNotNull(), F.col("_i"))).over(past)
    base = base.withColumn("_s", second).withColumn("_q", previous).withColumn("_l", F.coalesce(last_at, F.lit(0)))

    def line(p: str, q: str) -> Column:
        dx = F.when(F.col(q)["x"] != F.col(p)["x"], F.col(q)["x"] - F.col(p)["x"])
        return F.col(p)["v"] + (F.col(q)["v"] - F.col(p)["v"]) * (F.col(x).cast("double") - F.col(p)["x"]) / dx

    made = (
        F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), line("_a", "_b"))
        .when(F.col("_a").isNull(), line("_b", "_s"))
        .otherwise(line("_q", "_a"))
    )
    if limit is not None:
        made = F.when(F.col("_i") - F.col("_l") <= limit, made)
    return base.withColumn(out, F.coalesce(F.col(value), made)).drop("_p", "_i", "_a", "_b", "_u", "_d", "_s", "_q", "_l")


def drop_missing(df: DataFrame, t: str, cell: list[str], value: str) -> DataFrame:
    """Without the times and the cells that have no value at all (both judged on the original rows).

    Times and cells with a value are aggregated first, so that no task holds all cells of a time.
    """
    some = df.where(F.col(value).isNotNull())

    def within(rows: DataFrame, keys: list[str]) -> DataFrame:
        held = some.select([F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return rows.join(held, same, "left_semi")

    return within(within(df, [t]), cell)


def alpha_eff(scenes: DataFrame, t: str, alpha: float, nominal_days: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds alpha_eff = 1 - (1 - alpha)^(days since the previous scene / nominal); NULL for the first scene."""
    w = Window.partitionBy(*keys).orderBy(t) if keys else Window.partitionBy(F.lit(0)).orderBy(t)
    days = seconds(F.col(t)) - seconds(F.lag(t).over(w))
    days = days / 86400.0
    eff = F.when(days <= 0, F.lit(alpha)).otherwise(1.0 - F.pow(F.lit(1.0 - alpha), days / nominal_days))
    return scenes.withColumn("alpha_eff", F.when(days.isNotNull(), eff))


def ewma_final(cube: DataFrame, cell: list[str], t: str, value: str) -> DataFrame:
    """The average after the last scene for each cell: first value starts it, missing values hold it.

    `cube` carries alpha_eff of the scene. One aggregation a cell; the fold runs over the scenes in order.
    """
    seen = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).alias("v"), F.col("alpha_eff").alias("a"))))

    def step(e: Column, s: Column) -> Column:
        mixed = F.when(e.isNull(), s["v"]).otherwise((1.0 - s["a"]) * e + s["a"] * s["v"])
        return F.when(s["v"].isNull(), e).otherwise(mixed)

    return cube.groupBy(*cell).agg(F.aggregate(seen, F.lit(None).cast("double"), step).alias("ewma_final"))


def ewma_history(cube: DataFrame, cell: list[str], t: str, value: str) -> DataFrame:
    """The average after every scene, a row each."""
    seen = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).alias("v"), F.col("alpha_eff").alias("a"))))
    first = F.array().cast("array<double>")

    def step(h: Column, s: Column) -> Column:
        e = F.try_element_at(h, F.lit(-1))
        mixed = F.when(e.isNull(), s["v"]).otherwise((1.0 - s["a"]) * e + s["a"] * s["v"])
        return F.concat(h, F.array(F.when(s["v"].isNull(), e).otherwise(mixed)))

    folded = cube.groupBy(*cell).agg(seen.alias("_s")).withColumn("_h", F.aggregate("_s", first, step))
    rows = folded.select(*cell, F.explode(F.arrays_zip(F.col("_s.t").alias("t"), F.col("_h").alias("h"))).alias("r"))
    return rows.select(*cell, F.col("r.t").alias(t), F.col("r.h").alias("ewma"))
