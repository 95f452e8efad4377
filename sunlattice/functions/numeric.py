"""Comparisons and quotients with the missing-value rules of array code: a comparison with NaN or NULL is false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def is_value(c: Column) -> Column:
    """Neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def gt(a: Column, b) -> Column:
    """a > b, false if either is missing (NaN is the largest value to Spark)."""
    b = as_column(b)
    return F.coalesce((a > b) & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def lt(a: Column, b) -> Column:
    """a < b, false if either is missing."""
    b = as_column(b)
    return F.coalesce((a < b) & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def nan_to_null(c: Column) -> Column:
    """NULL for NaN, so that aggregates skip it."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """True for a number that is neither missing nor infinite."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) != float("inf")), F.lit(False))


def safe_div(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """a / max(b, eps): small and negative denominators become eps, missing ones stay missing."""
    return a / F.when(F.isnan(b), b).when(b > eps, b).when(b.isNotNull(), F.lit(eps))


def to_half(c: Column) -> Column:
    """The value rounded to a 10-bit mantissa (normal range of half precision)."""
    ulp = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(c))) - 10)
    return F.when(c == 0, c).otherwise(F.rint(c / ulp) * ulp)
