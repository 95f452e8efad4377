"""Model features, tree scoring and classes of the capacity factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunlattice.functions.numeric import finite, lt

#: Fixed values.
CF_MIN, CF_MAX = 0.0105783866057838, 0.4491107906753183
LOW, HIGH = 0.16708700705687, 0.20819425962165683


def trig(lat: Column, lon: Column) -> dict[str, Column]:
    return {
        "lat_sin": F.sin(F.radians(lat)),
        "lat_cos": F.cos(F.radians(lat)),
        "lon_sin": F.sin(F.radians(lon)),
        "lon_cos": F.cos(F.radians(lon)),
    }


def build_features(df: DataFrame, feature_columns: list[str], keep: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """Exactly `feature_columns`, in order: missing columns and missing or infinite values become 0.

    latitude and longitude turn into their sines and cosines. `features_missing` counts the features without a value.
    """
    if {"latitude", "longitude"} <= set(df.columns):
        df = df.withColumns(trig(F.col("latitude"), F.col("longitude")))
    known = set(df.columns) - {"latitude", "longitude", "name"}
    missing = [F.when(finite(F.col(c)), 0).otherwise(1) if c in known else F.lit(1) for c in feature_columns]
    made = [
        (F.when(finite(F.col(c)), F.col(c).cast("double")).otherwise(0.0) if c in known else F.lit(0.0)).alias(c)
        for c in feature_columns
    ]
    total = missing[0] if missing else F.lit(0)
    for m in missing[1:]:
        total = total + m
    return df.select(*[k for k in keep if k in df.columns], *made, total.alias("features_missing"))


def oblivious_trees(model: dict) -> Column:
    """A column for a forest of oblivious trees: {"bias", "scale", "trees": [{"splits": [[feature, border]..], "leaves": [..]}]}.

    Each tree's leaf number has bit i set if split i's feature exceeds its border; the leaf is read from a constant array,
    so scoring stays in generated code.
    """
    total = F.lit(0.0)
    for tree in model["trees"]:
        index = F.lit(0)
        for i, (feature, border) in enumerate(tree["splits"]):
            index = index + F.when(F.col(feature) > border, 1 << i).otherwise(0)
        total = total + F.get(F.array(*[F.lit(float(x)) for x in tree["leaves"]]), index)
    return total * float(model.get("scale", 1.0)) + float(model.get("bias", 0.0))


def surrogate_cf(raw: Column) -> Column:
    """A score clamped to the range of the index parameters."""
    return F.least(F.greatest(raw, F.lit(CF_MIN)), F.lit(CF_MAX))


def classify(cf: Column) -> dict[str, Column]:
    """Category and explanation; a missing factor compares with nothing and so is high."""
    percent = {k: f"{v * 100:.1f}" for k, v in (("low", LOW), ("high", HIGH))}
    return {
        "cf_category": F.when(lt(cf, LOW), "low").when(lt(cf, HIGH), "medium").otherwise("high"),
        # fixed values: the response's texts
        "cf_explanation": F.when(lt(cf, LOW), f"Низкий CF: ниже {percent['low']}%.")
        .when(lt(cf, HIGH), f"Средний CF: от {percent['low']}% до {percent['high']}%.")
        .otherwise(f"Высокий CF: выше {percent['high']}%."),
    }
