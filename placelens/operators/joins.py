"""Joins between places and their child tables, and key reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_children(child: DataFrame, places: DataFrame) -> DataFrame:
    """Child rows of the kept places."""
    return child.join(places.select("business_id").distinct(), "business_id", "left_semi")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def _one_row_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise while running when a key repeats; the check rides on one aggregate per key."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    bad = F.raise_error(F.concat(F.lit("duplicate join key: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys])))
    checked = n.select(*keys, F.when(F.col("_n") > 1, bad).otherwise(F.lit(1)).cast("int").alias("_one"))
    return df.join(checked, list(keys)).where(F.col("_one") == 1).drop("_one")


def join_features(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("business_id",)) -> DataFrame:
    """Inner join of two tables that must both hold one row per key."""
    return _one_row_per_key(left, keys).join(_one_row_per_key(right, keys), list(keys))


def join_signals(left: DataFrame, signals: DataFrame, keys: Sequence[str] = ("business_id",)) -> DataFrame:
    """Left join of per-key signals; missing numbers become 0."""
    numeric = [
        f.name for f in signals.schema.fields if f.name not in keys and f.dataType.typeName() in ("double", "float")
    ]
    return left.join(_one_row_per_key(signals, keys), list(keys), "left").na.fill(0.0, subset=numeric)


def text_fields(places: DataFrame) -> DataFrame:
    """The fields a profile document needs, blanks for NULLs."""
    names = ["name", "categories", "city", "state", "attributes"]
    return places.select("business_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in names])


def reconcile_keys(a: DataFrame, b: DataFrame, key: str = "business_id") -> DataFrame:
    """Sizes of two key sets and of both set differences."""
    left = a.select(F.col(key).alias("k")).distinct().withColumn("in_a", F.lit(1))
    right = b.select(F.col(key).alias("k")).distinct().withColumn("in_b", F.lit(1))
    both = left.join(right, "k", "full_outer")
    return both.agg(
        F.count("in_a").alias("n_a"),
        F.count("in_b").alias("n_b"),
        F.count_if(F.col("in_a").isNull()).alias("b_without_a"),
        F.count_if(F.col("in_b").isNull()).alias("a_without_b"),
    )
