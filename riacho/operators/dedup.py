"""First-wins and last-wins deduplication with explicit order; survivors never depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[Column], take) -> DataFrame:
    """One row per key by an aggregate, which is combined before the shuffle, unlike a window."""
    names = [f"_k{i}" for i in range(len(keys))]
    row = F.struct(*(F.col(c) for c in df.columns))
    picked = df.groupBy(*(k.alias(n) for k, n in zip(keys, names, strict=True))).agg(take(row).alias("_row"))
    return picked.select("_row.*")


def first_wins(df: DataFrame, keys: list[Column], *order: Column) -> DataFrame:
    """The first row of each key in ``order``; null keys form a key of their own. ``order`` has to be total."""
    return _pick(df, keys, lambda row: F.min_by(row, F.struct(*order)))


def last_wins(df: DataFrame, keys: list[Column], *order: Column) -> DataFrame:
    """The last row of each key in ``order``."""
    return _pick(df, keys, lambda row: F.max_by(row, F.struct(*order)))


def ranked(df: DataFrame, keys: list[Column], *order: Column) -> DataFrame:
    """``df`` with ``_rank`` of each row within its key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def without(df: DataFrame, key: Column, other: DataFrame, other_key: Column) -> DataFrame:
    """Rows whose key does not occur in ``other``; rows with a null key stay."""
    gone = other.select(other_key.alias("_gone")).filter("_gone is not null").distinct()
    return df.join(gone, key == F.col("_gone"), "left_anti")


def duplicate_ratio(df: DataFrame, key: Column) -> DataFrame:
    """(n_rows, n_distinct, duplicate_ratio) over non-null keys."""
    per = df.filter(key.isNotNull()).groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
    return out.withColumn("duplicate_ratio", F.when(F.col("n_rows") > 0, F.round(1 - F.col("n_distinct") / F.col("n_rows"), 6)).otherwise(F.lit(0.0)))
