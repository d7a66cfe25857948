"""Run analytics: trailing means, running bests, averages with memory, circuit breakers, checkpoints, fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_mean(df: DataFrame, keys: list[str], order: list[Column], value: str, rows: int = 20) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn("trailing_mean", F.avg(value).over(w))


def running_best(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """``df`` with the best value so far; nulls carry the previous one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("best", F.max(value).over(w))


def ema(df: DataFrame, key: str, order: Column, value: Column, alpha: float = 0.3) -> DataFrame:
    """(key, n, ema): exponential average in order, started by the first value; a fold over each key's own history.

    A key's history is one array: keys are single endpoints with bounded logs. The streaming form keeps one number of state.
    """
    rows = df.filter(value.isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.cast("double").alias("x")))).alias("h"))
    folded = F.aggregate("h", F.lit(None).cast("double"), lambda acc, r: F.when(acc.isNull(), r["x"]).otherwise(alpha * r["x"] + (1 - alpha) * acc))
    return rows.select(key, F.size("h").alias("n"), folded.alias("ema"))


def breaker(df: DataFrame, keys: list[str], order: list[Column], failed: Column, fails: int = 3) -> DataFrame:
    """Rows at which ``fails`` failures in a row (a multiple of it) trip the breaker; a success resets the count."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = df.withColumn("_bad", failed).withColumn("_run", F.sum((~F.col("_bad")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    count = F.count_if("_bad").over(Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return run.withColumn("in_a_row", count).filter(F.col("_bad") & (F.col("in_a_row") % fails == 0)).drop("_bad", "_run")


def best_step(df: DataFrame, key: str, step: Column, metric: Column) -> DataFrame:
    """(key, last_step, best_step, best): the latest step, and the one of the best metric, the first of equals.

    Rows without the metric count for the latest step only.
    """
    return df.groupBy(key).agg(F.max(step).alias("last_step"), F.max_by(step, F.when(metric.isNotNull(), F.struct(metric, -step))).alias("best_step"), F.max(metric).alias("best"))


def log_fit(df: DataFrame, n: Column, y: Column) -> DataFrame:
    """(intercept, slope) of y over the decimal logarithm of n."""
    x = F.log10(n)
    return df.filter(n > 0).agg(F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_slope(y, x), 6).alias("slope"))


def throughput(df: DataFrame, keys: list[str], milliseconds: Column) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(milliseconds).alias("n"), F.round(F.avg(milliseconds), 6).alias("mean_ms"), F.sum(milliseconds).alias("_ms"))
    return out.withColumn("per_second", F.round(F.col("n") / (F.col("_ms") / 1000), 6)).drop("_ms")


def log_rows(df: DataFrame, history: str = "log_history") -> DataFrame:
    """One row per entry of a trainer's log array, with the columns of its entries."""
    return df.select(*(c for c in df.columns if c != history), F.explode(history).alias("_e")).select("*", "_e.*").drop("_e")
