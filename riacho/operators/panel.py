"""Panels of entities over time, in long form: resampling, returns, detrending, factors, rank correlation, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riacho.functions import text as T


def unpivot_years(df: DataFrame, ids: list[str], prefix: str) -> DataFrame:
    """(ids..., year, value) of columns named ``<prefix> <year>``; values that are no number are null."""
    columns = [c for c in df.columns if c.startswith(prefix + " ") and c[-4:].isdigit()]
    long = df.select(*ids, *(F.col(f"`{c}`").cast("string").alias(c[-4:]) for c in columns)).unpivot(ids, None, "year", "value")
    return long.select(*ids, F.col("year").cast("int").alias("year"), F.col("value").try_cast("double").alias("value"))


def complete_only(df: DataFrame, entity: str, value: str, n: int) -> DataFrame:
    """Rows of entities that have ``n`` non-null values."""
    whole = df.groupBy(entity).agg(F.count(value).alias("_n")).filter(F.col("_n") == n).select(entity)
    return df.join(whole, entity, "left_semi")


def month_end(df: DataFrame, entity: str, date: Column, value: Column, *ties: Column) -> DataFrame:
    """(entity, month, value): last value of each month, carried forward over gaps; entities with a leading gap go."""
    last = df.groupBy(entity, F.last_day(date).alias("month")).agg(F.max_by(value, F.struct(date, *ties)).alias("value"))
    ends = last.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = ends.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("month"))
    grid = last.select(entity).distinct().crossJoin(F.broadcast(months))  # a calendar of months
    w = Window.partitionBy(entity).orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = grid.join(last, [entity, "month"], "left").withColumn("value", F.last("value", ignorenulls=True).over(w))
    gap = filled.groupBy(entity).agg(F.count_if(F.col("value").isNull()).alias("_gap")).filter("_gap = 0").select(entity)
    return filled.join(gap, entity, "left_semi")


def returns(df: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """Simple returns; the first row of each entity has none and goes."""
    before = F.lag(value).over(Window.partitionBy(entity).orderBy(time))
    return df.withColumn("ret", F.col(value) / before - 1).filter("ret is not null")


def detrended(df: DataFrame, entity: str, t: str, value: str) -> DataFrame:
    """``df`` with ``d``: value less the entity's own straight line over ``t``."""
    w = Window.partitionBy(entity)
    return df.withColumn("d", F.col(value) - (F.regr_intercept(F.col(value), F.col(t)).over(w) + F.regr_slope(F.col(value), F.col(t)).over(w) * F.col(t)))


def with_factors(df: DataFrame, t: str, d: str, rate: DataFrame) -> DataFrame:
    """``df`` with m (mean of ``d`` over entities at each time) and s (rate, standardised, with the deviation of ``d``).

    ``rate`` has (t, rate), one row per time; both factors are one row per time and so are broadcast.
    """
    market = df.groupBy(t).agg(F.avg(d).alias("m"))
    spread = df.agg(F.stddev_pop(d).alias("_sd"))
    level = rate.agg(F.avg("rate").alias("_mean"), F.stddev_pop("rate").alias("_std"))
    factor = rate.crossJoin(level).crossJoin(spread).select(t, ((F.col("rate") - F.col("_mean")) / F.col("_std") * F.col("_sd")).alias("s"))  # single rows
    return df.join(F.broadcast(market), t).join(F.broadcast(factor), t)


def pooled_residuals(df: DataFrame, y: str, m: str, s: str) -> DataFrame:
    """``df`` with ``eps``, residual of a pooled regression of ``y`` on an intercept, ``m`` and ``s``.

    Closed form from one aggregated row of moments.
    """
    c = df.agg(
        F.avg(y).alias("_y"), F.avg(m).alias("_m"), F.avg(s).alias("_s"), F.var_pop(m).alias("_mm"), F.var_pop(s).alias("_ss"),
        F.covar_pop(m, s).alias("_ms"), F.covar_pop(m, y).alias("_my"), F.covar_pop(s, y).alias("_sy"),
    )
    det = F.col("_mm") * F.col("_ss") - F.col("_ms") * F.col("_ms")
    bm = (F.col("_my") * F.col("_ss") - F.col("_sy") * F.col("_ms")) / det
    bs = (F.col("_sy") * F.col("_mm") - F.col("_my") * F.col("_ms")) / det
    fit = F.broadcast(c.select("_y", "_m", "_s", bm.alias("_bm"), bs.alias("_bs")))
    eps = F.col(y) - F.col("_y") - F.col("_bm") * (F.col(m) - F.col("_m")) - F.col("_bs") * (F.col(s) - F.col("_s"))
    return df.join(fit).withColumn("eps", eps).drop("_y", "_m", "_s", "_bm", "_bs")


def average_ranks(df: DataFrame, entity: str, value: str) -> DataFrame:
    """``df`` with ``r``, rank of the value within the entity; ties share the mean rank."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(entity, value))
    return df.withColumn("r", F.rank().over(Window.partitionBy(entity).orderBy(value)) + (ties - 1) / 2.0)


def pair_correlations(df: DataFrame, entity: str, t: str, value: str) -> DataFrame:
    """(i, j, rho) for i < j over common times; 0 where a series is constant.

    For a bounded set of entities (a universe chosen before): the result has one row per pair by definition.
    """
    a = df.select(F.col(entity).alias("i"), t, F.col(value).alias("x"))
    b = df.select(F.col(entity).alias("j"), t, F.col(value).alias("y"))
    rho = F.corr("x", "y")
    out = a.join(b, t).filter("i < j").groupBy("i", "j").agg(rho.alias("rho"))
    return out.withColumn("rho", F.when(F.col("rho").isNull() | F.isnan("rho"), F.lit(0.0)).otherwise(F.col("rho")))


def shrunk(pairs: DataFrame, to_identity: float = 0.3, to_mean: float = 0.5) -> DataFrame:
    """``pairs`` with both shrinkages of rho: towards no correlation, and towards the mean of all pairs."""
    mean = F.broadcast(pairs.agg(F.avg("rho").alias("_mean")))
    return pairs.join(mean).select("i", "j", "rho", (F.col("rho") * (1 - to_identity)).alias("rho_identity"), (F.col("rho") * (1 - to_mean) + F.col("_mean") * to_mean).alias("rho_mean"))


def proxy(pairs: DataFrame, traits: DataFrame, entity: str) -> DataFrame:
    """``pairs`` with a similarity from traits (entity, beta, score, grp): 0.5, less for gaps in beta and score as shares
    of their range, more within one group; between -1 and 1. Adds ``blend``, its mean with rho."""
    span = F.broadcast(traits.agg((F.max("beta") - F.min("beta")).alias("_b"), (F.max("score") - F.min("score")).alias("_s")))
    a = traits.select(F.col(entity).alias("i"), F.col("beta").alias("b1"), F.col("score").alias("s1"), F.col("grp").alias("g1"))
    b = traits.select(F.col(entity).alias("j"), F.col("beta").alias("b2"), F.col("score").alias("s2"), F.col("grp").alias("g2"))
    x = pairs.join(a, "i").join(b, "j").join(span)
    gap = lambda p, q, r: F.coalesce(F.abs(F.col(p) - F.col(q)) / F.nullif(F.col(r), F.lit(0.0)), F.lit(0.0))
    raw = 0.5 - 0.3 * gap("b1", "b2", "_b") - 0.2 * gap("s1", "s2", "_s") + F.when(F.col("g1") == F.col("g2"), 0.2).otherwise(0.0)
    sim = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))
    return x.select("i", "j", "rho", sim.alias("proxy"), ((F.col("rho") + sim) / 2).alias("blend"))


def bootstrap_pairs(df: DataFrame, entity: str, t: str, value: str, draws: int = 500, seed: str = "42") -> DataFrame:
    """(i, j, lo, hi, width, stable) of pair correlations over resampled times, on the Fisher scale.

    ``t`` numbers the times from 0. Each draw takes as many times as there are, with replacement, by hash. A pair is stable
    if its interval excludes 0.
    """
    n = df.agg((F.max(t) + 1).alias("n"))
    spark = df.sparkSession
    drawn = spark.range(draws).select(F.col("id").alias("b")).join(F.broadcast(n)).select("b", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("k"))
    drawn = drawn.select("b", F.floor(T.hash_uniform(F.concat_ws(",", F.col("b"), F.col("k")), seed) * F.col("n")).cast("int").alias(t))
    a = df.select(F.col(entity).alias("i"), t, F.col(value).alias("x"))
    b = df.select(F.col(entity).alias("j"), t, F.col(value).alias("y"))
    rho = a.join(b, t).filter("i < j").join(F.broadcast(drawn), t).groupBy("i", "j", "b").agg(F.corr("x", "y").alias("rho"))
    z = F.atanh(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.round(F.when(F.col("rho").isNull() | F.isnan("rho"), F.lit(0.0)).otherwise(F.col("rho")), 9))))
    ends = rho.withColumn("z", z).groupBy("i", "j").agg(F.percentile("z", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    out = ends.select("i", "j", F.tanh(F.col("p")[0]).alias("lo"), F.tanh(F.col("p")[1]).alias("hi"))
    return out.withColumn("width", F.col("hi") - F.col("lo")).withColumn("stable", (F.round("lo", 6) > 0) | (F.round("hi", 6) < 0))


def verdict(stability: DataFrame) -> DataFrame:
    """(n_pairs, n_stable, mean_width, verdict): stable if intervals are narrow and enough pairs are kept."""
    out = stability.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("stable").alias("n_stable"), F.round(F.avg("width"), 6).alias("mean_width"))
    return out.withColumn("verdict", F.when((F.col("mean_width") < 0.5) & (F.col("n_stable") / F.col("n_pairs") > 0.3), "stable").otherwise("unstable"))


def decorrelated(ranked: DataFrame, pairs: DataFrame, entity: str, limit: float = 0.7, cap: int = 12) -> DataFrame:
    """Entities in score order, each kept unless it correlates beyond ``limit`` with a kept one; at most ``cap``.

    ``ranked`` has (entity, position). Greedy choice depends on what was kept, so it folds over one array of the chosen
    universe, which is bounded; no rows are collected to the driver.
    """
    near = pairs.filter(F.abs("rho") > limit)
    both = near.select("i", "j").unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j")))
    per = ranked.join(both.groupBy("i").agg(F.collect_set("j").alias("near")), F.col(entity) == F.col("i"), "left")
    kind = f"array<{ranked.schema[entity].dataType.simpleString()}>"
    row = F.struct("position", F.col(entity).alias("e"), F.coalesce("near", F.array().cast(kind)).alias("near"))
    one = per.agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kept = F.aggregate("rows", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) >= cap) | F.arrays_overlap(acc, x["near"]), acc).otherwise(F.array_append(acc, x["e"])))
    return one.select(F.posexplode(kept).alias("pick", entity))


def triangle(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("rho"), 6).alias("mean"), F.round(F.percentile("rho", F.lit(0.5)), 6).alias("median"), F.round(F.max("rho"), 6).alias("max"))


def extremes(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most and least correlated pairs (a report)."""
    top = pairs.orderBy(F.round("rho", 9).desc(), "i", "j").limit(k).withColumn("side", F.lit("most"))
    return top.unionByName(pairs.orderBy(F.round("rho", 9), "i", "j").limit(k).withColumn("side", F.lit("least")))


def series_profile(df: DataFrame, entity: str, t: str, value: str) -> DataFrame:
    """Per entity: relative slope, residual deviation over mean, shares of positive values and rises, deepest drawdown."""
    w = Window.partitionBy(entity).orderBy(t)
    x = df.withColumn("_before", F.lag(value).over(w)).withColumn("_top", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = detrended(x, entity, t, value)
    mean = F.avg(value)
    return x.groupBy(entity).agg(
        F.count(value).alias("n"),
        F.round(F.regr_slope(value, t) / mean, 6).alias("slope"),
        F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))) / mean, 6).alias("deviation"),
        F.round(F.avg((F.col(value) > 0).cast("int")), 6).alias("positive"),
        F.round(F.avg(((F.col(value) - F.col("_before")) / F.col("_before") > 0).cast("int")), 6).alias("rises"),
        F.round(F.least(F.lit(1.0), 1 - F.min(F.col(value) / F.greatest(F.col("_top"), F.lit(1.0)))), 6).alias("drawdown"),
    )


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int, least: int = 1) -> DataFrame:
    """``df`` with the trailing mean over ``rows`` rows, rounded half to even; null with fewer than ``least`` rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn("mean", F.when(F.count(value).over(w) >= least, F.bround(F.avg(value).over(w), 2)))


def similar_by_latent(df: DataFrame, entity: str, features: list[str], k: int = 3) -> DataFrame:
    """(entity, latent array): scaled features projected on their first ``k`` principal components; signs are arbitrary."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    stages = [VectorAssembler(inputCols=features, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True), PCA(k=k, inputCol="_s", outputCol="_p")]
    return Pipeline(stages=stages).fit(df).transform(df).select(entity, vector_to_array("_p").alias("latent"))
