"""Asset selection and weights over a bounded universe of return series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riacho.functions import text as T


def random_weights(assets: DataFrame, asset: str, n: int, seed: str = "42") -> DataFrame:
    """(draw, asset, weight): ``n`` portfolios uniform on the simplex (normalised exponentials of hash numbers)."""
    draws = assets.sparkSession.range(n).select(F.col("id").alias("draw"))
    raw = draws.crossJoin(F.broadcast(assets.select(asset)))  # a chosen universe
    raw = raw.withColumn("_e", -F.ln(T.hash_uniform(F.concat_ws(",", F.col("draw"), F.col(asset)), seed)))
    total = raw.groupBy("draw").agg(F.sum("_e").alias("_t"))
    return raw.join(total, "draw").select("draw", asset, (F.col("_e") / F.col("_t")).alias("weight"))


def outcomes(weights: DataFrame, rets: DataFrame, asset: str, time: str, periods: int = 12, free: float = 0.0) -> DataFrame:
    """(draw, ret, vol, sharpe), annualised; ``free`` is the annual riskless rate."""
    per = rets.join(F.broadcast(weights), asset).groupBy("draw", time).agg(F.sum(F.col("ret") * F.col("weight")).alias("r"))
    out = per.groupBy("draw").agg((F.avg("r") * periods).alias("ret"), (F.stddev_samp("r") * F.sqrt(F.lit(periods))).alias("vol"))
    return out.withColumn("sharpe", (F.col("ret") - free) / F.col("vol"))


def chosen(outcome: DataFrame) -> DataFrame:
    """The portfolios of least deviation and of best Sharpe ratio."""
    return outcome.agg(F.min_by("draw", F.struct(F.round("vol", 9), "draw")).alias("min_vol_draw"), F.max_by("draw", F.struct(F.round("sharpe", 9), -F.col("draw"))).alias("max_sharpe_draw"))


def varying(rets: DataFrame, asset: str) -> DataFrame:
    """Rows of assets whose returns vary at all."""
    keep = rets.groupBy(asset).agg(F.var_pop("ret").alias("_v")).filter("_v > 1e-15").select(asset)
    return rets.join(keep, asset, "left_semi")


def top_by_mean(rets: DataFrame, asset: str, k: int) -> DataFrame:
    """The ``k`` assets of the highest mean return."""
    return rets.groupBy(asset).agg(F.avg("ret").alias("mean")).orderBy(F.round("mean", 9).desc(), asset).limit(k)


def utility_weights(rets: DataFrame, asset: str, time: str, risk: float, l2: float, cap: float = 1.5, floor: float = 0.5) -> DataFrame:
    """(asset, weight) that maximise mean less risk times variance less an L2 penalty, each within [floor/n, cap/n].

    The covariance (shrunk towards its diagonal mean) is as large as the chosen universe, so one task holds it; projected
    gradient ascent finds the optimum.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index=time, columns=asset, values="ret").dropna().sort_index(axis=1)
        mu, x = wide.mean().to_numpy(), wide.to_numpy()
        n = x.shape[1]
        cov = np.atleast_2d(np.cov(x, rowvar=False))
        centred = x - mu
        target = np.eye(n) * np.trace(cov) / n
        spread = ((centred[:, :, None] * centred[:, None, :] - cov) ** 2).sum() / len(x) ** 2
        distance = ((cov - target) ** 2).sum()
        share = min(1.0, spread / distance) if distance > 0 else 0.0
        cov = (1 - share) * cov + share * target
        lo, hi, w = floor / n, cap / n, np.full(n, 1 / n)
        step = 1 / (2 * (risk * np.linalg.norm(cov, 2) + l2) + 1e-9)
        for _ in range(2000):
            w = _project(w + step * (mu - 2 * risk * cov @ w - 2 * l2 * w), lo, hi)
        return pd.DataFrame({asset: wide.columns, "weight": w})

    kind = rets.schema[asset].dataType.simpleString()
    return rets.select(asset, time, "ret", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(lambda rows: solve(rows), f"{asset} {kind}, weight double")


def _project(w: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The nearest point with sum 1 and every weight in [lo, hi]."""
    a, b = (w - hi).min(), (w - lo).max()
    for _ in range(60):
        mid = (a + b) / 2
        a, b = (mid, b) if np.clip(w - mid, lo, hi).sum() > 1 else (a, mid)
    return np.clip(w - (a + b) / 2, lo, hi)


def grid(spark, **values: list) -> DataFrame:
    """Every combination of parameter values."""
    out = None
    for name, options in values.items():
        one = spark.createDataFrame([(v,) for v in options], f"{name} double")
        out = one if out is None else out.crossJoin(one)  # literal lists
    return out


def best_parameters(scores: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """The parameters of the highest mean score."""
    mean = scores.groupBy(*keys).agg(F.avg(score).alias("mean_score"))
    return mean.orderBy(F.round("mean_score", 9).desc(), *keys).limit(1)


def whole_shares(weights: DataFrame, price: str, cash: float) -> DataFrame:
    """``weights`` with the whole number of shares that the cash buys at each weight."""
    return weights.withColumn("shares", F.floor(F.col("weight") * cash / F.col(price)))
