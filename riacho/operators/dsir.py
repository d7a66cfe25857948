"""Importance resampling: hashed n-gram features, log ratios against a target slice, Gumbel top-k within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riacho.functions import text as T
from riacho.scale import running

BUCKETS, TOKENS = 10_000, 512


def features(text: Column, bucket=T.crc_bucket, buckets: int = BUCKETS, tokens: int = TOKENS) -> Column:
    """Buckets of the first ``tokens`` lower-case words and of their neighbouring pairs, with repeats."""
    words = F.slice(F.filter(F.split(F.lower(text), f"{T.WS}+"), lambda x: x != ""), 1, tokens)

    def both(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
        return F.transform(F.concat(w, pairs), lambda x: bucket(x, buckets))

    return F.flatten(F.transform(F.array(words), both))  # the lambda's argument is computed once


def document_features(df: DataFrame, doc_id: str, text: str, target: Column, bucket=T.crc_bucket, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, target, bucket, cnt) of each document."""
    rows = df.filter(F.col(text).isNotNull()).select(doc_id, F.coalesce(target, F.lit(False)).alias("target"), F.explode(features(F.col(text), bucket, buckets)).alias("bucket"))
    return rows.groupBy(doc_id, "target", "bucket").agg(F.count(F.lit(1)).alias("cnt"))


def bucket_counts(df: DataFrame, text: str, target: Column, bucket=T.crc_bucket, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, source_cnt, target_cnt); partial sums before the shuffle, at most ``buckets`` rows after it."""
    rows = df.filter(F.col(text).isNotNull()).select(F.coalesce(target, F.lit(False)).alias("target"), F.explode(features(F.col(text), bucket, buckets)).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("source_cnt"), F.count_if("target").alias("target_cnt"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, log_ratio) for every bucket, empty ones included; counts are smoothed by one."""
    spark = counts.sparkSession
    every = spark.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["source_cnt", "target_cnt"])
    total = counts.agg(F.coalesce(F.sum("source_cnt"), F.lit(0)).alias("s"), F.coalesce(F.sum("target_cnt"), F.lit(0)).alias("t"))
    t = (F.col("target_cnt") + 1) / (F.col("t") + buckets)
    s = (F.col("source_cnt") + 1) / (F.col("s") + buckets)
    return every.join(F.broadcast(total)).select("bucket", F.ln(t / s).alias("log_ratio"))  # one row of totals


def importance(feats: DataFrame, ratios: DataFrame, docs: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, raw): sum of count times log ratio; documents without features have 0.

    The ratios are one row per bucket, a bound by construction, so they are broadcast and features are never shuffled.
    """
    scored = feats.join(F.broadcast(ratios), "bucket").groupBy(doc_id).agg(F.sum(F.col("cnt") * F.col("log_ratio")).alias("raw"))
    return docs.select(doc_id).join(scored, doc_id, "left").select(doc_id, F.coalesce("raw", F.lit(0.0)).alias("raw"))


def gumbel(raw: Column, key: Column, seed: str = "42") -> Column:
    """Score whose ranking is a sample without replacement; the noise comes from a hash of the key."""
    u = F.least(F.greatest(T.hash_uniform(key, seed), F.lit(1e-12)), F.lit(1 - 1e-12))
    return raw - F.ln(-F.ln(u))


def take_budget(df: DataFrame, order: list[Column], tokens: Column, budget: int) -> DataFrame:
    """Rows in ``order`` until their tokens reach ``budget``; the row that crosses it is in. Adds taken_before."""
    summed = running(df.withColumn("_tok", tokens.cast("long")), order, F.col("_tok"), "_sum")
    return summed.withColumn("taken_before", F.col("_sum") - F.col("_tok")).filter(F.col("taken_before") < budget).drop("_sum", "_tok")


def divergence(counts: DataFrame, selected: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(kl_pre, kl_post, reduction, ratio) of the target against the source and against the selection, over all buckets.

    ``counts`` has (bucket, source_cnt, target_cnt), ``selected`` (bucket, sel_cnt).
    """
    every = counts.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").join(selected, "bucket", "left").na.fill(0)
    total = every.agg(F.sum("source_cnt").alias("s"), F.sum("target_cnt").alias("t"), F.sum("sel_cnt").alias("q"))
    x = every.join(F.broadcast(total))  # one row
    g = (F.col("target_cnt") + 1) / (F.col("t") + buckets)
    n = (F.col("source_cnt") + 1) / (F.col("s") + buckets)
    q = (F.col("sel_cnt") + 1) / (F.col("q") + buckets)
    out = x.agg(F.sum(g * F.ln(g / n)).alias("pre"), F.sum(g * F.ln(g / q)).alias("post"))
    ratio = F.when(F.abs("pre") < 1e-15, F.lit(0.0)).otherwise((F.col("pre") - F.col("post")) / F.col("pre"))
    return out.select(F.round("pre", 6).alias("kl_pre"), F.round("post", 6).alias("kl_post"), F.round(F.col("pre") - F.col("post"), 6).alias("reduction"), F.round(ratio, 6).alias("ratio"))


def gates(divergences: DataFrame, duplicate_ratio: float, keyword_ratio: float, kl: float = 0.06, share: float = 0.05) -> DataFrame:
    """The divergence row with the outcome of each quality gate."""
    return divergences.select("*", (F.lit(duplicate_ratio) < share).alias("duplicates_ok"), (F.lit(keyword_ratio) <= share).alias("keyword_ok"), ((F.col("kl_post") < kl) & (F.col("reduction") > 0)).alias("kl_ok"))
