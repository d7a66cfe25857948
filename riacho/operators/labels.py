"""Labelled text: union of sets, label maps, final merge with reasons, contracts, thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riacho.functions import text as T
from riacho.operators import dedup

SENTIMENTS = ("negative", "neutral", "positive")
ALIASES = ("source", "text", "sentence", "tweet", "headline", "input", "en")


def mapped(c: Column, values: dict[str, str]) -> Column:
    """Value looked up (trimmed, case ignored); unmapped and null values are null."""
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.element_at(table, F.lower(F.trim(c)))


def aliased(df: DataFrame, names: tuple[str, ...] = ALIASES, to: str = "source", dataset: str = "") -> DataFrame:
    """``df`` with the first column of ``names`` (case ignored) as ``to``, a dataset column, and no null or blank text."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    found = next((lower[n] for n in names if n in lower), None)
    if found is None:
        raise ValueError(f"none of {names} in {df.columns}")
    out = df if found == to else df.drop(to).withColumnRenamed(found, to)
    if "dataset" not in out.columns:
        out = out.withColumn("dataset", F.lit(dataset))
    return out.filter(T.strip(F.col(to)) != "")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def validity(source: Column, translated: Column, sentiment: Column) -> Column:
    """The first reason why a row is unfit, or ``keep``: blank_source, blank_translated, echo, no_label, bad_label."""
    blank = lambda c: F.coalesce(T.strip(c) == "", F.lit(True))
    return (
        F.when(blank(source), "blank_source")
        .when(blank(translated), "blank_translated")
        .when(T.canon(source) == T.canon(translated), "echo")
        .when(sentiment.isNull(), "no_label")
        .when(~sentiment.isin(*SENTIMENTS), "bad_label")
        .otherwise("keep")
    )


def final_merge(rows: DataFrame, labels: DataFrame, scores: DataFrame, label_order: list[Column], score_order: list[Column], row_order: list[Column]) -> DataFrame:
    """Rows (source, translated, ...) with the first label and the last score of their text; the last good row of each text.

    Adds sentiment, quality (null without score), reason and first_seen. Unfit rows come out with their reason, fit ones
    once per text.
    """
    first = dedup.first_wins(labels.filter("source is not null and sentiment is not null").withColumn("_key", T.canon(F.col("source"))), [F.col("_key")], *label_order).select("_key", F.col("sentiment"))
    last = dedup.last_wins(scores.filter("source is not null and score is not null").withColumn("_key", T.canon(F.col("source"))), [F.col("_key")], *score_order).select("_key", F.col("score").alias("quality"))
    joined = rows.withColumn("_key", T.canon(F.col("source"))).join(first, "_key", "left").join(last, "_key", "left")
    joined = joined.withColumn("reason", validity(F.col("source"), F.col("translated"), F.col("sentiment")))
    good = joined.filter("reason = 'keep'")
    seen = good.groupBy("_key").agg(F.min(F.struct(*row_order)).alias("first_seen"))
    kept = dedup.last_wins(good, [F.col("_key")], *row_order).join(seen, "_key")
    bad = joined.filter("reason != 'keep'")
    return kept.unionByName(bad, allowMissingColumns=True).drop("_key")


def dead_letters(df: DataFrame, path: str, reason: str = "reason", keep: str = "keep") -> DataFrame:
    """Writes the rows with another reason as JSON, a folder per reason, and returns the others."""
    df.filter(F.col(reason) != keep).write.mode("append").partitionBy(reason).json(path)
    return df.filter(F.col(reason) == keep)


def contract(json: Column, keys: list[str], numbers: list[str]) -> Column:
    """Every fault of a JSON row: bad_json, missing:k, extra:k, not_number:k (null is allowed, true and false are not)."""
    fields = F.json_object_keys(json)
    wanted = F.array(*map(F.lit, keys))
    kinds = [
        F.when(
            F.get_json_object(json, f"$.{k}").isNotNull() & ~F.schema_of_variant(F.parse_json(F.to_json(F.struct(F.get_json_object(json, f"$.{k}").alias("x"))))).contains("x: none")
            & F.get_json_object(json, f"$.{k}").try_cast("double").isNull(),
            F.lit(f"not_number:{k}"),
        )
        for k in numbers
    ]
    faults = F.concat(
        F.transform(F.array_except(wanted, fields), lambda k: F.concat(F.lit("missing:"), k)),
        F.transform(F.array_except(fields, wanted), lambda k: F.concat(F.lit("extra:"), k)),
        F.filter(F.array(*kinds), lambda x: x.isNotNull()) if kinds else F.array().cast("array<string>"),
    )
    return F.when(fields.isNull(), F.array(F.lit("bad_json"))).otherwise(F.array_sort(faults))


def quality_at_least(df: DataFrame, quality: Column, least: float) -> DataFrame:
    """Rows whose quality, read as a number (unreadable or null: 0), is at least ``least``."""
    return df.filter(F.coalesce(quality.try_cast("double"), F.lit(0.0)) >= least)


def label_by_prefix(c: Column) -> Column:
    """neg, neu, pos -> 0, 1, 2 by the first three letters."""
    three = F.substring(F.lower(F.trim(c)), 1, 3)
    return F.when(three == "neg", 0).when(three == "neu", 1).when(three == "pos", 2)


def retries(df: DataFrame, score: Column, below: float = 0.5) -> DataFrame:
    """Scored rows under ``below``; rows without a score stay out."""
    return df.filter(score < below)


def threshold_ladder(df: DataFrame, quality: Column, steps: list[float]) -> DataFrame:
    """(threshold, n): rows whose quality reaches each threshold, in one pass."""
    counts = df.agg(*(F.count_if(quality >= t).alias(f"c{i}") for i, t in enumerate(steps)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("n")) for i, t in enumerate(steps)))).alias("x")).select("x.*")


def score_summary(df: DataFrame, score: Column, below: float = 0.5) -> DataFrame:
    return df.agg(F.count(score).alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.count_if(score < below).alias("n_below"))


def conflicts(df: DataFrame, text: Column, label: Column) -> DataFrame:
    """(key, n_labels, n_rows) of texts that bear several labels."""
    out = df.filter(text.isNotNull() & label.isNotNull()).groupBy(T.canon(text).alias("key"), label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    out = out.groupBy("key").agg(F.count(F.lit(1)).alias("n_labels"), F.sum("n").alias("n_rows"))
    return out.filter("n_labels > 1")


def flow(df: DataFrame, *stages: tuple[str, Column]) -> DataFrame:
    """(stage, n): rows that pass the first k conditions, for each k; counts only fall, so flows are conserved."""
    passed, out = F.lit(True), []
    for _, condition in stages:
        passed = passed & F.coalesce(condition, F.lit(False))
        out.append(passed)
    counts = df.agg(*(F.count_if(c).alias(f"c{i}") for i, c in enumerate(out)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.col(f"c{i}").alias("n")) for i, (name, _) in enumerate(stages)))).alias("x")).select("x.*")
