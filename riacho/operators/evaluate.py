"""Evaluation: confusion, F1, paired intervals, splits, samples, probes, label parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riacho.functions import text as T


def confusion(df: DataFrame, gold: Column, predicted: Column, classes: list) -> DataFrame:
    """(gold, predicted, n) for every pair of classes, zeros included."""
    n = df.groupBy(gold.alias("gold"), predicted.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], "gold int, predicted int")  # classes squared
    return grid.join(n, ["gold", "predicted"], "left").na.fill(0, ["n"])


def f1(matrix: DataFrame) -> DataFrame:
    """(n, accuracy, macro_f1) of a confusion matrix; a class without rows has F1 0."""
    hits = F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0))
    per_gold = matrix.groupBy(F.col("gold").alias("c")).agg(F.sum("n").alias("support"), hits.alias("tp"))
    per_pred = matrix.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("chosen"))
    both = per_gold.join(per_pred, "c")
    denominator = F.col("support") + F.col("chosen")
    score = F.when(denominator > 0, 2 * F.col("tp") / denominator).otherwise(F.lit(0.0))
    return both.agg(F.sum("support").alias("n"), F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg(score), 6).alias("macro_f1"))


def paired(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """(n, mean_diff, se, lo, hi, wins) of b less a over common keys, with a 95 % normal interval."""
    x = a.select(key, F.col(score).alias("a")).join(b.select(key, F.col(score).alias("b")), key).withColumn("d", F.col("b") - F.col("a"))
    out = x.agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("sd"), F.count_if(F.col("d") > 0).alias("wins"))
    se = F.col("sd") / F.sqrt("n")
    return out.select("n", F.round("m", 6).alias("mean_diff"), F.round(se, 6).alias("se"), F.round(F.col("m") - 1.96 * se, 6).alias("lo"), F.round(F.col("m") + 1.96 * se, 6).alias("hi"), "wins")


def stratified_split(df: DataFrame, key: Column, stratum: str, share: float = 0.8, seed: str = "42") -> DataFrame:
    """``df`` with ``train``: the first ``share`` of each stratum in hash order, rounded down."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed), key.cast("string"))), key)
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    ranked = df.withColumn("_r", F.row_number().over(order)).join(F.broadcast(sizes), stratum)  # one row per class
    return ranked.withColumn("train", F.col("_r") <= F.floor(F.col("_n") * share)).drop("_r", "_n")


def hash_split(df: DataFrame, key: Column, test_share: float = 0.01, seed: str = "42") -> DataFrame:
    """``df`` with ``test``; each row decides for itself, so there is no shuffle."""
    return df.withColumn("test", T.hash_uniform(key, seed) < test_share)


def hash_sample(df: DataFrame, key: Column, n: int, seed: str = "42") -> DataFrame:
    """A uniform sample of ``n`` rows without replacement, the same for any partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), key.cast("string"))), key).limit(n)


def expanding_folds(df: DataFrame, position: str, folds: int = 3) -> DataFrame:
    """(fold, position, part): time-ordered folds; fold f trains on all that comes before its test part."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    size = F.floor(F.col("_n") / (folds + 1))
    f = df.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    x = df.select(position).join(F.broadcast(n)).crossJoin(F.broadcast(f))  # a handful of folds
    begin = F.col("_n") - (folds - F.col("fold")) * size
    part = F.when(F.col(position) < begin, "train").when(F.col(position) < begin + size, "test")
    return x.select("fold", position, part.alias("part")).filter("part is not null")


def parsed_label(c: Column, words: dict[str, int]) -> Column:
    """Class of the first known word in an answer; null if there is none."""
    hit = F.regexp_extract(F.lower(c), "(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")", 1)
    table = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    return F.element_at(table, F.nullif(hit, F.lit("")))


def wrong_when_unparsed(parsed: Column, gold: Column) -> Column:
    """Unparsed answers count as a class that is surely wrong."""
    return F.coalesce(parsed, F.when(gold == 1, 0).otherwise(1 - gold))


def argmax(vector: Column, n: int) -> Column:
    """Position of the largest of the first ``n`` components, the first of equals."""
    head = F.slice(vector, 1, n)
    return (F.array_position(head, F.array_max(head)) - 1).cast("int")


def centroid_probe(df: DataFrame, key: str, vector: str, label: str, train: str) -> DataFrame:
    """(key, label, predicted) of test rows: one-vs-rest logistic regression on features scaled by the training part."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, OneVsRest
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = df.select(key, F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("_v"), train)
    model = Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="features", withMean=True), OneVsRest(classifier=LogisticRegression(maxIter=20, regParam=0.01), parallelism=4)]).fit(rows.filter(train))
    return model.transform(rows.filter(~F.col(train))).select(key, F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


def union_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def with_model(df: DataFrame, text: str, call, name: str = "output", kind: str = "string", batch: int = 8) -> DataFrame:
    """``df`` with the answer of a model to each text, and the milliseconds per text of its batch.

    ``call`` maps a list of texts to a list of answers; it travels to the workers, so it must be picklable. Null texts are
    not asked.
    """
    import time

    def run(frames):
        for frame in frames:
            answers, took = [None] * len(frame), [None] * len(frame)
            asked = [i for i, t in enumerate(frame[text]) if isinstance(t, str)]
            for k in range(0, len(asked), batch):
                part = asked[k : k + batch]
                began = time.perf_counter()
                out = call([frame[text].iloc[i] for i in part])
                each = (time.perf_counter() - began) * 1000 / len(part)
                for i, a in zip(part, out, strict=True):
                    answers[i], took[i] = a, each
            yield frame.assign(**{name: answers, "ms": took})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` {kind}", "ms double"])
    return df.mapInPandas(run, schema)
