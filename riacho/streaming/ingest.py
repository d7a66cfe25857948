"""Structured Streaming: incremental ingestion of record files, and windowed counts of events (an extension)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_new(spark: SparkSession, folder: str, schema: str | T.StructType, kind: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """A stream of the files of ``folder``; the checkpoint of its query remembers which are done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(folder)


def append_once(stream: DataFrame, target: str, checkpoint: str, key: str):
    """Appends rows whose key the target lacks, first of each key per batch; a repeated batch adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark, rows = batch.sparkSession, batch.dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = rows.join(spark.read.schema(batch.schema).parquet(target).select(key), key, "left_anti")
        rows.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, ts: str, length: str, late: str | None = "1 day") -> DataFrame:
    """(day, event_type, n, total) per tumbling window; works on streams (with a watermark) and on tables alike."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = rows.groupBy(F.window(ts, length).alias("_w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("_w.start").alias("day"), "event_type", "n", "total")


def endpoint_health(events: DataFrame, key: str, ok: str, value: str, alpha: float = 0.3, fails: int = 3) -> DataFrame:
    """A stream of (key, n, ema, failures, tripped): one small state per endpoint, updated with each batch.

    ``tripped`` counts how often ``fails`` failures came in a row; a success resets the run.
    """
    out = f"{key} {events.schema[key].dataType.simpleString()}, n bigint, ema double, failures bigint, tripped bigint"

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema, run, tripped = state.get if state.exists else (0, None, 0, 0)
        for frame in frames:
            for good, x in zip(frame[ok], frame[value], strict=True):
                n += 1
                if good:
                    run = 0
                    ema = float(x) if ema is None else alpha * float(x) + (1 - alpha) * ema
                else:
                    run += 1
                    tripped += run % fails == 0
        state.update((n, ema, run, tripped))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ema": [ema], "failures": [run], "tripped": [tripped]})

    return events.groupBy(key).applyInPandasWithState(update, out, "n bigint, ema double, run bigint, tripped bigint", "update", GroupStateTimeout.NoTimeout)
