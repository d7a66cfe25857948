"""Sinks: JSON lines with resume, tables by suffix, manifests, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_missing(df: DataFrame, path: str, key: str) -> None:
    """Appends as JSON the rows whose key is not in ``path`` yet; a run that is repeated writes nothing twice."""
    rows = df
    if exists(df, path):
        done = df.sparkSession.read.schema(df.schema).json(path).select(F.col(key).alias("_done")).distinct()
        rows = df.join(done, F.col(key) == F.col("_done"), "left_anti")
    rows.write.mode("append").json(path)


def write_table(df: DataFrame, path: str) -> str:
    """Writes parquet or csv by suffix; another suffix gets ``.parquet``. Spark's committer makes it all or nothing."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").csv(path, header=True)
        return path
    path = path if path.endswith(".parquet") else path + ".parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines in UTF-8, a folder per value of ``by``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_ordered(df: DataFrame, path: str, *order) -> None:
    """JSON lines whose file order is ``order``: range-partitioned, so that no single task writes all."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """The rows of a small summary as JSON documents."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("type").json(path)
