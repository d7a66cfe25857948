"""Helpers that keep plans safe at any input size: lineage cuts, size-checked broadcasts, salted lookups."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes a side may have to be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Parts into which every key of a salted lookup is spread.
SALTS = 64


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where all tasks run in the driver (tests).

    On a cluster without the setting this raises: a folder of one machine would not survive it, nor be seen by others.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="riacho-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; the copy lies in the shared checkpoint folder and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    total = F.lit(16)
    for f in df.schema:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            total = total + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 8
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
        else:
            total = total + 8
    return total.cast("long")


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised side has at most so many rows and bytes; reads no more than ``max_rows`` of them."""
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_bytes(df)), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` materialised, and whether it may be broadcast: it then is small in rows and bytes and bears the hint.

    A larger one comes back without the hint; the caller shuffles, and salts if a key can be hot.
    """
    kept = materialize(df)
    small = small_enough(kept, max_rows, max_bytes)
    return (F.broadcast(kept) if small else kept), small


def salted_join(left: DataFrame, right: DataFrame, small: bool, keys: list[str], unique: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join with a side that has each key once; where that side is too large to broadcast, hot keys of ``left`` are salted."""
    if small:
        return left.join(F.broadcast(right), keys, how)
    many = right.withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(*unique), F.lit(salts)).cast("int")).join(many, [*keys, "_salt"], how).drop("_salt")


def salt_of(unique: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(unique), F.lit(salts)).cast("int")


def count_classes(rows: DataFrame, key: list[str], unique: str, salts: int = SALTS) -> DataFrame:
    """(key..., salt, n, first): size and smallest ``unique`` of each class, once per salt that has rows of it.

    Aggregated per (key, salt) first and per key next, so that a class with a third of all rows is never gathered
    in one task, and a later join on (key, salt) spreads that class over ``salts`` tasks.
    """
    part = rows.groupBy(*key, salt_of(F.col(unique), salts).alias("salt")).agg(
        F.count(F.lit(1)).alias("n_part"), F.min(unique).alias("first_part")
    )
    whole = part.groupBy(*key).agg(
        F.sum("n_part").alias("n"), F.min("first_part").alias("first"), F.collect_list("salt").alias("at")
    )  # at: no more than ``salts`` values
    return whole.select(*key, "n", "first", F.explode("at").alias("salt"))


def running(df: DataFrame, order: list[Column], value: Column | None = None, name: str = "position") -> DataFrame:
    """``df`` with a running total of ``value`` (or, without one, the row number from 0) in ``order``.

    Rows are range-partitioned by ``order``; only one subtotal per partition reaches the driver, so no single task sees
    all rows. ``order`` has to be total. The total includes the row itself.
    """
    each = F.lit(1).cast("long") if value is None else value
    parts = materialize(df.repartitionByRange(*order).withColumn("_v", each).withColumn("_p", F.spark_partition_id()))
    subtotals = sorted((r._p, r.s) for r in parts.groupBy("_p").agg(F.sum("_v").alias("s")).collect())
    before, offsets = 0, []
    for p, s in subtotals:
        offsets.append((p, before))
        before += s or 0
    kind = parts.schema["_v"].dataType.simpleString()
    kind = "double" if kind in ("double", "float") else "bigint"
    start = F.broadcast(df.sparkSession.createDataFrame(offsets, f"_p int, _start {kind}"))
    local = F.sum("_v").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.col("_start") + local - (F.lit(1) if value is None else F.lit(0))
    return parts.join(start, "_p").withColumn(name, total).drop("_v", "_p", "_start")
