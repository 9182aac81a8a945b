"""Deterministic randomness and row numbers without a single-task sort."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of a draw.
DRAW_BITS = 60
#: Rows of a task where tasks are counted by rows, so that a task's memory doesn't grow with the input.
TASK_ROWS = 1 << 21


def draw(*parts) -> Column:
    """A uniform number of 60 bits from the md5 of the parts; plain values are literals, columns are columns."""
    columns = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns).cast("binary")), 1, 15), 16, 10).cast("bigint")


def draws_of(seed: int, numbers: np.ndarray, step: int) -> np.ndarray:
    """``draw(seed, number, step)`` for each number, in a task's Python."""
    digests = b"".join([hashlib.md5(f"{seed}|{i}|{step}".encode()).digest() for i in numbers.tolist()])
    return (np.frombuffer(digests, ">u8")[::2] >> np.uint64(64 - DRAW_BITS)).astype(np.int64)


def rank_by_draw(df: DataFrame, drawn: str, ties: list[str], name: str = "rank", bucket_bits: int = 14) -> DataFrame:
    """``df`` with the 0-based row number by (drawn, ties).

    The leading bits of the draw are buckets of about equal size; each is numbered in its own task and shifted by the
    sum of the buckets before it. There are 2 ** ``bucket_bits``: of 10 ** 11 rows each has 6 million.
    """
    bucketed = df.withColumn("_bucket", F.shiftright(drawn, DRAW_BITS - bucket_bits))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(drawn, *ties)
    numbered = bucketed.withColumn("_k", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), "_bucket").withColumn(name, F.col("_offset") + F.col("_k")).drop("_bucket", "_k", "_offset")


def shared_folder(spark: SparkSession) -> str:
    """A folder below ``spark.checkpoint.dir`` for intermediate data; on one machine a temporary folder may stand in."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder by columns, which takes a fraction of a checkpoint's rows."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """The session's shuffle partitions, or more where each would get over ``TASK_ROWS`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def rank_by_range(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the 0-based row number by any order: a range shuffle, numbers within ranges, and the ranges' sizes.

    Columns named _id, _part or _offset are taken by the numbering; rename them before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = checkpointed(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return held.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + inside).drop("_id", "_part", "_offset")


def running_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with inclusive running sums within ``by`` in that order, and the group's totals.

    ``sums`` names each summed column's running sum; its total gets the suffix ``_all``. Rows are dealt by ranges of
    (by, order), so one group may lie in many tasks; each is summed in its ranges behind the sum of the ranges before.
    A column named _part is taken by the ranges; rename it before. Groups with a null in ``by`` are left out.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *map(F.col, by), *order)
    held = checkpointed(ranged.withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    per = held.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_{n}") for c, n in sums.items()))
    ahead = per.select(*by, "_part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums.values()), *(F.sum(f"_{n}").over(whole).alias(f"{n}_all") for n in sums.values()))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = held.select("*", *(F.sum(c).over(inside).alias(n) for c, n in sums.items())).join(ahead, [*by, "_part"])
    return summed.select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums.values()), *(f"{n}_all" for n in sums.values()))
