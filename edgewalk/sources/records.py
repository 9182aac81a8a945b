"""Readers of saved tables, scalar series, studies and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALAR_SCHEMA = "tag string, step long, value double"


def read_scalars(spark: SparkSession, path: str, tags: tuple[str, ...] | None = None) -> DataFrame:
    """A metrics table (tag, step, value), only the tags asked for; the filter reaches the scan."""
    rows = spark.read.parquet(path)
    return rows if tags is None else rows.where(F.col("tag").isin(*tags))


def read_studies(spark: SparkSession, glob: str) -> DataFrame:
    """The union of trial tables by a glob path; missing columns are null, the file tells the study."""
    rows = spark.read.option("mergeSchema", "true").parquet(glob).drop("trial_key")
    if "study" in rows.columns:
        return rows
    return rows.withColumn("study", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of one text file."""
    lines = spark.read.text(path, wholetext=True)
    each = lines.select(F.posexplode(F.split("value", "\n")).alias("i", "value"))
    return each.select((F.col("i") + 1).cast("bigint").alias("line_no"), "value")
