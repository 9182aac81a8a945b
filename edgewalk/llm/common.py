"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes (above one row) that a batch function gets at a time.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 24
#: A key is hot if it holds over one HOT_SHARE-th of all rows.
HOT_SHARE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the folder that ``spark.checkpoint.dir`` names.

    Where it names none, a temporary folder stands in if all runs on one machine; a cluster must name one.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all executors share; set up on first use."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables below the shared folder that cut lineage like checkpoints, and go when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that this object has written; others are left alone."""
        for t in tables:
            if found := self.paths.get(id(t)):
                self._delete(found[0])

    def clear(self) -> None:
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def join_spread(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, one row a key, whose column n counts the key's rows (and is dropped).

    Keys that hold over 1 / ``HOT_SHARE`` of all rows (fewer than ``HOT_SHARE`` keys) are joined by broadcast, so that no
    task gets a third of the rows; the others are joined by a shuffle.
    """
    bound = (per_key.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    hot = F.broadcast(per_key.where(F.col("n") > bound).drop("n"))
    rest = per_key.where(F.col("n") <= bound).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a batch function to ``BATCH_ROWS`` rows or ``BATCH_BYTES`` at a time (one row at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = min(BATCH_ROWS, batch.num_rows - at)
                while n > 1 and batch.slice(at, n).nbytes > BATCH_BYTES:
                    n //= 2
                yield fn(batch.slice(at, n))
                at += n

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for rows that no model may learn from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def texts(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text (null: empty) and the columns named in ``more``; other columns can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), *more, F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` training rows (doc_id, text, y), the same ones on every run.

    Rows that are held out are left out. Ids are taken in the order of their hash, so the sample doesn't follow
    storage order. A document that occurs twice counts once.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return texts(docs).join(F.broadcast(ids), "doc_id")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without copying them."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), at


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies: the folder named by TOKENIZER_DIR, else the one of this image."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)
