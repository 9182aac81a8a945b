"""Writers: edge lists, ratings, leaderboards, metrics and their states, trials and retention."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The partition column of trial tables; the trial itself stays where it is among the columns.
TRIAL_KEY = "trial_key"
#: The partition column of metric states.
BATCH_KEY = "batch_key"
# Settings that a leaderboard's configuration gets where a trial has none.
CONFIG_DEFAULTS = {"dataset.max_walk_length": 50, "dataset.num_walks": 1_000_000, "training.lr": 0.001}


def write_toy_edges(edges: DataFrame, path: str) -> None:
    """A comment line, then ``u v label<TAB>1.0`` lines in their place's order."""
    spark = edges.sparkSession
    head = spark.createDataFrame([(-1, "% toy dataset")], "place long, value string")
    lines = edges.select(F.col("place").cast("long"), F.concat(F.concat_ws(" ", "u", "v", "label"), F.lit("\t1.0")).alias("value"))
    head.unionByName(lines).coalesce(1).sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)


def write_ratings(ratings: DataFrame, path: str) -> None:
    """source, target, binary_rating, timestamp without a header."""
    ratings.select("source", "target", "binary_rating", "timestamp").write.mode("overwrite").option("header", "false").csv(path)


def write_leaderboard(board: DataFrame, path: str) -> None:
    board.coalesce(1).sortWithinPartitions("rank").write.mode("overwrite").option("header", "true").csv(path)


def best_config(board: DataFrame) -> dict:
    """The first trial's settings as sections; what it lacks gets its default."""
    row = board.orderBy("rank").first()
    known = {k: v for k, v in (row.asDict() if row else {}).items() if "." in k and v is not None}
    out: dict[str, dict] = {}
    for name, value in (CONFIG_DEFAULTS | known).items():
        section, _, key = name.partition(".")
        out.setdefault(section, {})[key] = value
    return out


def write_best_config(board: DataFrame, path: str) -> None:
    text = json.dumps(best_config(board), indent=2, sort_keys=True)
    board.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_metrics(rows: DataFrame, path: str, run: str | None = None) -> None:
    """Add (tag, step, value) rows to a metrics table.

    With a ``run`` they are that run's rows: put again, as in a retry, they replace themselves. A table has runs in all
    appends or in none.
    """
    some = rows.select("tag", "step", "value")
    if run is None:
        some.write.mode("append").parquet(path)
    else:
        _replace(some.withColumn("run", F.lit(run)), path, "run")


def append_trials(rows: DataFrame, path: str) -> None:
    """Put trials in a table by study and trial; a trial that is put again replaces itself, others stay."""
    _replace(rows.withColumn(TRIAL_KEY, F.col("trial")), path, "study", TRIAL_KEY)


def put_state(state: DataFrame, path: str, batch: int) -> None:
    """Keep a batch's metric state; a batch that is put again replaces itself, so a retry counts nothing twice."""
    _replace(state.withColumn(BATCH_KEY, F.lit(batch).cast("long")), path, BATCH_KEY)


def reset_state(spark: SparkSession, path: str) -> None:
    """Forget all batches of a state, as at the end of an epoch; nothing happens if there are none."""
    remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system of its path; a missing one is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _replace(rows: DataFrame, path: str, *key: str) -> None:
    """Overwrite exactly the partitions that ``rows`` have; they change when the whole job commits."""
    writer = rows.repartition(*key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*key).parquet(path)


def delete_old(files: DataFrame, keep: int) -> int:
    """Delete all but the newest ``keep`` files of each folder; the number deleted.

    ``files`` has folder, mtime and name. Deletion goes through the file system of the path, so shared stores work.
    """
    from ..operators.trials import newest

    spark = files.sparkSession
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for r in newest(files, keep).select("folder", "name").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{r.folder}/{r.name}")
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
