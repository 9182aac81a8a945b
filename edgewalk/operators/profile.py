"""Profiles of edges, encoded walks, stage views and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ids import IGNORED, MASK_ID, PAD_ID


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(100.0 * part.cast("double"), whole.cast("double"))


def label_histogram(edges: DataFrame) -> DataFrame:
    counts = edges.groupBy("label").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("n_all")))).select("label", "n", percent(F.col("n"), F.col("n_all")).alias("percent"))


def node_stats(edges: DataFrame) -> DataFrame:
    """Distinct, least and greatest node over both ends."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return ends.agg(F.count("*").alias("nodes"), F.min("node").alias("least"), F.max("node").alias("most"))


def stage_summary(views: DataFrame) -> DataFrame:
    """For each stage: positions, range of x, padded, ignored and attended shares in percent."""
    n = F.count("*")
    return views.groupBy("stage").agg(
        n.alias("positions"), F.count_distinct("walk_id").alias("walks"), F.min("x").alias("least_x"), F.max("x").alias("most_x"),
        percent(F.count_if(F.col("x") == PAD_ID), n).alias("padded"), percent(F.count_if(F.col("label") == IGNORED), n).alias("ignored"), percent(F.count_if(F.col("attn") == 1), n).alias("attended"),
    )


def stage_sparsity(views: DataFrame) -> DataFrame:
    """Valid labels, and positions that are attended without a label (nodes and visible edges)."""
    loose = F.count_if((F.col("attn") == 1) & (F.col("label") == IGNORED))
    return views.groupBy("stage").agg(F.count("*").alias("positions"), F.count_if(F.col("label") != IGNORED).alias("valid"), loose.alias("attended_unlabelled"), percent(loose, F.count_if(F.col("attn") == 1)).alias("attended_unlabelled_percent"))


def attended_lengths(views: DataFrame, max_walk_length: int) -> DataFrame:
    """Least, greatest, mean and lower median of attended positions a walk, and walks that reach 2 L + 1."""
    per = views.groupBy("stage", "walk_id").agg(F.sum("attn").alias("n"))
    return per.groupBy("stage").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.expr("percentile_disc(0.5) within group (order by n)").cast("bigint").alias("median"), F.count_if(F.col("n") >= 2 * max_walk_length + 1).alias("full"))


def token_frequency(view: DataFrame) -> DataFrame:
    """x, its count and its share in percent."""
    counts = view.groupBy("x").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("n_all")))).select("x", "n", percent(F.col("n"), F.col("n_all")).alias("percent"))


def token_usage(view: DataFrame) -> DataFrame:
    counts = view.groupBy("x").agg(F.count("*").alias("n"))
    total, content = F.sum("n"), ~F.col("x").isin(0, 1, 2)
    return counts.agg(percent(F.sum(F.when(F.col("x") == PAD_ID, F.col("n")).otherwise(0)), total).alias("pad"), percent(F.sum(F.when(F.col("x") == MASK_ID, F.col("n")).otherwise(0)), total).alias("mask"), F.count_if(content).alias("distinct_content"))


def dense_counts(labels: DataFrame, classes: int, label: str = "label") -> DataFrame:
    """The count of every class from 0 on; classes that don't occur count 0."""
    counts = labels.where(F.col(label) != IGNORED).groupBy(F.col(label).cast("bigint").alias("class_id")).agg(F.count("*").alias("n"))
    scaffold = labels.sparkSession.range(classes).select(F.col("id").alias("class_id"))
    return F.broadcast(scaffold).join(counts, "class_id", "left").select("class_id", F.coalesce("n", F.lit(0)).alias("n"))


def imbalance(counts: DataFrame) -> DataFrame:
    return counts.agg((F.max("n") / F.greatest(F.min("n"), F.lit(1))).alias("ratio")).withColumn("imbalanced", (F.col("ratio") > 2).cast("int"))


def targets_attended(views: DataFrame) -> DataFrame:
    """For each stage: walks with targets, and those whose targets are all attended and masked."""
    target = views.where(F.col("label") != IGNORED)
    per = target.groupBy("stage", "walk_id").agg(F.bool_and(F.col("attn") == 1).alias("seen"), F.bool_and(F.col("x") == MASK_ID).alias("masked"), F.count("*").alias("n"))
    return per.groupBy("stage").agg(F.count("*").alias("walks"), F.sum("n").alias("targets"), F.count_if("seen").alias("all_attended"), F.count_if("masked").alias("all_masked"))


def target_positions(views: DataFrame) -> DataFrame:
    """Positions of targets, MASK and PAD of each walk and stage, as text lists in ascending order."""
    places = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.col("pos")))), lambda p: p.cast("string")), ",")
    return views.groupBy("stage", "walk_id").agg(places(F.col("label") != IGNORED).alias("targets"), places(F.col("x") == MASK_ID).alias("masked"), places(F.col("x") == PAD_ID).alias("padded"))


def batch_skipping(batched: DataFrame) -> DataFrame:
    """Batches without a label are skipped; shares over all, label counts over the others."""
    per = batched.groupBy("stage", "batch_id").agg(F.count_if(F.col("label") != IGNORED).alias("valid"), F.count("*").alias("positions"))
    some = F.when(F.col("valid") > 0, F.col("valid"))
    return per.groupBy("stage").agg(
        F.count("*").alias("batches"), F.count_if(F.col("valid") == 0).alias("skipped"), percent(F.count_if(F.col("valid") == 0), F.count("*")).alias("skipped_percent"),
        percent(F.sum("valid"), F.sum("positions")).alias("label_percent"), F.min(some).alias("least"), F.max(some).alias("most"), F.avg(some).alias("mean"),
    )


def label_density(views: DataFrame) -> DataFrame:
    """Walks with a label at least, and how many labels those have."""
    per = views.groupBy("stage", "walk_id").agg(F.count_if(F.col("label") != IGNORED).alias("n"))
    return per.where("n > 0").groupBy("stage").agg(F.count("*").alias("walks"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def column_summary(rows: DataFrame, column: str) -> DataFrame:
    """Count, range, mean and sample deviation."""
    return rows.agg(F.count(column).alias("n"), F.min(column).alias("least"), F.max(column).alias("most"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))

