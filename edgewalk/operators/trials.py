"""Hyper-parameter trials: sampling, pruning, leaderboards, logs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ranking import DRAW_BITS, checkpointed, draw, rank_by_range

# Choices and ranges of the search.
HEADS = (1, 2, 4, 8, 16)
DIMS = (4, 8, 16, 32, 64, 128)
RANGES = {
    "max_walk_length": ("int", 10, 100), "num_walks": ("log_int", 100_000, 5_000_000),
    "lr": ("log_float", 1e-5, 1e-1), "weight_decay": ("log_float", 1e-8, 1e-1), "batch_size": ("choice", 32, 64, 128, 256, 512),
    "gradient_clip_val": ("float", 0.1, 2.0), "early_stopping_patience": ("int", 5, 20),
    "hidden_dim": ("choice", 4, 8, 16, 32, 64, 128, 256), "nlayers": ("int", 1, 6), "dropout": ("float", 0.0, 0.7),
}


def combos(spark: SparkSession) -> DataFrame:
    """(combo, nhead, emb): pairs whose embedding is a multiple of the heads, heads in the outer order."""
    heads = spark.createDataFrame(list(enumerate(HEADS)), "a int, nhead int")
    dims = spark.createDataFrame(list(enumerate(DIMS)), "b int, emb int")
    valid = heads.crossJoin(F.broadcast(dims)).where(F.col("emb") % F.col("nhead") == 0)
    return valid.select((F.row_number().over(Window.orderBy("a", "b")) - 1).cast("bigint").alias("combo"), F.col("nhead").cast("bigint").alias("nhead"), F.col("emb").cast("bigint").alias("emb"))


def decode_combos(trials: DataFrame, column: str = "combo") -> DataFrame:
    """``trials`` with nhead and emb; null outside the table."""
    return trials.join(F.broadcast(combos(trials.sparkSession)).withColumnRenamed("combo", column), column, "left")


def _uniform(seed: int, name: str, trial: Column) -> Column:
    return draw(seed, F.lit(name), trial).cast("double") / float(1 << DRAW_BITS)


def _sampled(seed: int, name: str, kind: str, *bounds) -> Column:
    u = _uniform(seed, name, F.col("trial"))
    if kind == "choice":
        return F.get(F.array(*map(F.lit, bounds)), F.floor(u * len(bounds)).cast("int")).cast("double")
    low, high = map(float, bounds)
    if kind == "float":
        return low + u * (high - low)
    if kind == "int":
        return F.floor(low + u * (high - low + 1)).cast("double")
    log = F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low))))
    return F.floor(log).cast("double") if kind == "log_int" else log


def search_space(spark: SparkSession, trials: int | DataFrame, base_epochs: int = 25, seed: int = 42) -> DataFrame:
    """A row of settings for each trial, of so many or of a table of them (trial); heads and embedding come from the valid pairs, so no trial is void."""
    ranges = RANGES | {"epochs": ("int", min(15, base_epochs // 4), min(100, base_epochs))}
    ids = trials.select("trial") if isinstance(trials, DataFrame) else spark.range(trials).select(F.col("id").alias("trial"))
    table = combos(spark)
    n = len([1 for h in HEADS for d in DIMS if d % h == 0])
    picked = ids.withColumn("combo", F.floor(_uniform(seed, "combo", F.col("trial")) * n)).join(F.broadcast(table), "combo")
    return picked.select("trial", "nhead", "emb", *(_sampled(seed, name, *spec).alias(name) for name, spec in ranges.items()))


def completed(trials: DataFrame) -> DataFrame:
    return trials.where(F.col("state") == "COMPLETE")


def statuses(trials: DataFrame) -> DataFrame:
    """(study, state, trials, with_value): a failed trial has a state of its own, and a value of 0 is a value."""
    return trials.groupBy("study", "state").agg(F.count("*").alias("trials"), F.count("val_auc").alias("with_value"))


def top_trials(trials: DataFrame, n: int = 10) -> DataFrame:
    """The best n by val_auc, then trial, with ranks from 1; trials without a value are left out."""
    best = trials.where("val_auc is not null").orderBy(F.desc("val_auc"), "trial").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("val_auc"), "trial")))


def leaderboard(studies: DataFrame, per_study: int = 10, n: int = 10) -> DataFrame:
    """The best of each study, then of all, ranked anew; a missing value counts as -1."""
    value = studies.withColumn("val_auc", F.coalesce("val_auc", F.lit(-1.0)))
    within = Window.partitionBy("study").orderBy(F.desc("val_auc"), "trial")
    kept = value.withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= per_study).drop("_r")
    best = kept.orderBy(F.desc("val_auc"), "study", "trial").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("val_auc"), "study", "trial")))


def best_trial(trials: DataFrame) -> DataFrame:
    return trials.where("val_auc is not null").agg(F.max_by("trial", F.struct(F.col("val_auc"), -F.col("trial"))).alias("trial"), F.max("val_auc").alias("val_auc"))


def described(trials: DataFrame) -> DataFrame:
    """nhead and emb from direct parameters, then user attributes, then the combo, else 'Unknown'."""
    known = decode_combos(trials.withColumnRenamed("nhead", "_h").withColumnRenamed("emb", "_e"))
    text = lambda *c: F.coalesce(*(F.col(x).cast("string") for x in c), F.lit("Unknown"))
    return known.withColumn("heads", text("_h", "attr_nhead", "nhead")).withColumn("dims", text("_e", "attr_emb", "emb")).drop("_h", "_e")


def pruned(reports: DataFrame, startup: int = 5, warmup: int = 5, bits: int = 15) -> DataFrame:
    """(trial, step, value, prune): below the median that earlier trials reported at the same step.

    The first ``startup`` trials and the first ``warmup`` steps are never pruned; higher values are better. Reports that repeat
    a trial and step are one report of the greatest value. Values that are null or no number are neither pruned nor counted.

    A value is below the median of n earlier ones by how many of them are not above it and, for even n, by its two
    neighbours among them. These are found in blocks of 2 ** ``bits`` reports by trial, in blocks by value, and from the
    counts of a grid of both, so a step with many trials is many tasks and none holds more than a block.
    """
    once = reports.groupBy("trial", "step").agg(F.max(F.col("value").cast("double")).alias("value"))
    number = F.col("value").isNotNull() & ~F.isnan("value")
    known = rank_by_range(once.where(number), ["step", "value", "trial"], "by_value")
    placed = rank_by_range(known, ["step", "trial"], "by_trial")
    rows = checkpointed(placed.withColumn("tb", F.shiftright("by_trial", bits)).withColumn("vb", F.shiftright("by_value", bits)))
    found = "step long, by_trial long, n long, below double, above double"
    own = rows.groupBy("step", "tb").applyInPandas(_among_own_block, found)
    near = rows.groupBy("step", "vb").applyInPandas(_among_earlier_blocks, found)
    per = own.unionByName(near).groupBy("step", "by_trial").agg(F.sum("n").alias("n"), F.max("below").alias("below"), F.min("above").alias("above"))
    first = rows.groupBy("step").agg(F.min("by_trial").alias("first"))
    whole = rows.join(_grid(rows), ["step", "tb", "vb"]).join(F.broadcast(first), "step").join(per, ["step", "by_trial"])
    earlier, n = F.col("by_trial") - F.col("first"), per["n"] + F.col("grid_n")
    middle = 0.5 * F.greatest(per["below"], "grid_below") + 0.5 * F.least(per["above"], "grid_above")
    half = F.floor(earlier / 2)
    low = F.when(earlier % 2 == 1, n <= half).otherwise((n < half) | ((n == half) & (F.col("value") < middle)))
    judged = whole.select("trial", "step", "value", ((earlier > 0) & (F.col("trial") >= startup) & (F.col("step") >= warmup) & low).alias("prune"))
    return judged.withColumn("prune", F.coalesce("prune", F.lit(False))).unionByName(once.where(~number).select("trial", "step", "value", F.lit(False).alias("prune")))


def _grid(rows: DataFrame) -> DataFrame:
    """For each cell of blocks by trial and by value: how many reports earlier blocks have in lower cells, and the nearest values.

    All pairs of a step's blocks are cells, the square of its reports over a block's size.
    """
    tbs, vbs = rows.select("step", "tb").distinct(), rows.select("step", "vb").distinct()
    held = rows.groupBy("step", "tb", "vb").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    cells = tbs.join(vbs, "step").join(held, ["step", "tb", "vb"], "left")
    lower = Window.partitionBy("step", "tb").orderBy("vb").rowsBetween(Window.unboundedPreceding, -1)
    upper = Window.partitionBy("step", "tb").orderBy("vb").rowsBetween(1, Window.unboundedFollowing)
    lines = cells.select("step", "tb", "vb", F.sum("n").over(lower).alias("n"), F.max("most").over(lower).alias("most"), F.min("least").over(upper).alias("least"))
    before = Window.partitionBy("step", "vb").orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("step", "tb", "vb", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("grid_n"), F.max("most").over(before).alias("grid_below"), F.min("least").over(before).alias("grid_above"))


def _among_own_block(block: pd.DataFrame) -> pd.DataFrame:
    """Each report against the earlier ones of its block by trial, in runs of 256."""
    block = block.sort_values("by_trial")
    return _against_earlier(block, np.arange(len(block)) // 256, inside=True)


def _among_earlier_blocks(block: pd.DataFrame) -> pd.DataFrame:
    """Each report of a block by value against those of earlier blocks by trial."""
    block = block.sort_values("by_trial")
    return _against_earlier(block, block["tb"].to_numpy(), inside=False)


def _against_earlier(block: pd.DataFrame, runs: np.ndarray, inside: bool) -> pd.DataFrame:
    """How many reports of earlier runs (``inside``: also of the own one) rank below each, and the values next to it."""
    ranks, values = block["by_value"].to_numpy(), block["value"].to_numpy()
    n, below, above = np.zeros(len(block), np.int64), np.full(len(block), -1), np.full(len(block), -1)
    seen = np.empty(0, np.int64)
    for rows in np.split(np.arange(len(block)), np.flatnonzero(np.diff(runs)) + 1):
        own = ranks[rows]
        at = np.searchsorted(seen, own)
        n[rows] = at
        below[rows] = np.where(at > 0, seen[np.maximum(at - 1, 0)], -1) if len(seen) else -1
        above[rows] = np.where(at < len(seen), seen[np.minimum(at, len(seen) - 1)], -1) if len(seen) else -1
        if inside:
            earlier = np.tri(len(rows), k=-1, dtype=bool)
            lower = earlier & (own[None, :] < own[:, None])
            n[rows] += lower.sum(1)
            below[rows] = np.maximum(below[rows], np.where(lower, own[None, :], -1).max(1))
            most = np.iinfo(np.int64).max
            nearest = np.minimum(np.where(earlier & ~lower, own[None, :], most).min(1), np.where(above[rows] < 0, most, above[rows]))
            above[rows] = np.where(nearest == most, -1, nearest)
        seen = np.sort(np.concatenate([seen, own]), kind="stable")
    order = np.argsort(ranks)
    look = lambda r: pd.Series(values[order[np.searchsorted(ranks, r, sorter=order).clip(0, len(order) - 1)]]).where(r >= 0).astype("Float64")
    return pd.DataFrame({"step": block["step"].to_numpy(), "by_trial": block["by_trial"].to_numpy(), "n": n, "below": look(below), "above": look(above)})


def newest(files: DataFrame, keep: int) -> DataFrame:
    """Files to delete: all but the newest ``keep`` of each folder by modification time."""
    order = Window.partitionBy("folder").orderBy(F.desc("mtime"), "name")
    return files.withColumn("_n", F.row_number().over(order)).where(F.col("_n") > keep).drop("_n")


def last_values(scalars: DataFrame, by: tuple[str, ...] = ("tag",)) -> DataFrame:
    """The value at the last step of each tag."""
    return scalars.groupBy(*by).agg(F.max("step").alias("step"), F.max_by("value", "step").alias("value"))


def parse_trial_log(lines: DataFrame) -> DataFrame:
    """(trial, val_auc, params) of finished trials in a search log with line_no and value.

    A block begins at "Trial n hyperparameters:" and holds the lines up to the next one; its first "Val AUC: x" is the
    trial's value. The finish line holds the parameters as a dictionary, read as JSON; nothing is evaluated. A log is
    one file of text, so its lines are numbered in one window.
    """
    # The phrases of the log.
    number = lambda pattern: F.regexp_extract("value", pattern, 1)
    header, auc = number(r"Trial (\d+) hyperparameters:"), number(r"Val AUC: ([\d.]+)")
    blocks = lines.withColumn("block", F.sum(F.when(header != "", 1).otherwise(0)).over(Window.orderBy("line_no"))).where("block > 0")
    values = blocks.groupBy("block").agg(
        F.max(F.when(header != "", header)).cast("bigint").alias("trial"),
        F.min_by(F.when(auc != "", auc).cast("double"), F.when(auc != "", F.col("line_no"))).alias("val_auc"),
    )
    finish = r"Trial (\d+) finished.*parameters: (\{.*\})"
    done = lines.where(F.col("value").rlike(finish)).select(number(finish).cast("bigint").alias("trial"), F.from_json(F.regexp_replace(F.regexp_extract("value", finish, 2), r"\bNone\b", "null"), "map<string,string>").alias("params"))
    return done.join(values.select("trial", "val_auc"), "trial", "left").select("trial", "val_auc", "params")
