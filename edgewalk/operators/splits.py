"""Four-way random splits of an edge list.

Edges have (edge_key, u, v, label) at least; edge_key is a stable name of the row, which the draw depends on. Copies of
a triple are not removed unless asked, so they may fall in several splits; lookups then resolve to the least split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Dataset
from ..ids import SPLITS, TEST
from ..ranking import DRAW_BITS, draw

TRIPLE = ["u", "v", "label"]
#: Leading bits of a draw that are a bucket; three buckets at most hold a border of two splits, and only those are sorted.
BUCKET_BITS = 14


def dedup_ordered(edges: DataFrame) -> DataFrame:
    """The first row of each triple by (major, minor, edge_key)."""
    order = F.struct("major", "minor", "edge_key")
    return edges.groupBy(*TRIPLE).agg(F.min(order).alias("first")).select("first.edge_key", "first.major", "first.minor", *TRIPLE)


def edge_draw(cfg: Dataset) -> Column:
    """The draw of an edge that splits go by."""
    return draw(cfg.seed, F.col("edge_key"))


def split_edges(edges: DataFrame, cfg: Dataset | None = None, drawn: str | None = None) -> DataFrame:
    """``edges`` with split_id: prefixes of int(ratio * n) rows in drawn order, the rest to test.

    All other columns stay, whatever their names; a split_id that is there already is replaced. Draws are needed three
    times, so where edges are written they may be written too: ``drawn`` names the column that has them (``edge_draw``),
    which is left out.
    """
    cfg = cfg or Dataset()
    if cfg.dedup:
        edges, drawn = dedup_ordered(edges), None
    kept = [F.col(c) for c in edges.columns if c not in ("split_id", drawn)]
    held = edges.select(F.struct(*kept).alias("row"), (F.col(drawn) if drawn else edge_draw(cfg)).alias("drawn"), "edge_key", *TRIPLE)
    held = held.withColumn("bucket", F.shiftright("drawn", DRAW_BITS - BUCKET_BITS))
    size = lambda ratio: F.floor(F.lit(float(ratio)) * F.col("n_all").cast("double"))
    train = size(cfg.train_ratio)
    mask, val = train + size(cfg.mask_ratio), train + size(cfg.mask_ratio) + size(cfg.val_ratio)
    split = lambda rank: F.when(rank < train, 0).when(rank < mask, 1).when(rank < val, 2).otherwise(TEST)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = held.groupBy("bucket").agg(F.count("*").alias("n"))
    sizes = sizes.select("bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(every).alias("n_all"))
    first, last = split(F.col("offset")), split(F.col("offset") + F.col("n") - 1)
    met = held.join(F.broadcast(sizes.withColumn("whole", F.when(first == last, first))), "bucket")
    inside = Window.partitionBy("bucket").orderBy("drawn", "edge_key", *TRIPLE)
    torn = met.where("whole is null").withColumn("rank", F.col("offset") + F.row_number().over(inside) - 1)
    return met.where("whole is not null").select("row.*", F.col("whole").alias("split_id")).unionByName(torn.select("row.*", split(F.col("rank")).alias("split_id")))


def split_lookup(split: DataFrame) -> DataFrame:
    """One split for each triple: train before mask before val before test."""
    return split.groupBy(*TRIPLE).agg(F.min("split_id").alias("split_id"))


def _names(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(enumerate(SPLITS)), "split_id int, split string"))


def split_sizes(split: DataFrame) -> DataFrame:
    """Distinct triples of each split and their share in percent; empty splits count 0."""
    counts = split.select("split_id", *TRIPLE).distinct().groupBy("split_id").agg(F.count("*").alias("n"))
    full = _names(split.sparkSession).join(counts, "split_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.sum("n").alias("n_all"))
    return full.crossJoin(F.broadcast(total)).select("split_id", "split", "n", F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("n_all")), F.lit(0.0)).alias("percent"))


def split_labels(split: DataFrame) -> DataFrame:
    """Label counts of each split's distinct triples."""
    return split.select("split_id", *TRIPLE).distinct().groupBy("split_id", "label").agg(F.count("*").alias("n"))


def split_overlaps(split: DataFrame) -> DataFrame:
    """Distinct triples that two splits share, for all six pairs of splits.

    Each triple's set of splits has four members at most, so pairs are made within a row, not by joining splits.
    """
    spark = split.sparkSession
    sets = split.groupBy(*TRIPLE).agg(F.array_sort(F.collect_set("split_id")).alias("s")).where(F.size("s") > 1)
    firsts = sets.select("s", F.explode("s").alias("a"))
    pairs = firsts.select("a", F.explode(F.filter("s", lambda b: b > F.col("a"))).alias("b"))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    scaffold = spark.createDataFrame([(a, b) for a in range(4) for b in range(a + 1, 4)], "a int, b int")
    return F.broadcast(scaffold).join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def sample_edges(edges: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k edges in drawn order (a top-k, not a full sort)."""
    return edges.withColumn("drawn", draw(seed, F.lit("sample"), F.col("edge_key"))).orderBy("drawn", "edge_key", *TRIPLE).limit(k).drop("drawn")
