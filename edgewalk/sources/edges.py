"""Edge lists from text files, ratings, and the graphs that the warehouse tables hold."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ranking import checkpointed, tasks_for

RATING_SCHEMA = "source long, target long, rating int, timestamp double"


def parse_edges(lines: DataFrame, separator: str = r"\s+", comment: str | None = "%", column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(u, v, label) and the columns to ``keep`` of lines with three fields or more; more fields are ignored, other numbers raise as in ``int``."""
    text = F.trim(F.regexp_replace(column, r"^\s+|\s+$", "")) if separator == r"\s+" else F.col(column)
    parts = F.split(text, separator)
    kept = lines if comment is None else lines.where(~F.col(column).startswith(comment))
    cell = lambda i, kind, name: F.trim(parts[i]).cast(kind).alias(name)
    return kept.where(F.size(parts) >= 3).select(*keep, cell(0, "bigint", "u"), cell(1, "bigint", "v"), cell(2, "int", "label"))


def root_of(spark: SparkSession, path: str) -> str:
    """The folder that file paths of rows are told from: the one that is read, or that of a file or of a glob's fixed part."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fixed = re.split(r"[*?\[{]", path)[0]
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = fixed == path and fs.getFileStatus(hadoop(path)).isDirectory()
    folder = path if whole else fixed.rpartition("/")[0] or ("/" if fixed.startswith("/") else ".")
    return fs.makeQualified(hadoop(folder)).toUri().toString()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): lines of all files below ``path``, with the file's path below the root and the byte at which their split begins."""
    where = F.col("_metadata.file_path")
    # Paths of rows may write file:/x or file:///x.
    plain = lambda c: F.regexp_replace(c, r"^([a-z0-9]+):/+", "$1:/")
    root = re.sub(r"^([a-z0-9]+):/+", r"\1:/", root_of(spark, path)).rstrip("/") + "/"
    below = F.when(F.startswith(plain(where), F.lit(root)), F.substr(plain(where), F.lit(len(root) + 1))).otherwise(where)
    return spark.read.option("recursiveFileLookup", "true").text(path).select("value", below.alias("file"), F.col("_metadata.file_block_start").alias("block"))


def keyed(edges: DataFrame) -> DataFrame:
    """``edges`` of files (file, block, u, v, label) with edge_key, major (the file's place by path) and minor (its edge).

    An edge's key is its file's path below the root and its place among the file's edges, however files are split into
    and packed in tasks: edges are numbered within splits, behind the sum of the splits before. The table is written once, so that all readers
    see the same splits.
    """
    held = checkpointed(edges.withColumn("_at", F.monotonically_increasing_id()))
    blocks = held.groupBy("file", "block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("file", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), (F.dense_rank().over(Window.orderBy("file")) - 1).cast("bigint").alias("major"))
    minor = F.col("_offset") + F.col("_at") - F.col("_first")
    return held.join(F.broadcast(places), ["file", "block"]).select(F.concat_ws("-", F.col("file"), minor).alias("edge_key"), "major", minor.alias("minor"), "u", "v", "label")


def load_spaced(spark: SparkSession, path: str) -> DataFrame:
    return keyed(parse_edges(read_lines(spark, path), keep=("file", "block")))


def load_commas(spark: SparkSession, path: str) -> DataFrame:
    return keyed(parse_edges(read_lines(spark, path), ",", None, keep=("file", "block")))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Ratings without a header; a malformed row raises."""
    return spark.read.schema(RATING_SCHEMA).option("mode", "FAILFAST").csv(path)


def flag_label(flag: Column) -> Column:
    return F.when(flag == "R", -1).when(flag == "A", 0).otherwise(1)


def _line_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from the customer's nation to the supplier's for each line; labels tell the return flag."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == customers.c_custkey).join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
    return joined.select(_line_key().alias("edge_key"), F.col("l_orderkey").alias("major"), F.col("l_linenumber").cast("bigint").alias("minor"), F.col("c_nationkey").cast("bigint").alias("u"), F.col("s_nationkey").cast("bigint").alias("v"), flag_label(F.col("l_returnflag")).alias("label"))


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each part of an order to the next one; tasks that sort lines are counted by rows."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lines = lines.repartition(tasks_for(spark, lines.count()), "l_orderkey")
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    paired = lines.withColumn("next", F.lead("l_partkey").over(in_order)).where("next is not null")
    return paired.select(_line_key().alias("edge_key"), F.col("l_orderkey").alias("major"), F.col("l_linenumber").cast("bigint").alias("minor"), F.col("l_partkey").alias("u"), F.col("next").alias("v"), flag_label(F.col("l_returnflag")).alias("label"))


def bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each line's customer to its supplier, whose ids are shifted; suppliers are sinks."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(_line_key().alias("edge_key"), F.col("l_orderkey").alias("major"), F.col("l_linenumber").cast("bigint").alias("minor"), F.col("o_custkey").alias("u"), (F.col("l_suppkey") + 10_000_000).alias("v"), flag_label(F.col("l_returnflag")).alias("label"))


#: name -> (spark, path) -> edges. The dataset names that users' configurations hold.
LOADERS = {
    "chess": load_spaced, "toy": load_spaced,
    "bitcoin-alpha": load_commas, "bitcoin-alpha-binary": load_commas, "bitcoin-otc": load_commas, "bitcoin-otc-binary": load_commas,
    "trade": trade, "copurchase": copurchase, "bipartite": bipartite,
}


def get_loader(name: str):
    if name not in LOADERS:
        raise ValueError(f"unknown dataset {name}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[name]


def register_loader(name: str, loader) -> None:
    LOADERS[name] = loader


def toy_graph(spark: SparkSession, nodes: int = 30, edges: int = 100, seed: int = 42) -> DataFrame:
    """A path over all nodes, then drawn edges without loops and repeats; labels -1, 0 or 1.

    More edges are drawn than wanted, by the number of pairs; the first distinct ones, by their place, are kept.
    """
    from ..ranking import draw

    path = spark.range(1, nodes).select((F.col("id") - 1).alias("place"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    wanted = max(edges - (nodes - 1), 0)
    drawn = spark.range(wanted * 8 + 8 * nodes).select((F.col("id") + nodes).alias("place"), (draw(seed, "u", F.col("id")) % nodes + 1).alias("u"), (draw(seed, "v", F.col("id")) % nodes + 1).alias("v"))
    labelled = path.unionByName(drawn.where("u <> v")).withColumn("label", (draw(seed, "l", F.col("place")) % 3 - 1).cast("int"))
    first = labelled.groupBy("u", "v", "label").agg(F.min("place").alias("place"))
    fresh = first.where(F.col("place") >= nodes).orderBy("place").limit(wanted)
    return labelled.where(F.col("place") < nodes - 1).select("place", "u", "v", "label").unionByName(fresh.select("place", "u", "v", "label"))
