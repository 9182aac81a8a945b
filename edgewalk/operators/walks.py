"""Random walks: uniform start among nodes with out-edges, then uniform out-edges, parallel ones each for itself.

A walk stops at a node without out-edges or after ``max_walk_length`` steps, so it has 2 * steps + 1 tokens at most.
Draws depend on (seed, walk, step) only, so results don't depend on partitions, and lost tasks give the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import edge_token, node_token
from ..ranking import TASK_ROWS, checkpointed, draw, draws_of, rank_by_draw, running_sums, shared_folder, stored, tasks_for

#: Most edges whose adjacency is broadcast, and most bytes of it (mostly 6 an edge); larger graphs are joined step by step.
BROADCAST_EDGES, BROADCAST_BYTES = 1 << 25, 1 << 28
#: Most steps that a task takes (for some of its walks) before it gives their paths back.
STEPS_AT_ONCE = 1 << 20
#: Steps between parts of paths that are written.
STEPS_PER_CUT = 8
#: Numbers of out-edges that one key of a join covers, so that a walker meets so many edges of a hub at most.
BLOCK = 64
#: A block of out-edges that over one FAN-th of all walkers may visit is filed in copies, so that each gets less.
FAN = 1024
#: Nodes that over one WIDE-th of all edges lead to or from are filed edge by edge, apart from the others.
WIDE = 1 << 14
#: Nodes in a batch of rows by node.
NODES_AT_ONCE = 1 << 14
#: Classes of nodes that edges are counted by to find those.
CLASSES = 1 << 18
#: Most edges (on average) of a bucket of ``FiledEdges``.
BUCKET_EDGES = 1 << 22


def adjacency(edges: DataFrame) -> DataFrame:
    """u, and its out-edges as an array of (v, label, and the least split if there is one) in ascending order; copies stay."""
    held = edges if not carried(edges) else edges.withColumn("split_id", F.min("split_id").over(Window.partitionBy("u", "v", "label")))
    return held.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("v", "label", *carried(edges)))).alias("out"))


def carried(rows: DataFrame) -> list[str]:
    """What paths hold besides v and label."""
    return [c for c in ("split_id",) if c in rows.columns]


def no_path(edges: DataFrame) -> Column:
    fields = ", ".join(f"{c}: {edges.schema[c].dataType.simpleString()}" for c in ("v", "label", *carried(edges)))
    return F.array().cast(f"array<struct<{fields}>>")


def out_edges(edges: DataFrame) -> DataFrame:
    """u, v, label, and the numbers [low, high) that the copies of the edge have among the node's deg out-edges.

    With split_id, its least one. Copies are counted first. Numbers come from ranges of (u, v, label), so a hub is numbered by many tasks.
    """
    counted = edges.groupBy("u", "v", "label").agg(F.count("*").alias("m"), *(F.min(c).alias(c) for c in carried(edges)))
    running = running_sums(counted, ["u"], [F.col("v"), F.col("label")], {"m": "high"})
    return running.select("u", "v", "label", *carried(edges), (F.col("high") - F.col("m")).alias("low"), "high", F.col("high_all").alias("deg"))


def degrees(edges: DataFrame) -> DataFrame:
    """Out-degree, with and without copies, of every node with out-edges."""
    counted = edges.groupBy("u", "v", "label").agg(F.count("*").alias("m"))
    return counted.groupBy("u").agg(F.sum("m").alias("deg"), F.count("*").alias("distinct_out"))


def starts(edges: DataFrame, num_walks: int, seed: int, walks_per_node: int = 1) -> DataFrame:
    """(walk_id, node): the drawn number modulo the count of start nodes, which are numbered in drawn order.

    Without a ``num_walks`` (0) there are ``walks_per_node`` for each start node, which are counted first.
    """
    nodes = edges.select("u").distinct().withColumn("drawn", draw(seed, F.lit("start"), F.col("u")))
    numbered = rank_by_draw(nodes, "drawn", ["u"]).select(F.col("u").alias("node"), F.col("rank").alias("pick"))
    count = nodes.agg(F.count("*").alias("n_nodes"))
    walks = edges.sparkSession.range(num_walks or walks_per_node * nodes.count()).select(F.col("id").alias("walk_id")).crossJoin(F.broadcast(count)).where("n_nodes > 0")
    return walks.select("walk_id", (draw(seed, F.col("walk_id"), 0) % F.col("n_nodes")).alias("pick")).join(numbered, "pick").select("walk_id", "node")


def random_walks(edges: DataFrame, num_walks: int = 100, max_walk_length: int = 16, seed: int = 42, broadcast_edges: int = BROADCAST_EDGES, walks_per_node: int = 1) -> DataFrame:
    """(walk_id, start, path): path is an array of (v, label), one for each step.

    Edges with a split_id give paths of (v, label, split_id), with the least split of the triple.
    """
    edges = edges.select("u", "v", "label", *carried(edges))
    begun = starts(edges, num_walks, seed, walks_per_node)
    if edges.limit(broadcast_edges + 1).count() <= broadcast_edges and (kinds := Codes.of(edges)) is not None:
        return _broadcast_walks(begun, edges, kinds, max_walk_length, seed)
    return _joined_walks(begun, edges, max_walk_length, seed)


@dataclass
class Codes:
    """How the columns of edges are held: numbers from 1 on, in the narrowest type, above the least value; 0 is null."""

    kinds: dict[str, str]
    least: dict[str, int]
    width: dict[str, str]

    @classmethod
    def of(cls, edges: DataFrame) -> Codes | None:
        """The codes of some edges; None if all would take over ``BROADCAST_BYTES``."""
        names = edges.columns
        found = edges.agg(F.count("*").alias("n"), F.approx_count_distinct("u").alias("nodes"), *(f(c).cast("bigint").alias(f"{c}_{f.__name__}") for c in names for f in (F.min, F.max))).first()
        least = {c: found[f"{c}_min"] or 0 for c in names}
        span = {c: (found[f"{c}_max"] or 0) - least[c] + 1 for c in names}
        if max(span.values()) >= 1 << 63:
            return None
        width = {c: np.min_scalar_type(x).str for c, x in span.items()}
        size = found["n"] * sum(np.dtype(width[c]).itemsize for c in names[1:]) + found["nodes"] * 16
        return cls({c: edges.schema[c].dataType.simpleString() for c in names}, least, width) if size <= BROADCAST_BYTES else None

    def coded(self, name: str, column: pa.Array) -> np.ndarray:
        value, null = column.cast(pa.int64()).fill_null(self.least[name]).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
        return np.where(null, 0, value - self.least[name] + 1).astype(self.width[name])

    def values(self, name: str, codes: np.ndarray) -> pa.Array:
        kind = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[self.kinds[name]]
        return pa.array(codes.astype("int64") - 1 + self.least[name], mask=codes == 0).cast(kind)


def _coded_edges(codes: Codes, names: list[str]):
    """A range of edges -> one row of each column's codes in order, behind its nodes and their numbers of out-edges.

    Copies of a triple get its least split that isn't null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        columns = {c: np.concatenate([codes.coded(c, b[c]) for b in held]) for c in names}
        # A null split comes last, the other nulls first.
        keys = [x - np.array(1, x.dtype) if c == "split_id" else x for c, x in columns.items()]
        order = np.lexsort(keys[::-1])
        columns = {c: x[order] for c, x in columns.items()}
        fresh = lambda *some: np.flatnonzero(np.r_[True, np.any([columns[c][1:] != columns[c][:-1] for c in some], axis=0)])
        if len(names) > 3:
            first = fresh(*names[:3])
            columns[names[3]] = np.repeat(columns[names[3]][first], np.diff(np.append(first, len(order))))
        first = fresh("u")
        nodes = columns.pop("u")[first].astype("int64") - 1 + codes.least["u"]
        parts = [nodes, np.diff(np.append(first, len(order))), *columns.values()]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["u", "deg", *names[1:]])

    return run


def coded_adjacency(edges: DataFrame, codes: Codes) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Nodes with out-edges in order, where the edges of each begin (and the last ones end), and the codes of all edges.

    Edges are sorted in ranges of (u, v, label), so a hub is sorted by many tasks; the driver only puts the ranges' codes together.
    """
    names, spark = edges.columns, edges.sparkSession
    ranged = edges.where("u is not null").repartitionByRange(tasks_for(spark, edges.count()), "u", "v", "label")
    found = ranged.mapInArrow(_coded_edges(codes, names), ", ".join(f"{c} binary" for c in ("u", "deg", *names[1:]))).toArrow()
    whole = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in found[c] if x.is_valid)])
    nodes, deg = whole("u", "int64"), whole("deg", "int64")
    # A node on the border of two ranges is there twice.
    first = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]]) if len(nodes) else np.zeros(0, int)
    begin = np.r_[0, np.cumsum(deg)]
    return nodes[first], begin[np.append(first, len(nodes))], {c: whole(c, codes.width[c]) for c in names[1:]}


def _broadcast_walks(begun: DataFrame, edges: DataFrame, codes: Codes, length: int, seed: int) -> DataFrame:
    """Each task takes its walks' steps, all of them, along the broadcast codes of the adjacency."""
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(coded_adjacency(edges, codes))
    begun = stored(begun.select("walk_id", F.col("node").alias("start")))
    fields = no_path(edges).alias("path")
    schema = f"{begun.schema.simpleString()[7:-1]}, path {begun.select(fields).schema['path'].dataType.simpleString()}"

    def run(batches):
        nodes, begin, held = shared.value
        for batch in batches:
            at_once = max(1, STEPS_AT_ONCE // max(length, 1))
            for some in (batch.slice(k, at_once) for k in range(0, batch.num_rows, at_once)):
                taken = steps_taken(some["walk_id"].to_numpy(), some["start"], nodes, begin, lambda e: codes.values("v", held["v"][e]), length, seed)
                edge = taken[taken >= 0]
                structs = pa.StructArray.from_arrays([codes.values(c, x[edge]) for c, x in held.items()], names=list(held))
                ends = np.r_[0, np.cumsum((taken >= 0).sum(1))]
                yield pa.RecordBatch.from_arrays([some["walk_id"], some["start"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)], names=["walk_id", "start", "path"])

    tasks = tasks_for(spark, begun.count() * length)
    return begun.repartition(tasks, "walk_id").mapInArrow(run, schema)


def steps_taken(walks: np.ndarray, start: pa.Array, nodes: np.ndarray, begin: np.ndarray, ahead, length: int, seed: int) -> np.ndarray:
    """[walks, steps] places of the edges that walks take, -1 once they have ended; ``ahead`` has the nodes that edges lead to."""
    out = np.full((len(walks), length), -1, np.int64)
    alive, node = np.arange(len(walks)), start
    for step in range(1, length + 1):
        known, node = node.is_valid().to_numpy(zero_copy_only=False), node.fill_null(0).to_numpy(zero_copy_only=False)
        place = np.searchsorted(nodes, node)
        some = known & (place < len(nodes))
        some[some] = nodes[place[some]] == node[some]
        alive, place = alive[some], place[some]
        if not len(alive):
            break
        out[alive, step - 1] = edge = begin[place] + draws_of(seed, walks[alive], step) % (begin[place + 1] - begin[place])
        node = ahead(edge)
    return out


def _block(k: Column) -> Column:
    return F.floor(k / BLOCK)


def node_table(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, deg (its out-edges) and fan of every node with out-edges.

    A node is visited about as often as edges lead to it. ``fan`` is the number of copies that its blocks of out-edges
    need, so that each copy is visited by one ``FAN``-th of the walkers at most; all copies together are ``FAN`` blocks.
    Both counts come from one aggregation: rows are short, so few tasks get many nodes, and each further table of nodes
    (of a second count, or for a join of both) would take as much memory again.
    """
    end = lambda node, deg, led: F.struct(F.col(node).alias("node"), F.lit(deg).alias("deg"), F.lit(led).alias("led"))
    ends = edges.select(F.explode(F.array(end("u", 1, 0), end("v", 0, 1))).alias("e")).select("e.*").where("node is not null")
    counts = ends.groupBy("node").agg(F.sum("deg").alias("deg"), F.sum("led").alias("led")).where("deg > 0")
    total = edges.agg(F.count("*").alias("n_edges"))
    share = F.col("led") * F.lit(float(FAN)) / F.col("n_edges") / F.ceil(F.col("deg") / block)
    return counts.crossJoin(F.broadcast(total)).select("node", "deg", F.greatest(F.ceil(share), F.lit(1)).cast("int").alias("fan"))


class FiledEdges:
    """Out-edges as a table that is bucketed by (u, block, copy), the key of a step, below the shared folder.

    A row has the block's out-edges as arrays in the order of their numbers, and with each the degree and fan of the node
    it leads to, so that a step is one join, reads one row for each block, and moves walkers only.
    """

    key = ("u", "block", "copy")

    def __init__(self, edges: DataFrame, nodes: DataFrame):
        self.spark = edges.sparkSession
        self.name, buckets = f"edges_{uuid.uuid4().hex}", max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), edges.count() // BUCKET_EDGES)
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        ahead = nodes.select(F.col("node").alias("v"), F.col("deg").alias("deg_v"), F.col("fan").alias("fan_v"))
        fans = nodes.select(F.col("node").alias("u"), "fan")
        made = self.made(out_edges(edges).drop("deg").join(ahead, "v", "left").join(fans, "u"), ["v", "label", "deg_v", "fan_v", *carried(edges)])
        rows = made.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).drop("fan")
        rows.repartition(buckets, *self.key).sortWithinPartitions(*self.key).write.bucketBy(buckets, *self.key).sortBy(*self.key).option("path", self.path).saveAsTable(self.name)

    def made(self, edges: DataFrame, fields: list[str]) -> DataFrame:
        """A row for each block, with its fan."""
        return (
            edges.withColumn("block", F.explode(F.sequence(_block(F.col("low")), _block(F.col("high") - 1))))
            .withColumn("k", F.explode(F.sequence(F.greatest("low", F.col("block") * BLOCK), F.least("high", (F.col("block") + 1) * BLOCK) - 1)))
            .groupBy("u", "block", "fan").agg(F.sort_array(F.collect_list(F.struct("k", *fields))).alias("r"))
            .select("u", "block", "fan", *(F.col(f"r.{c}").alias(c) for c in fields))
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


class EdgeRows(FiledEdges):
    """Out-edges as plain rows, a row for each number k and copy, bucketed by (u, k, copy); fans are those of blocks of one.

    Rows are shuffled three times: to be numbered, to meet the node they lead to, and to their bucket. Tasks are counted
    by rows, and none sorts or gathers more than it numbers.
    """

    key = ("u", "k", "copy")

    def __init__(self, edges: DataFrame, nodes: DataFrame):
        self.spark = edges.sparkSession
        rows = edges.count()
        self.name, buckets = f"edges_{uuid.uuid4().hex}", tasks_for(self.spark, rows)
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        ahead = nodes.select(F.col("node").alias("v"), F.col("deg").alias("deg_v"), F.col("fan").alias("fan_v"))
        fans = F.broadcast(nodes.where("fan > 1").select(F.col("node").alias("u"), "fan"))  # at most FAN nodes
        made = numbered_edges(edges, nodes, buckets).join(ahead.hint("shuffle_hash"), "v", "left").join(fans, "u", "left")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1))
        filed = made.select("u", "k", copies.alias("copy"), "v", "label", "deg_v", "fan_v", *carried(edges))
        filed.repartition(buckets, *self.key).write.bucketBy(buckets, *self.key).option("path", self.path).saveAsTable(self.name)


def numbered_edges(edges: DataFrame, nodes: DataFrame, tasks: int, hub: int = TASK_ROWS) -> DataFrame:
    """u, v, label, and the edge's number k among those of u; with split_id, the least one of its triple.

    Out-edges of a node are numbered in one task, which takes one shuffle and one sort; those of nodes with over ``hub``
    (few, so their names are broadcast) are numbered by ranges.
    """
    in_order = [F.col(c) for c in ("v", "label", *carried(edges))]
    hubs = stored(nodes.where(F.col("deg") > hub).select(F.col("node").alias("u")))
    wide = hubs.count() > 0
    plain = edges.join(F.broadcast(hubs), "u", "left_anti") if wide else edges
    plain = plain.where("u is not null").repartition(tasks, "u")
    least = [F.first(c).over(Window.partitionBy("u", "v", "label").orderBy(*in_order)).alias(c) for c in carried(edges)]
    numbers = F.row_number().over(Window.partitionBy("u").orderBy(*in_order)) - 1
    out = plain.select("u", "v", "label", numbers.cast("bigint").alias("k"), *least)
    if not wide:
        return out
    ranged = out_edges(edges.join(F.broadcast(hubs), "u", "left_semi"))
    return out.unionByName(ranged.select("u", "v", "label", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("k"), *carried(edges)))


def step_along(walkers: DataFrame, filed: DataFrame, step: int, seed: int) -> DataFrame:
    """``step_on`` for an ``EdgeRows`` table."""
    k = draw(seed, F.col("walk_id"), step) % F.col("deg")
    asked = walkers.withColumn("at_k", F.coalesce(k, -1 - F.col("walk_id"))).withColumn("at_copy", F.coalesce((F.col("walk_id") % F.col("fan")).cast("int"), F.lit(0)))
    on = (asked.node == filed.u) & (asked.at_k == filed.k) & (asked.at_copy == filed["copy"])
    met = asked.hint("shuffle_hash").join(filed, on, "left")
    taken = F.when(F.col("v").isNull(), F.col("path")).otherwise(F.concat("path", F.array(F.struct("v", "label", *carried(filed)))))
    return met.select("walk_id", F.coalesce("v", "node").alias("node"), F.col("deg_v").alias("deg"), F.col("fan_v").alias("fan"), taken.alias("path"))


class NodeRows(FiledEdges):
    """A row for each node with its out-edges as arrays in order, bucketed by u: edges are shuffled once to be filed.

    A walker needs nothing but its node, as its row tells how many out-edges there are. A task sorts its edges by columns
    (Arrow), some ``TASK_ROWS`` of them; wide nodes (``wide_nodes``), which could make it more, are not held.
    """

    key = ("u",)

    def __init__(self, edges: DataFrame):
        self.spark = edges.sparkSession
        self.name, buckets = f"edges_{uuid.uuid4().hex}", tasks_for(self.spark, edges.count())
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        fields = ["v", "label", *carried(edges)]
        near = edges.where("u is not null").repartition(buckets, "u").select("u", *fields)
        kinds = {c: edges.schema[c].dataType.simpleString() for c in fields}
        rows = near.mapInArrow(_by_node, ", ".join(["u bigint", *(f"{c} array<{k}>" for c, k in kinds.items())]))
        rows.write.bucketBy(buckets, *self.key).option("path", self.path).saveAsTable(self.name)


def _by_node(batches):
    """A task's edges -> a row for each u, whose other columns are lists in ascending order; copies of a triple get its least split."""
    table = pa.Table.from_batches(held) if (held := list(batches)) else None
    if table is None or not table.num_rows:
        return
    names = table.column_names
    table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in names], null_placement="at_start")).combine_chunks()
    columns = [pa.concat_arrays(table.column(c).chunks) for c in names]
    begins = _changes(columns[0])
    first = np.flatnonzero(begins)
    if len(columns) > 3:
        fresh = begins | _changes(columns[1]) | _changes(columns[2])
        columns[3] = columns[3].take(pa.array(np.flatnonzero(fresh)[np.cumsum(fresh) - 1]))
    for at in range(0, len(first), NODES_AT_ONCE):
        starts = np.append(first[at : at + NODES_AT_ONCE], first[at + NODES_AT_ONCE] if at + NODES_AT_ONCE < len(first) else table.num_rows)
        low, n = int(starts[0]), int(starts[-1] - starts[0])
        lists = [pa.ListArray.from_arrays(pa.array((starts - low).astype("int32")), c.slice(low, n)) for c in columns[1:]]
        yield pa.RecordBatch.from_arrays([columns[0].take(pa.array(starts[:-1])), *lists], names=names)


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; a null equals nulls only."""
    value, null = (x.to_numpy(zero_copy_only=False) for x in (column.fill_null(0), column.is_null()))
    return np.r_[True, (value[1:] != value[:-1]) | (null[1:] != null[:-1])]


def wide_nodes(edges: DataFrame, rows: int) -> DataFrame:
    """``node_table`` of the nodes that over one ``WIDE``-th of all edges (and over ``BLOCK``) lead to or from, with deg 0 for sinks.

    Ends are counted by classes of a hash first, and by node only in classes that reach as many, so few nodes are held at once.
    """
    least = max(BLOCK, rows // WIDE)
    ends = edges.select(F.posexplode(F.array("u", "v")).alias("side", "node")).where("node is not null").withColumn("class", F.pmod(F.xxhash64("node"), F.lit(CLASSES)))
    full = ends.groupBy("side", "class").agg(F.count("*").alias("n")).where(F.col("n") > least).select("class").distinct()
    found = ends.join(F.broadcast(stored(full)), "class", "left_semi").groupBy("node").agg(F.count_if(F.col("side") == 0).alias("deg"), F.count_if(F.col("side") == 1).alias("led"))
    share = F.col("led") * F.lit(float(FAN)) / F.lit(rows) / F.greatest("deg", F.lit(1))
    return found.where((F.col("deg") > least) | (F.col("led") > least)).select("node", "deg", F.greatest(F.ceil(share), F.lit(1)).cast("int").alias("fan"))


def step_by_node(walkers: DataFrame, filed: DataFrame, step: int, seed: int, wide: DataFrame | None = None, wide_edges: DataFrame | None = None) -> DataFrame:
    """``walkers`` (walk_id, node, path) after a step along a ``NodeRows`` table; the node is null once a walk has ended.

    Walkers at wide nodes step along an ``EdgeRows`` table of those. They and ended ones are dealt by their own id here,
    so that many at one place are not sent to one task.
    """
    asked = walkers.withColumn("deg", F.lit(None).cast("bigint")) if wide is None else walkers.join(F.broadcast(wide), "node", "left")
    asked = asked.withColumn("plain", F.col("node").isNotNull() & F.col("deg").isNull())
    asked = asked.withColumn("at", F.when(F.col("plain"), F.col("node")).otherwise(F.col("walk_id")))
    met = asked.hint("shuffle_hash").join(filed, (asked["at"] == filed["u"]) & asked["plain"], "left")
    k = (draw(seed, F.col("walk_id"), step) % F.size("v")).cast("int")
    edge = lambda c: F.when(F.col("u").isNotNull(), F.get(c, k))
    went = met.select("walk_id", "node", "path", *(c for c in ("deg", "fan") if wide is not None), F.struct(*(edge(c).alias(c) for c in ("v", "label", *carried(filed)))).alias("e"))
    taken = F.when(F.col("e.v").isNull(), F.col("path")).otherwise(F.concat("path", F.array("e")))
    if wide is None:
        return went.select("walk_id", F.col("e.v").alias("node"), taken.alias("path"))
    deg = F.when(F.col("deg") > 0, F.col("deg"))
    moved = went.select("walk_id", F.when(deg.isNotNull(), F.col("node")).otherwise(F.col("e.v")).alias("node"), deg.alias("deg"), "fan", taken.alias("path"))
    return step_along(moved, wide_edges, step, seed).select("walk_id", "node", "path")


def step_on(walkers: DataFrame, filed: DataFrame, step: int, seed: int) -> DataFrame:
    """``walkers`` (walk_id, node, deg, fan, path) after a step along the out-edges of a ``FiledEdges`` table.

    A walker at a sink (deg null) stays; its key is its own, so that a sink's walkers are not sent to one task.
    """
    k = draw(seed, F.col("walk_id"), step) % F.col("deg")
    asked = walkers.withColumn("k", k).withColumn("at_block", F.coalesce(_block(F.col("k")), -1 - F.col("walk_id"))).withColumn("at_copy", F.coalesce((F.col("walk_id") % F.col("fan")).cast("int"), F.lit(0)))
    on = (asked.node == filed.u) & (asked.at_block == filed.block) & (asked.at_copy == filed["copy"])
    met = asked.hint("shuffle_hash").join(filed, on, "left")
    at = lambda c: F.get(c, (F.col("k") % BLOCK).cast("int"))
    edge = F.struct(*(at(c).alias(c) for c in ("v", "label", *carried(filed))))
    taken = F.when(F.col("v").isNull(), F.col("path")).otherwise(F.concat("path", F.array(edge)))
    return met.select("walk_id", F.coalesce(at("v"), "node").alias("node"), at("deg_v").alias("deg"), at("fan_v").alias("fan"), taken.alias("path"))


def _joined_walks(begun: DataFrame, edges: DataFrame, length: int, seed: int) -> DataFrame:
    """Walks step by step over a ``NodeRows`` table, and an ``EdgeRows`` table of wide nodes if there are any.

    Each ``STEPS_PER_CUT`` steps are written as one part of the paths.
    """
    none = no_path(edges)
    wide = stored(wide_nodes(edges, edges.count()))
    some = wide.count() > 0
    held_apart = F.broadcast(wide.select(F.col("node").alias("u")))
    tables = [NodeRows(edges.join(held_apart, "u", "left_anti") if some else edges)]
    if some:
        tables.append(EdgeRows(stored(edges.join(held_apart, "u", "left_semi")), wide.where("deg > 0")))
    apart = (wide, tables[1].rows()) if some else ()
    begun = stored(begun)
    cur = begun.select("walk_id", "node", none.alias("path"))
    parts = []
    for first in range(1, length + 1, STEPS_PER_CUT):
        for step in range(first, min(first + STEPS_PER_CUT, length + 1)):
            cur = step_by_node(cur, tables[0].rows(), step, seed, *apart)
        held = stored(cur)
        parts.append(held.select("walk_id", F.lit(first).alias("first"), "path"))
        cur = held.where("node is not null").select("walk_id", "node", none.alias("path"))
        if not cur.take(1):
            break
    for table in tables:
        table.drop()
    begun = begun.select("walk_id", F.col("node").alias("start"))
    if not parts:
        return begun.withColumn("path", none)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    paths = every.groupBy("walk_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "path"))), lambda x: x["path"])).alias("path"))
    return begun.join(paths, "walk_id", "left").select("walk_id", "start", F.coalesce("path", none).alias("path"))


def walk_edges(walks: DataFrame) -> DataFrame:
    """(walk_id, step, u, v, label) of every step; u is the node before it."""
    stepped = walks.select("walk_id", "start", "path", F.posexplode("path").alias("i", "e"))
    u = F.when(F.col("i") == 0, F.col("start")).otherwise(F.get("path", F.col("i") - 1)["v"])
    return stepped.select("walk_id", (F.col("i") + 1).alias("step"), u.alias("u"), F.col("e.v").alias("v"), F.col("e.label").alias("label"))


def walk_tokens(walks: DataFrame) -> DataFrame:
    """(walk_id, pos, token): nodes at even, edges at odd positions."""
    begun = walks.select("walk_id", F.lit(0).alias("pos"), node_token(F.col("start")).alias("token"))
    steps = walks.select("walk_id", F.posexplode("path").alias("i", "e"))
    both = F.array(F.struct((2 * F.col("i") + 1).alias("pos"), edge_token(F.col("e.label")).alias("token")), F.struct((2 * F.col("i") + 2).alias("pos"), node_token(F.col("e.v")).alias("token")))
    return begun.unionByName(steps.select("walk_id", F.explode(both).alias("t")).select("walk_id", "t.*"))


def walk_lengths(tokens: DataFrame) -> DataFrame:
    per = tokens.groupBy("walk_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("walks"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def token_types(tokens: DataFrame) -> DataFrame:
    """Node and edge tokens of all walks, and their ratio (null without edges)."""
    n = tokens.agg(F.count_if(F.col("token").startswith("N_")).alias("nodes"), F.count_if(F.col("token").startswith("E_")).alias("edges"))
    return n.withColumn("ratio", F.try_divide(F.col("nodes").cast("double"), F.col("edges")))
