"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Every node has a parent, at first its least neighbour or itself. A round takes the least grandparent among a node's
    neighbours; the node, and its parent too (so that whole trees are hooked, not leaves), take it if it is less, and
    every node takes its own grandparent if that is less. Trees halve their depth each round while they merge, so in
    practice rounds grow with the logarithm of the longest path (see the tests for paths, also those with a minimum at
    both ends). When no parent changes, every parent is the least node of its component.

    Least values of a node with many neighbours are aggregated before the shuffle; joins on a hub are left to the
    engine's splitting of skewed joins. Loops count; edges with a null end don't. Parents are written to the shared
    folder each round, and those of the round before are deleted; nothing is collected but whether one has changed.
    The table that is returned lies in ``scratch``, whose owner may clear it.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    sound = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    both = scratch.write(sound.unionByName(sound.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parents = scratch.write(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
    while True:
        above = parents.select(F.col("node").alias("up"), F.col("up").alias("grand"))
        known = parents.select("node", "up").join(above, "up")
        near = both.join(known.select(F.col("node").alias("b"), "grand"), "b").groupBy("a").agg(F.min("grand").alias("near"))
        met = known.join(near, known["node"] == near["a"]).select("node", "up", "grand", "near")
        hooks = met.groupBy(F.col("up").alias("root")).agg(F.min("near").alias("hook"))
        low = F.least("up", "grand", "near", "hook")
        after = scratch.write(met.join(hooks, met["node"] == hooks["root"], "left").select("node", low.alias("up"), (low < F.col("up")).alias("moved")))
        scratch.drop(parents)
        parents = after
        if not parents.where("moved").take(1):
            scratch.drop(both)
            return parents.select("node", F.col("up").alias("component"))
