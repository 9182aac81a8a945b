"""Vocabulary and class map: ids in the order of first encounter, walks before edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import edge_token, is_edge, is_node, node_token
from ..ids import RESERVED
from ..ranking import rank_by_range, stored

#: Bits of a place in the walks that hold the position; the others hold the walk.
POS_BITS = 24
#: Most names that no walk has whose table is broadcast; rows of edges are shuffled to meet more.
BROADCAST_NAMES = 100_000


def vocabulary(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """(token, token_id): reserved tokens, then walk tokens by (walk, pos), then edge tokens by (major, minor, key).

    Only tokens that no walk has are looked for among the places of edges; these tokens are written first, so where there
    are none or few the edges stay where they are (a shuffle of all edges by label would end in as few tasks as there are
    labels). A walk's place is one number, so positions are below 2 ** ``POS_BITS``.
    """
    place = lambda source, a, b, c, d: F.struct(F.lit(source).alias("s"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    of_walks = stored(tokens.groupBy("token").agg(F.min(F.shiftleft("walk_id", POS_BITS) + F.col("pos")).alias("place")))
    first = of_walks.select("token", place(0, F.col("place"), F.lit(0).cast("bigint"), F.lit(""), F.lit(0)).alias("at"))
    ends = F.array(*(F.struct(F.col(c).cast("bigint").alias("name"), F.lit(i).alias("i")) for i, c in enumerate(("u", "v"))))
    nodes = edges.select("major", "minor", "edge_key", F.explode(ends).alias("t")).select("major", "minor", "edge_key", "t.*")
    labels = edges.select("major", "minor", "edge_key", F.col("label").cast("bigint").alias("name"), F.lit(2).alias("i"))
    for rows, token in ((nodes, node_token), (labels, edge_token)):
        unseen = stored(rows.select("name").distinct().withColumn("token", token(F.col("name"))).join(of_walks, "token", "left_anti"))
        n_unseen = unseen.limit(BROADCAST_NAMES + 1).count()
        if not n_unseen:
            continue
        unseen = F.broadcast(unseen) if n_unseen <= BROADCAST_NAMES else unseen
        at = place(1, F.col("major").cast("bigint"), F.col("minor").cast("bigint"), F.col("edge_key"), F.col("i"))
        first = first.unionByName(rows.join(unseen, "name").groupBy("token").agg(F.min(at).alias("at")))
    ranked = rank_by_range(first, ["at", "token"]).select("token", (F.col("rank") + len(RESERVED)).alias("token_id"))
    fixed = F.array(*(F.struct(F.lit(t).alias("token"), F.lit(i).cast("bigint").alias("token_id")) for i, t in enumerate(RESERVED)))
    reserved = tokens.sparkSession.range(0, 1, 1, 1).select(F.explode(fixed).alias("t")).select("t.*")
    return reserved.unionByName(ranked)


def class_map(vocab: DataFrame) -> DataFrame:
    """(token, token_id, class_id) of edge tokens, in the vocabulary's order; there are as many as labels, so few."""
    return vocab.where(is_edge(F.col("token"))).select("token", "token_id", (F.row_number().over(Window.orderBy("token_id")) - 1).cast("bigint").alias("class_id"))


def composition(vocab: DataFrame) -> DataFrame:
    t = F.col("token")
    return vocab.agg(F.count("*").alias("vocab_size"), F.count_if(is_node(t)).alias("nodes"), F.count_if(is_edge(t)).alias("edges"), F.count_if(~is_node(t) & ~is_edge(t)).alias("special"))
