"""Encoded walks and the views of the three stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import encode, is_edge, is_node, parse_edge_label, parse_node
from ..ids import BAD, IGNORED, MASK_ID, PAD_ID, STAGE_TARGETS, UNK_ID
from ..ranking import draw, rank_by_draw, tasks_for

#: Most nodes whose ids are broadcast to the steps of walks (about 50 bytes each); steps are shuffled to meet more.
BROADCAST_NODES = 1 << 21


def with_context(tokens: DataFrame) -> DataFrame:
    """``tokens`` with the tokens before and behind in the walk; null at its ends. Tasks that sort them are counted by rows."""
    tokens = tokens.repartition(tasks_for(tokens.sparkSession, tokens.count()), "walk_id")
    order = Window.partitionBy("walk_id").orderBy("pos")
    return tokens.withColumn("before", F.lag("token").over(order)).withColumn("behind", F.lead("token").over(order))


def encode_walks(tokens: DataFrame, vocab: DataFrame, lookup: DataFrame) -> DataFrame:
    """(walk_id, pos, token_id, split_id); nodes, and edges that no split holds, have split -1."""
    near = with_context(tokens)
    edge = is_edge(F.col("token"))
    keyed = near.select("walk_id", "pos", "token", *(F.when(edge, x).alias(n) for n, x in (("u", parse_node(F.col("before"))), ("v", parse_node(F.col("behind"))), ("label", parse_edge_label(F.col("token")).cast("int")))))
    joined = encode(keyed.join(lookup, ["u", "v", "label"], "left"), vocab)
    return joined.select("walk_id", "pos", "token_id", F.coalesce("split_id", F.lit(BAD)).alias("split_id"))


def encode_paths(walks: DataFrame, vocab: DataFrame, classes: DataFrame) -> DataFrame:
    """``encode_walks`` of walks whose paths have the split of each edge, clustered by walk.

    A step (an edge and the node it leads to) is one row until its ids are found. Up to ``BROADCAST_NODES`` nodes come to the
    steps, which stay where their walk is; more are joined by a shuffle, and only nodes are. Steps aren't sorted for that
    join, and tasks that sort them are counted by rows.
    """
    none = F.lit(None).cast("int")
    begun = walks.select("walk_id", F.lit(-1).alias("i"), F.col("start").alias("node"), none.alias("label"), none.alias("split_id"))
    steps = walks.select("walk_id", F.posexplode("path").alias("i", "e")).select("walk_id", "i", F.col("e.v").alias("node"), F.col("e.label").cast("int").alias("label"), F.col("e.split_id").cast("int").alias("split_id"))
    nodes = vocab.where(is_node(F.col("token"))).select(parse_node(F.col("token")).alias("node"), F.col("token_id").alias("node_id"))
    edges = classes.select(parse_edge_label(F.col("token")).cast("int").alias("label"), F.col("token_id").alias("edge_id"))
    few = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    if few:
        first = F.array(F.struct(F.col("start").alias("v"), none.alias("label"), none.alias("split_id")))
        path = F.transform("path", lambda e: F.struct(e["v"].alias("v"), e["label"].cast("int").alias("label"), e["split_id"].cast("int").alias("split_id")))
        whole = walks.select("walk_id", F.posexplode(F.concat(first, path)).alias("k", "e"))
        reached = whole.select("walk_id", (F.col("k") - 1).alias("i"), F.col("e.v").alias("node"), F.col("e.label").alias("label"), F.col("e.split_id").alias("split_id"))
    else:
        reached = begun.unionByName(steps)
    met = reached.join(F.broadcast(nodes) if few else nodes.hint("shuffle_hash"), "node", "left").join(F.broadcast(edges), "label", "left").select("walk_id", "i", "node_id", "edge_id", "split_id")
    near = met
    if not few:
        tasks = tasks_for(walks.sparkSession, walks.agg(F.sum(F.size("path") + 1)).first()[0] or 0)
        near = met.repartition(tasks, "walk_id").sortWithinPartitions("walk_id", "i")
    token = lambda pos, token_id, split: F.struct(pos.alias("pos"), F.coalesce(token_id, F.lit(UNK_ID)).cast("bigint").alias("token_id"), F.coalesce(split, F.lit(BAD)).alias("split_id"))
    both = F.array(token(2 * F.col("i") + 1, F.col("edge_id"), F.col("split_id")), token(2 * F.col("i") + 2, F.col("node_id"), none))
    return near.select("walk_id", F.explode(both).alias("t")).select("walk_id", "t.*").where("pos >= 0")


def padded(encoded: DataFrame, length: int | None = None) -> DataFrame:
    """``encoded`` with rows of the pad id up to the longest walk's length, or to ``length``.

    The walks' ends are few bytes, which the engine would merge into few tasks; they are dealt anew before they become many rows.
    """
    ends = encoded.groupBy("walk_id").agg(F.max("pos").alias("last"))
    most = F.lit(length - 1) if length else F.col("most")
    full = ends if length else ends.crossJoin(F.broadcast(encoded.agg(F.max("pos").alias("most"))))
    dealt = full.where(F.col("last") < most).repartition(tasks_for(encoded.sparkSession, 0), "walk_id")
    pads = dealt.select("walk_id", F.explode(F.sequence(F.col("last") + 1, most)).alias("pos"))
    return encoded.unionByName(pads.select("walk_id", "pos", F.lit(PAD_ID).cast("bigint").alias("token_id"), F.lit(BAD).alias("split_id")))


def _seen(target: int) -> dict[str, Column]:
    """x, label and attn of a token by its split_id and class_id.

    Split ids are ordered by visibility, so one comparison with the stage's target decides: targets are masked,
    labelled and attended; later splits are masked and hidden; all else is shown.
    """
    s = F.col("split_id")
    return {
        "x": F.when(s >= target, MASK_ID).otherwise(F.col("token_id")).cast("bigint"),
        "label": F.when(s == target, F.coalesce("class_id", F.lit(IGNORED))).otherwise(IGNORED).cast("bigint"),
        "attn": ((F.col("token_id") != PAD_ID) & (s <= target)).cast("int"),
    }


def stage_view(encoded: DataFrame, classes: DataFrame, stage: str) -> DataFrame:
    """(walk_id, pos, x, label, attn) of one stage."""
    labelled = encoded.join(F.broadcast(classes.select("token_id", "class_id")), "token_id", "left")
    return labelled.select("walk_id", "pos", *(c.alias(n) for n, c in _seen(STAGE_TARGETS[stage]).items()))


def stage_views(encoded: DataFrame, classes: DataFrame) -> DataFrame:
    """All three stages in one table with a stage column; one pass over ``encoded`` makes three rows of each."""
    labelled = encoded.join(F.broadcast(classes.select("token_id", "class_id")), "token_id", "left")
    each = F.array(*(F.struct(*(c.alias(n) for n, c in _seen(target).items()), F.lit(s).alias("stage")) for s, target in STAGE_TARGETS.items()))
    return labelled.select("walk_id", "pos", F.explode(each).alias("e")).select("walk_id", "pos", "e.*")


def packed(view: DataFrame) -> DataFrame:
    """One row for each walk: arrays x, labels and attn in the order of positions."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "x", "label", "attn")))
    grouped = view.groupBy("walk_id").agg(rows.alias("r"))
    return grouped.select("walk_id", F.col("r.x").alias("x"), F.col("r.label").alias("labels"), F.col("r.attn").alias("attn"))


def batches(view: DataFrame, batch_size: int, shuffle_seed: int | None = None) -> DataFrame:
    """``view`` with batch_id: walks in their order, or in drawn order; the last batch may be short."""
    if shuffle_seed is None:
        return view.withColumn("batch_id", F.floor(F.col("walk_id") / batch_size))
    drawn = view.select("walk_id").distinct().withColumn("drawn", draw(shuffle_seed, F.lit("batch"), F.col("walk_id")))
    ranked = rank_by_draw(drawn, "drawn", ["walk_id"])
    return view.join(ranked.select("walk_id", F.floor(F.col("rank") / batch_size).alias("batch_id")), "walk_id")
