"""Tokens of walks: building, testing, parsing, and looking up ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ids import EDGE_PREFIX, IGNORED, NODE_PREFIX, UNK_ID, UNK_LABEL, UNK_TOKEN


def node_token(node: Column) -> Column:
    return F.concat(F.lit(NODE_PREFIX), node.cast("string"))


def edge_token(label: Column) -> Column:
    return F.concat(F.lit(EDGE_PREFIX), label.cast("string"))


def is_node(token: Column) -> Column:
    return F.coalesce(token, F.lit("")).startswith(NODE_PREFIX)


def is_edge(token: Column) -> Column:
    return F.coalesce(token, F.lit("")).startswith(EDGE_PREFIX)


def _number(token: Column, prefix: str) -> Column:
    return F.when(F.coalesce(token, F.lit("")).startswith(prefix), F.substring(token, len(prefix) + 1, 64).cast("bigint"))


def parse_node(token: Column) -> Column:
    """The node's number, null for other tokens."""
    return _number(token, NODE_PREFIX)


def parse_edge_label(token: Column) -> Column:
    """The edge's label, null for other tokens; negative labels count."""
    return _number(token, EDGE_PREFIX)


def encode(rows: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """``rows`` with token_id; unknown tokens get the id of <UNK>."""
    return rows.join(vocab.select(F.col("token").alias(token), "token_id"), token, "left").withColumn("token_id", F.coalesce("token_id", F.lit(UNK_ID)))


def decode(rows: DataFrame, vocab: DataFrame, token_id: str = "token_id") -> DataFrame:
    """``rows`` with token; unknown ids get <UNK>."""
    return rows.join(vocab.select(F.col("token_id").alias(token_id), "token"), token_id, "left").withColumn("token", F.coalesce("token", F.lit(UNK_TOKEN)))


def encode_label(rows: DataFrame, classes: DataFrame, by: str = "token") -> DataFrame:
    """``rows`` with class_id, by token or by token_id; others get -1."""
    return rows.join(classes.select(by, "class_id"), by, "left").withColumn("class_id", F.coalesce("class_id", F.lit(IGNORED)))


def decode_label(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the edge token of class_id; others get <UNK_LABEL>."""
    return rows.join(classes.select("class_id", "token"), "class_id", "left").withColumn("token", F.coalesce("token", F.lit(UNK_LABEL)))
