"""The corpus pipeline: STAGES over documents, each one's result written and read again as the next one's input.

Toxic documents go; of each group of near copies one document stays; secrets are replaced in texts; documents are put
in the order of a schedule that holds every source to its weight; texts become piece ids, in rows that tell their place in
that order (source, slot, and place within the slot's block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewalk.llm import mixing, pieces, secrets, simhash, toxicity
from edgewalk.llm.common import checkpointed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    redacted = secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast(kind))
    return redacted.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces, with each row's place in the mixing order: a schedule depends on the rows alone, so it comes out as before."""
    order = mixing.scheduled(docs).select("row.doc_id", "source", "slot", "place", "row.text")
    return pieces.encode_pieces(order, keep=("source", "slot", "place")).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL expresses none of the learned and hashed stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
