"""A corpus made ready for training in five stages, each over all that the one before kept.

Every stage reads the table that its predecessor wrote in the shared folder, so a lost executor costs the tasks of one
stage at most. Stages return the columns of documents, but for the last: doc_id, ids (array<int>), n_ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.llm import decontam, linededup, neardup, pieces, toxicity
from folioquarry.llm.common import discard, mark, tidy, written
from folioquarry.session import table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("n_ids", F.size("ids"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("decontamination", decontaminate),
    ("sentencepiece", encode_pieces),
]

#: Trained and sketching stages cannot be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; what a stage leaves in the shared folder goes when the next has read it."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        first = mark()
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        tidy(spark, first, docs)
        if held is not None:
            discard(held)
        held = docs
    return docs
