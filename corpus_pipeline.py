"""A corpus pipeline of five stages, each a training-data operator with its production parameters.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that it keeps with
all their columns; the last returns packed pieces. ``run`` applies them one after another and writes each result to the
cluster's shared folder, so that a lost executor costs one stage at most; what a stage has read is deleted.

Null texts count as empty: quality and toxicity score them like texts without words, near-duplicates and secrets leave
them as they are, packing gives them the end token alone. Repeated rows of an id and a text become one in the third
stage; empty tables give empty tables; other columns of any name are kept up to the last stage.

Trained models, minwise trees and multiway differencing can't be stated in SQL, so ``ORACLE_SQL`` is None;
tests/llm holds the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import minhash, packing, quality, secrets, toxicity
from shelfwise.llm.common import drop_written, filter_texts, table, written_table
from shelfwise.llm.queries import BYTE_BPE

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; without labels it rejects none."""
    sent = spark.sparkContext.broadcast(quality.train(docs, table(spark, sf_dir, "labels")))
    return filter_texts(docs, "text", lambda texts: (sent.value.scores(texts) >= 0.5).tolist())


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't flag; without labels it flags none."""
    sent = spark.sparkContext.broadcast(toxicity.train(docs, table(spark, sf_dir, "labels")))
    return filter_texts(docs, "text", lambda texts: (sent.value.scores(texts) < 0.5).tolist())


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash.deduplicated(docs, shingle=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked and n_chars following the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_dedup", one_of_each_group),
    ("secrets", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
