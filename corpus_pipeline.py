"""From raw documents to token ids: toxicity, near-dedup, substring dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept. All but the last return the columns of docs, extra ones included,
whatever they are called. ``run`` writes what a stage returns as Parquet in the
folder that spark.checkpoint.dir names and reads it again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plotwise.llm import minhash, mixing, sentencepiece, substrings, toxicity
from plotwise.operators.graph import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go. Null and empty texts stay unless most labelled rows are toxic; repeated rows go or stay together."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id, by five-word shingles and a similarity of 0.8. Texts without words and rows without a doc_id stay; all rows of a doc_id that stays do."""
    return minhash.drop_near_duplicates(docs, width=5, threshold_percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document go from the texts; n_chars follows. Documents of which nothing is left by that go; ones without text stay, as do rows without a doc_id."""
    return substrings.drop_repeated_passages(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources by weights 1, 2, 3 in turn, as large as its input; a document is in it once for each epoch. A null source is one of its own; texts without words take no room and go with their place in the queue."""
    return mixing.mix_sources(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of each document of the mix; none for null and empty texts."""
    return sentencepiece.encode(docs.select("doc_id", "source", "text"), with_columns=True).select("doc_id", "source", "ids", "n_ids", "round_trip")


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_near_duplicates), ("substring dedup", drop_repeated_passages), ("mixing", mix), ("SentencePiece", encode)]

#: No SQL for stages that learn and tokenize; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents of sf_dir."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
