"""Training-data pipeline: stages over the table ``documents``, each one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from quantloom.llm import bpe, decontamination, line_dedup, near_duplicates, toxicity
from quantloom.llm.common import materialize, release_scratch, scratch_tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows predicted to be toxic by their own text (null: empty), by a lexicon learned from ``labels``; null and repeated ids change nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that an earlier line repeats; rows with a null id keep all lines, rows of one id are one document."""
    return line_dedup.drop_lines(docs, least_words=1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, one row of each id; rows with a null id stay."""
    return near_duplicates.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose text copies an item of ``benchmark``, with or without an id."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text (null: empty) and the text that they decode to."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Scores, signatures and alignments have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``.

    Each stage's rows are written to the shared folder and read again, so that
    a lost executor costs one stage at most; what a stage wrote besides goes.
    """
    older = scratch_tables()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release_scratch(docs, older=older)
    return STAGES[-1][1](spark, docs, sf_dir)
