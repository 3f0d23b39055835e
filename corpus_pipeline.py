"""The corpus pipeline: toxicity, line dedup, near-dedup, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; every stage but the last returns the columns of ``documents``.  ``run``
writes each stage as Parquet in the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from emoscope.llm import bpe, line_dedup, near_dedup, source_mixing, toxicity
from emoscope.session import ensure_checkpoint_dir
from emoscope.sources.tables import table


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line found in at least ten documents only the first occurrence stays."""
    return line_dedup.dedup_texts(docs, min_docs=10, min_chars=1, keep_first=True)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (shingles of five words, 0.8)."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return source_mixing.mixed_rows(docs)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return bpe.tokenised(docs, bpe.tokenizer_path())


STAGES = [("toxicity", stage_toxicity), ("line_dedup", stage_line_dedup), ("near_dedup", stage_near_dedup),
          ("source_mixing", stage_mixing), ("bpe", stage_bpe)]

#: Learned models and random rounding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
