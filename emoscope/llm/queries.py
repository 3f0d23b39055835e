"""Queries of the operators over the given tables, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

import corpus_pipeline
from emoscope.llm import (bpe, fingerprints, hard_negatives, language_id, license_scan, line_dedup, near_dedup, oracles_scan,
                          quality_classifier, quality_rules, source_divergence, source_mixing, token_counts, toxicity)
from emoscope.llm.oracles import SQL
from emoscope.session import ensure_checkpoint_dir
from emoscope.sources.tables import table

def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels")


def op1_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(_docs(spark, sf_dir))


def op2_document_fingerprints(spark, sf_dir):
    return fingerprints.document_fingerprints(_docs(spark, sf_dir))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(_docs(spark, sf_dir), min_docs=10, min_chars=1)


def op4_source_mixing(spark, sf_dir):
    return source_mixing.source_mixing(_docs(spark, sf_dir))


def op5_quality_classifier(spark, sf_dir):
    return quality_classifier.quality_classifier(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op6_token_counts(spark, sf_dir):
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    return token_counts.token_counts(_docs(spark, sf_dir), _labels(spark, sf_dir), bpe.tokenizer_path(), folder)


def op7_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_docs(spark, sf_dir), size=4, percent=80)


def op8_bpe_codec(spark, sf_dir):
    return bpe.bpe_codec(_docs(spark, sf_dir), bpe.tokenizer_path())


def op9_language_id(spark, sf_dir):
    pieces = bpe.Vocabulary(bpe.tokenizer_path()).bytes_of.values()
    return language_id.language_id(_docs(spark, sf_dir), list(pieces))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op11_license_scan(spark, sf_dir):
    return license_scan.license_scan(_docs(spark, sf_dir))


def op12_source_divergence(spark, sf_dir):
    return source_divergence.source_divergence(_docs(spark, sf_dir), min_docs=3, top=200)


def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        hard_negatives.scaled(F.col("embedding"), 256).alias("v"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_document_fingerprints, op3_line_dedup, op4_source_mixing, op5_quality_classifier,
    op6_token_counts, op7_minhash_near_dedup, op8_bpe_codec, op9_language_id, op10_toxicity,
    op11_license_scan, op12_source_divergence, op13_hard_negatives)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES = SQL | oracles_scan.SQL
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
