"""Operator 10: toxicity by gradient-boosted trees over dense features.

A lexicon of insulting words and word beginnings is learned from one part of
the labelled sample by smoothed log-odds of document frequencies, beside a
short fixed list of public English insults.  Each whole text then gives a dense
vector: lexicon densities, hits near a second-person word, capitals,
punctuation, and words with letters and digits or symbols mixed (obfuscation).
Spark ML's gradient-boosted trees learn from a second part of the sample and
its isotonic regression calibrates on a third, which neither has seen.  The
documents of each class are dealt to the parts by the rank of a hash, 4:3:1.
Where the rarer class has fewer than ``ENOUGH`` of them, all documents teach both
lexicon and trees (the trees see either half by a lexicon of the other half),
and the trees' own probability is the score.

Bounds: at most ``per_class`` labelled documents of each class are learned
from, and the lexicon keeps at most ``lexicon_size`` entries.  Scoring reads
all texts whole.

Defined results: a null or empty text has an all-zero vector and the score the
model gives to it; where a class has no labelled text (or the table is empty)
every score is 0; null ids, repeated rows and other columns do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emoscope.llm.common import in_fold, kept_by_worker, labelled_sample, saved, text_of

# Public insult words and second-person words of four languages.
INSULTS = frozenset(
    "idiot moron stupid loser trash scum pathetic worthless disgusting clown dumb fool jerk imbecile cretin dimwit halfwit "
    "creep freak coward liar vermin filth garbage ugly hateful "
    "trottel depp dummkopf vollidiot abschaum versager erbärmlich wertlos widerlich dumm "
    "imbécile crétin abruti débile minable ordure raclure pathétique stupide dégoûtant "
    "idiota imbécil estúpido tonto inútil basura escoria patético perdedor asqueroso".split())
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein ihr euch tu te toi ton vous votre "
                          "usted ustedes tus vosotros".split())
BEGINNINGS = (4, 5, 6)
NEAR = 3
#: The part of each rank of a document in its class: lexicon, trees, calibration.
PARTS = [0, 1, 0, 1, 0, 1, 0, 2]
ENOUGH = 40
NAMES = ("lexicon_sum", "lexicon_density", "lexicon_top", "hits", "insults", "insult_density", "near_second_person",
         "capitals", "punctuation", "obfuscation", "shouting", "log_words")
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_]+[\d@$*!_#]+[^\W\d_]+")


def grams_of(text: Column) -> Column:
    """Distinct words and word beginnings ('^' and the first letters) of a text."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}]+"), lambda w: F.length(w) > 2))
    starts = [_beginnings(words, k) for k in BEGINNINGS]
    return F.array_distinct(F.concat(words, *starts))


def _beginnings(words: Column, k: int) -> Column:
    longer = F.filter(words, lambda w: F.length(w) > k)
    return F.transform(longer, lambda w: F.concat(F.lit("^"), F.substring(w, 1, k)))


def learn_lexicon(sample: DataFrame, least: int = 3, log_odds: float = 2.5, lexicon_size: int = 4000
                  ) -> dict[str, float]:
    """Weights of the grams that mark label 1 in ``sample`` (``text, y``)."""
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    grams = (sample.select("y", F.explode(grams_of(F.col("text"))).alias("g")).groupBy("g")
             .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).filter(F.col("pos") >= least))
    odds = (F.log((F.col("pos") + 0.5) / F.lit(n.get(1, 0) + 1.0))
            - F.log((F.col("neg") + 0.5) / F.lit(n.get(0, 0) + 1.0)))
    best = (grams.withColumn("w", odds).filter(F.col("w") >= log_odds)
            .orderBy(F.col("w").desc(), "g").limit(lexicon_size))
    return {r.g: r.w for r in best.collect()}


def features(text: str | None, lexicon: Mapping[str, float]) -> list[float]:
    """The dense vector of one whole text, in the order of ``NAMES``."""
    text = text or ""
    words = _WORD.findall(text.lower())
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    weight = {w: _weight(w, lexicon) for w in set(words)}
    hits = [i for i, w in enumerate(words) if weight[w]]
    insults = sum(w in INSULTS for w in words) if not INSULTS.isdisjoint(weight) else 0
    total = sum(weight[words[i]] for i in hits)
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR):i + NEAR + 1]) for i in hits)
    data = text.encode("utf-8")
    letters = max(1, sum(map(len, words)))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    points = len(data) - len(data.translate(None, b"!?.,;:"))
    shouts = data.count(b"!")
    mixed = len(_MIXED.findall(text)) if any(c in text for c in "0123456789@$*!_#") else 0
    return [total, total / n, max((weight[words[i]] for i in hits), default=0.0), float(len(hits)),
            float(insults), insults / n, float(near), upper / letters, points / n, mixed / n, shouts / n,
            float(np.log1p(n))]


def _weight(word: str, lexicon: Mapping[str, float]) -> float:
    best = lexicon.get(word, 0.0)
    for k in BEGINNINGS:
        if len(word) > k:
            best = max(best, lexicon.get("^" + word[:k], 0.0))
    return max(best, 5.0) if word in INSULTS else best


class Model:
    """Lexicon, trees and calibration; None for the last two where nothing could be
    learned, and for the last where too few rows were left to calibrate on."""

    def __init__(self, lexicon, trees, curve):
        self.lexicon, self.trees, self.curve = lexicon, trees, curve

    def vectors(self, docs: DataFrame) -> DataFrame:
        lexicon = self.lexicon

        @F.pandas_udf("array<double>")
        def dense(texts: pd.Series) -> pd.Series:
            kept_by_worker("toxicity")
            return pd.Series([features(t, lexicon) for t in texts])

        return docs.withColumn("_x", array_to_vector(dense(text_of())))

    def add_score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs`` plus the calibrated score."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(0.0))
        raw = self.trees.transform(self.vectors(docs)).withColumn("_p", vector_to_array("_prob")[1])
        scored = self.curve.transform(raw) if self.curve else raw.withColumn("_score", F.col("_p"))
        return scored.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score")))
                                 ).drop("_x", "_raw", "_prob", "_pred", "_p", "_score")


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", per_class: int = 3000,
        trees: int = 12, depth: int = 3, lexicon_size: int = 4000) -> Model:
    """Learn from label rows where ``train`` holds."""
    sample = saved(labelled_sample(docs, labels, label, train, per_class))
    # by rank, so that each part has documents of each class; at most per_class ids of a class
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id", F.lit("part")), "doc_id"))
    ranks = saved(sample.select("doc_id", "y").distinct().withColumn("rank", rank))
    ids = dict(ranks.groupBy("y").count().collect())
    if len(ids) < 2:  # no text of some class
        return Model({}, None, None)
    least = min(ids.values())
    parts = PARTS if least >= ENOUGH else [0, 1]
    part = F.element_at(F.lit(parts), (F.col("rank") % len(parts) + 1).cast("int"))
    sample = sample.join(F.broadcast(ranks), ["doc_id", "y"]).withColumn("part", part)

    def taught(rows: DataFrame) -> Model:
        return Model(learn_lexicon(rows, lexicon_size=lexicon_size), None, None)

    model = half = taught(sample.filter("part = 0"))
    vectors = half.vectors(sample.filter("part > 0"))
    if least < ENOUGH:
        model, other = taught(sample), taught(sample.filter("part = 1"))
        vectors = vectors.unionByName(other.vectors(sample.filter("part = 0")))
    vectors = saved(vectors.select("part", F.col("y").cast("double").alias("y"), "_x"))
    learner = GBTClassifier(featuresCol="_x", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.3,
                            seed=7, minInstancesPerNode=min(2, least))
    learner.setPredictionCol("_pred").setProbabilityCol("_prob").setRawPredictionCol("_raw")
    if least < ENOUGH:
        model.trees = learner.fit(vectors)
        return model
    model.trees = learner.fit(vectors.filter("part < 2"))
    held = model.trees.transform(vectors.filter("part = 2")).withColumn("_p", vector_to_array("_prob")[1])
    model.curve = IsotonicRegression(featuresCol="_p", labelCol="y", predictionCol="_score").fit(held)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, threshold: float = 0.5,
             **how) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    out = in_fold(F.col("doc_id"), mod, held)
    model = fit(docs, labels, ~out, **how)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return model.add_score(thin).select("doc_id", out.alias("held_out"), "score",
                                        (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more."""
    model = fit(docs, labels, ~in_fold(F.col("doc_id"), 5, 0), **how)
    # the row travels as one struct, so no column of it can clash with the model's
    packed = docs.select(F.struct(*docs.columns).alias("_row"), text_of().alias("text"))
    return model.add_score(packed, "_toxic").filter(F.col("_toxic") < threshold).select("_row.*")
