"""Operator 5: compression classifier for text quality.

Two zstandard dictionaries are trained, one on good and one on bad labelled
text.  A whole text is cut into pieces (so that a long text cannot teach itself
to the compressor) and every piece is compressed with either dictionary.  The
evidence is (bad size - good size) / (bad size + good size), summed over the
pieces; a logistic curve, fitted on labelled texts that the dictionaries have
not seen and shifted to the true share of good labels, makes it a score.  Every
third document of a class by the rank of a hash calibrates; a class of fewer than
three documents teaches and calibrates with all of them.

Bounds: at most ``per_class`` labelled documents of each class and
``pieces_each`` evenly spaced pieces of each document are used for learning.
Scoring reads all texts whole.

Defined results: a null or empty text has no evidence and gets the curve's
value at zero evidence; where one class has no labelled text (or the table is
empty) nothing can be learned and every score is the share of good labels, or
0.5 without labels; null ids, repeated rows and other columns do no harm.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emoscope.llm.common import in_fold, labelled_sample

PIECE = 2048
LEVEL = 3


def pieces(text: str) -> list[bytes]:
    data = text.encode("utf-8")
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)]


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
    return tuple(zstd.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
                                     dict_data=zstd.ZstdCompressionDict(d)) for d in (good, bad))


def evidence(text: str | None, good: bytes, bad: bytes) -> float:
    """Normalised difference of compressed sizes, positive where ``good`` fits better."""
    g, b = _compressors(good, bad)
    a = c = 0
    for piece in pieces(text or ""):
        a += len(g.compress(piece))
        c += len(b.compress(piece))
    return (c - a) / (a + c) if a + c else 0.0


def _dictionary(texts: list[str], size: int, pieces_each: int) -> bytes:
    sample = []
    for t in texts:
        own = pieces(t)
        step = max(1, -(-len(own) // pieces_each))
        sample += own[::step]
    joined = b"".join(sample)
    try:
        return zstd.train_dictionary(min(size, max(256, len(joined) // 8)), sample).as_bytes()
    except zstd.ZstdError:  # too little text to train on: the text itself is the dictionary
        return joined[-size:] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a ridge-penalised logistic curve with equal class weights."""
    scale = float(np.abs(x).mean()) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + np.eye(2) * 0.01
        w = w + np.clip(np.linalg.solve(curve, design.T @ (weight * (y - p)) - 0.01 * w), -5, 5)
    return float(w[0] / scale), float(w[1])


class Model:
    """Two dictionaries and a calibration curve; small, so it travels with the tasks."""

    def __init__(self, good: bytes, bad: bytes, slope: float, offset: float):
        self.good, self.bad, self.slope, self.offset = good, bad, slope, offset

    def score(self, text: str | None) -> float:
        x = evidence(text, self.good, self.bad) if self.good else 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * x + self.offset))))


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", per_class: int = 1500,
        pieces_each: int = 4, dict_bytes: int = 65536) -> Model:
    """Learn from label rows where ``train`` holds."""
    shares = dict(labels.filter(train & F.col(label).isNotNull()).groupBy(label).count().collect())
    good, bad = shares.get(1, 0), shares.get(0, 0)
    prior = min(0.99, max(0.01, good / (good + bad))) if good + bad else 0.5
    shift = math.log(prior / (1 - prior))
    if not good or not bad:
        return Model(b"", b"", 0.0, shift)
    # bounded: evenly spaced pieces of at most 2 * per_class documents
    rows = labelled_sample(docs, labels, label, train, per_class)
    rows = _thinned(rows, pieces_each).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    taught, held = {}, []
    for y in (0, 1):
        ids = sorted({r.doc_id for r in rows if r.y == y}, key=_hash_of)
        own = set(ids[::3] if len(ids) > 2 else ids)  # these calibrate, the others make dictionaries
        held += [r for r in rows if r.doc_id in own]
        taught[y] = [r.text for r in rows if r.y == y and (r.doc_id not in own or len(ids) < 3)]
    if not all(taught.values()):
        return Model(b"", b"", 0.0, shift)
    d1, d0 = (_dictionary(taught[y], dict_bytes, pieces_each) for y in (1, 0))
    x = np.array([evidence(r.text, d1, d0) for r in held])
    slope, offset = _logistic(x, np.array([r.y for r in held], float))
    return Model(d1, d0, slope, offset + shift)


def _hash_of(doc_id: int) -> bytes:
    return hashlib.blake2b(str(doc_id).encode(), digest_size=8).digest()


def _thinned(rows: DataFrame, pieces_each: int) -> DataFrame:
    """Sample texts cut to ``pieces_each`` evenly spaced pieces before they go to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                own = pieces(t)
                own = own[::max(1, -(-len(own) // pieces_each))]
                out.append(b"".join(own).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(2)],
                                             names=["doc_id", "text", "y"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y").mapInArrow(
        run, "doc_id long, text string, y int")


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())],
                                             names=["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double")


def quality_classifier(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2,
                       threshold: float = 0.7, **how) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    out = in_fold(F.col("doc_id"), mod, held)
    model = fit(docs, labels, ~out, **how)
    return score_texts(docs, model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
