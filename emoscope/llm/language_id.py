"""Operator 9: language identification by segmentation-marginalised unigrams.

The pieces are the byte strings of up to ``PIECE_BYTES`` bytes of a fixed public
vocabulary.  Each language has a probability for every piece.  A word's
probability in a language is the sum over all its segmentations into pieces of
the product of their probabilities, which the forward algorithm computes; a
text's log-likelihood is the sum over its words.  Piece probabilities are
learned by expectation-maximisation (forward-backward) from word counts.

Words are maximal runs of letters in lower case; a word longer than
``BLOCK`` bytes is scored block by block.  The forward pass runs over all new
words of a batch at once in numpy and a bounded table per worker remembers
them; that table affects speed only.

Bounds: word counts come from at most ``sample_docs`` training documents of each
language, chosen by a hash of the id, and at most ``words_each`` most frequent
words of a language; every language with a training document is learned.
Scoring reads all texts whole.

Defined results: null text or text without a letter is ``und`` with score 0;
where nothing can be learned (no row with a language) every text is ``und``;
ties go to the language that sorts first; null ids, repeated rows and other
columns do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emoscope.llm.common import in_fold, text_of

PIECE_BYTES = 8
BLOCK = 40
MAX_REMEMBERED = 200_000
FLOOR = 1e-6
_WORD = re.compile(r"[^\W\d_]+")


class Pieces:
    """Piece numbers by bytes; every single byte is a piece."""

    def __init__(self, pieces: Sequence[bytes]):
        every = sorted({p for p in pieces if 0 < len(p) <= PIECE_BYTES} | {bytes([b]) for b in range(256)})
        self.count = len(every)
        self.keys, self.ids = [], []
        for k in range(1, PIECE_BYTES + 1):
            own = [(int.from_bytes(p, "big"), i) for i, p in enumerate(every) if len(p) == k]
            own.sort()
            self.keys.append(np.array([x for x, _ in own], np.uint64))
            self.ids.append(np.array([i for _, i in own], np.int64))

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Words as bytes, one row each and all of one length n; the result has, at
        [row, start, k], the number of the piece of k + 1 bytes at start, or -1."""
        rows, n = words.shape
        out = np.full((rows, n, PIECE_BYTES), -1, np.int64)
        key = np.zeros((rows, n), np.uint64)
        for k in range(min(n, PIECE_BYTES)):
            width = n - k
            key = (key[:, :width] << np.uint64(8)) | words[:, k:].astype(np.uint64)
            keys = self.keys[k]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out[:, :width, k] = np.where(keys[at] == key, self.ids[k][at], -1)
        return out


def forward(numbers: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """[row, position, language]: summed probability of all segmentations of each
    prefix.  ``probs`` is [piece + 1, language] with a last row of zeros (for -1)."""
    rows, n, _ = numbers.shape
    out = np.zeros((n + 1, rows, probs.shape[1]))
    out[0] = 1.0
    for end in range(1, n + 1):
        for k in range(min(end, PIECE_BYTES)):
            out[end] += out[end - k - 1] * probs[numbers[:, end - k - 1, k]]
    return out


def _grouped(words: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words by length: their places and their bytes as a matrix."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes):
        places = np.flatnonzero(sizes == n)
        yield places, np.frombuffer(b"".join(words[i] for i in places), np.uint8).reshape(-1, int(n))


def blocks(word: bytes) -> list[bytes]:
    return [word[i:i + BLOCK] for i in range(0, len(word), BLOCK)]


class Model:
    def __init__(self, languages: list[str], pieces: Pieces, probs: np.ndarray):
        self.languages, self.pieces = languages, pieces
        self.probs = np.vstack([probs, np.zeros((1, len(languages)))])

    def log_likelihoods(self, words: Sequence[str]) -> np.ndarray:
        """[word, language] for non-empty words."""
        parts, owner = [], []
        for i, w in enumerate(words):
            for b in blocks(w.encode("utf-8")):
                parts.append(b)
                owner.append(i)
        logs = np.zeros((len(parts), len(self.languages)))
        for places, matrix in _grouped(parts):
            for lo in range(0, len(places), 4096):
                some = places[lo:lo + 4096]
                logs[some] = np.log(forward(self.pieces.numbers(matrix[lo:lo + 4096]), self.probs)[-1])
        out = np.zeros((len(words), len(self.languages)))
        np.add.at(out, np.array(owner, np.int64), logs)
        return out


def words_of_text(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def letters_only(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


class Memory:
    """Log-likelihoods of the words met so far by this worker."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages)))

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of_text(t) for t in texts]
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in self.rows))
        if len(self.rows) + len(new) > MAX_REMEMBERED and self.rows:
            self.clear()
            new = list(dict.fromkeys(w for ws in split for w in ws))
        if new:
            start = len(self.rows)
            while start + len(new) > len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            plain = [letters_only(w) for w in new]
            have = [i for i, w in enumerate(plain) if w]
            values = np.full((len(new), len(self.model.languages)), np.nan)  # no letter: no evidence
            if have:
                values[have] = self.model.log_likelihoods([plain[i] for i in have])
            self.table[start:start + len(new)] = values
            self.rows.update(zip(new, range(start, start + len(new))))
        names, scores = [], []
        for ws in split:
            row = self.table[[self.rows[w] for w in ws]] if ws else self.table[:0]
            row = row[~np.isnan(row[:, 0])] if row.size else row
            if not len(row):
                names.append("und")
                scores.append(0.0)
                continue
            total = row.sum(0)
            best = int(total.argmax())
            names.append(self.model.languages[best])
            scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
        return names, scores


def fit(docs: DataFrame, train: Column, pieces: Sequence[bytes], sample_docs: int = 3000,
        words_each: int = 20_000, rounds: int = 3) -> Model | None:
    """Learn from rows where ``train`` holds and ``lang`` is not null."""
    known = docs.filter(train & F.col("lang").isNotNull()).withColumn("lang", F.col("lang").cast("string"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # a bounded row_number: at most sample_docs ids of a language leave a task
    ids = (known.filter("doc_id is not null").select("lang", "doc_id").distinct()
           .withColumn("_n", first).filter(F.col("_n") <= sample_docs).drop("_n"))
    sample = known.join(F.broadcast(ids), ["lang", "doc_id"])
    words = sample.select("lang", F.explode(
        F.split(F.lower(text_of()), "[^\\p{L}]+")).alias("w")).filter("w != ''")
    counts = words.groupBy("lang", "w").count()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("count").desc(), "w"))
    rows = counts.withColumn("_n", nth).filter(F.col("_n") <= words_each).select("lang", "w", "count").collect()
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    table = Pieces(pieces)
    probs = np.zeros((table.count, len(languages)))
    for j, lang in enumerate(languages):
        own = [(b, r["count"]) for r in rows if r.lang == lang for b in blocks(r.w.encode("utf-8"))]
        probs[:, j] = _learn([b for b, _ in own], np.array([c for _, c in own], float), table, rounds)
    return Model(languages, table, probs)


def _learn(words: list[bytes], counts: np.ndarray, table: Pieces, rounds: int) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation."""
    groups = [(counts[places], table.numbers(m)) for places, m in _grouped(words)]
    p = np.full(table.count + 1, 1.0 / table.count)
    p[-1] = 0.0
    for turn in range(rounds + 1):
        seen = np.zeros(table.count + 1)
        for c, numbers in groups:
            if turn == 0:  # start from how often each piece occurs at all
                np.add.at(seen, numbers, np.broadcast_to(c[:, None, None], numbers.shape))
                continue
            n = numbers.shape[1]
            ahead = forward(numbers, p[:, None])[:, :, 0]
            behind = np.zeros((n + 1, len(c)))
            behind[n] = 1.0
            for start in range(n - 1, -1, -1):
                for k in range(min(n - start, PIECE_BYTES)):
                    behind[start] += behind[start + k + 1] * p[numbers[:, start, k]]
            weight = c / ahead[n]
            for start in range(n):
                for k in range(min(n - start, PIECE_BYTES)):
                    ids = numbers[:, start, k]
                    np.add.at(seen, ids, weight * ahead[start] * p[ids] * behind[start + k + 1])
        seen[-1] = 0.0
        p = seen / seen.sum()
        p[:-1] = np.maximum(p[:-1], FLOOR)
        p[:-1] /= p[:-1].sum()
    return p[:-1]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every document."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return thin.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                names, scores = memory.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "lang_pred", "score"])
    return thin.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, pieces: Sequence[bytes], mod: int = 5, held: int = 0, **how) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document."""
    out = in_fold(F.col("doc_id"), mod, held)
    return predict(docs, fit(docs, ~out, pieces, **how)).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score")
