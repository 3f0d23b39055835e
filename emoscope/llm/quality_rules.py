"""Operator 1: quality rules as a short-circuit cascade.

A rule looks at one whole text and says whether to reject it.  The base counts
are output columns, so every text pays for them once, and the base rule comes
first.  ``order_rules`` runs every other rule on a bounded sample of documents
that pass it, measuring its share of rejections and the time that it takes on top
of the base counts, and puts the rules in order of rejections per second.
``apply_rules`` then evaluates them in that order and stops at the first
rejection, so a measure that only a late rule needs is taken of the texts alone
that earlier rules let through.  The order changes cost, never the verdict: a
document is kept if no rule rejects it.

Defined results: a null or empty text has no words and zero counts and fails
the base rule; null ids, repeated rows, ties and extra columns pass through
untouched (one output row for each input row); an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emoscope.llm.common import WHITE

SYMBOLS = b"#*$%&|<>"
_WHITE = WHITE.encode()
_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))


class Text:
    """One whole text; every measure is computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # splits at exactly the six ASCII white-space bytes

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - self.count(_WHITE)

    @cached_property
    def n_symbols(self) -> int:
        return self.count(SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that have a word."""
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by a 3-word window that occurs at least twice."""
        n = len(self.words)
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        v = len(number)
        pair = ids[:-2] * v + ids[1:-1]
        if v >= 1 << 20:  # keep the window code below 2**63
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        _, where, times = np.unique(pair * v + ids[2:], return_inverse=True, return_counts=True)
        again = times[where] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k:n - 2 + k] |= again
        return int(covered.sum())

    def count(self, characters: bytes) -> int:
        """How many of these ASCII characters the text holds."""
        return len(self.data) - len(self.data.translate(None, characters))


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


#: Production rules; thresholds are parameters of the rule set, not of the data.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda t: 10 * t.n_symbols > len(t.words)),
    Rule("capitals", lambda t: t.count(_UPPER) > t.count(_LOWER)),
    Rule("word_length", lambda t: not 2 * len(t.words) <= t.word_chars <= 20 * len(t.words)),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > 3 * len(t.lines)),
    Rule("repeated_words", lambda t: 10 * t.n_repeat_words > 3 * len(t.words)),
)


class Measured(NamedTuple):
    rule: Rule
    seconds: float
    rejected: float
    seen: int

    @property
    def worth(self) -> float:
        """Rejections per second of work (the smoothing keeps unused rules comparable)."""
        return (self.rejected + 0.5) / (self.seconds + 1e-6)


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 400) -> list[Measured]:
    """The rules, best rejection per cost first.

    Every rule runs on its own on the same sample: those of the ``sample_rows``
    documents with the smallest hash of their id that pass the base rule.  Its
    time is that beyond the base counts, which the text has by then.  Only ids
    of the sample and three numbers per rule and task reach the driver.
    """
    chosen = (docs.select("doc_id").filter("doc_id is not null")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    ids = [r[0] for r in chosen.collect()]
    names = [r.name for r in rules]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if not base_fails(Text(t))]
            for k, rule in enumerate(rules):
                known = [with_base(Text(t)) for t in texts]  # its own Texts: no other rule has paid for it
                began = time.thread_time()
                gone = sum(bool(rule.rejects(t)) for t in known)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([time.thread_time() - began]),
                     pa.array([gone], pa.int64()), pa.array([batch.num_rows], pa.int64())],
                    names=["k", "s", "gone", "seen"])

    found = {}
    if ids:
        part = docs.filter(F.col("doc_id").isin(ids)).select("text")
        found = {r.k: r for r in part.mapInArrow(measure, "k int, s double, gone long, seen long")
                 .groupBy("k").agg(F.sum("s").alias("s"), F.sum("gone").alias("gone"),
                                   F.sum("seen").alias("seen")).collect()}
    out = [Measured(rule, found[k].s, found[k].gone, found[k].seen) if k in found
           else Measured(rule, 0.0, 0, 0) for k, rule in enumerate(rules)]
    assert len(set(names)) == len(names), "rule names must differ"
    return sorted(out, key=lambda m: -m.worth)


def base_fails(t: Text) -> bool:
    n = len(t.words)
    return n < 50 or 100 * t.n_repeat_words > 50 * n


def with_base(t: Text) -> Text:
    """The text with its base counts taken, as every text has them."""
    t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words  # noqa: B018 - each is kept once asked for
    return t


def passes(t: Text, rules: Sequence[Rule]) -> bool:
    """False at the first rejection: the rules behind it are not evaluated."""
    return not base_fails(t) and not any(r.rejects(t) for r in rules)


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean")


def apply_rules(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Base counts of every text, the base rule, and the cascade in the given order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                t = with_base(Text(x.as_py()))
                rows.append((len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines,
                             t.n_repeat_words, base_fails(t), passes(t, rules)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]),
                 *(pa.array(c, pa.bool_()) for c in cols[5:])],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES,
                  sample_rows: int = 400) -> DataFrame:
    """Measure, order, apply."""
    return apply_rules(docs, [m.rule for m in order_rules(docs, rules, sample_rows)])
