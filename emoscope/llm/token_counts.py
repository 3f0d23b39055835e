"""Operator 6: delta-maintained token-count rollups.

``measured`` reads the texts once and writes nothing but counts: a thin ledger
row for each document and tokenizer version, with the count of the text's
distinct lines beside it.  Changes of documents become signed sums of ledger
rows: an insert adds a document and its tokens, a delete takes away what the
ledger has of it, a revision takes the old counts away and adds the new ones.
Neither needs a text again.  ``deltas`` sums them by source, language and
tokenizer version before anything is stored.

``Rollup`` keeps the sums of each batch in a folder of its own that is never
written twice, and a manifest that says which folders count.  A commit writes
its folder, then the next version of the manifest, one small file that appears
whole or not at all.  Until then readers see the version before; if it fails, the
batch has not happened and can be committed again.  A batch that the manifest
knows, live or absorbed by ``compact``, is not committed twice, so a replay
changes nothing.  Of two writers of one version the second fails and may retry.

Defined results: null text has no tokens; a null source or language is a group
of its own; repeated rows count each, and a change of an id is one of all its
rows; null ids are never marked; groups whose documents have all gone stay with
zeros; no batches give no rows; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emoscope.llm.bpe import SharedCodec
from emoscope.llm.common import n_words_of, text_of

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
MANIFEST = "batch string, folder string, absorbed_by string"


def distinct_lines(text: Column) -> Column:
    """The text without the lines that repeat an earlier one; null where none does."""
    lines = F.split(text, "\n")
    once = F.array_distinct(lines)
    return F.when(F.size(once) < F.size(lines), F.array_join(once, "\n"))


def measured(docs: DataFrame, shared: SharedCodec, words: str = "whitespace-1", bpe: str = "byte_bpe_50k") -> DataFrame:
    """The ledger: ``doc_id, source, lang, tokenizer, tokens, revised``, two rows a document, by white space and by
    the BPE codec of operator 8; ``revised`` counts the distinct lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.get()
        for batch in batches:
            n = [len(codec.encode(x.as_py())) for x in batch.column(5)]
            again = [k if x.as_py() is None else len(codec.encode(x.as_py())) for k, x in zip(n, batch.column(6))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n, pa.int64()), pa.array(again, pa.int64())],
                                             names=["doc_id", "source", "lang", "words", "words_again", "tokens", "tokens_again"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    rows = rows.withColumn("again", distinct_lines(F.col("text")))
    rows = rows.select("doc_id", "source", "lang", n_words_of(F.col("text")).alias("words"),
                       n_words_of(F.coalesce("again", "text")).alias("words_again"), "text", "again")
    counts = rows.mapInArrow(run, "doc_id long, source string, lang string, words long, words_again long, tokens long, tokens_again long")
    each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(n).alias("tokens"), F.col(again).alias("revised"))
                     for name, n, again in ((words, "words", "words_again"), (bpe, "tokens", "tokens_again"))])
    return counts.select("doc_id", "source", "lang", F.inline(each))


def deltas(counted: DataFrame, sign: int) -> DataFrame:
    """Signed sums of ledger rows, one row per group."""
    return counted.groupBy(*KEYS).agg((F.count("*") * sign).alias("docs"), (F.sum("tokens") * sign).alias("tokens"))


def revision(old: DataFrame, new: DataFrame) -> DataFrame:
    """The delta of documents whose counts went from ``old`` to ``new``."""
    return deltas(old, -1).unionByName(deltas(new, 1)).groupBy(*KEYS).agg(
        F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals kept in one shared folder: ``batch-*`` folders of sums, and versions of the manifest."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifest(self) -> tuple[int, dict[str, tuple[str | None, str | None]]]:
        """Its latest version (0: none yet) and, for each batch, its folder and the batch that absorbed it."""
        try:
            rows = self.spark.read.schema(f"{MANIFEST}, version int").json(f"{self.folder}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, {}
        last = rows.agg(F.max("version")).first()[0] or 0
        return last, {r.batch: (r.folder, r.absorbed_by) for r in rows.filter(F.col("version") == last).collect()}

    def _publish(self, version: int, known: dict[str, tuple[str | None, str | None]]) -> None:
        rows = self.spark.createDataFrame([(b, f, a) for b, (f, a) in sorted(known.items())], MANIFEST)
        rows.coalesce(1).write.mode("error").json(f"{self.folder}/manifest/version={version}")

    def _store(self, batch: str, delta: DataFrame) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"batch id {batch!r} must be letters, digits, '_', '.' or '-'")
        path = f"{self.folder}/batch-{batch}-{uuid.uuid4().hex}"
        delta.select("source", "lang", "tokenizer", "docs", "tokens").write.parquet(path)
        return path

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Store the batch and let it count; False, and nothing done, if it counts already."""
        version, known = self.manifest()
        if batch in known:
            return False
        self._publish(version + 1, known | {batch: (self._store(batch, delta), None)})
        return True

    def totals(self, batches: list[str] | None = None) -> DataFrame:
        """Sums over all live batches, or over those that the named ones are or have been absorbed by."""
        _, known = self.manifest()
        names = set(known) if batches is None else set(batches)
        while any(known[b][1] for b in names):
            names = {known[b][1] or b for b in names}
        paths = sorted(known[b][0] for b in names)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def compact(self, batches: list[str], into: str) -> str:
        """Fold live batches into one new batch, which then stands for them."""
        version, known = self.manifest()
        if into in known or into in batches:
            raise ValueError("the new batch needs an id of its own")
        if any(known[b][1] for b in batches):
            raise ValueError("an absorbed batch cannot be folded again")
        path = self._store(into, self.totals(batches))
        self._publish(version + 1, known | {b: (known[b][0], into) for b in batches} | {into: (path, None)})
        return into


def token_counts(docs: DataFrame, labels: DataFrame, path: str, folder: str, **how) -> DataFrame:
    """The rollup of a corpus after three batches: all documents come in, those
    labelled toxic go out, and those labelled low quality are revised to their
    distinct lines.  The first two are then folded into one, and all three are
    committed again, which must not count.

    Returns ``source, lang, tokenizer, docs, tokens`` for both tokenizers.
    """
    spark = docs.sparkSession
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).select(
        F.col("doc_id").cast("long").alias("_id"), "toxic", "quality")
    gone = F.coalesce(F.col("toxic") == 1, F.lit(False))
    poor = F.coalesce(F.col("quality") == 0, F.lit(False)) & ~gone

    where = f"{folder.rstrip('/')}/ledger"
    measured(docs, SharedCodec(docs, path, **how)).write.parquet(where)
    ledger = spark.read.parquet(where)
    marked = ledger.join(marks.filter(gone | poor), F.col("doc_id") == F.col("_id"))
    old = marked.filter(poor)
    batches = {"load": deltas(ledger, 1), "takedown": deltas(marked.filter(gone), -1),
               "revise": revision(old, old.withColumn("tokens", F.col("revised")))}
    rollup = Rollup(spark, f"{folder.rstrip('/')}/rollup")
    for name, delta in batches.items():
        rollup.commit(name, delta)
    rollup.compact(["load", "takedown"], "base")
    for name, delta in batches.items():
        rollup.commit(name, delta)
    return rollup.totals()
