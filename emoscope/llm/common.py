"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emoscope.session import ensure_checkpoint_dir

#: The six ASCII white-space characters that separate words.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RE = "[\\x20\\x09-\\x0D]+"
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def saved(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder, cutting its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(name: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of non-white-space characters, as an array."""
    return F.filter(F.split(text, WHITE_RE), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_RE)).cast("long")


def in_fold(doc_id: Column, mod: int, value: int) -> Column:
    """True where crc32 of the id's text leaves ``value`` modulo ``mod`` (a null
    id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod == value


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column,
                    per_class: int) -> DataFrame:
    """Up to ``per_class`` labelled documents of each class: columns ``doc_id, text, y``.

    ``keep`` says which label rows may be learned from.  The choice is by a hash
    of the id, so it is the same on every run; the bound is the caller's
    documented parameter and the only broadcast (2 * ``per_class`` ids).
    Null ids or labels, and ids with contradictory labels, are left out.
    """
    rows = (labels.filter(keep & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
            .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_y"))
            .filter("y = _y").drop("_y"))
    order = F.xxhash64("doc_id")
    ids = None
    for y in (0, 1):
        part = rows.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id")
    return found.select("doc_id", "text", F.col("y").cast("int").alias("y"))


_KEPT: dict[str, object] = {}


def kept_by_worker(key: str, make=None):
    """What this Python worker keeps under ``key``, made if it is not there yet.

    A worker serves the tasks of many stages, one after the other; it keeps one
    thing at a time, so what an earlier stage needed is freed when a task of
    another begins (without ``make`` nothing is kept in its place)."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _KEPT[key] = make() if make else None
    return _KEPT[key]
