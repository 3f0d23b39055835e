"""Operator 3: line deduplication (native).

A line's key is the line without ASCII white space at its ends and with A-Z in
lower case.  ``line_hashes`` gives one row per line with a 128-bit hash of the
key, its document and position; texts stay behind.  ``line_counts``
range-partitions those rows by (hash, salt) and sorts each range by document
and position, so one stream over a range meets the first occurrence first and
counts documents as the document changes; the salt, taken from the document,
cuts a hot line into bounded pieces whose small summaries are then added up.
``drop_bitmaps`` returns, per document, the dropped positions as runs (a
run-length compressed bitmap), and ``apply_bitmaps`` filters the lines.

Two rules are offered: ``keep_first=False`` drops every line whose key is found
in at least ``min_docs`` documents; ``keep_first=True`` keeps the first
occurrence (least document, then position) of such a line.

Defined results: null or empty text is one empty line; keys shorter than
``min_chars`` are never dropped; a document is a distinct (doc_id, text) pair,
so repeated rows count once and are decided alike, and null ids are documents
too; every input row gives one output row; other columns are kept by
``dedup_texts`` and not read otherwise.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emoscope.llm.common import WHITE, saved, text_of

SALTS = 64


def line_keys(text: Column) -> Column:
    """Keys of all lines of a text, as an array."""
    # lower() is the same as lowering A-Z where all characters are ASCII, and much faster
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.transform(F.split(lowered, "\n"), lambda x: F.btrim(x, F.lit(WHITE)))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")
                       ).withColumn("text_hash", F.xxhash64("text"))


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``h, salt, doc_id, text_hash, pos`` for every line with a key long enough."""
    keys = F.transform(line_keys(F.col("text")), lambda k: F.when(
        F.char_length(k) >= min_chars, F.unhex(F.md5(k.cast("binary")))))
    rows = _identified(docs).select("doc_id", "text_hash", F.posexplode(keys).alias("pos", "h"))
    return rows.filter("h is not null").select(
        "h", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int").alias("salt"),
        "doc_id", "text_hash", "pos")


def line_counts(lines: DataFrame) -> DataFrame:
    """``h, n_docs, first`` for every line hash: number of documents and the
    first occurrence as (doc_id, text_hash, pos)."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(n, "h", "salt")
    stream = Window.partitionBy("h", "salt").orderBy("doc_id", "text_hash", "pos")
    at = F.struct("doc_id", "text_hash")
    marked = ranged.select("h", "salt", "doc_id", "text_hash", "pos",
                           F.lag(at).over(stream).alias("before"),
                           F.row_number().over(stream).alias("nth"))
    piece = marked.groupBy("h", "salt").agg(
        F.sum(F.when(F.col("before").eqNullSafe(at), 0).otherwise(1)).alias("n"),
        F.min(F.when(F.col("nth") == 1, F.struct("doc_id", "text_hash", "pos"))).alias("first"))
    return piece.groupBy("h").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first"))


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                 keep_first: bool = False) -> DataFrame:
    """``doc_id, text_hash, runs``: dropped line positions per document, as runs
    (start, length) in order.  Documents that lose nothing have no row."""
    lines = saved(line_hashes(docs, min_chars))
    hot = line_counts(lines).filter(F.col("n_docs") >= min_docs)
    # one row per salt, so that the join below meets a hot line in SALTS pieces
    hot = hot.select("h", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    gone = lines.join(hot, ["h", "salt"])
    if keep_first:
        gone = gone.filter(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("first")))
    ps = gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("ps"))
    return ps.select("doc_id", "text_hash", _runs(F.col("ps")).alias("runs"))


def _runs(ps: Column) -> Column:
    """Sorted positions as runs (start, length)."""
    starts = F.filter(ps, lambda p, i: (i == 0) | (F.get(ps, i - 1) != p - 1))
    ends = F.filter(ps, lambda p, i: (i == F.size(ps) - 1) | (F.get(ps, i + 1) != p + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` plus ``n_lines, n_dropped, kept`` (the text without dropped lines)."""
    left = docs.withColumn("_t", text_of()).withColumn("_h", F.xxhash64("_t"))
    right = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_rh"), "runs")
    both = left.join(right, F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
                     & (F.col("_h") == F.col("_rh")), "left")
    lines = F.split("_t", "\n")
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    left_over = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    # the one-element transform splits the text once for all positions
    stays = F.transform(F.array(lines), lambda xs: F.array_join(
        F.transform(left_over, lambda i: F.get(xs, i)), "\n"))[0]
    dropped = F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["length"]),
                         F.lit(0).cast("long"))
    return (both.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", dropped)
            .withColumn("kept", F.when(F.col("runs").isNull(), F.col("_t"))
                        .otherwise(stays))
            .drop("_t", "_h", "_id", "_rh", "runs"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
               keep_first: bool = False) -> DataFrame:
    """Digest per document: ``doc_id, n_lines, n_dropped, kept_sha256``."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = apply_bitmaps(thin, drop_bitmaps(thin, min_docs, min_chars, keep_first))
    return done.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def dedup_texts(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                keep_first: bool = False) -> DataFrame:
    """``docs`` with ``text`` (and ``n_chars``, if there) rewritten where lines went."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the row travels as one struct, so no column of it can clash with the bitmaps'
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), "doc_id", "text")
    done = apply_bitmaps(packed, drop_bitmaps(thin, min_docs, min_chars, keep_first))
    hit = F.col("n_dropped") > 0
    new = {"text": F.when(hit, F.col("kept")).otherwise(F.col("text")),
           "n_chars": F.when(hit, F.char_length("kept").cast("long")).otherwise(
               F.col("_row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return done.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in docs.columns])
