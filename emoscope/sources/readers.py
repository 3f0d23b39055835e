"""Readers for the reference's file formats (SRC01-SRC16).

All readers return lazy DataFrames with explicit schemas (no inference, so
speaker ``0017`` stays a string).  Line order, where a format depends on it,
comes from ``monotonically_increasing_id`` (increasing in file order) turned
into consecutive numbers by the range-sharded row number, not from a
single-task window.  Directory listings use the ``binaryFile`` source with
its ``content`` column never selected, so only metadata is read.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emoscope.functions.names import path_basename, path_parent, swap_suffix
from emoscope.operators.ordered import global_row_number

BOM = "﻿"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """SRC01 prediction CSV with header; every column a string."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def file_inventory(spark: SparkSession, base: str, patterns: Sequence[str] = ("*",),
                   recursive: bool = True) -> DataFrame:
    """SRC14 file listing (path, length, modificationTime, name, parent,
    suffix) for the glob patterns; file contents are never read."""
    out = None
    for pat in patterns:
        r = (spark.read.format("binaryFile").option("pathGlobFilter", pat)
             .option("recursiveFileLookup", str(recursive).lower()).load(base)
             .select(F.regexp_replace("path", "^file:", "").alias("path"), "length", "modificationTime"))
        out = r if out is None else out.unionByName(r)
    out = out.distinct()
    return out.select("path", "length", "modificationTime", path_basename("path").alias("name"),
                      path_parent("path").alias("parent"),
                      F.regexp_extract(path_basename("path"), r"(\.[^.]*)$", 1).alias("suffix"))


def entries(spark: SparkSession, base: str) -> DataFrame:
    """``path`` of every file and folder right under ``base``, one row each.  A
    table is a file or a folder of part files, and both exist; a folder shows by
    the files below it."""
    root = base.rstrip("/")
    files = file_inventory(spark, base).select("path")
    inside = F.substring("path", F.lit(len(re.sub("^file:(//)?(?=/)", "", root)) + 2), F.length("path"))
    return files.select(F.concat(F.lit(root + "/"), F.substring_index(inside, "/", 1)).alias("path")).distinct()


def scan_results(spark: SparkSession, base: str, version: str, max_columns: int = 64) -> DataFrame:
    """SRC02 prediction tables under ``base/results_<...>_<model>/`` whose
    file stem ends in ``_<version>``; adds ``model`` and ``source_file``.

    Tables of different models have different columns.  One scan reads the
    files of all folders by position (up to ``max_columns``); the first row of
    each file is its header, and the others are put under its names.  A later
    row that repeats the header word for word counts as a header too, and a
    name that a file lacks is NULL in its rows.  Files are chosen by their paths
    inside the scan; only the distinct column names reach the driver."""
    def rows_of(width: int) -> tuple[DataFrame, DataFrame]:
        """The chosen files' rows and headers, ``width`` columns wide."""
        columns = [f"_{i}" for i in range(width)]
        raw = (spark.read.schema(", ".join(f"{c} string" for c in columns)).option("recursiveFileLookup", True)
               .option("pathGlobFilter", "*.csv").csv(base))
        path = F.col("_metadata.file_path")
        # a table is a CSV file, or a directory named like one holding part files
        is_dir_table = path_basename(path_parent(path)).endswith(".csv")
        table_path = F.when(is_dir_table, path_parent(path)).otherwise(path)
        folder = path_basename(path_parent(table_path))
        stem = F.regexp_replace(path_basename(table_path), r"\.[^.]*$", "")
        chosen = (F.regexp_extract(folder, r"^([^_]*)", 1) == "results") & (F.substring_index(stem, "_", -1) == version)
        rows = raw.where(chosen).select(F.array(*columns).alias("row"), path.alias("source_file"),
                                        F.substring_index(folder, "_", -1).alias("model"),
                                        F.col("_metadata.file_block_start").alias("start"))
        heads = (rows.where("start = 0").withColumn("place", F.monotonically_increasing_id())
                 .groupBy("source_file").agg(F.min_by("row", "place").alias("head")))
        return rows, heads

    named = rows_of(max_columns)[1].select(F.posexplode("head").alias("place", "name")).where("name is not null")
    places = {r.name: r.last for r in named.groupBy("name").agg(F.max("place").alias("last")).collect()}
    if not places:
        raise FileNotFoundError(f"no result tables for version {version} under {base}")
    names = list(places)
    # a row shorter than the schema costs the parser an error record, so the rows are read no wider than the widest header
    rows, heads = rows_of(max(places.values()) + 1)
    # one short row for each file, so no row has to move to meet its header
    data = rows.join(F.broadcast(heads), "source_file").where(~F.col("row").eqNullSafe(F.col("head")))
    values = [F.get("row", F.array_position("head", F.lit(c)).cast("int") - 1).alias(c) for c in sorted(names)]
    return data.select(*values, "model", "source_file")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """SRC03 wide sentence CSV (header, quoted fields, strings)."""
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", True).csv(path))


def read_pipe_manifest(spark: SparkSession, path: str, header: bool = True, arity: int | None = None,
                       min_fields: int = 2, parent: str | None = None) -> DataFrame:
    """SRC04-SRC06 ``audio|text`` lines: UTF-8 BOM removed, header skipped,
    rows with fewer than ``min_fields`` (or not exactly ``arity``) fields
    dropped, fields stripped, audio path prefixed with ``parent``."""
    lines = (spark.read.text(path).withColumn("__id", F.monotonically_increasing_id())
             .withColumn("__file", F.col("_metadata.file_path")))
    lines = lines.withColumn("value", F.regexp_replace("value", "^" + BOM, ""))
    if header:
        # the first line of every file (one row per file: a small aggregate)
        firsts = lines.groupBy("__file").agg(F.min("__id").alias("__id"))
        lines = lines.join(firsts, ["__file", "__id"], "left_anti")
    parts = F.split("value", r"\|")
    lines = lines.withColumn("__p", parts)
    if arity is not None:
        lines = lines.where(F.size("__p") == arity)
    else:
        lines = lines.where(F.size("__p") >= min_fields)
    audio = F.trim(F.get(F.col("__p"), 0))
    if parent:
        audio = F.concat(F.lit(parent.rstrip("/") + "/"), audio)
    text = F.trim(F.element_at("__p", -1)) if arity == 3 else F.trim(F.get(F.col("__p"), 1))
    return lines.select(audio.alias("audio_path"), text.alias("text"), F.col("__id").alias("line_id"))


JSONL_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("wav", T.StringType()), T.StructField("duration", T.DoubleType()),
])


def read_jsonl_manifest(spark: SparkSession, glob: str) -> DataFrame:
    """SRC07 JSON-lines manifest with a fixed schema; id token = 2nd path segment of ``wav``."""
    df = spark.read.schema(JSONL_SCHEMA).json(glob)
    return df.withColumn("id_token", F.get(F.split("wav", "/"), 1))


def read_sidecar_json(spark: SparkSession, glob: str, audio_suffix: str = ".mp3",
                      schema: T.StructType = JSONL_SCHEMA) -> DataFrame:
    """SRC08 one JSON object per file; the audio file is the sibling with
    another suffix."""
    df = spark.read.schema(schema).option("multiLine", True).json(glob)
    src = F.regexp_replace(F.col("_metadata.file_path"), "^file:", "")
    return df.withColumn("json_path", src).withColumn("audio_path", swap_suffix(src, audio_suffix))


def read_sidecar_text(spark: SparkSession, glob: str, mode: str = "whole",
                      audio_suffix: str = ".wav") -> DataFrame:
    """SRC09 text next to each audio file: whole file (``whole``), or the
    first line split on TAB into (id, text) (``first_line_tab``)."""
    # wholetext must be passed to text() itself: its default would override an option()
    df = spark.read.text(glob, wholetext=True)
    src = F.regexp_replace(F.col("_metadata.file_path"), "^file:", "")
    base = df.select(src.alias("text_path"), "value")
    if mode == "whole":
        return base.select("text_path", swap_suffix(F.regexp_replace("text_path", r"\.normalized\.txt$", ".txt"),
                                                    audio_suffix).alias("audio_path"),
                           F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))
    first = F.substring_index("value", "\n", 1)
    parts = F.split(first, "\t")
    return base.select("text_path", F.get(parts, 0).alias("utt_id"), F.trim(F.get(parts, 1)).alias("text"))


def read_eval_list(spark: SparkSession, path: str, root: str, default_suffix: str = ".wav") -> DataFrame:
    """SRC10 ``utt|prompt_text|prompt_wav|gt_text[|gt_wav]``; a missing 5th
    field defaults to ``<utt><suffix>``; relative wav paths are made absolute
    under ``root``."""
    lines = spark.read.text(path).where(F.char_length(F.trim("value")) > 0)
    p = F.split("value", r"\|")
    df = lines.select(p.alias("p")).where(F.size("p").isin(4, 5))

    def absolute(c):
        return F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), c))

    gt_wav = F.coalesce(F.get(F.col("p"), 4), F.concat(F.get(F.col("p"), 0), F.lit(default_suffix)))
    return df.select(F.get(F.col("p"), 0).alias("utt"), F.get(F.col("p"), 1).alias("prompt_text"),
                     absolute(F.get(F.col("p"), 2)).alias("prompt_wav"), F.get(F.col("p"), 3).alias("gt_text"),
                     absolute(gt_wav).alias("gt_wav"))


CROSS_SCHEMA = "ref_utt string, ref_dur double, ref_txt string, gen_utt string, gen_dur double, gen_txt string"


def read_cross_sentence_list(spark: SparkSession, path: str, root: str) -> DataFrame:
    """SRC11 TSV of cross-sentence pairs; ``spk-chapter-utt`` ids give the
    paths ``root/spk/chapter/<id>.flac``."""
    df = spark.read.schema(CROSS_SCHEMA).option("sep", "\t").csv(path)

    def wav(u):
        parts = F.split(F.col(u), "-")
        return F.concat_ws("/", F.lit(root.rstrip("/")), F.get(parts, 0), F.get(parts, 1),
                           F.concat(F.col(u), F.lit(".flac")))

    return df.withColumn("ref_wav", wav("ref_utt")).withColumn("gen_wav", wav("gen_utt"))


def numbered_lines(spark: SparkSession, path: str, name: str = "line_no") -> DataFrame:
    """Lines with consecutive 0-based numbers in (file name, position) order,
    so an ordered multi-part output reads back in order."""
    lines = (spark.read.text(path).withColumn("__id", F.monotonically_increasing_id())
             .withColumn("__file", F.col("_metadata.file_path")))
    n = global_row_number(lines, ["__file", "__id"], name)
    return n.select((F.col(name) - 1).alias(name), "value")


def read_rooted_tsv(spark: SparkSession, path: str) -> DataFrame:
    """SRC12 first line is the root directory, then ``rel<TAB>frames``;
    returns (line_no from 0 for the first entry, path, frames)."""
    lines = numbered_lines(spark, path)
    root = lines.where(F.col("line_no") == 0).select("value").limit(1).scalar()
    body = lines.where(F.col("line_no") > 0)
    p = F.split("value", "\t")
    return body.select((F.col("line_no") - 1).alias("line_no"),
                       F.concat(root, F.lit("/"), F.get(p, 0)).alias("path"),
                       F.get(p, 1).cast("long").alias("frames"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """SRC13 vocabulary: index = line number; a repeated token keeps its last index."""
    lines = numbered_lines(spark, path, "idx")
    tok = F.regexp_replace("value", r"[\r\n]+$", "")
    return lines.groupBy(tok.alias("token")).agg(F.max("idx").alias("idx"))


def load_prepared(spark: SparkSession, path: str) -> DataFrame:
    """SRC15 prepared dataset (rows with their duration column)."""
    return spark.read.parquet(f"{path.rstrip('/')}/raw")


def read_metrics_report(spark: SparkSession, glob: str) -> DataFrame:
    """SRC16 confusion matrices of the text reports as (report, target,
    actual, predicted, n).  A report is one small file, read whole; its
    lines are exploded and each matrix row is tied to the header above it."""
    files = spark.read.text(glob, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:", "").alias("report"), "value")
    lines = files.select("report", F.posexplode(F.split("value", "\n")).alias("ln", "line"))
    header = F.regexp_extract("line", r"^(True|Proxy)\\Predicted\t", 1)
    lines = lines.withColumn("__h", F.when(header != "", F.col("ln")))
    from pyspark.sql import Window
    w = Window.partitionBy("report").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("__hln", F.last("__h", ignorenulls=True).over(w))
    heads = lines.where(F.col("__h").isNotNull()).select(
        "report", F.col("ln").alias("__hln"), F.lower(header).alias("target"),
        F.expr("slice(split(line, '\\t'), 2, size(split(line, '\\t')))").alias("labels"))
    rows = lines.where(F.col("line").rlike(r"^[^\t]+\t\t[0-9]")).select(
        "report", "__hln", F.substring_index("line", "\t", 1).alias("actual"),
        F.split(F.regexp_replace("line", r"^[^\t]+\t\t", ""), "\t").alias("counts"))
    j = rows.join(heads, ["report", "__hln"])
    cells = j.select("report", "target", "actual", "labels", F.posexplode("counts").alias("i", "n"))
    return cells.select("report", "target", "actual", F.element_at("labels", F.col("i") + 1).alias("predicted"),
                        F.col("n").cast("long").alias("n"))
