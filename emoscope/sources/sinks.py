"""Writers (SNK01-SNK07).

Every writer is a distributed ``DataFrame.write``; nothing is gathered on the
driver.  Formats that the reference writes as one nested document with all
samples inside (the dataset manifest, run JSON) are written as flat tables
plus a one-row summary, so no single row or task holds the whole dataset.
Scratch output goes under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emoscope.operators.greedy import Rule, greedy_batches
from emoscope.session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/emoscope-io/{name}-{uuid.uuid4().hex[:12]}"


def write_csv(df: DataFrame, path: str, max_records: int | None = None) -> str:
    """SNK01 CSV with header, no index column."""
    w = df.write.mode("overwrite").option("header", True)
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    w.csv(path)
    return path


def write_prepared(df: DataFrame, path: str, text: str = "text", duration: str = "duration",
                   max_records: int | None = None) -> str:
    """SNK02/SNK03 prepared dataset: ``raw`` rows (duration stays a column;
    ``max_records`` caps rows per shard file), ``vocab`` (distinct characters
    by code point) and a one-row ``summary`` (rows, vocab size, hours)."""
    from emoscope.operators.corpus import build_vocab
    w = df.write.mode("overwrite")
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    w.parquet(f"{path}/raw")
    spark = df.sparkSession
    raw = spark.read.parquet(f"{path}/raw")
    vocab = build_vocab(raw, text)
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    v = spark.read.parquet(f"{path}/vocab")
    summary = raw.agg(F.count(F.lit(1)).alias("rows"), (F.sum(duration) / 3600).alias("hours")) \
        .withColumn("vocab_size", v.groupBy().agg(F.count(F.lit(1))).scalar())
    summary.write.mode("overwrite").json(f"{path}/summary")
    return path


def write_shards(df: DataFrame, path: str, order: Sequence[str], line: Column, max_bytes: int) -> str:
    """SNK03 text shards of at most ``max_bytes``: rows in ``order`` (unique, not
    NULL), one ``line`` each, cut greedily where the next line would pass the cap.

    Sizes are those of the encoded lines, newline included, so the cap holds for
    the files.  Only sizes go through the running total; a shard's lines meet in
    one task and make one file, ``shard=N``.  A line above the cap is an error."""
    size = F.octet_length(line) + 1
    fits = F.when(size <= max_bytes, size).otherwise(F.raise_error(F.lit(f"a line is longer than {max_bytes} bytes")).cast("int"))
    cut = greedy_batches(df.select(*order, fits.alias("__size")), [], order, "__size", Rule(max_bytes), name="shard")
    lines = df.select(*order, line.alias("value")).join(cut.select(*order, "shard"), list(order))
    lines.repartition("shard").sortWithinPartitions("shard", *order).select("shard", "value") \
        .write.mode("overwrite").partitionBy("shard").text(path)
    return path


def list_shards(spark: SparkSession, path: str) -> DataFrame:
    """``shard, rows, bytes`` of the files that ``write_shards`` left."""
    files = spark.read.text(path).select("shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    each = files.groupBy("shard", "file").agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("bytes"))
    return each.groupBy(F.col("shard").cast("long").alias("shard")).agg(
        F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))


def write_scores(df: DataFrame, path: str, score: str, digits: int = 5) -> str:
    """SNK04 per-sample scores as JSON lines, and the corpus mean written
    apart (the reference appends a non-JSON line; here it is its own file)."""
    df.write.mode("overwrite").json(f"{path}/samples")
    df.agg(F.bround(F.avg(score), digits).alias(f"mean_{score}"), F.count(F.lit(1)).alias("n")) \
        .write.mode("overwrite").json(f"{path}/summary")
    return path


def build_manifest(results: DataFrame, jobs: DataFrame, path: str, key: str = "job_number") -> str:
    """SNK05 dataset manifest: ``samples`` (successful results joined to
    their jobs, ``sample_%06d`` ids), ``failed_jobs`` and a one-row
    ``dataset_info`` with the statistics."""
    from emoscope.operators.joins import join_results
    from emoscope.operators.ranking import number_rows
    ok, bad = join_results(results, jobs, key)
    samples = number_rows(ok, [], [key], "sample_no", fmt="sample_%06d")
    samples.write.mode("overwrite").json(f"{path}/samples")
    bad.write.mode("overwrite").json(f"{path}/failed_jobs")
    stats = results.agg(F.count(F.lit(1)).alias("total_jobs"), F.count_if("success").alias("successful"),
                        F.count_if(~F.col("success")).alias("failed"),
                        F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)).alias("success_rate"))
    stats.write.mode("overwrite").json(f"{path}/dataset_info")
    return path


def write_rooted_manifest(df: DataFrame, path: str, root: str, rel: str = "rel_path", frames: str = "frames",
                          name: str = "name", label: str = "label", line: str = "line_no") -> str:
    """SNK06 the positional triple as three text outputs in line order: the
    ``.tsv`` (root line, then ``rel<TAB>frames``), ``.lengths`` and ``.emo``.
    Output is range-partitioned by line, so the part files concatenate in
    order without a single-task sort."""
    spark = df.sparkSession
    head = spark.createDataFrame([(-1, root)], f"{line} long, value string")
    tsv = df.select(F.col(line).cast("long").alias(line), F.concat_ws("\t", rel, F.col(frames).cast("string")).alias("value"))
    for sub, data in (("tsv", head.unionByName(tsv)),
                      ("lengths", df.select(F.col(line).cast("long").alias(line), F.col(frames).cast("string").alias("value"))),
                      ("emo", df.select(F.col(line).cast("long").alias(line), F.concat_ws("\t", name, label).alias("value")))):
        data.orderBy(line).select("value").write.mode("overwrite").text(f"{path}/{sub}")
    return path


def write_run(df: DataFrame, path: str, error: str = "error") -> str:
    """SNK07 a scoring run: successful rows, failed rows and a one-row
    summary (counts, success rate, time of writing)."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)  # three outputs of rows that are made once
    try:
        df.where(F.col(error).isNull()).drop(error).write.mode("overwrite").option("header", True).csv(f"{path}/results")
        df.where(F.col(error).isNotNull()).write.mode("overwrite").json(f"{path}/failed_files")
        df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(error).isNull()).alias("successful"),
               F.count_if(F.col(error).isNotNull()).alias("failed"),
               F.current_timestamp().alias("written_at")).write.mode("overwrite").json(f"{path}/metadata")
    finally:
        df.unpersist()
    return path


def write_metrics_report(cm: DataFrame, path: str, report: str = "report", target: str = "target") -> str:
    """The confusion-matrix part of the per-run text report (one small file
    per report, matrices bounded by labels x labels), so that reports can be
    produced and read back by ``read_metrics_report``."""
    labels = cm.groupBy(report, target).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("actual", "predicted"))))).alias("labels"))
    cells = cm.join(labels, [report, target])
    rows = cells.groupBy(report, target, "actual", "labels").agg(
        F.map_from_entries(F.collect_list(F.struct("predicted", F.col("n").cast("string")))).alias("m"))
    rows = rows.select(report, target, "actual", "labels", F.concat(F.col("actual"), F.lit("\t\t"), F.array_join(
        F.transform("labels", lambda lab: F.coalesce(F.element_at("m", lab), F.lit("0"))), "\t")).alias("line"))
    head = F.concat(F.when(F.col(target) == "true", "True").otherwise("Proxy"), F.lit("\\Predicted\t"),
                    F.array_join("labels", "\t"))
    mats = rows.groupBy(report, target, "labels").agg(F.array_sort(F.collect_list(F.struct("actual", "line"))).alias("r"))
    mats = mats.select(report, target, F.concat_ws("\n", head, F.array_join(F.transform("r", lambda s: s["line"]), "\n"))
                       .alias("block"))
    docs = mats.groupBy(report).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        F.when(F.col(target) == "true", 0).otherwise(1).alias("o"), "block"))), lambda s: s["block"]), "\n\n").alias("value"))
    docs.write.mode("overwrite").partitionBy(report).text(path)
    return path
