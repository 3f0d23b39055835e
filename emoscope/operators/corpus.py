"""Corpus and run statistics, vocabulary operators (AGG12-AGG26, AGG30).

Everything is an aggregate over the table (partial aggregation on the map
side) or a join; nothing is gathered on the driver.  Sets that the reference
builds in memory (character vocabularies) are ``distinct`` rows here.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emoscope.functions.text import tokenize_char
from emoscope.operators.ordered import global_row_number, ordered_scan
from emoscope.operators.parallel import spread


def distribution(df: DataFrame, col: str) -> DataFrame:
    """AGG12 frequency of each value, its share, and its rank (descending
    count, value as tie-break).  The ranking window runs over the aggregated
    table (one row per distinct value)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.groupBy().agg(F.count(F.lit(1))).scalar()
    ranked = global_row_number(counts, [-F.col("n"), F.col(col)], "rank")
    return ranked.withColumn("share", F.col("n") / total)


def distribution_summary(df: DataFrame, col: str) -> DataFrame:
    """AGG12 most common value (ties: smallest value) and number of distinct values."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(col, F.struct(-F.col("n"), F.col(col))).alias("most_common"),
                      F.count(F.lit(1)).alias("n_distinct"))


def text_stats(df: DataFrame, text_col: str, class_col: str, line_col: str) -> DataFrame:
    """AGG13 one row: texts, length min/max/avg, line range, distinct lines,
    distinct texts.  (Counts by class are ``distribution(df, class_col)``.)"""
    ln = F.char_length(text_col)
    return df.agg(
        F.count(F.lit(1)).alias("n_texts"), F.min(ln).alias("min_len"), F.max(ln).alias("max_len"),
        F.avg(ln).alias("avg_len"), F.min(line_col).alias("first_line"), F.max(line_col).alias("last_line"),
        F.count_distinct(line_col).alias("distinct_lines"), F.count_distinct(text_col).alias("distinct_texts"),
        F.count_distinct(class_col).alias("n_classes"))


def coverage(df: DataFrame, speaker: str = "speaker", emotion: str = "emotion",
             duration: str = "duration", order: str = "audio_path", head: int = 5) -> DataFrame:
    """AGG14 per speaker x emotion: files, average duration of the first
    ``head`` files (file order), speakers per emotion, and all files.  The first-N
    filter is a ``row_number() <= N`` window, which Spark pre-limits per map
    partition (WindowGroupLimit), so a hot group never sorts in one task."""
    w = Window.partitionBy(speaker, emotion).orderBy(order)
    first = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= head)
    files = df.groupBy(speaker, emotion).agg(F.count(F.lit(1)).alias("files"))
    firsts = first.groupBy(speaker, emotion).agg(F.avg(duration).alias(f"avg_first{head}_duration"))
    per_emotion = df.groupBy(emotion).agg(F.count_distinct(speaker).alias("speakers_with_emotion"))
    total = df.groupBy().agg(F.count(F.lit(1))).scalar()
    return files.join(firsts, [speaker, emotion]).join(per_emotion, emotion).withColumn("total_files", total)


def manifest_summary(df: DataFrame, duration: str = "duration", text: str = "text") -> DataFrame:
    """AGG15 rows, total hours, min / max seconds, vocabulary size."""
    vocab = build_vocab(df, text).groupBy().agg(F.count(F.lit(1))).scalar()
    return df.agg(F.count(F.lit(1)).alias("rows"), (F.sum(duration) / 3600).alias("hours"),
                  F.min(duration).alias("min_sec"), F.max(duration).alias("max_sec")).withColumn("vocab_size", vocab)


def build_vocab(df: DataFrame, text: str, extra_ranges: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """AGG16 distinct characters of the texts (plus forced code-point ranges,
    e.g. 32-126 and 192-255), sorted by code point, indexed from 0."""
    # distinct per row first: the explode emits each character once per text
    chars = df.select(F.explode(F.array_distinct(tokenize_char(text))).alias("token")).distinct()
    spark = df.sparkSession
    for lo, hi in extra_ranges:
        rng = spark.range(lo, hi + 1).select(
            F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("token"))
        chars = chars.unionByName(rng).distinct()
    # code-point order: UTF-32 big-endian bytes sort like code points
    keyed = chars.withColumn("__cp", F.hex(F.encode("token", "UTF-32")))
    return global_row_number(keyed, ["__cp"], "idx").select("token", (F.col("idx") - 1).alias("idx"))


def _id_pages(vocab: DataFrame) -> Column:
    """The ids of a character vocabulary as one scalar: by code point, in pages of 256."""
    one = F.when(F.char_length("token") == 1, F.ascii("token")).otherwise(
        F.raise_error(F.concat(F.lit("not a single character: "), F.col("token"))).cast("int"))
    at = vocab.select(one.alias("cp"), F.col("idx").cast("long").alias("idx"))
    pages = at.groupBy(F.floor(F.col("cp") / 256).cast("int").alias("page")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("cp") % 256, "idx"))).alias("m"))
    pages = pages.select("page", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.try_element_at("m", i)).alias("ids"))
    return pages.agg(F.map_from_entries(F.collect_list(F.struct("page", "ids"))).alias("m"), F.max("page").alias("top")).select(
        F.transform(F.sequence(F.lit(0), F.coalesce("top", F.lit(0))), lambda p: F.try_element_at("m", p))).scalar()


def encode_chars(df: DataFrame, tokens: str, vocab: DataFrame, name: str = "ids") -> DataFrame:
    """ARR02 for character vocabularies: ``df`` plus the ids of the characters in
    ``tokens``, unknown -> 0.  A character's code point is its place in one
    array, at most 1,114,112 ids whatever the data, so rows are neither
    exploded nor joined nor moved.  For vocabularies of longer tokens use
    ``encode_by_join``."""
    ids = F.transform(tokens, lambda t: F.coalesce(
        F.get(F.get("__pages", F.floor(F.ascii(t) / 256).cast("int")), F.ascii(t) % 256), F.lit(0)))
    return df.withColumn("__pages", _id_pages(vocab)).select(*df.columns, ids.alias(name))


def encode_by_join(df: DataFrame, id_col: str, tokens: str, vocab: DataFrame) -> DataFrame:
    """ARR02 for vocabularies of any tokens and size: explode, join to (token,
    idx), unknown -> 0, collect back in position order per row."""
    ex = spread(df, id_col).select(id_col, F.posexplode(tokens).alias("pos", "token"))
    j = ex.join(vocab.select("token", "idx"), "token", "left").fillna(0, subset=["idx"])
    coll = F.array_sort(F.collect_list(F.struct("pos", "idx")))
    return j.groupBy(id_col).agg(F.transform(coll, lambda s: s["idx"]).alias("ids"))


def oov(df: DataFrame, id_col: str, text: str, vocab: DataFrame) -> DataFrame:
    """AGG17 characters not in the vocabulary, in first-seen order (by row
    id, then position).  A row gives each of its distinct characters once, with
    its first place and its number; the minimum over rows is a partial aggregate
    by character, and only distinct characters meet the vocabulary."""
    each = df.select(id_col, F.col(text).alias("__t"), F.explode(F.array_distinct(tokenize_char(text))).alias("token"))
    n = (F.octet_length("__t") - F.octet_length(F.replace("__t", "token"))) / F.octet_length("token")
    place = F.struct(id_col, (F.position("token", "__t") - 1).alias("pos"))
    first = each.groupBy("token").agg(F.min(place).alias("__first"), F.sum(n.cast("long")).alias("n"))
    miss = first.join(vocab.select("token"), "token", "left_anti")
    return miss.select("token", "n", F.col(f"__first.{id_col}").alias("first_row"), F.col("__first.pos").alias("first_pos"))


def extend_vocab(vocab: DataFrame, requested: DataFrame, order_col: str) -> DataFrame:
    """AGG18 append requested symbols that are missing, after the existing
    ones, in ``order_col`` order."""
    new = requested.select("token", order_col).join(vocab.select("token"), "token", "left_anti")
    new = new.groupBy("token").agg(F.min(order_col).alias(order_col))
    top = vocab.groupBy().agg(F.max("idx")).scalar()
    numbered = global_row_number(new, [order_col, "token"], "__rn")
    return vocab.select("token", "idx").unionByName(
        numbered.select("token", (top + F.col("__rn")).alias("idx")))


def mean_score(df: DataFrame, col: str, digits: int, by: Sequence[str] = (), empty_zero: bool = False) -> DataFrame:
    """AGG19 corpus score: mean rounded half-even to ``digits`` (numpy
    rounding); 0 when empty if ``empty_zero``."""
    m = F.avg(col)
    if empty_zero:
        m = F.coalesce(m, F.lit(0.0))
    return df.groupBy(*by).agg(F.bround(m, digits).alias(f"mean_{col}"), F.count(col).alias("n"))


def _group_key(by: Sequence[str]) -> Column:
    """The grouping columns as one struct, which is never NULL and so joins like any value."""
    return F.struct(F.lit(0).alias("__all"), *by)


def exact_quantiles(df: DataFrame, key: str, col: str, qs: Sequence[float], out: str) -> DataFrame:
    """Quantiles (linear interpolation) of ``col`` per ``key`` as an array column.

    Rows are counted per (key, value), combined on the map side; a range-sharded
    running count over the values gives each its span of positions, and a
    quantile is read off the two spans that its position falls between."""
    counts = df.where(F.col(col).isNotNull()).groupBy(key, col).agg(F.count(F.lit(1)).alias("__c"))
    spans = ordered_scan(counts, [key], [col], running_sum=("__c", "__upto"))
    sizes = counts.groupBy(key).agg(F.sum("__c").alias("__n"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("__upto") - F.col("__c") <= place) & (place < F.col("__upto")), F.col(col)))

    places = [(F.col("__n") - 1) * F.lit(float(q)) for q in qs]
    found = spans.join(sizes, key).groupBy(key).agg(
        F.array(*[at(F.floor(p)) for p in places]).alias("__lo"), F.array(*[at(F.ceil(p)) for p in places]).alias("__hi"),
        F.array(*[F.max(p - F.floor(p)) for p in places]).alias("__part"))
    return found.select(key, F.array(*[
        F.col("__lo")[i] + (F.col("__hi")[i] - F.col("__lo")[i]) * F.col("__part")[i] for i in range(len(qs))]).alias(out))


def latency_report(df: DataFrame, latency: str = "latency_s", audio: str = "audio_s",
                   by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """AGG20 RTF = processing seconds / audio seconds (here the sum of request
    latencies, as the log has no wall clock), mean latency in ms, variance of
    the latencies in seconds x1000 (population, as the reference prints it),
    p50/p90/p95/p99 in ms (linear interpolation like numpy).

    ``exact=True`` finds the percentiles with ``exact_quantiles``, so no group
    is held by one task; ``exact=False`` uses the mergeable
    ``percentile_approx`` sketch.  An empty log gives no rows."""
    qs = [0.5, 0.9, 0.95, 0.99]
    keyed = df.withColumn("__key", _group_key(by))
    agg = keyed.groupBy("__key").agg(
        F.count(F.lit(1)).alias("requests"),
        (F.sum(latency) / F.sum(audio)).alias("rtf"),
        (F.avg(latency) * 1000).alias("mean_latency_ms"),
        (F.var_pop(latency) * 1000).alias("latency_variance"),
        *([] if exact else [F.percentile_approx(latency, qs, 10000).alias("__p")]))
    if exact:
        agg = agg.join(exact_quantiles(keyed, "__key", latency, qs, "__p"), "__key", "left")
    return agg.select(*[F.col("__key")[c].alias(c) for c in by], "requests", "rtf", "mean_latency_ms", "latency_variance",
                      *[(F.col("__p")[i] * 1000).alias(f"p{int(q * 100)}_ms") for i, q in enumerate(qs)])


def batch_stats(df: DataFrame, size_col: str = "batch_size", count_col: str = "count",
                ns_col: str = "total_ns") -> DataFrame:
    """AGG21 per batch size: executions, total ms, average ms, average ms per sample."""
    agg = df.groupBy(size_col).agg(F.sum(count_col).alias("executions"), F.sum(ns_col).alias("__ns"))
    return (agg.withColumn("total_ms", F.col("__ns") / 1e6)
            .withColumn("avg_ms", F.col("total_ms") / F.col("executions"))
            .withColumn("avg_ms_per_sample", F.col("avg_ms") / F.col(size_col)).drop("__ns"))


def mean_std(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG22 mean and population standard deviation."""
    return df.groupBy(*by).agg(F.avg(col).alias(f"mean_{col}"), F.stddev_pop(col).alias(f"std_{col}"))


def run_stats(df: DataFrame, success: str = "success", by: Sequence[str] = ()) -> DataFrame:
    """AGG23 totals, successes, failures and success rate (0 when empty)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(success)).alias("succeeded"),
        F.count_if(~F.col(success)).alias("failed"),
        F.coalesce(F.avg(F.col(success).cast("double")), F.lit(0.0)).alias("success_rate"))


def dir_size(inventory: DataFrame, by: Sequence[str] = (), length: str = "length") -> DataFrame:
    """AGG24 total bytes and files (of an inventory listing)."""
    return inventory.groupBy(*by).agg(F.sum(length).alias("bytes"), F.count(F.lit(1)).alias("files"))


def best_epoch(df: DataFrame, epoch: str = "epoch", metric: str = "wa", by: Sequence[str] = ()) -> DataFrame:
    """AGG25 first epoch with the strictly greatest metric: ``max_by`` over
    (metric, -epoch)."""
    return df.groupBy(*by).agg(F.max_by(epoch, F.struct(F.col(metric), -F.col(epoch))).alias("best_epoch"),
                               F.max(metric).alias(f"best_{metric}"))


def training_plan(df: DataFrame, duration: str, workers: int, frames_per_worker: int,
                  sample_rate: int = 24000, hop: int = 256, epochs_updates: int | None = None,
                  warmup_share: float = 0.05) -> DataFrame:
    """AGG26 numbers for a training run from the duration list: max frame
    length, samples, hours, frames, updates per epoch (total frames / frames
    per update), warm-up updates; with ``epochs_updates``, the epochs that so
    many updates take (``epochs``)."""
    frames = F.col(duration) * sample_rate / hop
    agg = df.agg(F.max(frames).alias("max_frame_len"), F.count(F.lit(1)).alias("samples"),
                 (F.sum(duration) / 3600).alias("hours"), F.sum(frames).alias("total_frames"))
    per_update = workers * frames_per_worker
    agg = agg.withColumn("updates_per_epoch", F.ceil(F.col("total_frames") / per_update).cast("bigint"))
    agg = agg.withColumn("warmup_updates", F.ceil(F.col("updates_per_epoch") * warmup_share).cast("bigint"))
    if epochs_updates is None:
        return agg
    return agg.withColumn("epochs", F.try_divide(F.lit(float(epochs_updates)), F.col("total_frames") / per_update))


def epoch_log(df: DataFrame, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """AGG30 mean loss per epoch."""
    return df.groupBy(epoch).agg(F.avg(loss).alias("mean_loss"), F.count(F.lit(1)).alias("batches"))


def dataset_card(manifest: DataFrame, emotion: str = "emotion", kind: str = "emotion_type",
                 method: str = "method_used") -> tuple[DataFrame, DataFrame]:
    """SNK08 counts by emotion x type and by method."""
    a = manifest.groupBy(emotion, kind).agg(F.count(F.lit(1)).alias("n"))
    b = manifest.groupBy(method).agg(F.count(F.lit(1)).alias("n"))
    return a, b
