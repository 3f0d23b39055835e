"""Length-aware batching and silence segmentation (WIN07, WIN08, WIN12).

WIN07 and WIN08 are greedy recurrences: where a batch closes depends on every
earlier item of the same sequence, so no window expresses them.  They run as
slice transducers (``greedy.py``), so no task holds a shard or a bucket.

WIN12 (gaps and islands): run ids are running sums of change flags from the
range-sharded scan, and the choice among long silences is greedy, too.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emoscope.operators.greedy import Cuts, Rule, greedy_batches
from emoscope.operators.ordered import ordered_scan
from emoscope.session import ensure_checkpoint_dir


def bucket_index(length, min_len: float, max_len: float, buckets: int = 200):
    """WIN08 bucket = floor((len - min) / (max - min + 1) * buckets)."""
    c = F.col(length) if isinstance(length, str) else length
    return F.floor((c - F.lit(min_len)) / F.lit(max_len - min_len + 1) * F.lit(buckets)).cast("int")


def silent_runs(frames: DataFrame, utt: str, order: Sequence[str], rms: str, threshold: float,
                min_run: int = 1) -> DataFrame:
    """WIN12 gaps and islands over a frame-energy series: frames below
    ``threshold`` are silent; consecutive silent frames form a run (run id =
    running count of run starts, from the range-sharded scan).  For each
    silent run of at least ``min_run`` frames: first / last frame position,
    length, and the quietest frame (the cut point, ``min_by``)."""
    f = frames.withColumn("__silent", (F.col(rms) < threshold).cast("int"))
    f = ordered_scan(f, [utt], list(order), row_number="frame_pos", lag=[("__silent", "__prev")])
    start = ((F.col("__silent") == 1) & (F.coalesce(F.col("__prev"), F.lit(0)) == 0)).cast("double")
    f = f.withColumn("__start", start)
    f = ordered_scan(f, [utt], list(order), running_sum=("__start", "__run"))
    s = f.where(F.col("__silent") == 1)
    runs = s.groupBy(utt, F.col("__run").cast("bigint").alias("run_id")).agg(
        F.min("frame_pos").alias("first_frame"), F.max("frame_pos").alias("last_frame"),
        F.count(F.lit(1)).alias("run_frames"),
        F.min_by("frame_pos", F.struct(F.col(rms), F.col("frame_pos"))).alias("cut_frame"))
    return runs.where(F.col("run_frames") >= min_run)


def silence_clips(frames: DataFrame, utt: str, order: Sequence[str], rms: str, threshold: float,
                  min_length: int, min_interval: int, max_kept: int) -> DataFrame:
    """WIN12 clips between silences: ``utt, clip, begin, end``, frames from 0, end
    exclusive.  All lengths are in frames.

    A silence of at least ``min_interval`` frames is cut at its quietest frame
    if ``min_length`` frames lie between the last cut and its end; a longer
    silence leaves at most ``max_kept`` frames on each side.  A leading silence
    over ``max_kept`` is always cut and so is a trailing one of
    ``min_interval``; both go whole but for what is kept beside the speech.  A
    NULL energy counts as sound, a NULL ``utt`` as a series of its own, and a
    series without cuts is one clip.

    The cut places depend on their own silence alone and come from aggregates.
    Only the choice among long silences is sequential; it runs as slice
    transducers (``greedy.Cuts``), so an endless recording spreads as well."""
    f = frames.select(F.struct(utt).alias("__u"), *order, rms).withColumn(
        "__quiet", F.coalesce((F.col(rms) < threshold).cast("long"), F.lit(0)))
    sizes = f.groupBy("__u").agg(F.count(F.lit(1)).alias("__n"))
    f = ordered_scan(f, ["__u"], list(order), row_number="__row", running_sum=("__quiet", "__quiet_rows"))
    quiet = f.where("__quiet = 1").select("__u", (F.col("__row") - 1).alias("__p"), F.col(rms).alias("__rms"),
                                          (F.col("__row") - F.col("__quiet_rows")).alias("__run"))
    runs = quiet.groupBy("__u", "__run").agg(F.min("__p").alias("__s"), (F.max("__p") + 1).alias("__e"))
    size, leading = F.col("__e") - F.col("__s"), (F.col("__s") == 0) & (F.col("__e") > max_kept)
    trailing = F.col("__e") == F.col("__n")
    runs = runs.join(sizes, "__u").where((size >= min_interval) | (leading & ~trailing))

    def quietest(inside):
        return F.min(F.when(inside, F.struct("__rms", "__p")))["__p"]

    head, tail = F.col("__p") <= F.col("__s") + max_kept, F.col("__p") >= F.col("__e") - max_kept
    cuts = quiet.join(runs, ["__u", "__run"]).groupBy("__u", "__s", "__e", "__n").agg(
        quietest(head).alias("__lo"), quietest(tail).alias("__hi"), quietest(head & tail).alias("__mid"))
    short, long = size <= max_kept, size > 2 * max_kept
    begin = F.when(trailing, F.col("__lo")).when(F.col("__s") == 0, 0).when(short | long, F.col("__lo")) \
        .otherwise(F.least("__lo", "__mid"))
    end = F.when(trailing, F.col("__n") + 1).when(short, F.col("__lo")).when((F.col("__s") == 0) | long, F.col("__hi")) \
        .otherwise(F.greatest("__hi", "__mid"))
    cuts = cuts.select("__u", "__s", "__e", "__n", (trailing | leading).alias("__always"), begin.cast("long").alias("__from"),
                       end.cast("long").alias("__to"))
    ensure_checkpoint_dir(frames.sparkSession)
    cuts = cuts.checkpoint()  # a row for each long silence; the frames are not read again
    taken = greedy_batches(cuts, ["__u"], ["__s"], None, Cuts("__s", "__e", "__to", "__always", min_length),
                           starts_name="__taken").where("__taken").checkpoint()
    # what lies between the taken cuts: from the one before to this one, and from the last one to the end
    inner = ordered_scan(taken, ["__u"], ["__s"], lag=[("__to", "__before")])
    inner = inner.where(F.col("__before").isNotNull() | (F.col("__from") > 0)).select(
        "__u", F.coalesce("__before", F.lit(0)).cast("long").alias("begin"), F.col("__from").alias("end"))
    inner = ordered_scan(inner, ["__u"], ["begin", "end"], row_number="__k").select(
        "__u", (F.col("__k") - 1).alias("clip"), "begin", "end")
    per = taken.groupBy("__u").agg(F.max_by("__to", "__s").alias("__last"), (F.count(F.lit(1)) - F.when(
        F.min_by("__from", "__s") <= 0, 1).otherwise(0)).alias("__clips"))
    rest = sizes.join(per, "__u", "left").select("__u", F.coalesce("__clips", F.lit(0)).cast("long").alias("clip"),
                                                F.coalesce("__last", F.lit(0)).cast("long").alias("begin"), F.col("__n").alias("end"))
    return inner.unionByName(rest.where("begin < end")).select(F.col("__u")[utt].alias(utt), "clip", "begin", "end")


def bucket_batches(df: DataFrame, length: str, order: str, min_len: float, max_len: float,
                   budget: float, buckets: int = 200, num_slices: int | None = None) -> DataFrame:
    """WIN08 bucketed batching in input order (``order``): within each bucket of
    lengths in [min, max] a batch closes as soon as its running total reaches
    ``budget``; the residual is the last batch of the bucket."""
    b = df.where(F.col(length).between(min_len, max_len)).select(
        order, bucket_index(length, min_len, max_len, buckets).alias("bucket"), length)
    out = greedy_batches(b, ["bucket"], [order], length, Rule(budget, closing=True), num_slices=num_slices)
    return out.select(order, "bucket", "batch", length)


def dynamic_batches(df: DataFrame, shard: str, length: str, id_col: str, budget: float,
                    max_n: int = 0, drop_last: bool = False, num_slices: int | None = None) -> DataFrame:
    """WIN07 batches by length (id tie-break) within each shard: the frame total
    stays within ``budget`` and the count within ``max_n`` (0: no limit).  Items
    longer than the budget sort last and are dropped first; ``drop_last`` drops
    the last batch of a shard.  Output: id, shard, batch (per shard), length."""
    keep = df.select(id_col, shard, length).where(F.col(length) <= budget)
    out = greedy_batches(keep, [shard], [length, id_col], length, Rule(budget, max_n), num_slices=num_slices)
    if drop_last:
        last = out.groupBy(shard).agg(F.max("batch").alias("__last"))
        out = out.join(last, shard).where(F.col("batch") < F.col("__last")).drop("__last")
    return out.select(id_col, shard, "batch", length)
