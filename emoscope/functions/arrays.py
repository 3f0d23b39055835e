"""Array-column functions for signals and token sequences (ARR05-ARR18).

Per-row array work uses Spark's higher-order functions (``transform``,
``aggregate``, ``zip_with``, ``filter``), which run in the JVM.  Operators
that combine several rows (padding to a batch maximum, mean pooling,
concatenation in order) are DataFrame operators over ``posexplode`` /
``groupBy`` so that the work is spread by key.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emoscope.functions.hashing import stable_hash


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.
    Catalyst does not share sub-expressions inside lambdas, so a per-array
    statistic used inside ``transform`` must be bound this way or it is
    recomputed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pad_batch(df: DataFrame, batch_col: str, arr_col: str, value=0, cap: int | None = None) -> DataFrame:
    """ARR05 pad every array to the longest of its batch with ``value``; adds
    ``padded``, ``mask`` (True on padding) and ``length``.  With ``cap`` the
    arrays are first cut to that length."""
    arr = _c(arr_col)
    if cap is not None:
        arr = F.slice(arr, 1, cap)
    out = df.withColumn("__arr", arr).withColumn("length", F.size("__arr"))
    out = out.withColumn("__max", F.max("length").over(Window.partitionBy(batch_col)))
    pad = F.array_repeat(F.lit(value).cast(out.schema["__arr"].dataType.elementType), F.col("__max") - F.col("length"))
    out = out.withColumn("padded", F.concat("__arr", pad))
    out = out.withColumn("mask", length_mask(F.col("length"), F.col("__max")))
    return out.drop("__arr", "__max")


def length_mask(length, max_len) -> Column:
    """ARR06 boolean mask of ``max_len`` positions, True beyond ``length``."""
    m = _c(max_len) if not isinstance(max_len, int) else F.lit(max_len)
    return F.when(m > 0, F.transform(F.sequence(F.lit(1), m), lambda i: i > _c(length))).otherwise(
        F.array().cast("array<boolean>"))


def rms(arr) -> Column:
    """ARR07 root mean square."""
    a = _c(arr)
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)) / F.size(a))


def rms_normalise(arr, target: float = 0.1) -> Column:
    """ARR07 scale up to ``target`` RMS only when below it."""
    a = _c(arr)
    return let(rms(a), lambda r: F.when(r < target, F.transform(a, lambda x: x * F.lit(target) / r)).otherwise(a))


def peak_normalise(arr, level: float = 0.95) -> Column:
    """ARR08 scale so the largest magnitude equals ``level`` (if above 0)."""
    a = _c(arr)
    peak = F.array_max(F.transform(a, lambda x: F.abs(x)))
    return let(peak, lambda p: F.when(p > 0, F.transform(a, lambda x: x / p * F.lit(level))).otherwise(a))


def loudness_blend(arr) -> Column:
    """ARR08 blend ``x / max * 0.5 + 0.5 * x`` (max of magnitudes)."""
    a = _c(arr)
    peak = F.array_max(F.transform(a, lambda x: F.abs(x)))
    return let(peak, lambda p: F.when(p > 0, F.transform(a, lambda x: x / p * 0.5 + x * 0.5)).otherwise(a))


def trim_quiet(arr, threshold: float) -> Column:
    """ARR09 drop leading and trailing elements with magnitude <= threshold;
    unchanged when every element is quiet."""
    a = _c(arr)
    loud = F.transform(a, lambda x: F.abs(x) > threshold)
    first = F.array_position(loud, True)
    last_rev = F.array_position(F.reverse(loud), True)
    n = F.size(a)
    return F.when(first == 0, a).otherwise(F.slice(a, first.cast("int"), (n - last_rev + 1 - first + 1).cast("int")))


def to_mono(left, right) -> Column:
    """ARR10 channel mean of two channels."""
    return F.zip_with(_c(left), _c(right), lambda x, y: (x + y) / 2)


def layer_norm(arr, eps: float = 1e-5) -> Column:
    """ARR11 standardise a vector (population variance, no affine)."""
    a = _c(arr)
    n = F.size(a)

    def with_mean(mean):
        var = _sum(F.transform(a, lambda x: (x - mean) * (x - mean))) / n
        return let(F.sqrt(var + F.lit(eps)), lambda sd: F.transform(a, lambda x: (x - mean) / sd))

    return let(_sum(a) / n, with_mean)


def mean_pool(df: DataFrame, key: Sequence[str] | str, arr_col: str) -> DataFrame:
    """ARR12 mean vector per key in long form ``(key, pos, mean)``: explode
    positions and average by (key, pos), a partial aggregate."""
    keys = [key] if isinstance(key, str) else list(key)
    ex = df.select(*keys, F.posexplode(arr_col).alias("pos", "__x"))
    return ex.groupBy(*keys, "pos").agg(F.avg("__x").alias("mean"))


def mean_pool_vector(df: DataFrame, key: Sequence[str] | str, arr_col: str) -> DataFrame:
    """ARR12 the pooled vector as one array per key (pos order); the arrays
    have the vector width, so the collect is bounded by it."""
    keys = [key] if isinstance(key, str) else list(key)
    pooled = mean_pool(df, keys, arr_col)
    vec = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return pooled.groupBy(*keys).agg(F.transform(vec, lambda s: s["mean"]).alias("pooled"))


def masked_mean(arr, length) -> Column:
    """ARR12 masked variant: mean of the first ``length`` elements."""
    return _sum(F.slice(_c(arr), 1, _c(length))) / _c(length)


def argmax_label(scores, labels: Sequence[str]) -> Column:
    """ARR13 label of the largest score (first on ties)."""
    s = _c(scores)
    arr = F.array(*[F.lit(x) for x in labels])
    return F.element_at(arr, F.array_position(s, F.array_max(s)).cast("int"))


def argmax_index(scores) -> Column:
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def edit_mask(n_frames, parts) -> Column:
    """ARR16 True outside the edited ``[start, end)`` parts, False inside.
    ``parts`` is an array of struct(start, end) in frames."""
    n = _c(n_frames)
    p = _c(parts)
    return F.transform(F.sequence(F.lit(0), n - 1),
                       lambda i: ~F.exists(p, lambda s: (i >= s["start"]) & (i < s["end"])))


def random_crop(arr, n: int, seed_col) -> Column:
    """ARR17 fixed-length crop at a hash-drawn start when longer than ``n``."""
    a = _c(arr)
    size = F.size(a)
    start = F.pmod(stable_hash(_c(seed_col), 0), F.greatest(size - n + 1, F.lit(1))) + 1
    return F.when(size > n, F.slice(a, start.cast("int"), n)).otherwise(a)


def frame_energies(arr, win: int, hop: int) -> Column:
    """ARR18 energies of frames of length ``win`` every ``hop`` samples."""
    a = _c(arr)
    n = F.size(a)
    starts = F.sequence(F.lit(1), F.greatest(n - win + 1, F.lit(1)), F.lit(hop))
    return F.transform(starts, lambda s: _sum(F.transform(F.slice(a, s, win), lambda x: x * x)) / win)


def zero_crossing_rate(arr) -> Column:
    """ARR18 share of adjacent pairs that change sign."""
    a = _c(arr)
    n = F.size(a)
    pairs = F.zip_with(F.slice(a, 1, n - 1), F.slice(a, 2, n - 1), lambda x, y: F.when(x * y < 0, 1.0).otherwise(0.0))
    return F.when(n > 1, _sum(pairs) / (n - 1))


def signal_quality(df: DataFrame, id_col: str, arr_col: str, win: int = 8, hop: int = 4) -> DataFrame:
    """ARR18 per-signal quality: frame energies (window / hop), zero-crossing
    rate, SNR estimate ``10*log10(mean energy / 30th percentile energy)`` and
    score ``min(100, max(0, (snr + 10) * 5))``.  Frame energies are built per
    frame (the reference averages over the wrong axis)."""
    e = df.select(id_col, zero_crossing_rate(arr_col).alias("zcr"),
                  F.posexplode(frame_energies(arr_col, win, hop)).alias("frame", "energy"))
    agg = e.groupBy(id_col).agg(
        F.first("zcr").alias("zcr"), F.avg("energy").alias("mean_energy"),
        F.percentile("energy", 0.3).alias("noise_energy"), F.count(F.lit(1)).alias("n_frames"))
    snr = F.when(F.col("noise_energy") > 0, 10 * F.log10(F.col("mean_energy") / F.col("noise_energy")))
    return (agg.withColumn("snr_db", snr)
            .withColumn("quality", F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.col("snr_db") + 10) * 5))))


def rechunk(arr, n: int) -> Column:
    """TVF05 fixed-size chunks of a sequence (explode it for one row each)."""
    a = _c(arr)
    starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(n))
    return F.when(F.size(a) > 0, F.transform(starts, lambda s: F.slice(a, s, n))).otherwise(F.array())


def concat_capped(df: DataFrame, keys: Sequence[str], order: Sequence[str], arr_col: str, cap: int,
                  out: str = "joined") -> DataFrame:
    """ARR14 concatenate each key's arrays in ``order`` until ``cap`` elements;
    the last array taken is cut.  Rows past the cap are dropped before the
    collect (range-sharded running sum), so each collected array is bounded by
    ``cap``."""
    from emoscope.operators.ranking import take_until
    sized = df.withColumn("__len", F.size(arr_col))
    taken = take_until(sized, list(keys), list(order), "__len", float(cap))
    taken = taken.withColumn("__part", F.slice(arr_col, 1, F.col("taken").cast("int")))
    parts = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col("__part").alias("__p"))))
    return taken.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda s: s["__p"])).alias(out))


def crossfade_pieces(df: DataFrame, key: str, order: str, arr_col: str, n: int) -> DataFrame:
    """ARR15 in long form ``(key, part, piece)``: an entity's wave is its
    pieces in ``part`` order, so no row holds more than a segment, however many segments an entity has.

    The overlap starts at ``n`` and, as in the reference, keeps shrinking to the
    shortest side seen, which is the running minimum of the sizes.  A segment
    owns the samples after its overlap; the head of the next one fades into its
    last samples.  Where a segment is shorter than ``2 * n``, several heads can
    fade into one sample: only there are samples dealt out by their place, and
    the heads of a place folded in order.  A NULL segment gives a NULL piece."""
    from emoscope.operators.ordered import ordered_scan
    from emoscope.session import ensure_checkpoint_dir
    n = max(n, 0)
    segs = df.select(F.col(key).alias("__key"), F.col(order).alias("__o"), F.col(arr_col).alias("__a"),
                     F.when(F.col(arr_col).isNotNull(), F.size(arr_col)).alias("__n"))
    segs = segs.withColumn("__head", F.struct("__n", F.slice("__a", 1, n).alias("a")))
    segs = ordered_scan(segs, ["__key"], ["__o"], ties=["__a"], row_number="part", running_min=("__n", "__least"),
                        lead=[("__head", "__next")])
    most = F.least(F.lit(n), "__least")
    segs = segs.select("__key", "part", "__n", F.col("__next.__n").alias("__next_n"),
                       F.when(F.col("part") == 1, 0).otherwise(most).alias("__k"),
                       F.coalesce(F.when(F.col("__next.__n").isNotNull(), F.least(most, "__next.__n")), F.lit(0)).alias("__kn"),
                       "__a", F.col("__next.a").alias("__h"))
    own = F.slice("__a", F.col("__k") + 1, F.greatest(F.col("__n") - F.col("__k"), F.lit(0)))
    segs = segs.select("__key", "part", "__kn", F.coalesce(F.slice("__h", 1, F.col("__kn")), F.slice("__a", 1, 0)).alias("__h"), own.alias("__own"),
                       (F.col("__n").isNotNull() & F.coalesce(F.least("__n", "__next_n") < 2 * n, F.lit(False))).alias("__short"))

    def weight(i):
        return F.when(F.col("__kn") > 1, i / F.greatest(F.col("__kn") - 1, F.lit(1)).cast("double")).otherwise(0.0)

    kept = F.size("__own") - F.col("__kn")
    faded = F.transform(F.arrays_zip(F.slice("__own", kept + 1, F.col("__kn")).alias("t"), F.col("__h").alias("h")),
                        lambda x, i: x["t"] * (F.lit(1.0) - weight(i)) + x["h"] * weight(i))
    whole = F.when(F.col("__kn") > 0, F.concat(F.slice("__own", 1, kept), faded)).otherwise(F.col("__own"))
    long = segs.where(~F.col("__short")).select("__key", "part", whole.alias("piece"))

    if not df.where(F.size(arr_col).between(0, 2 * n - 1)).limit(1).count():
        return long.withColumnRenamed("__key", key)
    ensure_checkpoint_dir(df.sparkSession)
    short = segs.where("__short").drop("__short").withColumn("__len", F.size("__own").cast("long")).checkpoint()
    short = ordered_scan(short, ["__key"], ["part"], running_sum=("__len", "__end"))
    steps = F.concat(
        F.transform("__own", lambda x, i: F.struct((F.col("__end") - F.col("__len") + i).alias("p"), F.lit(0).alias("turn"),
                                                   F.lit(1.0).alias("w"), x.alias("x"))),
        F.transform("__h", lambda x, i: F.struct((F.col("__end") - F.col("__kn") + i).alias("p"), F.lit(1).alias("turn"),
                                                 weight(i).alias("w"), x.alias("x"))))
    place = short.select("__key", "part", F.explode(steps).alias("s")).groupBy("__key", F.col("s.p").alias("p")).agg(
        F.array_sort(F.collect_list(F.struct("s.turn", "part", "s.w", "s.x"))).alias("steps"))
    final = F.aggregate(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))), F.element_at("steps", 1)["x"],
                        lambda acc, s: acc * (F.lit(1.0) - s["w"]) + s["x"] * s["w"])
    block = place.select("__key", F.element_at("steps", 1)["part"].alias("part"), "p", final.alias("x"))
    block = block.groupBy("__key", "part").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("xs"))
    none = short.where("__len = 0").select("__key", "part", F.slice("__own", 1, 0).alias("piece"))
    dealt = block.select("__key", "part", F.transform("xs", lambda s: s["x"]).alias("piece"))
    return long.unionByName(dealt).unionByName(none).withColumnRenamed("__key", key)


def crossfade(df: DataFrame, key: str, order: str, arr_col: str, n: int, out: str = "wave") -> DataFrame:
    """ARR15 join one entity's segments (e.g. the chunks of one generated
    utterance) in order with linear cross-fades: the pieces of
    ``crossfade_pieces``, put together once."""
    parts = F.array_sort(F.collect_list(F.struct("part", "piece")))
    wave = F.flatten(F.transform(parts, lambda s: s["piece"]))
    return crossfade_pieces(df, key, order, arr_col, n).groupBy(key).agg(wave.alias(out))
