"""Ranking, numbering and running-window operators (WIN01-WIN06, WIN09-WIN19).

Top-N per group uses ``row_number() <= N``: Spark inserts a partial
``WindowGroupLimit`` before the shuffle, so at most N rows per group and map
partition travel, even for a hot group.  Numbering and running sums over
population keys use the range-sharded scan of ``ordered.py``.  Windows over
one bounded entity (a conversation, an utterance) are plain windows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emoscope.functions.hashing import stable_hash
from emoscope.operators.ordered import global_row_number, key_sizes, ordered_scan


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int,
          rank_col: str = "rank") -> DataFrame:
    """WIN01 top-N rows per group; ``order`` must end with a unique tie-break."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def head_n(df: DataFrame, keys: Sequence[str], line_col: str, n: int) -> DataFrame:
    """WIN02 first N rows in file order per group."""
    return top_n(df, keys, [F.col(line_col)], n, "__rn").drop("__rn")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "row_no",
                fmt: str | None = None) -> DataFrame:
    """WIN03 consecutive numbers 1..n (per key, or global when no keys),
    optionally formatted (``sample_%06d``)."""
    if keys:
        out = ordered_scan(df, keys, order, row_number=name)
    else:
        out = global_row_number(df, order, name)
    if fmt:
        out = out.withColumn(name + "_label", F.format_string(fmt, F.col(name)))
    return out


def running_offset(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], size: str,
                   name: str = "offset") -> DataFrame:
    """WIN04 exclusive prefix sum of ``size`` (the start offset of each row)."""
    out = ordered_scan(df, keys, order, running_sum=(size, "__incl"))
    return out.withColumn(name, (F.col("__incl") - F.col(size)).cast("bigint")).drop("__incl")


def take_until(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], length: str,
               cap: float) -> DataFrame:
    """WIN05 take rows in order until the total reaches ``cap``; the last one
    taken is cut (``taken`` = the part of it that fits)."""
    out = ordered_scan(df, keys, order, running_sum=(length, "__incl"))
    prev = F.col("__incl") - F.col(length)
    return (out.where(prev < cap)
            .withColumn("taken", F.least(F.col(length).cast("double"), F.lit(float(cap)) - prev))
            .drop("__incl"))


def clip_segments(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], length: str,
                  soft: float = 6.0, hard: float = 12.0) -> DataFrame:
    """WIN06 keep segments in order; stop at the first segment that would be
    added when more than ``soft`` is already taken and the total would pass
    ``hard``.  ``clipped_total`` is the kept total cut at ``hard``."""
    out = ordered_scan(df, keys, order, running_sum=(length, "__incl"))
    prev = F.col("__incl") - F.col(length)
    stop = (prev > soft) & (F.col("__incl") > hard)
    # rows from the first stop on are dropped: running count of stops within the key
    flagged = out.withColumn("__stop", stop.cast("double"))
    flagged = ordered_scan(flagged, keys, order, running_sum=("__stop", "__stops"))
    kept = flagged.where(F.col("__stops") == 0).drop("__stop", "__stops")
    return kept.withColumn("kept_total", F.col("__incl")).withColumn(
        "clipped_total", F.least(F.col("__incl"), F.lit(hard))).drop("__incl")


def split_even(df: DataFrame, order: Sequence[Column | str], k: int, keys: Sequence[str] = (),
               name: str = "part") -> DataFrame:
    """WIN09 k contiguous parts, the first ``n mod k`` one row larger (the
    ``ntile`` rule), without a single-task window."""
    numbered = number_rows(df, keys, order, "__rn")
    sized = key_sizes(numbered, list(keys), "__n")
    base = F.floor(F.col("__n") / k)
    extra = F.col("__n") % k
    rn0 = F.col("__rn") - 1
    big = extra * (base + 1)
    part = F.when(rn0 < big, F.floor(rn0 / (base + 1))).otherwise(extra + F.floor((rn0 - big) / F.greatest(base, F.lit(1))))
    return sized.withColumn(name, part.cast("int")).drop("__rn", "__n")


def split_block(df: DataFrame, order: Sequence[Column | str], k: int, name: str = "part") -> DataFrame:
    """WIN10 contiguous parts of ``n // k + 1`` rows."""
    numbered = number_rows(df, [], order, "__rn")
    sized = key_sizes(numbered, [], "__n")
    size = F.floor(F.col("__n") / k) + 1
    return sized.withColumn(name, F.floor((F.col("__rn") - 1) / size).cast("int")).drop("__rn", "__n")


def split_fixed(df: DataFrame, order: Sequence[Column | str], n: int, name: str = "batch") -> DataFrame:
    """WIN11 fixed-size batches of ``n`` rows in order."""
    numbered = number_rows(df, [], order, "__rn")
    return numbered.withColumn(name, F.floor((F.col("__rn") - 1) / n).cast("int")).drop("__rn")


def dedupe_text(df: DataFrame, text_col: str, order: Sequence[Column | str]) -> DataFrame:
    """WIN13 keep the first row per normalised text (lower(trim)).  First per
    key is a ``min_by`` aggregate: partial per map partition, so a text with
    many copies never sorts in one task."""
    key = F.lower(F.trim(F.col(text_col)))
    cols = df.columns
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return (df.groupBy(key.alias("__norm"))
            .agg(F.min_by(F.struct(*cols), rank).alias("__row"))
            .select("__row.*"))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], col: str,
                  name: str | None = None) -> DataFrame:
    """WIN14 carry the last non-NULL value forward within a key, by the
    range-sharded scan: a key may be a segment's script or a whole population."""
    out = ordered_scan(df, keys, order, last=[(col, "__carried")])
    columns = [c for c in df.columns if c != name]
    if not name:
        return out.select(*[F.col("__carried").alias(c) if c == col else c for c in columns])
    return out.select(*columns, F.col("__carried").alias(name))


def shuffle_order(df: DataFrame, id_col: str, seed: int, epoch: int = 0, name: str = "shuffle_key") -> DataFrame:
    """WIN15 deterministic epoch-seeded order: a hash key (sort on it when
    writing; no global sort is forced here)."""
    return df.withColumn(name, stable_hash(id_col, seed + epoch))


def sort_by_cost(df: DataFrame, cost: str, id_col: str) -> DataFrame:
    """WIN17 descending estimated cost (range-partitioned global sort)."""
    return df.orderBy(F.desc(cost), F.asc(id_col))


def assemble_conversation(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                          text: str = "text", assistant: str = "assistant") -> DataFrame:
    """WIN16 the turns of each conversation in order (an entity-sized array),
    the last turn when it is by the assistant, and a blank guard turn."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"),
                                                 F.col(text).alias("content"))))
    out = df.groupBy(conv).agg(turns.alias("messages"), F.max_by(F.struct(role, text), turn).alias("__last"))
    last_assistant = F.when(F.col("__last")[role] == assistant, F.col("__last")[text])
    guard = F.array(F.struct(F.lit(None).cast("bigint").alias("turn"), F.lit(assistant).alias("role"),
                             F.lit("").alias("content")))
    return (out.withColumn("last_assistant", last_assistant)
            .withColumn("with_guard", F.concat("messages", guard)).drop("__last"))


def best_reference(df: DataFrame, speaker: str, emotion: str, duration: str, id_col: str, n: int,
                   lo: float = 3.0, hi: float = 10.0, target: float = 6.5, seed: int = 0) -> DataFrame:
    """WIN18 quality-scored references: score ``10 - |target - d|`` among
    lo..hi seconds, the best file per speaker x emotion (first file when none
    is in range), then up to ``n`` speakers per emotion in hashed speaker
    order.  Both steps are top-N windows with partial pre-limits."""
    in_range = F.col(duration).between(lo, hi)
    score = F.when(in_range, F.lit(10.0) - F.abs(F.lit(target) - F.col(duration))).otherwise(F.lit(None))
    scored = df.withColumn("score", score)
    per_spk = top_n(scored, [speaker, emotion],
                    [F.col("score").desc_nulls_last(), F.col(id_col)], 1, "__r1").drop("__r1")
    ranked = top_n(per_spk, [emotion], [stable_hash(speaker, seed), F.col(speaker)], n, "pick")
    return ranked


def next_valid(df: DataFrame, order: Sequence[Column | str], valid: Column, cols: Sequence[str]) -> DataFrame:
    """WIN19 replace an invalid row (NULL counts as invalid) by the next valid
    one, wrapping to the first valid row at the end; without any valid row the
    columns are NULL.  One range-sharded scan carries the next valid row's
    columns backwards, so a long run of invalid rows meets no join and no key."""
    by = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    flagged = df.withColumn("__v", F.when(F.coalesce(valid, F.lit(False)), F.struct(*cols)))
    first = flagged.groupBy().agg(F.min_by("__v", F.when(F.col("__v").isNotNull(), by))).scalar()
    out = ordered_scan(flagged, [], order, following=[("__v", "__next")])
    out = out.withColumn("__next", F.coalesce("__next", first))
    return out.select(*[F.col(f"__next.{c}").alias(c) if c in cols else c for c in df.columns])
