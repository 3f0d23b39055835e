"""Ordered scans that stay balanced when one key holds a third of the rows.

A window ``PARTITION BY key ORDER BY ...`` sends every row of a key to one
task.  For population keys (user, speaker, source, split) one key can be huge,
so the scans here cut the sequence of ``(keys, order)`` into slices:

1. Slice bounds come from a bounded sample, the rows with the smallest hash of
   ``(keys, order)``.  It is a scalar subquery that gives the same bounds on
   every evaluation; the bounds set the balance, never the result.
2. A row finds its slice by binary search in the bounds.  Native windows over
   ``(keys, slice)`` give the local row number, sum, and neighbours; a hot key
   spans several slices, so no task holds it whole.
3. One aggregate per ``(keys, slice)``, combined on the map side, and a window
   over its rows give what crosses slice borders: counts, sums, neighbours, and
   the last or next value that is not NULL.  Only a key's later slices need it:
   at most one row for each border, joined back on ``(keys, slice)``, by which
   the rows are partitioned already.  A scan without keys has one row a slice,
   which is looked up by its number, without a join.

Everything is a DataFrame expression: no Python, no job at build, no
checkpoint, and values keep their types.  NULL keys form one key; NULLs sort
first in ``order``.

The order must be total (add a unique id as the last order column) so that
results are deterministic when a task is retried.  All order columns ascend;
negate a number to have it descend.

Windows over naturally bounded entities (the turns of one conversation, the
frames of one utterance) use plain Spark windows elsewhere in the library.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled rows for each slice; more only make the slices more even.
SAMPLE_PER_SLICE = 8


def _slice_count(df: DataFrame, num_slices: int | None) -> int:
    """Twice the shuffle partitions, as slices are dealt out by hash."""
    return num_slices or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _bounds(df: DataFrame, place: Column, n: int) -> Column:
    """``n - 1`` ascending bounds of the slices, as one array (empty for no rows)."""
    rows = df.select(place.alias("p")).orderBy(F.xxhash64("p"), "p").limit(n * SAMPLE_PER_SLICE)
    picked = F.transform(F.sequence(F.lit(1), F.lit(n - 1)),
                         lambda i: F.get("a", F.floor(i * F.size("a") / n).cast("int")))
    return (rows.agg(F.array_sort(F.collect_list("p")).alias("a"))
            .select(F.when(F.size("a") > 0, picked)).scalar())


def _with_slice(df: DataFrame, n_keys: int, place: Column, n: int) -> DataFrame:
    """Adds ``__g``: the row's key and slice, the slice being the number of
    bounds at or below the row's place, found by binary search."""
    # a projection a step: a fold would copy the bounds at each step of each row, so rows x slices bytes in all
    out = df.select(*df.columns, place.alias("__p"), _bounds(df, place, n).alias("__b"), F.lit(0).alias("__at"))
    for by in (1 << k for k in reversed(range((n - 1).bit_length()))):
        low = F.get("__b", F.col("__at") + by - 1) <= F.col("__p")  # NULL behind the last bound
        out = out.select(*df.columns, "__p", "__b", (F.col("__at") + F.when(low, by).otherwise(0)).alias("__at"))
    # Catalyst writes a join key out in terms of its sources, which repeats each step in the one above, so slices x
    # slices expressions in the driver; it does not look behind a generator (an outer one, as it filters by others)
    out = out.select(*df.columns, "__p", F.explode_outer(F.array("__at")).alias("__at"))
    # a struct is never NULL, so NULL keys group and join like any other
    key = F.struct(F.lit(0).alias("all"), *[F.col(f"__p.k{i}").alias(f"k{i}") for i in range(n_keys)])
    return out.select(*df.columns, F.struct(key.alias("key"), F.col("__at").alias("slice")).alias("__g"))


def slices_of(df: DataFrame, keys: Sequence[str], by: Sequence[Column], num_slices: int) -> DataFrame:
    """``df`` plus ``__g``, a struct of the row's key and the number of its slice in ``by`` order."""
    place = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
                     *[c.alias(f"o{i}") for i, c in enumerate(by)])
    return _with_slice(df, len(keys), place, num_slices)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    *,
    row_number: str | None = None,
    running_sum: tuple[str, str] | None = None,
    running_min: tuple[str, str] | None = None,
    ties: Sequence[str | Column] = (),
    lag: Iterable[tuple[str, str]] = (),
    lead: Iterable[tuple[str, str]] = (),
    last: Iterable[tuple[str, str]] = (),
    following: Iterable[tuple[str, str]] = (),
    num_partitions: int | None = None,
) -> DataFrame:
    """Add per-key ordered columns without a per-key task.

    ``row_number``  name of a 1-based position within the key.
    ``running_sum`` ``(value_col, out_col)``: inclusive running sum within the
    key, NULL values counting as 0; the type is that of Spark's ``sum``.
    ``running_min`` ``(value_col, out_col)``: inclusive running minimum within
    the key, NULL values left out.
    ``ties`` columns that order rows of equal ``order``; such rows share a slice,
    so the bounds need not hold these columns.
    ``lag`` / ``lead`` ``(col, out_col)`` pairs: the value of the previous /
    next row of the same key (NULL at the key's first / last row).
    ``last`` / ``following`` ``(col, out_col)`` pairs: the last value that is not
    NULL at or before the row / the first one at or after it, within the key.
    ``num_partitions`` is the number of slices.
    """
    keys, lag, lead, last, following = list(keys), list(lag), list(lead), list(last), list(following)
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = slices_of(df, keys, by, _slice_count(df, num_partitions))
    by += [F.col(c) if isinstance(c, str) else c for c in ties]

    value = None
    if running_sum:
        value = F.coalesce(F.col(running_sum[0]), F.lit(0).cast(df.schema[running_sum[0]].dataType))

    ahead = Window.partitionBy("__g").orderBy(*by)
    local = placed.withColumn("__rn", F.row_number().over(ahead).cast("long"))
    if running_sum:
        local = local.withColumn("__cs", F.sum(value).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    if running_min:
        local = local.withColumn("__cm", F.min(running_min[0]).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    for i, (c, _) in enumerate(lag):
        local = local.withColumn(f"__lag{i}", F.lag(c).over(ahead))
    if lead:
        local = local.withColumn("__end", F.lead(F.lit(1)).over(ahead).isNull())
    for i, (c, _) in enumerate(lead):
        local = local.withColumn(f"__lead{i}", F.lead(c).over(ahead))
    # a frame to the end of the slice would be read anew for each row, so the rows run backwards instead
    back = Window.partitionBy("__g").orderBy(F.desc("__rn"))
    for window, pairs, kind in ((ahead, last, "past"), (back, following, "next")):
        for i, (c, _) in enumerate(pairs):
            local = local.withColumn(f"__{kind}{i}", F.last(c, ignorenulls=True).over(
                window.rowsBetween(Window.unboundedPreceding, 0)))

    totals = [F.count(F.lit(1)).alias("n")]
    if running_sum:
        totals.append(F.sum(value).alias("s"))
    if running_min:
        totals.append(F.min(running_min[0]).alias("m"))
    totals += [F.max_by(F.struct(c), F.struct(*by))[c].alias(f"last{i}") for i, (c, _) in enumerate(lag)]
    totals += [F.min_by(F.struct(c), F.struct(*by))[c].alias(f"first{i}") for i, (c, _) in enumerate(lead)]
    for i, (c, _) in enumerate(last):
        totals.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*by))).alias(f"past{i}"))
    for i, (c, _) in enumerate(following):
        totals.append(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*by))).alias(f"next{i}"))
    slices = placed.groupBy("__g").agg(*totals)
    along = Window.partitionBy("__g.key").orderBy("__g.slice")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.sum("n").over(before).alias("__n0")]
    if running_sum:
        carry.append(F.sum("s").over(before).alias("__s0"))
    if running_min:
        carry.append(F.min("m").over(before).alias("__m0"))
    carry += [F.lag(f"last{i}").over(along).alias(f"__last{i}") for i in range(len(lag))]
    carry += [F.lead(f"first{i}").over(along).alias(f"__first{i}") for i in range(len(lead))]
    behind = Window.partitionBy("__g.key").orderBy(F.desc("__g.slice")).rowsBetween(Window.unboundedPreceding, -1)
    carry += [F.last(f"past{i}", ignorenulls=True).over(before).alias(f"__past_{i}") for i in range(len(last))]
    carry += [F.last(f"next{i}", ignorenulls=True).over(behind).alias(f"__next_{i}") for i in range(len(following))]
    later = F.lead(F.lit(1)).over(along).alias("__later")
    carry = slices.select("__g", *carry, later)
    needed = F.col("__n0").isNotNull()
    carry = carry.where(needed | F.col("__later").isNotNull() if lead or following else needed).drop("__later")

    if keys:
        out = local.join(carry, "__g", "left")
    else:  # one sequence: a row for each slice, looked up by the slice's number
        names = [c for c in carry.columns if c != "__g"]
        known = carry.agg(F.map_from_entries(F.collect_list(F.struct("__g.slice", F.struct(*names)))).alias("m"))
        n = _slice_count(df, num_partitions)
        table = known.select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at("m", i))).scalar()
        out = local.withColumn("__c", F.get(table, F.col("__g.slice"))).select("*", *[F.col(f"__c.{c}").alias(c) for c in names])
    extra = []
    if row_number:
        extra.append((F.col("__rn") + F.coalesce("__n0", F.lit(0))).alias(row_number))
    if running_sum:
        extra.append(F.when(F.col("__s0").isNull(), F.col("__cs")).otherwise(F.col("__cs") + F.col("__s0"))
                     .alias(running_sum[1]))
    if running_min:
        extra.append(F.least("__cm", "__m0").alias(running_min[1]))
    for i, (_, name) in enumerate(lag):
        extra.append(F.when(F.col("__rn") == 1, F.col(f"__last{i}")).otherwise(F.col(f"__lag{i}")).alias(name))
    for i, (_, name) in enumerate(lead):
        extra.append(F.when(F.col("__end"), F.col(f"__first{i}")).otherwise(F.col(f"__lead{i}")).alias(name))
    for kind, pairs in (("past", last), ("next", following)):
        extra += [F.coalesce(f"__{kind}{i}", f"__{kind}_{i}").alias(name) for i, (_, name) in enumerate(pairs)]
    return out.select(*df.columns, *extra)


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str = "row_no",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based position in a total order, without a single-task window."""
    return ordered_scan(df, [], order, row_number=name, num_partitions=num_partitions)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                value: str, name: str, num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys`` in ``order``."""
    return ordered_scan(df, keys, order, running_sum=(value, name), num_partitions=num_partitions)


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
               lag: Iterable[tuple[str, str]] = (), lead: Iterable[tuple[str, str]] = (),
               num_partitions: int | None = None) -> DataFrame:
    """Previous / next value within the key (``lag`` / ``lead`` of one row)."""
    return ordered_scan(df, keys, order, lag=lag, lead=lead, num_partitions=num_partitions)


def key_sizes(df: DataFrame, keys: Sequence[str], name: str = "key_rows") -> DataFrame:
    """Rows per key, joined back; a plain aggregate (partial counts map-side)."""
    if not keys:
        # scalar subquery: the total is computed once and read as a constant
        return df.withColumn(name, df.groupBy().agg(F.count(F.lit(1))).scalar())
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return df.join(sizes, on=list(keys), how="inner")


__all__ = ["ordered_scan", "slices_of", "global_row_number", "running_sum", "neighbours", "key_sizes"]
