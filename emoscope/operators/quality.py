"""Filters and data-quality predicates (FLT01-FLT14, AGG27).

Filters are native predicates, so Catalyst pushes the column ones into the
parquet scan.  Block lists and file inventories are joined, not collected:
a semi / anti join lets the optimizer broadcast a small side and shuffle a
large one.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_labels(df: DataFrame, col: str, labels: Sequence[str]) -> DataFrame:
    """FLT01 keep rows whose label is in the set."""
    return df.where(F.col(col).isin(list(labels)))


def keep_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """FLT02 inclusive range (0.4-30, 0.3-30, 1-30, 3-10 in the reference)."""
    return df.where(F.col(col).between(lo, hi))


def keep_min_len(df: DataFrame, col: str, n: int, trim: bool = False) -> DataFrame:
    """FLT03 minimum character length, before or after trimming."""
    c = F.trim(F.col(col)) if trim else F.col(col)
    return df.where(F.char_length(c) >= n)


def drop_blocklist(df: DataFrame, id_col: str | Column, blocklist: DataFrame, block_col: str = "id") -> DataFrame:
    """FLT04 drop rows whose id is in a block-list table (left anti join; the
    optimizer broadcasts the list when its statistics say it is small)."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    left = df.withColumn("__bid", key)
    right = blocklist.select(F.col(block_col).alias("__bid")).distinct()
    return left.join(right, "__bid", "left_anti").drop("__bid")


def contains_any(col: str | Column, needles: Sequence[str]) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    cond = F.lit(False)
    for s in needles:
        cond = cond | F.contains(c, F.lit(s))
    return cond


def drop_contains_any(df: DataFrame, col: str, needles: Sequence[str]) -> DataFrame:
    """FLT05 drop rows containing any of the substrings (OR of ``contains``)."""
    return df.where(~contains_any(col, needles))


def repetition_hits(df: DataFrame, id_col: str, col: str, n: int = 2, tolerance: int = 10) -> DataFrame:
    """FLT06 ids of rows where some n-gram of characters occurs more than
    ``tolerance`` times (overlapping count).

    A row's own n-grams are sorted, so one that occurs more than ``tolerance``
    times stands that many places apart from itself: no n-gram leaves its row, and
    a task holds the n-grams of one text.  Only rows that share their id have
    them counted together as well.  Whole texts are scanned."""
    # n-grams from the character array, materialised once per row: element
    # access is O(1), so a text of k characters costs O(k * n)
    def grams(c: Column) -> Column:
        k = F.size(c) - n + 1
        starts = F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*[F.element_at(c, i + j) for j in range(n)]))

    def apart(s: Column) -> Column:
        far = F.size(s) - tolerance
        return F.when(far >= 1, F.exists(F.sequence(F.lit(0), far - 1), lambda i: F.get(s, i) == F.get(s, i + tolerance))).otherwise(False)

    # arrays are bound as lambda variables: a filter on a column made of them would make them anew at each place
    texts = df.select(F.struct(id_col).alias("__id"), F.col(col).alias("__t"))
    ordered = F.transform(F.array(F.split("__t", "")), lambda c: F.sort_array(grams(c)))
    own = texts.where(F.exists(ordered, apart)).select("__id")
    repeated = df.groupBy(F.struct(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__id")
    both = texts.join(repeated, "__id", "left_semi").select("__id", F.split("__t", "").alias("__c"))
    counts = both.select("__id", F.explode(grams(F.col("__c"))).alias("__g")).groupBy("__id", "__g").agg(F.count(F.lit(1)).alias("__n"))
    shared = counts.where(F.col("__n") > tolerance).select("__id")
    return own.unionByName(shared).select(F.col(f"__id.{id_col}").alias(id_col)).distinct()


def drop_repetitive(df: DataFrame, id_col: str, col: str, n: int = 2, tolerance: int = 10) -> DataFrame:
    """FLT06 as a filter: anti join against the repetition hits."""
    return df.join(repetition_hits(df, id_col, col, n, tolerance), id_col, "left_anti")


def keep_existing(df: DataFrame, path_col: str, inventory: DataFrame, inv_col: str = "path") -> DataFrame:
    """FLT07 keep rows whose file is in the inventory (left semi join)."""
    inv = inventory.select(F.col(inv_col).alias("__p"))
    return df.join(inv, df[path_col] == inv["__p"], "left_semi")


def missing_files(df: DataFrame, path_col: str, inventory: DataFrame, inv_col: str = "path") -> DataFrame:
    """FLT08 rows whose file is missing (the strict variant fails on them)."""
    inv = inventory.select(F.col(inv_col).alias("__p"))
    return df.join(inv, df[path_col] == inv["__p"], "left_anti")


def assert_existing(df: DataFrame, path_col: str, inventory: DataFrame, inv_col: str = "path") -> DataFrame:
    """FLT08 strict: raises at run time when any file is missing."""
    miss = missing_files(df, path_col, inventory, inv_col)
    # the guard depends on scalar subqueries over the anti join, so neither
    # column pruning nor filter push-down can move or drop it
    n_missing = miss.groupBy().agg(F.count(F.lit(1))).scalar()
    example = miss.select(F.min(path_col)).scalar()
    guard = F.when(n_missing > 0, F.raise_error(F.concat(F.lit("missing file: "), example)))
    return df.where(guard.isNull())


def slice_predictions(df: DataFrame, kind: str | None = None, slm: str | None = None,
                      txt_cond: str | None = None, lbl_col: str = "lbl_full") -> DataFrame:
    """FLT10 conjunctive slice: congruent / proxy x model x text condition."""
    cond = F.lit(True)
    if kind:
        cond = cond & F.col(lbl_col).contains(kind)
    if slm:
        cond = cond & (F.col("slm") == slm)
    if txt_cond:
        cond = cond & (F.col("txt_cond") == txt_cond)
    return df.where(cond)


def quality_gate(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """FLT11 reject ledger: ``reason`` is the first failing rule (in order),
    NULL for accepted rows.  ``rules`` are ``(reason, failure_predicate)``."""
    expr = None
    for reason, failed in rules:
        expr = F.when(failed, F.lit(reason)) if expr is None else expr.when(failed, F.lit(reason))
    return df.withColumn("reason", expr)


def accepted(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("reason").isNull()).drop("reason")


def rejected(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("reason").isNotNull())


def subsample(df: DataFrame, fraction: float, seed: int, id_col: str | None = None) -> DataFrame:
    """FLT12 random subsample.  With ``id_col`` the draw is a hash threshold
    (reproducible across engines and retries); else Bernoulli ``sample``."""
    if id_col is None:
        return df.sample(False, fraction, seed)
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10)
    return df.where(h.cast("double") / F.lit(float(16 ** 8)) < F.lit(fraction))


def reject_counts(ledger: DataFrame, by: str = "lang") -> DataFrame:
    """FLT13 per-group count of rejected rows (and total rows)."""
    return ledger.groupBy(by).agg(F.count_if(F.col("reason").isNotNull()).alias("rejected"),
                                  F.count(F.lit(1)).alias("total"))


def drop_label(df: DataFrame, col: str, value: str) -> DataFrame:
    """FLT14 exclude one class, case-insensitively."""
    return df.where(F.lower(F.col(col)) != value.lower())


def validate_table(df: DataFrame, text_col: str, line_col: str, class_col: str,
                   required: Sequence[str], min_len: int = 10, max_line: int | None = None) -> DataFrame:
    """AGG27 dataset validation: one row with the issue list.

    Issues: missing required classes, short texts (< ``min_len``), empty
    texts, duplicate (line, class) pairs, line numbers out of range.  One
    aggregate pass; missing classes come from a set bounded by ``required``.
    Duplicates are counted per (line, class) so the wide-table defect of the
    reference (one line feeding several columns) is not flagged."""
    req = F.array(*[F.lit(r) for r in required])
    # the set collected holds only required classes, so it is bounded by len(required)
    seen = F.collect_set(F.when(F.array_contains(req, F.col(class_col)), F.col(class_col)))
    out = df.agg(
        F.count_if(F.char_length(F.trim(text_col)) == 0).alias("empty_texts"),
        F.count_if((F.char_length(F.trim(text_col)) > 0) & (F.char_length(F.trim(text_col)) < min_len)).alias("short_texts"),
        (F.count(F.lit(1)) - F.count_distinct(F.struct(line_col, class_col))).alias("duplicate_lines"),
        F.count_if((F.col(line_col) < 0) | (F.lit(max_line).isNotNull() & (F.col(line_col) > F.lit(max_line))))
        .alias("out_of_range"),
        F.array_sort(F.array_except(req, seen)).alias("missing_classes"),
    )
    issues = F.array_compact(F.array(
        F.when(F.size("missing_classes") > 0, F.concat(F.lit("missing classes: "), F.array_join("missing_classes", ","))),
        F.when(F.col("short_texts") > 0, F.format_string("short texts: %d", F.col("short_texts"))),
        F.when(F.col("empty_texts") > 0, F.format_string("empty texts: %d", F.col("empty_texts"))),
        F.when(F.col("duplicate_lines") > 0, F.format_string("duplicate lines: %d", F.col("duplicate_lines"))),
        F.when(F.col("out_of_range") > 0, F.format_string("line out of range: %d", F.col("out_of_range"))),
    ))
    return out.withColumn("issues", F.when(F.size(issues) == 0, F.array(F.lit("none found"))).otherwise(issues))
