"""Classification metrics and association tests (AGG01-AGG11).

Design: every metric starts from one grouped count (partial aggregation on
the map side, so the shuffle carries at most groups x labels rows), and the
rest is arithmetic on that small table.  Per-class counts come from a single
pass in which each row contributes to its true label and to its predicted
label; no join and no cross product is needed.  Zero-count cells are made only
where the result is the full matrix; chi-square needs the seen cells alone.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _one():
    return F.lit(1.0).cast("double")


def _keys(by: Sequence[str] | None) -> list[str]:
    return list(by or [])


def confusion(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (),
              label_cols: Sequence[str] = ()) -> DataFrame:
    """AGG01 long-form confusion matrix ``(by..., actual, predicted, n)``.

    Without ``label_cols`` cells with zero count are implicit (absent rows).
    With them, every group gets the full matrix over the labels found in any of
    those columns, zero cells included; the label list is one scalar, as long
    as the label cardinality.  Rows with a NULL label keep their own cell."""
    keys = _keys(by)
    if not label_cols:
        return (df.groupBy(*keys, F.col(y).alias("actual"), F.col(yhat).alias("predicted"))
                .agg(F.count(F.lit(1)).alias("n")))
    # the rows are counted once; labels, groups and cells all come from those counts, each reading them with ``_n``
    # so that the three share one exchange
    seen = (df.select(*keys, F.col(y).alias("actual"), F.col(yhat).alias("predicted"),
                      F.array(*[F.col(c) for c in label_cols]).alias("_seen"))
            .groupBy(*keys, "actual", "predicted", "_seen").agg(F.count(F.lit(1)).alias("_n")).where("_n > 0"))
    # explode would have its filter (array not empty) pushed below the counts, so that the rows are made and counted again
    known = (seen.select(F.explode_outer("_seen").alias("label")).where("label is not null").distinct()
             .agg(F.array_sort(F.collect_list("label"))).scalar())
    groups = seen.select(*keys).distinct() if keys else seen.groupBy().agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    groups = groups.withColumn("_labels", known)
    zeros = (groups.select(*keys, F.explode("_labels").alias("actual"), "_labels")
             .select(*keys, "actual", F.explode("_labels").alias("predicted"), F.lit(0).cast("long").alias("n")))
    cells = seen.select(*keys, "actual", "predicted", F.col("_n").alias("n"))
    return cells.unionByName(zeros).groupBy(*keys, "actual", "predicted").agg(F.sum("n").alias("n"))


def accuracy(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), name: str = "accuracy") -> DataFrame:
    """AGG02 share of rows with ``y == yhat`` (NULL-safe: NULL never matches)."""
    hit = F.when(F.col(y) == F.col(yhat), _one()).otherwise(F.lit(0.0))
    return df.groupBy(*_keys(by)).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias(name))


def per_class(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (),
              labels: Sequence[str] | None = None) -> DataFrame:
    """Per (group, label): support, predicted, tp, precision, recall, f1.

    Labels are those seen in ``y`` or ``yhat`` of the group; with ``labels``
    given, exactly those labels (zero rows added, others dropped), matching
    ``f1_score(labels=...)``.  Undefined ratios are 0 (``zero_division=0``).
    """
    keys = _keys(by)
    roles = F.array(
        F.struct(F.col(y).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                 F.when(F.col(y) == F.col(yhat), 1).otherwise(0).alias("tp")),
        F.struct(F.col(yhat).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")),
    )
    long = df.select(*keys, F.inline(roles))
    if labels is not None:
        fixed = F.array(*[F.lit(x) for x in labels])
        long = long.where(F.array_contains(fixed, F.col("label")))
        zeros = (df.select(*keys).distinct()
                 .select(*keys, F.explode(fixed).alias("label"), F.lit(0).alias("t"), F.lit(0).alias("p"),
                         F.lit(0).alias("tp")))
        long = long.unionByName(zeros)
    counts = long.groupBy(*keys, "label").agg(
        F.sum("t").cast("bigint").alias("support"),
        F.sum("p").cast("bigint").alias("predicted"),
        F.sum("tp").cast("bigint").alias("tp"))
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    out = counts.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(F.lit(0.0))
    return out.withColumn("f1", f1)


def f1_macro(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (),
             labels: Sequence[str] | None = None) -> DataFrame:
    """AGG03 macro F1: mean over labels (zero-support labels count as 0)."""
    pc = per_class(df, y, yhat, by, labels)
    return pc.groupBy(*_keys(by)).agg(F.avg("f1").alias("f1_macro"), F.count(F.lit(1)).alias("n_labels"))


def classification_report(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (),
                          labels: Sequence[str] | None = None) -> DataFrame:
    """AGG04 per-class rows plus ``accuracy``, ``macro avg``, ``weighted avg``
    rows, in the layout of a classification report (long form)."""
    keys = _keys(by)
    pc = per_class(df, y, yhat, by, labels)
    cls = pc.select(*keys, F.col("label").alias("row"), "precision", "recall", "f1", "support")
    summ = pc.groupBy(*keys).agg(
        F.avg("precision").alias("m_p"), F.avg("recall").alias("m_r"), F.avg("f1").alias("m_f"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("w_p"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("w_r"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("w_f"),
        F.sum("support").alias("total"),
        (F.sum("tp") / F.sum("support")).alias("acc"))
    rows = F.array(
        F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"), F.col("total").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), F.col("m_p").alias("precision"), F.col("m_r").alias("recall"),
                 F.col("m_f").alias("f1"), F.col("total").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), F.col("w_p").alias("precision"), F.col("w_r").alias("recall"),
                 F.col("w_f").alias("f1"), F.col("total").alias("support")),
    )
    return cls.unionByName(summ.select(*keys, F.inline(rows)))


def wa_ua_f1(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG05 weighted accuracy, unweighted accuracy (mean recall over classes
    with support) and support-weighted F1, each x100."""
    pc = per_class(df, y, yhat, by)
    return pc.groupBy(*_keys(by)).agg(
        (F.sum("tp") / F.sum("support") * 100).alias("wa"),
        (F.avg(F.when(F.col("support") > 0, F.col("recall"))) * 100).alias("ua"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support") * 100).alias("wf1"))


def error_attribution(df: DataFrame, by: Sequence[str] = (), wav="wav_emo", txt="txt_emo",
                      pred="pred_emo", cond="txt_cond") -> DataFrame:
    """AGG07 of the wrong answers, the share that equals the text label, and
    that share split by implicit / explicit text.  NULL when no errors."""
    err = F.col(wav) != F.col(pred)
    follows = err & (F.col(txt) == F.col(pred))
    n_err = F.sum(F.when(err, 1).otherwise(0))

    def share(cond_col):
        return F.try_divide(F.sum(F.when(cond_col, 1).otherwise(0)).cast("double"), n_err.cast("double"))

    return df.groupBy(*_keys(by)).agg(
        n_err.cast("bigint").alias("errors"),
        share(follows).alias("err_follow_text"),
        share(follows & (F.col(cond) == "implicit")).alias("err_follow_text_implicit"),
        share(follows & (F.col(cond) == "explicit")).alias("err_follow_text_explicit"))


def metrics_by(df: DataFrame, by: Sequence[str], wav="wav_emo", txt="txt_emo", pred="pred_emo",
               cond="txt_cond") -> DataFrame:
    """AGG06 grouped accuracy, proxy accuracy and error attribution in one
    aggregate (one shuffle of partial sums)."""
    hit = F.when(F.col(wav) == F.col(pred), _one()).otherwise(F.lit(0.0))
    hit_txt = F.when(F.col(txt) == F.col(pred), _one()).otherwise(F.lit(0.0))
    err = F.col(wav) != F.col(pred)
    follows = err & (F.col(txt) == F.col(pred))
    n_err = F.sum(F.when(err, 1).otherwise(0))

    def share(c):
        return F.try_divide(F.sum(F.when(c, 1).otherwise(0)).cast("double"), n_err.cast("double"))

    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit).alias("accuracy"),
        F.avg(hit_txt).alias("accuracy_proxy"),
        n_err.cast("bigint").alias("errors"),
        share(follows).alias("err_follow_text"),
        share(follows & (F.col(cond) == "implicit")).alias("err_follow_text_implicit"),
        share(follows & (F.col(cond) == "explicit")).alias("err_follow_text_explicit"))


def crosstab(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG08 contingency table in long form ``(by..., a, b, n)``."""
    return df.groupBy(*_keys(by), a, b).agg(F.count(F.lit(1)).alias("n"))


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """RSH02 the matrix at the edge: pivot with an explicit value list (no
    extra job to discover values), zeros filled."""
    wide = df.groupBy(a).pivot(b, list(values)).agg(F.count(F.lit(1)))
    return wide.fillna(0, subset=list(values))


def crosstab_norm(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG09 column-normalised contingency table ``n / sum(n) per b``.  The
    window runs over the aggregated table (groups x labels rows)."""
    keys = _keys(by)
    ct = crosstab(df, a, b, by)
    w = Window.partitionBy(*keys, b)
    return ct.withColumn("share", F.col("n") / F.sum("n").over(w))


def _chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution: Q(dof/2, stat/2)."""
    out = []
    for x, k in zip(stat.to_numpy(dtype=float), dof.to_numpy(dtype=float)):
        out.append(_gammaincc(k / 2.0, x / 2.0) if k > 0 and np.isfinite(x) else float("nan"))
    return pd.Series(out)


def _gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma (series below a+1, Lentz continued
    fraction above)."""
    import math
    if x <= 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        ap = a
        for _ in range(1000):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return 1.0 - total * math.exp(-x + a * math.log(x) - gln)
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def _margins(cells: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Cells with their row and column totals (windows over the counted table)."""
    return (cells.withColumn("_ra", F.sum("n").over(Window.partitionBy(*keys, a)))
            .withColumn("_cb", F.sum("n").over(Window.partitionBy(*keys, b))))


def expected_counts(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG10 ``(by..., actual, predicted, n, expected)`` for every label pair of
    a group, zero cells included: expected = row total x column total / n.
    Labels are those of both columns; a label absent from a margin expects 0."""
    keys = _keys(by)
    cells = _margins(confusion(df, a, b, by, label_cols=[a, b]), "actual", "predicted", keys)
    cells = cells.withColumn("_tot", F.sum("n").over(Window.partitionBy(*keys)))
    if keys:  # a group with a NULL key is left out; asked of the total, as the filter must not reach the shared counts
        some = F.lit(True)
        for k in keys:
            some = some & F.col(k).isNotNull()
        cells = cells.withColumn("_tot", F.when(some, F.col("_tot"))).where("_tot is not null")
    return cells.withColumn("expected", F.col("_ra") * F.col("_cb") / F.col("_tot")).drop("_ra", "_cb", "_tot")


def chi2_test(df: DataFrame, a: str, b: str, by: Sequence[str] = (), correction: bool = True) -> DataFrame:
    """AGG10 Pearson chi-square of the a x b table: statistic, dof, p-value.

    With row totals r, column totals c and N rows, chi2 = N * (sum(n^2 / (r c)) - 1),
    and the sum needs the seen cells only, so no zero cell is made.  In a 2 x 2
    table every cell is equally far from its expected count, so the Yates
    correction (only at dof 1, as usual) needs one cell's distance d:
    max(d - 0.5, 0)^2 * N * sum(1 / r) * sum(1 / c).  The p-value is the only
    Python step (one row per group, Arrow-batched)."""
    keys = _keys(by)
    cells = _margins(crosstab(df, a, b, by), a, b, keys)
    n, r, c = F.col("n").cast("double"), F.col("_ra"), F.col("_cb")
    stat = cells.groupBy(*keys).agg(
        F.sum("n").alias("n_total"), F.sum(n * n / r / c).alias("_q"),
        F.round(F.sum(n / r)).cast("int").alias("n_rows"), F.round(F.sum(n / c)).cast("int").alias("n_cols"),
        F.sum(n / r / r).alias("_ir"), F.sum(n / c / c).alias("_ic"),
        F.min(F.struct("n", "_ra", "_cb")).alias("_one"))
    dof = ((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).cast("bigint")
    chi2 = F.greatest(F.lit(0.0), F.col("n_total") * (F.col("_q") - 1))
    if correction:
        off = F.abs(F.col("_one.n") - F.col("_one._ra") * F.col("_one._cb") / F.col("n_total"))
        yates = F.pow(F.greatest(off - 0.5, F.lit(0.0)), 2) * F.col("n_total") * F.col("_ir") * F.col("_ic")
        chi2 = F.when(dof == 1, yates).otherwise(chi2)
    sf = F.pandas_udf(_chi2_sf, "double")
    out = stat.select(*keys, chi2.alias("chi2"), dof.alias("dof"), "n_total", "n_rows", "n_cols")
    return out.withColumn("p_value", sf(F.col("chi2"), F.col("dof")))


def cramers_v(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG11 Cramer's V ``sqrt(chi2 / n / (min(r, c) - 1))`` without the
    continuity correction."""
    t = chi2_test(df, a, b, by, correction=False)
    v = F.sqrt(F.col("chi2") / F.col("n_total") / (F.least("n_rows", "n_cols") - 1))
    return t.withColumn("cramers_v", v)


def label_domain(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SET03 distinct labels over several columns."""
    return df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("label")).where(
        F.col("label").isNotNull()).distinct()


def same_labels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG28 one row: do all columns carry the same label set?  Counted per
    label (partial aggregates), so no set is gathered in one row."""
    seen = F.inline(F.array(*[F.struct(F.col(c).alias("label"), F.lit(i).alias("i")) for i, c in enumerate(cols)]))
    of = [F.max(F.col("i") == i).alias(f"s{i}") for i in range(len(cols))]
    per_label = df.select(seen).where(F.col("label").isNotNull()).groupBy("label").agg(*of)
    every = F.lit(True)
    for i in range(len(cols)):
        every = every & F.col(f"s{i}")
    return per_label.agg(F.coalesce(F.bool_and(every), F.lit(True)).alias("same_labels"),
                         F.count_if("s0").cast("int").alias("n_labels"))
