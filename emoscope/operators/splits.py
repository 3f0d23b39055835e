"""Train / validation / test splits and sampling (SPL01-SPL06).

Random draws are hashes of ``(id, seed)``, so a split is reproducible on
retry and in any engine.  Exact split sizes need ranks within a stratum; those
come from the range-sharded scan, so a stratum with a third of the rows is
still spread over many tasks.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emoscope.functions.hashing import stable_hash
from emoscope.operators.ordered import key_sizes, ordered_scan
from emoscope.operators.ranking import running_offset, top_n


def _h(id_col: str, seed: int) -> Column:
    return stable_hash(id_col, seed)


def holdout_top_n(df: DataFrame, strata: Sequence[str], order: Sequence[Column], n: int,
                  id_col: str) -> tuple[DataFrame, DataFrame]:
    """SPL01 test = top-N per stratum (e.g. 30 longest), rest = all minus test
    by key (anti join; no positional leak)."""
    test = top_n(df, strata, order, n, "__rank").drop("__rank")
    rest = df.join(test.select(id_col), id_col, "left_anti")
    return rest, test


def stratified_split(df: DataFrame, strata: Sequence[str], id_col: str, test_frac: float,
                     seed: int) -> DataFrame:
    """SPL02 within each stratum, rows in hash order; the first
    ``ceil(test_frac * n)`` go to ``val``, the rest to ``train``."""
    keyed = df.withColumn("__h", _h(id_col, seed))
    ranked = ordered_scan(keyed, strata, ["__h", id_col], row_number="__rn")
    sized = key_sizes(ranked, strata, "__n")
    n_test = F.ceil(F.col("__n") * test_frac)
    return sized.withColumn("split", F.when(F.col("__rn") <= n_test, "val").otherwise("train")) \
        .drop("__h", "__rn", "__n")


def random_split(df: DataFrame, id_col: str, frac: float, seed: int) -> DataFrame:
    """SPL03 sizes ``int(frac * n)`` and the rest, by hash order."""
    keyed = df.withColumn("__h", _h(id_col, seed))
    ranked = ordered_scan(keyed, [], ["__h", id_col], row_number="__rn")
    n = df.groupBy().agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn("split", F.when(F.col("__rn") <= F.floor(n * frac), "train").otherwise("val")) \
        .drop("__h", "__rn")


def fold_split(df: DataFrame, line_col: str, start: int, end: int, size: str) -> DataFrame:
    """SPL04 leave one contiguous fold out: rows with ``start <= line < end``
    are ``test``; the offsets of the remaining rows are recomputed."""
    tagged = df.withColumn("split", F.when(F.col(line_col).between(start, end - 1), "test").otherwise("train_val"))
    return running_offset(tagged, ["split"], [line_col], size, "offset")


def mix_corpora(df: DataFrame, corpus_col: str, fractions: Mapping[str, float], id_col: str,
                seed: int) -> DataFrame:
    """SPL05 weighted sampling from several corpora: keep a row of corpus c
    when its hash draw is below ``fractions[c]`` (hash threshold, so the
    sample is reproducible; ``sampleBy`` is the Bernoulli equivalent)."""
    frac = F.create_map(*[F.lit(x) for kv in fractions.items() for x in kv])
    u = _h(id_col, seed).cast("double") / F.lit(float(16 ** 15))
    return df.where(u < F.coalesce(F.try_element_at(frac, F.col(corpus_col)), F.lit(0.0)))


def read_split_list(lines: DataFrame, col: str = "value", default_speaker: str = "0") -> DataFrame:
    """SPL06 ``path|text|speaker`` lines; speaker defaults to ``0``."""
    parts = F.split(F.col(col), r"\|")
    return lines.select(F.get(parts, 0).alias("path"), F.get(parts, 1).alias("text"),
                        F.coalesce(F.get(parts, 2), F.lit(default_speaker)).alias("speaker"))
