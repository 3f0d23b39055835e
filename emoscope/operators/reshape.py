"""Reshape and set operations (RSH01-RSH02, SET01-SET04)."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt_sentences(df: DataFrame, ids: Sequence[str], value_cols: Sequence[str],
                   var_name: str = "csv_column", value_name: str = "text") -> DataFrame:
    """RSH01 wide -> long with NULL values dropped, ids (row number) kept."""
    long = df.unpivot(list(ids), list(value_cols), var_name, value_name)
    return long.where(F.col(value_name).isNotNull())


def union_predictions(dfs: Sequence[DataFrame]) -> DataFrame:
    """SET01 union of differently shaped tables, missing columns as NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def missing(required: DataFrame, found: DataFrame, col: str) -> DataFrame:
    """SET04 required minus found (distinct values, anti join)."""
    return required.select(col).distinct().join(found.select(col).distinct(), col, "left_anti")
