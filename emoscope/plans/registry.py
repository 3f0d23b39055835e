"""Registry of named queries: a Spark builder and, where SQL can say the same
thing, an independent DuckDB oracle.

Query names are the operator IDs of the survey, lower-cased, plus a short
description, e.g. ``agg01_confusion``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emoscope.plans.oracle_views import VIEW_SQL

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, note: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, note)
        return fn
    return deco


def oracle(select: str, views: Sequence[str] = (), ctes: Sequence[tuple[str, str]] = ()) -> str:
    """Compose ``WITH <views>, <ctes> <select>`` for DuckDB."""
    parts = [f"{n} AS ({VIEW_SQL[n]})" for n in views]
    parts += [f"{n} AS ({body})" for n, body in ctes]
    if not parts:
        return select
    return "WITH " + ",\n".join(parts) + "\n" + select


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double / float column so both engines hash the same text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
