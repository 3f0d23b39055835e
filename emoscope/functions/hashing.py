"""Seeded, engine-independent hash keys for reproducible random draws.

A draw is a hash of ``(value, seed)``: the same on every retry, every
partitioning and in any SQL engine with ``md5`` (the first 15 hex digits fit
a signed 64-bit integer).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(col, seed: int | str) -> Column:
    """Non-negative 60-bit integer from md5(``value:seed``)."""
    c = F.col(col) if isinstance(col, str) else col
    digest = F.md5(F.concat_ws(":", c.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def stable_uniform(col, seed: int | str) -> Column:
    """Uniform draw in [0, 1) from ``stable_hash``."""
    return stable_hash(col, seed).cast("double") / F.lit(float(16 ** 15))


def stable_hash_sql(expr: str, seed: int | str) -> str:
    """The DuckDB expression equal to ``stable_hash``."""
    return (f"CAST(('0x' || substr(md5(concat_ws(':', CAST({expr} AS VARCHAR), '{seed}')), 1, 15)) AS BIGINT)")
