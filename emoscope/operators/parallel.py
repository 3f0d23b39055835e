"""Partitioning for fan-out operators.

Operators that expand a row into thousands (one per character, word or n-gram)
and then group by the row's id deal the rows out by that id first: whole rows
travel once, and the grouping by (id, ...) afterwards needs no exchange of the
expanded rows.  The plan is the same whatever the input's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), key)
