"""Values carried across slices, against plain windows and loops."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from emoscope.operators.ordered import ordered_scan
from emoscope.operators.ranking import carry_forward, next_valid


@pytest.fixture(scope="module")
def rows(spark):
    """A key with half of the rows, a NULL key, and runs of NULL values longer than a slice."""
    rng = np.random.default_rng(4)
    out = []
    for i in range(900):
        key = None if i % 7 == 0 else "hot" if i % 2 else f"k{i % 5}"
        value = None if 100 < i < 500 or rng.random() < 0.6 else int(rng.integers(1000))
        out.append((i, key, value, float(i % 13)))
    return spark.createDataFrame(out, "id long, key string, value int, x double").repartition(6).cache()


@pytest.mark.parametrize("slices", [1, 2, 5, 64])
@pytest.mark.parametrize("keys", [["key"], []])
def test_carried_values_equal_windows(rows, slices, keys):
    w = Window.partitionBy(*keys).orderBy("x", "id")
    want = rows.select("id", F.last("value", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("past"),
                       F.first("value", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("next"),
                       F.row_number().over(w).cast("long").alias("n"), F.lead("value").over(w).alias("lead"))
    got = ordered_scan(rows, keys, ["x", "id"], row_number="n", lead=[("value", "lead")], last=[("value", "past")],
                       following=[("value", "next")], num_partitions=slices).select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect())


def test_carry_forward_over_a_population_key(rows):
    w = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.v for r in rows.select("id", F.last("value", True).over(w).alias("v")).collect()}
    named, same = carry_forward(rows, ["key"], ["id"], "value", "filled"), carry_forward(rows, ["key"], ["id"], "value")
    assert named.columns == [*rows.columns, "filled"] and same.columns == rows.columns
    assert {r.id: r.filled for r in named.collect()} == want == {r.id: r.value for r in same.collect()}
    assert {r.id: r.value for r in named.collect()} == {r.id: r.value for r in rows.collect()}


@pytest.mark.parametrize("case", ["run", "none", "all", "last", "null"])
def test_next_valid_wraps(spark, case):
    valid = {"run": lambda i: i < 10 or i > 700, "none": lambda i: False, "all": lambda i: True, "last": lambda i: i == 777,
             "null": lambda i: None if i % 3 else i > 300}[case]
    flags = [valid(i) for i in range(800)]
    df = spark.createDataFrame([(i, f, i, f"t{i}") for i, f in enumerate(flags)], "id long, ok boolean, use long, t string")
    good = [i for i, f in enumerate(flags) if f]
    want = {i: next((g for g in good if g >= i), good[0] if good else None) for i in range(800)}
    out = next_valid(df.repartition(7), ["id"], F.col("ok"), ["use", "t"])
    assert out.columns == df.columns
    got = out.collect()
    assert {r.id: r.use for r in got} == want and len(got) == 800
    assert all(r.t == (None if r.use is None else f"t{r.use}") for r in got)


def test_next_valid_has_no_join(spark):
    df = spark.range(1000).selectExpr("id", "id as use")
    plan = next_valid(df, ["id"], F.col("id") % 500 == 0, ["use"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan
