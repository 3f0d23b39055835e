"""User hooks: one call a batch, errors by row, segments by batch."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from emoscope.operators import udf as U


@pytest.fixture(scope="module")
def rows(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    yield spark.range(1000).withColumn("text", F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("n "), F.col("id").cast("string")))).coalesce(1).cache()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def counting(kind):
    """Models that give half of the id; odd ids fail.  Their calls are counted in the value's fraction."""
    def make():
        calls = [0]

        def framed(pdf):
            calls[0] += 1
            odd = pdf["id"] % 2 == 1
            return pd.DataFrame({"value": pdf["id"] // 2 + calls[0] / 10_000, "error": odd.map({True: "odd", False: None})})

        def raising(pdf):
            if (pdf["id"] % 2 == 1).any():
                raise ValueError("odd")
            return pdf["id"] // 2

        def one(row):
            if row["id"] % 2:
                raise ValueError("odd")
            return row["id"] // 2

        return {"framed": framed, "raising": raising, "row": U.per_row(one)}[kind]
    return make


def test_dense_failures_cost_one_call_a_batch(rows):
    got = U.score(rows, counting("framed"), ["id"]).collect()
    assert {round(r.value % 1 * 10_000) for r in got if r.value is not None} == set(range(1, 11))  # 1,000 rows, ten calls
    assert all((r.error is not None) == (r.id % 2 == 1) == (r.value is None) for r in got) and len(got) == 1000


def test_all_protocols_answer_alike(rows):
    answers = [{r.id: (None if r.value is None else int(r.value), r.error is None) for r in U.score(rows, counting(k), ["id"]).collect()}
               for k in ("framed", "raising", "row")]
    assert answers[0] == answers[1] == answers[2]
    assert answers[0] == {i: (None, False) if i % 2 else (i // 2, True) for i in range(1000)}
    assert U.score(rows.limit(0), counting("framed"), ["id"]).count() == 0


def test_segments_by_batch(spark, rows):
    out = U.python_segments(rows, "text", ["id", "text"], str.split)
    assert out.columns == ["id", "text", "segment_idx", "segment"]
    got = sorted(tuple(r) for r in out.collect())
    want = sorted((i, f"n {i}", k, s) for i in range(1000) if i % 11 for k, s in enumerate(["n", str(i)]))
    assert got == want
    odd = spark.createDataFrame([(1, ""), (2, None), (3, "a b"), (4, "  ")], "id long, text string")
    assert [tuple(r) for r in U.python_segments(odd, "text", ["id"], str.split).collect()] == [(3, 0, "a"), (3, 1, "b")]
    assert spark.catalog.listTables() == [] or all("udt" not in t.name for t in spark.catalog.listTables())


def test_classifier_refuses_ragged_vectors(spark):
    for rows in ([(1, [1.0], 0), (2, [1.0, 2.0], 1)], []):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        with pytest.raises(ValueError, match="one length"):
            U.train_classifier(df, "embedding", "label", "vec_id")
