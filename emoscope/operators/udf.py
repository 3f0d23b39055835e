"""User-function surface (UDF01, UDF03, UDA01) and the classifier (AGG29).

User code enters as Arrow-batched pandas / Arrow functions; the table work
around it (joins, aggregation, splits) stays in Spark.  Aggregating user
metrics are mergeable: a partial pandas step per partition, a native sum
across partitions, and a final step on the small per-group table, so no
group is ever gathered into one task.
"""

from __future__ import annotations

import uuid
from typing import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a model gets at once, at most; what it makes of them meanwhile grows with their number.
MODEL_ROWS = 256

_MODEL: dict = {}


def _worker_model(key: str, make_model: Callable):
    """The model of this Python worker; workers import this module, so it outlives a task."""
    if key not in _MODEL:
        _MODEL.clear()
        _MODEL[key] = make_model()
    return _MODEL[key]


def per_row(fn: Callable[[pd.Series], object]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A batch model from a function of one row: an exception is that row's ``error``."""
    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        values, errors = [], []
        for _, row in pdf.iterrows():
            try:
                values.append(fn(row))
                errors.append(None)
            except Exception as e:  # noqa: BLE001 - the row's own failure
                values.append(None)
                errors.append(f"ERROR: {type(e).__name__}: {e}")
        return pd.DataFrame({"value": pd.Series(values, index=pdf.index, dtype=object),
                             "error": pd.Series(errors, index=pdf.index, dtype=object)})
    return model


def _parts(made, index: pd.Index) -> tuple[pd.Series, pd.Series]:
    """Values and errors of what a model returned, for the rows of ``index``."""
    if not isinstance(made, pd.DataFrame):
        return pd.Series(made, index=index), pd.Series([None] * len(index), index=index, dtype=object)
    if len(made) != len(index):
        raise ValueError(f"the model gave {len(made)} rows for {len(index)}")
    errors = made["error"].astype(object).where(made["error"].notna(), None)
    values = made["value"].where(made["error"].isna(), None)  # a failed row has no value
    return values.set_axis(index), errors.set_axis(index)


def score(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.Series | pd.DataFrame]],
          input_cols: Sequence[str], value_type: T.DataType = T.DoubleType(), key: str | None = None) -> DataFrame:
    """UDF01 score every row with a user model.  The model is built once per
    Python worker (``make_model``) and kept under ``key`` (a name and version the
    caller vouches for; by default one of this call alone), and called once for
    each block of at most ``MODEL_ROWS`` rows of an Arrow batch, so its memory
    does not grow with the batch.

    A model returns the values, or a frame with a ``value`` and an ``error``
    for each row, so that rows that fail cost no further call and do not stop
    the run (``per_row`` makes such a model of a function of one row).  A
    model that raises instead fails as a whole for the batch; its rows are then
    given to it one by one, to find those that fail."""
    model_key = key or uuid.uuid4().hex
    cols = list(input_cols)
    schema = T.StructType(list(df.schema.fields) + [T.StructField("value", value_type),
                                                    T.StructField("error", T.StringType())])

    def run(batches):
        model = _worker_model(model_key, make_model)
        for pdf in (whole.iloc[lo:lo + MODEL_ROWS].reset_index(drop=True)
                    for whole in batches for lo in range(0, len(whole), MODEL_ROWS)):
            try:
                values, errors = _parts(model(pdf[cols]), pdf.index)
            except Exception:  # noqa: BLE001 - the model cannot tell which rows fail
                rows = per_row(lambda row: _parts(model(pdf[cols].loc[[row.name]]), pd.Index([row.name]))[0].iloc[0])
                values, errors = _parts(rows(pdf[cols]), pdf.index)
            yield pdf.assign(value=values, error=errors)

    return df.mapInPandas(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], n: int,
                schema: T.StructType) -> DataFrame:
    """UDF03 apply ``fn`` to Arrow record batches of at most ``n`` rows."""
    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, n):
                yield fn(b.slice(start, n))

    return df.mapInArrow(run, schema)


def mergeable_metric(df: DataFrame, keys: Sequence[str], partial: Callable[[pd.DataFrame], dict],
                     partial_cols: Sequence[str], final: Callable[[pd.DataFrame], pd.DataFrame],
                     out_schema: str) -> DataFrame:
    """UDA01 custom grouped metric as partial sums: ``partial`` turns the rows
    of one key inside one Arrow batch into additive numbers; Spark sums them
    per key; ``final`` maps the per-key sums to the metric.  Memory per task
    is one batch, whatever the group size."""
    keys = list(keys)
    p_schema = T.StructType([df.schema[k] for k in keys] +
                            [T.StructField(c, T.DoubleType()) for c in partial_cols])

    def part(batches):
        for pdf in batches:
            rows = []
            for k, g in pdf.groupby(keys, sort=False, dropna=False):
                k = k if isinstance(k, tuple) else (k,)
                d = partial(g)
                rows.append(list(k) + [float(d[c]) for c in partial_cols])
            yield pd.DataFrame(rows, columns=keys + list(partial_cols))

    sums = df.mapInPandas(part, p_schema).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in partial_cols])

    def fin(batches):
        for pdf in batches:
            yield final(pdf)

    return sums.mapInPandas(fin, out_schema)


def train_classifier(df: DataFrame, features: str, label: str, id_col: str, seed: int = 42,
                     hidden: int = 256, max_iter: int = 100) -> DataFrame:
    """AGG29 linear-ReLU-linear style classifier on pooled vectors, re-aimed
    as Spark ML's multilayer perceptron (layers [d, hidden, k]); split 80/20
    by hash (SPL03); reports WA / UA / weighted F1 (AGG05) per split."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector
    from emoscope.operators.metrics import wa_ua_f1
    from emoscope.operators.splits import random_split

    data = df.select(id_col, array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("features"),
                     F.col(label).cast("double").alias("label"))
    split = random_split(data, id_col, 0.8, seed)
    train = split.where(F.col("split") == "train")
    shape = df.agg(F.min(F.size(features)).alias("least"), F.max(F.size(features)).alias("most"), F.max(label).alias("top")).first()
    if shape.most is None or shape.least != shape.most:
        raise ValueError(f"vectors must have one length, not {shape.least} to {shape.most}")
    width, n_classes = shape.most, int(shape.top) + 1
    mlp = MultilayerPerceptronClassifier(layers=[width, hidden, n_classes], maxIter=max_iter, seed=seed)
    model = mlp.fit(train)
    pred = model.transform(split).select("split", F.col("label").cast("int").cast("string").alias("y"),
                                         F.col("prediction").cast("int").cast("string").alias("yhat"))
    return wa_ua_f1(pred, "y", "yhat", ["split"])


def with_parsed(df: DataFrame, col: str, parser: Callable[[pd.Series], pd.DataFrame] | None = None,
                schema: str = "txt_emo string, txt_cond string, wav_emo string, lbl_full string, tts_model string"
                ) -> DataFrame:
    """UDF02 parsed name fields as a struct column ``parsed``: the native
    parser (PRJ02) by default, or a user parser as a vectorised pandas UDF
    (Series of names -> DataFrame of fields)."""
    if parser is None:
        from emoscope.functions.names import parse_name
        return df.withColumn("parsed", parse_name(col))
    udf = F.pandas_udf(parser, schema)
    return df.withColumn("parsed", udf(F.col(col)))


def python_segments(df: DataFrame, col: str, keep: Sequence[str], splitter: Callable[[str], list[str]]) -> DataFrame:
    """UDT01 user one-row-to-many function over Arrow batches: the columns
    ``keep`` of each row beside ``segment_idx, segment``, a row for each segment
    (none for NULL).  The texts of a batch go through the hook and come back as
    one list array; the kept columns are taken by row, never touched in Python.
    The native TVF operators are the default, this is the hook for user
    segmenters."""
    keep = list(keep)
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField("segment_idx", T.IntegerType()),
                                                          T.StructField("segment", T.StringType())])

    def run(batches):
        for batch in batches:
            lists = pa.array([None if t is None else splitter(t) for t in batch.column(len(keep)).to_pylist()],
                             pa.list_(pa.string()))
            row = pc.list_parent_indices(lists)
            first = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            at = np.arange(len(row)) - np.concatenate([[0], first])[row.to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(row) for i in range(len(keep))], pa.array(at.astype(np.int32)), pc.list_flatten(lists)],
                names=[*keep, "segment_idx", "segment"])

    return df.select(*keep, F.col(col).alias("__text")).mapInArrow(run, schema)
