"""Operator 13: hard negatives by coordinate pruning over length buckets.

For an anchor vector, the hardest rows of another label that still score clearly
below a positive are wanted: exact, by integer inner product, ties by the
smaller id.

``build_index`` range-partitions all rows by descending length and cuts each
range into buckets of bounded size.  A bucket keeps its rows and, for each
coordinate, a list of the rows sorted by that coordinate of the unit vector.
Some neighbouring buckets make a shard, which one task holds at a time.

``search`` sends an anchor to every shard whose longest vector can reach its
score.  There the anchor passes the buckets in order of length.  A lower limit
``s`` on the score means an angle of at most ``acos(s / (|a| * longest))``
between anchor and row, and so a feasible range of values in each coordinate.
The ranges of the anchor's ``FOCUS`` largest coordinates are cut out of their
sorted lists and intersected; what is left is verified by its exact inner
product.  Where the smallest range still holds a good part of the bucket, the
whole bucket is verified in one matrix product.  The limit rises to the k-th
best score found so far, from bucket to bucket.

Positives and negatives are two searches: the first asks for the best rows of
the anchor's label, the second, for each positive, for rows of other labels in
a window of scores below the positive's.

Memory: a task holds one shard (at most ``SHARD_BUCKETS`` buckets) and a block
of anchors; the others stream by.  Nothing but counts and the shards' lengths
reaches the driver.  Work is anchors times rows, in blocks, less what is pruned.

Defined results: rows with a null id, label or vector, or a component that is
null or not finite, take no part; an empty vector scores 0 with every row, and
of vectors with different lengths the shorter is filled up with zeros; of rows
repeated under one id the least (label, vector) stands for all; an anchor
without positives, or a positive without rows in its window, gives no rows; an
empty table gives none; other columns are not read.  Components must fit 31 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emoscope.llm.common import saved

FOCUS = 3
BUCKET_ROWS, BUCKET_CELLS = 2048, 1 << 19
SHARD_BUCKETS = 32
BLOCK = 256
_NONE = np.iinfo(np.int64).min
_SLACK = 1e-5

INDEX = ("shard long, kind int, shortest double, longest double, n int, dim int, ids binary, labels binary, "
         "cells binary, lists binary")


def scaled(vector: Column, by: int = 256) -> Column:
    """Components times ``by``, rounded down; null where one is null or not finite."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * by)))


def one_row_each(rows: DataFrame) -> DataFrame:
    """``vec_id, label, v, length`` of the rows that take part, one for each id."""
    whole = rows.filter("vec_id is not null and label is not null and v is not null")
    each = whole.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return each.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "v", F.sqrt(squares).alias("length"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors as rows of one matrix, filled up with zeros or cut to ``dim``."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[at < dim], at[at < dim]] = values[at < dim]
    return out


def _unit(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the vectors over their lengths (zeros stay)."""
    lengths = np.sqrt((cells.astype(np.float64) ** 2).sum(1))
    return lengths, cells / np.where(lengths > 0, lengths, 1.0)[:, None]


def _bucket(shard: int, ids: np.ndarray, labels: np.ndarray, cells: np.ndarray) -> dict:
    order = np.argsort(ids)  # positions in id order, so ties need no ids
    ids, labels, cells = ids[order], labels[order], cells[order]
    if cells.size and np.abs(cells).max() >= 1 << 31:
        raise ValueError("a component needs more than 31 bits")
    lengths, unit = _unit(cells)
    lists = np.argsort(unit, axis=0, kind="stable").T.astype(np.int32)
    return {"shard": shard, "kind": 0, "shortest": float(lengths.min()), "longest": float(lengths.max()), "n": len(ids),
            "dim": cells.shape[1], "ids": ids.tobytes(), "labels": labels.tobytes(),
            "cells": cells.astype(np.int32).tobytes(), "lists": np.ascontiguousarray(lists).tobytes()}


def build_index(rows: DataFrame) -> DataFrame:
    """The buckets of all rows, one row each (see ``INDEX``), written once."""
    spark = rows.sparkSession
    rows = saved(rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // (BUCKET_ROWS * SHARD_BUCKETS)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held = TaskContext.get().partitionId() << 24, 0, None

        def cut(table: pa.Table, n: int) -> pa.RecordBatch:
            part = table.slice(0, n).combine_chunks()
            vectors = part.column("v").chunk(0)
            cells = _matrix(vectors, int(np.diff(vectors.offsets.to_numpy()).max()))
            row = _bucket(first + made // SHARD_BUCKETS, part.column("vec_id").to_numpy(), part.column("label").to_numpy(), cells)
            return pa.RecordBatch.from_pylist([row], _INDEX_SCHEMA)

        def full(table: pa.Table) -> int:
            """Rows that fill the next bucket, 0 if there are too few."""
            dim = max(1, int(pc.max(pc.list_value_length(table.column("v"))).as_py()))
            n = max(1, min(BUCKET_ROWS, BUCKET_CELLS // dim))
            return n if table.num_rows >= n else 0

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows and (n := full(held)):
                yield cut(held, n)
                made, held = made + 1, held.slice(n)
        if held is not None and held.num_rows:
            yield cut(held, held.num_rows)

    ranged = rows.select("vec_id", "label", "v", (-F.col("length")).alias("place")).repartitionByRange(
        parts, "place", "vec_id").sortWithinPartitions("place", "vec_id")
    return saved(ranged.select("vec_id", "label", "v").mapInArrow(build, INDEX))


_INDEX_SCHEMA = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("shortest", pa.float64()), ("longest", pa.float64()),
                           ("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()),
                           ("cells", pa.binary()), ("lists", pa.binary())])


class _Bucket:
    """A bucket in memory."""

    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        self.n, self.dim, self.shortest, self.longest = n, dim, row["shortest"], row["longest"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.cells = np.frombuffer(row["cells"], np.int32).reshape(n, dim)
        self.lists = np.frombuffer(row["lists"], np.int32).reshape(dim, n)
        self.unit = _unit(self.cells)[1].astype(np.float32)
        self.sorted = np.take_along_axis(self.unit.T, self.lists, axis=1)

    def scores(self, vectors: np.ndarray, longest: float, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Exact inner products; floats serve while no sum can pass their whole numbers."""
        bound = longest * self.longest
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        return (vectors.astype(kind) @ self.cells[rows].astype(kind).T).astype(np.int64)


class _Block:
    """Anchors, their score windows, and the best rows found so far."""

    def __init__(self, rows: pa.Table, k: int):
        self.k = k
        self.anchor, self.label = rows.column("anchor_id").to_numpy(), rows.column("label").to_numpy()
        vectors = rows.column("v").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        sizes = np.diff(vectors.offsets.to_numpy())
        self.whole = _matrix(vectors, int(sizes.max(initial=0)))
        self.length, self.unit = _unit(self.whole)
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        windows = rows.column("windows").to_pylist()
        self.of = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        flat = [x for w in windows for x in w]
        self.tag = np.array([x["tag"] for x in flat], np.int32)
        self.same = np.array([x["same"] for x in flat], bool)
        self.low = np.array([_NONE if x["low"] is None else x["low"] for x in flat], np.int64)
        self.high = np.array([-(_NONE + 1) if x["high"] is None else x["high"] for x in flat], np.int64)
        self.turn = np.concatenate([np.arange(len(w)) for w in windows]) if flat else np.empty(0, int)
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))  # window, score, id

    def limits(self) -> np.ndarray:
        """The least score that still matters, for each anchor."""
        out = np.full(len(self.anchor), -(_NONE + 1), np.int64)
        np.minimum.at(out, self.of, self.low)
        return out

    def pass_bucket(self, b: _Bucket) -> None:
        limit = self.limits().astype(np.float64)
        reach = self.length * np.where(limit > 0, b.longest, b.shortest)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach > 0, limit / reach, np.where(limit > 0, 2.0, -1.0))
        alive = np.flatnonzero(cosine <= 1 + _SLACK)
        if not len(alive):
            return
        vectors = self.whole[:, :b.dim] if self.whole.shape[1] >= b.dim else np.pad(
            self.whole, ((0, 0), (0, b.dim - self.whole.shape[1])))
        begin, end, low, high = self._ranges(b, alive, cosine[alive])
        count = (end - begin).min(1, initial=b.n)
        some, most = alive[(count > 0) & (count <= b.n // 4)], alive[count > b.n // 4]
        found = []
        for x in some.tolist():
            at = int(np.searchsorted(alive, x))
            found.append(self._sparse(b, x, vectors[x:x + 1], begin[at], end[at], low[at], high[at]))
        if len(most):
            found += self._dense(b, most, vectors)
        self._merge(found)

    def _ranges(self, b: _Bucket, alive: np.ndarray, cosine: np.ndarray):
        """Feasible ranges of the focus coordinates, as values and as places in the sorted lists."""
        focus = self.focus[alive]
        have = focus < b.dim  # a coordinate that the bucket lacks is 0 in all its rows
        angle = np.arccos(np.clip(np.take_along_axis(self.unit[alive], focus, axis=1), -1, 1))
        delta = np.arccos(np.clip(cosine, -1, 1))[:, None]
        low = np.cos(np.minimum(np.pi, angle + delta)) - _SLACK
        high = np.cos(np.maximum(0, angle - delta)) + _SLACK
        begin, end = np.zeros(focus.shape, int), np.full(focus.shape, b.n)
        for f in np.unique(focus[have]).tolist():
            at = focus == f
            begin[at] = np.searchsorted(b.sorted[f], low[at], "left")
            end[at] = np.searchsorted(b.sorted[f], high[at], "right")
        return begin, end, low, high

    def _sparse(self, b: _Bucket, x: int, vector: np.ndarray, begin, end, low, high):
        """Hits of one anchor among the rows in all its ranges."""
        least = int(np.argmin(end - begin))
        rows = b.lists[self.focus[x, least], begin[least]:end[least]]
        for c, f in enumerate(self.focus[x].tolist()):
            if c != least and f < b.dim:
                rows = rows[(b.unit[rows, f] >= low[c]) & (b.unit[rows, f] <= high[c])]
        scores = b.scores(vector, float(self.length[x]), rows)[0]
        same, other = b.labels[rows] == self.label[x], b.ids[rows] != self.anchor[x]
        windows, values, ids = [], [], []
        for w in np.flatnonzero(self.of == x).tolist():
            hit = other & (same == self.same[w]) & (scores >= self.low[w]) & (scores <= self.high[w])
            windows.append(np.full(int(hit.sum()), w))
            values.append(scores[hit])
            ids.append(b.ids[rows[hit]])
        return np.concatenate(windows), np.concatenate(values), np.concatenate(ids)

    def _dense(self, b: _Bucket, anchors: np.ndarray, vectors: np.ndarray) -> list:
        """Hits of many anchors, the whole bucket verified at once; k for each window and their ties."""
        scores = b.scores(vectors[anchors], float(self.length[anchors].max()))
        same = self.label[anchors][:, None] == b.labels[None, :]
        other = self.anchor[anchors][:, None] != b.ids[None, :]
        place = np.full(len(self.anchor), -1)
        place[anchors] = np.arange(len(anchors))
        out = []
        for turn in range(int(self.turn.max(initial=-1)) + 1):
            w = np.flatnonzero((self.turn == turn) & (place[self.of] >= 0))
            at = place[self.of[w]]
            s = scores[at]
            fits = other[at] & (same[at] == self.same[w][:, None]) & (s >= self.low[w][:, None]) & (s <= self.high[w][:, None])
            s = np.where(fits, s, _NONE)
            if b.n > self.k:
                s = np.where(s >= np.partition(s, b.n - self.k, axis=1)[:, b.n - self.k, None], s, _NONE)
            row, col = np.nonzero(s > _NONE)
            out.append((w[row], s[row, col], b.ids[col]))
        return out

    def _merge(self, found: list) -> None:
        """Keep the k best of each window, and raise its limit to the last of them."""
        w, s, i = (np.concatenate(x) for x in zip(self.best, *found))
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        first = np.searchsorted(w, w, "left")
        keep = np.arange(len(w)) - first < self.k
        self.best = w[keep], s[keep], i[keep]
        last = np.flatnonzero(np.arange(len(w)) - first == self.k - 1)
        self.low[w[last]] = np.maximum(self.low[w[last]], s[last])

    def result(self) -> pa.RecordBatch:
        w, s, i = self.best
        return pa.RecordBatch.from_arrays(
            [pa.array(self.anchor[self.of[w]]), pa.array(self.tag[w]), pa.array(s), pa.array(i)],
            names=["anchor_id", "tag", "score", "vec_id"])


def search(index: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """``anchor_id, tag, score, vec_id, rank``: the ``k`` best rows in each score window of each anchor.

    ``anchors`` has ``anchor_id, label, v, length, windows``; a window is a struct ``tag, same, low, high``:
    rows of the same label or of another, with a score from ``low`` to ``high`` (null: no limit)."""
    longest = index.groupBy("shard").agg(F.max("longest").alias("longest"))
    shards = longest.agg(F.collect_list(F.struct("shard", "longest"))).scalar()
    least = F.array_min(F.transform("windows", lambda w: F.coalesce(w["low"].cast("double"), F.lit(0.0))))
    open_to = F.filter("shards", lambda s: (F.col("least") <= 0) | (
        s["longest"] * F.col("length") * (1 + _SLACK) >= F.col("least")))
    dealt = anchors.withColumn("least", least).withColumn("shards", shards).select(
        F.explode(F.transform(open_to, lambda s: s["shard"])).alias("shard"), F.lit(1).alias("kind"),
        "anchor_id", "label", "v", "windows")
    both = index.unionByName(dealt, allowMissingColumns=True).select(*index.columns, "anchor_id", "label", "v", "windows")
    n = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), longest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, buckets = None, []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            at, kind = table.column("shard").to_numpy(), table.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(at)]
            for a, z in zip(cuts, cuts[1:]):
                if z == a:
                    continue
                if at[a] != shard:
                    shard, buckets = at[a], []
                if kind[a] == 0:
                    rows = table.slice(a, z - a).select(_INDEX_SCHEMA.names)
                    buckets += [_Bucket(r) for i in range(rows.num_rows) for r in rows.slice(i, 1).to_pylist()]
                    buckets.sort(key=lambda b: -b.longest)
                    continue
                for lo in range(a, z, BLOCK):
                    block = _Block(table.slice(lo, min(BLOCK, z - lo)), k)
                    for b in buckets:
                        block.pass_bucket(b)
                    yield block.result()

    met = both.repartitionByRange(n, "shard").sortWithinPartitions("shard", "kind", "anchor_id")
    hits = met.mapInArrow(run, "anchor_id long, tag int, score long, vec_id long")
    order = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id, label, v`` (whole numbers); ``anchor`` says which rows are anchors.  A negative
    scores from ``low`` to ``high`` percent of its positive."""
    rows = saved(one_row_each(rows))
    index = build_index(rows)
    anchors = rows.filter(anchor).withColumnRenamed("vec_id", "anchor_id")
    window = "array<struct<tag:int,same:boolean,low:long,high:long>>"
    all_same = F.array(F.struct(F.lit(0), F.lit(True), F.lit(None), F.lit(None))).cast(window)
    best = saved(search(index, anchors.withColumn("windows", all_same), positives).select(
        "anchor_id", F.col("rank").alias("tag"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # a window below a negative score is empty
    ps = F.col("positive_score")
    windows = best.filter(ps >= 0).groupBy("anchor_id").agg(F.collect_list(F.struct(
        "tag", F.lit(False).alias("same"), F.expr(f"({low} * positive_score + 99) div 100").alias("low"),
        F.expr(f"({high} * positive_score) div 100").alias("high"))).cast(window).alias("windows"))
    found = search(index, anchors.join(windows, "anchor_id"), negatives)
    return found.join(best, ["anchor_id", "tag"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("long").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
