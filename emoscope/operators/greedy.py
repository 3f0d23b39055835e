"""Greedy choices along an ordered sequence, cut into slices.

Where a greedy batch starts, or whether a cut is taken, depends on every earlier
item, so no window says it.  But all that a slice of the sequence has to know of
what lies before it is a small state: of the open batch its total so far and its
number of items, of the last cut its place.  And whatever that is, the first
start inside the slice lies in its *head*, the items that one batch can hold.
So a slice is a small transducer:

1. ``transduce`` reads a slice once.  For each start in the head it follows the
   starts to the slice's end and records how many there are and the state then.
   All of them share one table of successors, so this takes one backward pass.
2. ``fold`` runs over the slices of a key in order, a row each: the state that
   enters a slice gives its first start, and that gives the state that leaves.
3. ``number`` follows the starts of each slice from its first one.

Slices come from the range bounds of ``ordered.py``, at most about
``SLICE_ROWS`` rows each, so a key with a third of all rows spans many tasks.  A
head holds no more items than one batch.  Totals are added up from the batch's
first item on, item by item, as a loop would, so lengths that are no whole
numbers close their batches where the loop does.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from emoscope.operators.ordered import slices_of

#: Rows of a slice, about.
SLICE_ROWS = 1 << 20


class Rule:
    """When a batch closes.  With ``closing`` it closes behind the item that brings its total to
    ``budget``; else before an item that would bring it above ``budget`` or its count above ``max_n``."""

    #: The state that enters a key's first slice: the open batch's total and number of items.
    begin = (0.0, 0)

    def __init__(self, budget: float, max_n: int = 0, closing: bool = False):
        self.budget, self.max_n, self.closing = float(budget), int(max_n), closing

    def items(self, length: str) -> list[Column]:
        return [F.coalesce(F.col(length).cast("double"), F.lit(0.0))]

    def enter(self, x: np.ndarray, state: tuple[float, int]) -> int | None:
        """Place of the first start given the state; ``len(x)`` if the last item closes a batch, None if none starts."""
        return self.first_start(x, *state) if state[1] else 0

    def leave(self, x: np.ndarray, last: int, nxt: int) -> tuple[float, int]:
        """The state behind the items if ``last`` is the last start among them, ``nxt`` its successor."""
        return (0.0, 0) if nxt == len(x) else (float(np.cumsum(x[last:])[-1]), len(x) - last)

    def through(self, x: np.ndarray, state: tuple[float, int]) -> tuple[float, int]:
        """The state behind the items if none of them starts a batch."""
        return float(np.cumsum(np.concatenate([[state[0]], x]))[-1]), state[1] + len(x)

    def _over(self, totals: np.ndarray) -> np.ndarray:
        return totals >= self.budget if self.closing else totals > self.budget

    def first_start(self, x: np.ndarray, total: float = 0.0, count: int = 0) -> int | None:
        """Place of the first start in ``x`` behind an open batch (of ``count`` items, or of its own first)."""
        totals = np.cumsum(np.concatenate([[total], x]))[1:]
        over = self._over(totals)
        at = int(over.argmax()) + self.closing if over.any() else None
        if self.max_n and not self.closing and self.max_n - count < len(x):
            at = self.max_n - count if at is None else min(at, self.max_n - count)
        return at

    def head(self, x: np.ndarray) -> int:
        """How many items can lie before the first start, with the start itself."""
        at = self.first_start(x)
        return len(x) if at is None else min(len(x), at + 1)

    def successors(self, x: np.ndarray) -> np.ndarray:
        """For a batch that starts at each place the place of the next start; ``len(x) + 1`` if it stays open."""
        n = len(x)
        p = np.concatenate([[0], np.cumsum(x, dtype=np.longdouble)])
        goal = p[:-1] + self.budget
        # prefix sums only narrow the place down: near the budget, the batch's own sum decides
        near = np.longdouble(n * 1.1e-19) * p[-1] + n * 2.3e-16 * self.budget
        whole = float(p[-1]) < 2.0 ** 53 and bool((x == np.floor(x)).all())
        side = "left" if self.closing else "right"
        if whole:
            low = high = np.searchsorted(p, goal, side)
        else:
            low, high = np.searchsorted(p, goal - near, "left"), np.searchsorted(p, goal + near, "right")
        out = np.where(low <= n, low - (0 if self.closing else 1), n + 1)  # p[k] is the sum of k items
        for i in np.flatnonzero(low != high).tolist():
            at = self.first_start(x[i:min(n, int(high[i]))])
            out[i] = (int(high[i]) - (0 if self.closing else 1) if high[i] <= n else n + 1) if at is None else i + at
        if self.max_n and not self.closing:
            last = np.arange(n) + self.max_n
            out = np.minimum(out, np.where(last < n, last, n + 1))
        after = np.arange(1, n + 1)  # an item above the budget is a batch of its own
        return np.maximum(out, np.where(after < n, after, n if self.closing else n + 1))


class Cuts:
    """Which cuts are taken: those that are ``always``, and those whose ``reach`` lies at least ``min_length``
    behind the place ``to`` that the last taken cut leads to (0 before the first).  All three ascend, and a cut
    leads no further than the next one's ``start``."""

    begin = (0.0, 1)

    def __init__(self, start: str, reach: str, to: str, always: str, min_length: float):
        self.columns, self.min_length = (start, reach, to, always), float(min_length)

    def items(self, length: str | None = None) -> list[Column]:
        return [F.col(c).cast("double") for c in self.columns]

    def _first(self, x: np.ndarray, at: float) -> int | None:
        taken = (x[:, 3] > 0) | (x[:, 1] - at >= self.min_length)
        return int(taken.argmax()) if taken.any() else None

    def enter(self, x: np.ndarray, state: tuple[float, int]) -> int | None:
        return self._first(x, state[0])

    def head(self, x: np.ndarray) -> int:
        at = self._first(x, x[0, 0])  # the last cut before leads no further
        return len(x) if at is None else at + 1

    def successors(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        after = np.arange(1, n + 1)
        far = np.maximum(after, np.searchsorted(x[:, 1], x[:, 2] + self.min_length, "left"))
        always = np.append(np.flatnonzero(x[:, 3] > 0), n)
        out = np.minimum(far, always[np.searchsorted(always, after, "left").clip(max=len(always) - 1)])
        return np.where(out < n, out, n + 1)

    def leave(self, x: np.ndarray, last: int, nxt: int) -> tuple[float, int]:
        return float(x[last, 2]), 1

    def through(self, x: np.ndarray, state: tuple[float, int]) -> tuple[float, int]:
        return state


def _chains(nxt: np.ndarray, head: int) -> tuple[list[int], list[int]]:
    """For each start in the head: how many batches start from it on, and the last of them."""
    n = len(nxt)
    count, last, to = [1] * n, list(range(n)), nxt.tolist()
    for i in range(n - 1, -1, -1):
        j = to[i]
        if j < n:
            count[i], last[i] = count[j] + 1, last[j]
    return count[:head], last[:head]


def _sorted(table: pa.Table, order: Sequence[str], columns: Sequence[str]) -> tuple[pa.Table, np.ndarray]:
    """The rows in order, and their items as one array (of rows, if an item has several numbers)."""
    table = table.sort_by([(c, "ascending") for c in order])
    x = np.stack([table.column(c).to_numpy().astype(np.float64) for c in columns], axis=1)
    return table, x[:, 0] if len(columns) == 1 else x


def greedy_batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], length: str | None, rule: Rule | Cuts,
                   name: str = "batch", num_slices: int | None = None, starts_name: str | None = None) -> DataFrame:
    """``df`` plus ``name``: the number of each row's batch within its key, from 0, in ``order`` (total, ascending;
    -1 before the first start), and ``starts_name``, if given: whether the row is a start.

    Lengths are numbers of at least 0; a NULL counts as 0, and NULL keys are one key."""
    spark = df.sparkSession
    keys, order = list(keys), list(order)
    if num_slices is None:
        num_slices = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SLICE_ROWS))
    numbers = rule.items(length)
    xs = [f"__x{i}" for i in range(len(numbers))]
    placed = slices_of(df, keys, [F.col(c) for c in order], num_slices).withColumns(dict(zip(xs, numbers)))
    columns = df.columns
    g = placed.schema["__g"].dataType.simpleString()
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` long"
    out += f", `{starts_name}` boolean" if starts_name else ""
    g_type, result = _arrow(f"g {g}").field("g").type, _arrow(out)

    def transduce(table: pa.Table) -> pa.Table:
        rows, x = _sorted(table, order, xs)
        nxt, n, head = rule.successors(x), len(x), rule.head(x)
        count, last = _chains(nxt, head)
        state = {s: rule.leave(x, s, int(nxt[s])) for s in set(last)}
        row = {"g": rows.column("__g")[0].as_py(), "n": n, "head": x[:head].reshape(-1).tolist(), "count": count,
               "total": [state[s][0] for s in last], "items": [state[s][1] for s in last]}
        return _table([row], _schema(g_type, n=pa.int64(), head=_DOUBLES, count=_LONGS,
                                     total=_DOUBLES, items=_LONGS))

    def fold(table: pa.Table) -> pa.Table:
        out, state, begun = [], rule.begin, 0
        for row in sorted(table.drop_columns(["k"]).to_pylist(), key=lambda r: r["g"]["slice"]):
            head = np.array(row["head"])
            head = head if len(xs) == 1 else head.reshape(-1, len(xs))
            at = rule.enter(head, state)
            out.append({"g": row["g"], "at": -1 if at is None or at >= row["n"] else at, "begun": begun})
            if at is None:  # the head is the whole slice, and the state passes through
                state = rule.through(head, state)
            elif at >= row["n"]:  # closed by the slice's last item
                state = rule.begin
            else:
                begun, state = begun + row["count"][at], (row["total"][at], row["items"][at])
        return _table(out, _schema(g_type, at=pa.int64(), begun=pa.int64()))

    def number(table: pa.Table, entry: pa.Table) -> pa.Table:
        rows, x = _sorted(table, order, xs)
        nxt, starts, s = rule.successors(x).tolist(), np.zeros(len(x), np.int64), entry.column("at")[0].as_py()
        while 0 <= s < len(x):
            starts[s] = 1
            s = nxt[s]
        batch = entry.column("begun")[0].as_py() + np.cumsum(starts) - 1
        done = rows.select(columns).append_column(name, pa.array(batch))
        return (done.append_column(starts_name, pa.array(starts > 0)) if starts_name else done).cast(result)

    heads = placed.groupBy("__g").applyInArrow(
        transduce, f"g {g}, n long, head array<double>, count array<long>, total array<double>, items array<long>")
    entries = heads.withColumn("k", F.col("g.key")).groupBy("k").applyInArrow(fold, f"g {g}, at long, begun long")
    return placed.groupBy("__g").cogroup(entries.groupBy("g")).applyInArrow(number, out)


_DOUBLES, _LONGS = pa.list_(pa.float64()), pa.list_(pa.int64())


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark schema, every field nullable."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def _schema(g: pa.DataType, **columns: pa.DataType) -> pa.Schema:
    return pa.schema([("g", g), *columns.items()])


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


__all__ = ["Cuts", "Rule", "greedy_batches", "SLICE_ROWS"]
