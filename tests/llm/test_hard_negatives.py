"""Hard negatives: brute force over clusters, lengths, ties and odd rows."""

import math

import numpy as np
import pytest

pytest.importorskip("emoscope.llm")

from pyspark.sql import functions as F  # noqa: E402

from emoscope.llm import hard_negatives as H  # noqa: E402

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int, shard string, n int, score double, ids string, tag int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, 0.5, "y", 2) for i, v, y in rows], SCHEMA)


def mined(df, **how):
    rows = df.select("vec_id", "label", H.scaled(F.col("embedding")).alias("v"), "shard", "n", "score")
    return H.hard_negatives(rows, F.col("vec_id") % 50 == 0, **how)


def brute(rows, n_pos=5, n_neg=3, low=50, high=95):
    live = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        c = (y, [math.floor(256 * float(np.float32(x))) for x in v])
        live[i] = min(live.get(i, c), c)
    out = set()
    for a, (ya, va) in live.items():
        if a % 50:
            continue
        score = {i: sum(p * q for p, q in zip(va, v)) for i, (_, v) in live.items() if i != a}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if live[i][0] == ya][:n_pos]:
            good = [i for i in best if live[i][0] != ya and low * score[p] <= 100 * score[i] <= high * score[p]]
            out |= {(a, p, r, i, score[p], score[i]) for r, i in enumerate(good[:n_neg], 1)}
    return out


def got(df, **how):
    out = mined(df, **how)
    assert out.columns == COLUMNS
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def clustered(n, dim, seed, spread):
    """Tight clusters of several labels, with lengths over two orders of magnitude."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centre[rng.integers(12)] + spread * rng.normal(size=dim)
        v = v / np.linalg.norm(v) * np.exp(rng.uniform(-2, 2))
        rows.append((i, [float(x) for x in v], int(rng.integers(4))))
    return rows


@pytest.mark.parametrize("spread, bucket", [(0.02, 40), (0.3, 64), (1.5, 2048)])
def test_equals_brute_force(spark, monkeypatch, spread, bucket):
    monkeypatch.setattr(H, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(H, "SHARD_BUCKETS", 3)
    monkeypatch.setattr(H, "BLOCK", 4)
    rows = clustered(900, 16, bucket, spread)
    expect = brute(rows)
    assert len(expect) > 50 and got(frame(spark, rows)) == expect


def test_pruning_leaves_few_rows_to_verify(spark, monkeypatch):
    """Over tight clusters the ranges must cut most rows away, and lose none."""
    rows = clustered(2000, 16, 7, 0.02)
    data = np.array([[math.floor(1024 * x / math.hypot(*v)) for x in v] for _, v, _ in rows])  # a bucket has rows of like length
    labels, ids = np.array([y for *_, y in rows]), np.arange(len(rows))
    import pyarrow as pa
    bucket = H._Bucket(H._bucket(0, ids, labels, data))
    windows = [[{"tag": 0, "same": True, "low": int(0.95 * (data[a] @ data[a]) * bucket.shortest / np.linalg.norm(data[a])), "high": None}]
               for a in range(0, 2000, 50)]
    table = pa.table({"anchor_id": pa.array(range(0, 2000, 50), pa.int64()), "label": pa.array(labels[::50]),
                      "v": pa.array(data[::50].tolist(), pa.list_(pa.int64())), "windows": pa.array(windows)})
    block, seen = H._Block(table, 5), []
    scores = bucket.scores
    monkeypatch.setattr(bucket, "scores", lambda v, n, r=slice(None): seen.append(len(v) * len(bucket.ids[r])) or scores(v, n, r))
    first = block.low.copy()
    block.pass_bucket(bucket)
    exact = data[::50] @ data.T
    for w, a in enumerate(range(0, 2000, 50)):
        fits = [i for i in range(2000) if i != a and labels[i] == labels[a] and exact[w, i] >= first[w]]
        best = sorted(fits, key=lambda i: (-exact[w, i], i))[:5]
        assert block.best[2][block.best[0] == w].tolist() == best
    assert 0 < sum(seen) < 0.4 * 40 * 2000


def test_one_vector_for_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET_ROWS", 50)
    rows = clustered(600, 8, 3, 0.5)
    rows = [(i, rows[0][1], i % 5) if i % 3 == 0 else r for i, r in enumerate(rows)]
    assert got(frame(spark, rows)) == brute(rows)


def test_windows_and_counts_are_parameters(spark):
    rows = clustered(400, 8, 5, 0.5)
    for how in ({"positives": 2, "negatives": 7, "low": 10, "high": 100}, {"positives": 1, "negatives": 1, "low": 33, "high": 34}):
        assert got(frame(spark, rows), **how) == brute(rows, how["positives"], how["negatives"], how["low"], how["high"])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.75, 0.25], 2), (2, [0.75, 0.25], 2), (3, None, 1), (4, [1.0, None], 1),
            (5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (None, [1.0, 1.0], 2), (7, [0.9, 0.1], None), (8, [], 2), (9, [0.6], 2),
            (10, [0.6, 0.3, 9.0], 2), (11, [0.0, 0.0], 1), (12, [-1.0, -1.0], 1), (13, [0.7, 0.3], 2), (13, [0.1, 0.1], 3),
            (50, [0.0, 0.0], 2), (100, [], 1), (150, [-1.0, -0.5], 1), (200, [5.0, 5.0], 9), (250, [100000.0, 70000.0], 1),
            (14, [60000.0, 70000.0], 2), (15, [70000.0, 50000.0], 1)]
    assert got(frame(spark, rows)) == brute(rows)


def test_tables_without_pairs(spark):
    assert got(frame(spark, [])) == set()
    assert got(frame(spark, [(50, [1.0], 1)])) == set()
    assert got(frame(spark, [(50, [1.0], 1), (1, [1.0], 2)])) == set()
    assert got(frame(spark, [(None, None, None)])) == set()
