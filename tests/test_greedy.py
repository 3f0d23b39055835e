"""Greedy batching by slice transducers against the plain loop."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emoscope.operators.batching import silence_clips
from emoscope.operators.greedy import Cuts, Rule, greedy_batches


def loop(lengths, rule):
    """The recurrence, item by item."""
    out, total, items, batch = [], 0.0, 0, -1
    for v in lengths:
        if not rule.closing and items and (total + v > rule.budget or (rule.max_n and items >= rule.max_n)):
            total, items = 0.0, 0
        if not items:
            batch += 1
        out.append(batch)
        total, items = total + v, items + 1
        if rule.closing and total >= rule.budget:
            total, items = 0.0, 0
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 30).map(float), st.integers(0, 300).map(lambda x: x * 0.1), st.floats(0, 40)),
                min_size=1, max_size=80),
       st.sampled_from([0.3, 1.5, 10.0, 30.0]), st.integers(0, 5), st.booleans())
def test_successors_follow_the_loop(lengths, budget, max_n, closing):
    rule = Rule(budget, max_n, closing)
    nxt, starts, s = rule.successors(np.array(lengths)), np.zeros(len(lengths), int), 0
    while s < len(lengths):
        starts[s], s = 1, nxt[s]
    assert (np.cumsum(starts) - 1).tolist() == loop(lengths, rule)


CASES = {"whole": lambda rng, n: rng.integers(0, 400, n).astype(float), "tenths": lambda rng, n: rng.integers(1, 4000, n) * 0.1,
         "tiny": lambda rng, n: rng.random(n) * 0.5, "equal": lambda rng, n: np.full(n, 10.0)}


@pytest.mark.parametrize("kind", CASES)
def test_any_slices_give_the_loops_batches(spark, kind):
    """One key holds two thirds of the rows; one key is NULL; batches longer than a slice ("tiny")."""
    rng = np.random.default_rng(len(kind))
    lengths = CASES[kind](rng, 600)
    keys = [None if i % 9 == 1 else i % 9 if i % 9 < 3 else 0 for i in range(600)]
    rows = [(i, k, float(x), f"t{i}") for i, (k, x) in enumerate(zip(keys, lengths))]
    df = spark.createDataFrame(rows, "id long, key int, len double, text string").repartition(5)
    by_key = defaultdict(list)
    for i, k, x, _ in rows:
        by_key[k].append((i, x))
    for rule in (Rule(1000.0, 6), Rule(1000.0), Rule(700.0, closing=True)):
        want = {i: b for items in by_key.values() for (i, _), b in zip(items, loop([x for _, x in items], rule))}
        for slices in (1, 2, 7, 64):
            got = greedy_batches(df, ["key"], ["id"], "len", rule, num_slices=slices)
            assert got.columns == [*df.columns, "batch"]
            got = got.collect()
            assert {r.id: r.batch for r in got} == want, (rule.__dict__, slices)
            assert len(got) == 600 and all(r.text == f"t{r.id}" for r in got)


def test_no_keys_null_lengths_and_no_rows(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 7)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, len double")
    got = {r.id: r.batch for r in greedy_batches(df, [], ["id"], "len", Rule(11.0, 4), num_slices=9).collect()}
    assert [got[i] for i in range(100)] == loop([x or 0.0 for _, x in rows], Rule(11.0, 4))
    assert greedy_batches(df.limit(0), [], ["id"], "len", Rule(11.0)).count() == 0


def test_few_jobs_whatever_the_rows(spark):
    """No rounds of joins: the whole of it takes ten jobs at most."""
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    for n in (50, 20_000):
        df = spark.range(n).selectExpr("id", "0 as shard", "cast(id % 97 as double) as len")
        context.setJobGroup(f"greedy-{n}", "greedy")
        greedy_batches(df, ["shard"], ["len", "id"], "len", Rule(500.0, 16)).write.format("noop").mode("overwrite").save()
        assert len(tracker.getJobIdsForGroup(f"greedy-{n}")) <= 10, n
    context.setLocalProperty("spark.jobGroup.id", None)


def taken(cuts, min_length):
    """The choice among cuts, one after the other."""
    at, out = 0, []
    for start, reach, to, always in cuts:
        if always or reach - at >= min_length:
            out.append(start)
            at = to
    return out


@pytest.mark.parametrize("gap", [3, 40])
def test_cuts_in_any_slices(spark, gap):
    """A hot recording with half of all silences, long stretches without a taken cut, and cuts that are always taken."""
    rng = np.random.default_rng(gap)
    rows, want = [], {}
    for key, n in (("hot", 500), ("a", 30), (None, 40), ("one", 1)):
        p, cuts = 0, []
        for _ in range(n):
            start = p + int(rng.integers(1, gap))
            reach = start + int(rng.integers(1, 9))
            cuts.append((start, reach, int(rng.integers(start, reach + 1)), bool(rng.random() < 0.02)))
            p = reach
        rows += [(key, *c) for c in cuts]
        want[key] = taken(cuts, 60)
    df = spark.createDataFrame(rows, "u string, s long, e long, to long, always boolean").repartition(7)
    for slices in (1, 2, 9, 64):
        got = defaultdict(list)
        for r in greedy_batches(df, ["u"], ["s"], None, Cuts("s", "e", "to", "always", 60), num_slices=slices,
                                starts_name="taken").orderBy("s").collect():
            if r.taken:
                got[r.u].append(r.s)
        assert {k: got[k] for k in want} == want, slices


def test_an_endless_recording_of_silences(spark):
    """One recording of 400,000 frames, a silence every ten, is not one row or one task."""
    df = spark.range(400_000).selectExpr("'r' as u", "id as i", "if(id % 10 in (7, 8, 9), 0.01 + (id % 10) / 1000, 1.0) as rms").repartition(8)
    clips = silence_clips(df, "u", ["i"], "rms", 0.1, 25, 3, 4).orderBy("begin").collect()
    cuts = taken([(10 * k + 7, 10 * k + 10, 10 * k + 7, k == 39_999) for k in range(40_000)], 25)
    begins = [0, *cuts[:-1]]
    assert [(r.clip, r.begin, r.end) for r in clips] == [(i, b, e) for i, (b, e) in enumerate(zip(begins, cuts))]
