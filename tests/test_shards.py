"""Shards by bytes: the cap, whole contents, and what a greedy cut leaves."""

import os
import random

import pytest
from pyspark.sql import functions as F

from emoscope.sources import sinks as K


def test_no_shard_over_the_cap_and_all_rows_once(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["é", "x", "漢"]) * rnd.randrange(0, 400)) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(9)
    out, cap = f"{tmp_path}/shards", 5000
    K.write_shards(df, out, ["id"], F.concat_ws("|", F.col("id").cast("string"), "text"), cap)
    lines, sizes = [], []
    for d in sorted((x for x in os.listdir(out) if x.startswith("shard=")), key=lambda x: int(x[6:])):
        files = [f for f in os.listdir(f"{out}/{d}") if f.startswith("part-")]
        assert len(files) == 1
        sizes.append(os.path.getsize(f"{out}/{d}/{files[0]}"))
        lines += open(f"{out}/{d}/{files[0]}", encoding="utf-8").read().splitlines()
    assert lines == [f"{i}|{t}" for i, t in rows]  # shard after shard, the rows in order
    first = 0
    for k, size in enumerate(sizes):  # each shard is full: the next line would have passed the cap
        assert size <= cap
        while size > 0:
            size -= len(lines[first].encode()) + 1
            first += 1
        if k + 1 < len(sizes):
            assert sizes[k] + len(lines[first].encode()) + 1 > cap
    listed = {r.shard: (r.bytes, r.files) for r in K.list_shards(spark, out).collect()}
    assert listed == {k: (s, 1) for k, s in enumerate(sizes)}


def test_a_line_above_the_cap_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "short"), (2, "x" * 100)], "id long, text string")
    with pytest.raises(Exception, match="longer than 50 bytes"):
        K.write_shards(df, f"{tmp_path}/s", ["id"], F.col("text"), 50)
