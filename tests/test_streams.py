"""Streams over several files, micro-batches and runs."""

import os
import time

import pytest
from pyspark.sql import functions as F

from emoscope.streaming import streams as S

TALK = "conn long, turn long, text string, closes boolean, ts timestamp"
TURNS = "conv_id long, turn long, role string, text string, ts timestamp"


class Inbox:
    """A folder that files arrive in, one micro-batch each."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.path, self.schema = spark, f"{tmp_path}/in", schema
        os.makedirs(self.path)

    def put(self, rows):
        df = self.spark.createDataFrame(rows, self.schema.replace("timestamp", "long"))
        if "timestamp" in self.schema:
            df = df.withColumn("ts", F.timestamp_seconds("ts"))
        df.coalesce(1).write.mode("append").parquet(self.path)
        time.sleep(0.02)

    def stream(self):
        return S.file_stream(self.spark, self.path, self.schema, max_files_per_trigger=1)


def test_first_package_after_close_idle_time_and_restart(spark, tmp_path):
    inbox = Inbox(spark, tmp_path, TALK)
    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"

    def run():
        S.run_available(S.stream_first_package(inbox.stream(), F.col("closes"), watermark="1 second", idle_minutes=10), out, ck)
        return {(r.conn, r.turn): r.first_package for r in spark.read.parquet(out).collect()}

    inbox.put([(1, 2, "b", False, 120), (1, 1, "a", False, 60), (2, 1, "x", False, 60)])  # out of order in one file
    inbox.put([(1, 3, "c", False, 180), (1, 4, "", True, 200), (1, 5, "d", False, 220), (3, 1, "only", True, 200)])
    inbox.put([(1, 6, "", True, 240), (2, 2, "y", False, 240)])
    want = {(1, 1): True, (1, 2): False, (1, 3): False, (1, 5): True, (2, 1): True, (2, 2): False}
    assert run() == want
    # a new run goes on where the last one ended: connection 1 has closed, 2 is open
    inbox.put([(1, 7, "e", False, 300), (2, 3, "z", False, 300)])
    want |= {(1, 7): True, (2, 3): False}
    assert run() == want
    # an hour without a request ends a connection as well
    inbox.put([(9, 1, "clock", False, 4000)])
    inbox.put([(2, 4, "back", False, 4100), (9, 2, "tick", False, 4100)])
    want |= {(9, 1): True, (2, 4): True, (9, 2): False}
    assert run() == want


def test_state_of_closed_and_idle_connections_goes(spark, tmp_path):
    inbox = Inbox(spark, tmp_path, TALK)
    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"
    inbox.put([(i, 1, "a", False, 60) for i in range(50)])
    inbox.put([(i, 2, "", True, 70) for i in range(20)])
    inbox.put([(999, 1, "clock", False, 9000)])
    inbox.put([(999, 2, "tick", False, 9100)])
    S.run_available(S.stream_first_package(inbox.stream(), F.col("closes"), watermark="1 second", idle_minutes=10), out, ck)
    with S._state_store(spark):
        left = spark.read.format("statestore").option("stateVarName", "open").load(ck)
        assert [r.key[0] for r in left.select("key").collect()] == [999]


def test_conversation_in_the_wrong_order_and_repeated(spark, tmp_path):
    turns = [(7, t, "assistant" if t % 2 else "user", f"t{t}", 10_000 + 60 * t) for t in range(9)]
    rows = {}
    for name, order in (("right", range(9)), ("wrong", [8, 2, 5, 0, 7, 1, 6, 3, 4])):
        inbox = Inbox(spark, tmp_path / name, TURNS)
        order = list(order)
        for part in (order[:3], order[3:6], order[6:], order[6:]):  # the last file comes twice
            inbox.put([turns[t] for t in part])
        out = f"{tmp_path}/{name}/out"
        S.run_available(S.stream_conversation(inbox.stream(), keep=16), out, f"{tmp_path}/{name}/ck", mode="update",
                        foreach_batch=S.append_batches(out))
        rows[name] = [tuple(r) for r in S.latest_state(spark, out, ["conv_id"]).collect()]
    assert rows["right"] == rows["wrong"] == [(7, 9, 8, None, 9)]


def test_conversation_state_is_bounded(spark, tmp_path):
    inbox = Inbox(spark, tmp_path, TURNS)
    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"
    for part in range(3):
        inbox.put([(1, t, "assistant", f"t{t}", 10_000 + 60 * t) for t in range(100 * part, 100 * part + 100)])
    S.run_available(S.stream_conversation(inbox.stream(), keep=5), out, ck, mode="update", foreach_batch=S.append_batches(out))
    assert [tuple(r) for r in S.latest_state(spark, out, ["conv_id"]).collect()] == [(1, 300, 299, "t299", 5)]
    with S._state_store(spark):
        assert spark.read.format("statestore").option("stateVarName", "last").load(ck).count() <= 5


def test_dedupe_over_files_and_late_rows(spark, tmp_path):
    inbox = Inbox(spark, tmp_path, "id long, body string, ts timestamp")
    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"

    def run():
        S.run_available(S.stream_dedupe(inbox.stream(), "body", "ts", "1 hour").select("id"), out, ck)
        return sorted(r.id for r in spark.read.parquet(out).collect())

    inbox.put([(1, "a", 10_000), (2, "b", 10_000)])
    inbox.put([(3, "a", 10_900), (4, "c", 10_900)])  # a again, in another file
    assert run() == [1, 2, 4]
    inbox.put([(5, "b", 11_000), (6, "d", 20_000)])  # b again, after a restart
    for i in (7, 8):  # rows are late by the watermark of the trigger before, and go after the rows of a trigger
        inbox.put([(i, f"tick {i}", 20_000 + i)])
    inbox.put([(9, "e", 12_000), (10, "a", 21_000)])  # e is older than the watermark; a's hour is over
    assert run() == [1, 2, 4, 6, 7, 8, 10]


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    write = S.append_batches(f"{tmp_path}/out")
    first, second = (spark.createDataFrame([("k", n)], "key string, n long") for n in (1, 2))
    for batch, i in ((first, 0), (second, 1), (second, 1), (first, 0)):
        write(batch, i)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert [tuple(r) for r in S.latest_state(spark, f"{tmp_path}/out", ["key"]).collect()] == [("k", 2)]
