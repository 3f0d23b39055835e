"""Structured Streaming operators (STR01-STR06).

Sources are file streams (new files in a folder); sinks write under the
shared checkpoint folder with a checkpoint location, so a restarted query
resumes exactly.  Aggregates in update mode go through ``foreachBatch``, which
writes each micro-batch's changed rows as a folder of its own, so a batch that
is replayed replaces itself; the current table is "latest row per key"
(``latest_state``), computed by Spark, not by the driver.  Late data: rows older
than the watermark are dropped by Spark.

STR04 and STR06 keep a little state per key (``transformWithState``, RocksDB).
It goes by the key's own event (a connection that closes) or by an event-time
timer once the key has been idle, so the state follows the live keys.  A key's
rows of one trigger are put in order before they count, whatever files and
Arrow batches they came in; how many those can be is set by
``max_files_per_trigger``.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """RocksDB for the queries started inside, unless the session names a store itself."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, "")
    if not before or before.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over files arriving in ``path`` (glob allowed)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def run_available(sdf: DataFrame, out: str, checkpoint: str, mode: str = "append", fmt: str = "parquet",
                  foreach_batch=None) -> None:
    """Process everything available now, then stop (``availableNow``)."""
    w = sdf.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    with _state_store(sdf.sparkSession):
        if foreach_batch is not None:
            q = w.foreachBatch(foreach_batch).start()
        else:
            q = w.format(fmt).option("path", out).start()
        q.awaitTermination()


def append_batches(out: str):
    """foreachBatch writer: each micro-batch's rows in a folder ``batch_id=N``, replaced if the batch is replayed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return write


def latest_state(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Current value per key from update-mode batches: the row of the last batch."""
    d = spark.read.parquet(out)
    cols = [c for c in d.columns if c not in keys and c != "batch_id"]
    latest = d.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("__s"))
    return latest.select(*keys, "__s.*")


def stream_counts(sdf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """STR01 running counts per key (update mode)."""
    return sdf.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def stream_latency(sdf: DataFrame, ts: str, window: str, watermark: str, latency: str = "latency_s",
                   audio: str = "audio_s") -> DataFrame:
    """STR02 latency report per tumbling event-time window: requests, RTF,
    mean latency (ms), approximate p90 (ms).  ``ts`` must be a TIMESTAMP."""
    w = sdf.withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("requests"), (F.sum(latency) / F.sum(audio)).alias("rtf"),
                 (F.avg(latency) * 1000).alias("mean_latency_ms"),
                 (F.percentile_approx(latency, 0.9, 10000) * 1000).alias("p90_ms"),
                 F.max(latency).alias("max_latency_s")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests", "rtf",
                "mean_latency_ms", "p90_ms", "max_latency_s")


def stream_dedupe(sdf: DataFrame, key_col, ts: str, watermark: str) -> DataFrame:
    """STR03 each content hash once while within the watermark."""
    keyed = sdf.withColumn("content_key", F.md5(key_col if not isinstance(key_col, str) else F.col(key_col)))
    return keyed.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["content_key"])


class _Idle(StatefulProcessor):
    """A processor whose key's state goes once it has been idle for ``idle_ms`` of event time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def _init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def _rows(self, rows: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
        """The key's rows of this trigger, in order; its timer moves to the end of the idle time.

        Timers fire after a trigger's rows, so a key that comes back when its time is over is forgotten here."""
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")
        before = self.until.get()[0] if self.until.exists() else None
        if before is not None and int(pdf["ms"].min()) > before:
            self.handle.deleteTimer(before)
            self._forget()
            before = None
        until = int(pdf["ms"].max()) + self.idle_ms
        if before is None or until > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)
            self.until.update((until,))
        return pdf

    def _forget(self) -> None:
        self.until.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        return iter([])

    def close(self) -> None:
        pass


class _FirstPackage(_Idle):
    """The first request of a connection, and the first one after it closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._init(handle)
        self.open = handle.getValueState("open", "open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = self._rows(rows, "turn")
        was_open, first, last = self.open.exists(), [], None
        for closes, ms in zip(pdf["closes"].tolist(), pdf["ms"].tolist()):
            was_open = was_open and (last is None or ms - last <= self.idle_ms)
            first.append(not closes and not was_open)
            was_open, last = not closes, ms
        if was_open:
            self.open.update((True,))
        else:  # nothing to remember of a closed connection
            self.handle.deleteTimer(self.until.get()[0])
            self._forget()
        pdf["first_package"] = first
        yield pdf.loc[~pdf["closes"].astype(bool), ["conn", "turn", "text", "first_package"]]

    def _forget(self) -> None:
        super()._forget()
        self.open.clear()


def _keyed(sdf: DataFrame, ts: str, watermark: str, *columns: Column | str) -> DataFrame:
    return sdf.withWatermark(ts, watermark).select(*columns, F.col(ts), F.unix_millis(F.col(ts)).alias("ms"))


def stream_first_package(sdf: DataFrame, closes: Column, ts: str = "ts", watermark: str = "1 minute",
                         idle_minutes: float = 60) -> DataFrame:
    """STR04 mark each connection's first request: ``conn, turn, text, first_package``.

    ``closes`` marks the rows that end a connection (they are not returned); the
    request after it is a first one again, and so is one after ``idle_minutes``
    without any.  Chunking splits the first request smaller (TVF04)."""
    rows = _keyed(sdf, ts, watermark, F.col("conn").cast("long").alias("conn"), F.col("turn").cast("long").alias("turn"), "text",
                  F.coalesce(closes, F.lit(False)).alias("closes"))
    return rows.groupBy("conn").transformWithStateInPandas(
        _FirstPackage(int(idle_minutes * 60_000)), "conn long, turn long, text string, first_package boolean", "Append", "EventTime")


class _Conversation(_Idle):
    """The last turns of a conversation, and how many there have been."""

    def __init__(self, idle_ms: int, keep: int):
        super().__init__(idle_ms)
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._init(handle)
        self.turns = handle.getValueState("turns", "turns long")
        self.last = handle.getMapState("last", "turn long", "role string, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = self._rows(rows, "turn").drop_duplicates("turn")
        kept = {k[0]: tuple(v) for k, v in self.last.iterator()} if self.last.exists() else {}
        new = [(int(t), r, x) for t, r, x in zip(pdf["turn"], pdf["role"], pdf["text"]) if int(t) not in kept]
        turns = (self.turns.get()[0] if self.turns.exists() else 0) + len(new)
        self.turns.update((turns,))
        now = dict(sorted((kept | {t: (r, x) for t, r, x in new}).items())[-self.keep:])
        for t in kept.keys() - now.keys():
            self.last.removeKey((t,))
        for t in now.keys() - kept.keys():
            self.last.updateValue((t,), now[t])
        top = max(now)
        role, text = now[top]
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "last_turn": [top],
                            "last_assistant": [text if role == "assistant" else None], "kept": [len(now)]})

    def _forget(self) -> None:
        super()._forget()
        self.turns.clear()
        self.last.clear()


def stream_conversation(sdf: DataFrame, ts: str = "ts", watermark: str = "1 hour", idle_minutes: float = 1440,
                        keep: int = 8) -> DataFrame:
    """STR06 conversation state that grows by turn (update mode): ``conv_id, turns, last_turn, last_assistant, kept``.

    The state holds the last ``keep`` turns, so turns that come in the wrong
    order or again, up to that many back, count once and in their place; it goes
    after ``idle_minutes`` without a turn."""
    rows = _keyed(sdf, ts, watermark, F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                  "role", "text")
    return rows.groupBy("conv_id").transformWithStateInPandas(
        _Conversation(int(idle_minutes * 60_000), keep),
        "conv_id long, turns long, last_turn long, last_assistant string, kept int", "Update", "EventTime")
