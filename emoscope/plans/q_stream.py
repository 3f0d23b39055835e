"""Batching, user-function, classifier and streaming queries
(WIN07, WIN08, UDF01, UDF03, UDA01, AGG29, STR01-STR06)."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emoscope.operators import batching as B
from emoscope.operators import udf as U
from emoscope.plans import views as V
from emoscope.plans.q_predictions import PARSED_CTES
from emoscope.plans.registry import oracle, register, rounded
from emoscope.sources.sinks import scratch_dir
from emoscope.sources.tables import table
from emoscope.streaming import streams as S

FRAMES_SQL = "floor(n_chars / 15e0 * 24000 / 256)"


def _frames(spark, sf):
    u = V.utterances(spark, sf)
    return u.select("doc_id", F.floor(F.col("duration") * 24000 / 256).cast("double").alias("frames"))


WIN07_SQL = f"""
WITH RECURSIVE s AS (
  SELECT row_number() OVER (ORDER BY len, doc_id) AS i, doc_id, len FROM (
    SELECT doc_id, {FRAMES_SQL} AS len FROM documents)),
r(i, doc_id, batch, frames, cnt, kept) AS (
  SELECT i, doc_id, 0, CASE WHEN len <= 12000 THEN len ELSE 0 END, CASE WHEN len <= 12000 THEN 1 ELSE 0 END,
         len <= 12000 FROM s WHERE i = 1
  UNION ALL
  SELECT s.i, s.doc_id,
         CASE WHEN r.frames + s.len <= 12000 AND r.cnt < 16 THEN r.batch
              ELSE r.batch + CASE WHEN r.cnt > 0 THEN 1 ELSE 0 END END,
         CASE WHEN r.frames + s.len <= 12000 AND r.cnt < 16 THEN r.frames + s.len WHEN s.len <= 12000 THEN s.len ELSE 0 END,
         CASE WHEN r.frames + s.len <= 12000 AND r.cnt < 16 THEN r.cnt + 1 WHEN s.len <= 12000 THEN 1 ELSE 0 END,
         (r.frames + s.len <= 12000 AND r.cnt < 16) OR s.len <= 12000
  FROM r JOIN s ON s.i = r.i + 1)
SELECT doc_id, CAST(batch AS BIGINT) AS batch FROM r WHERE kept"""


@register("win07_dynamic_batches", WIN07_SQL)
def q_win07(spark, sf):
    """Length-sorted greedy batches of at most 12,000 frames and 16 items over the whole table."""
    f = _frames(spark, sf).withColumn("shard", F.lit(0).cast("bigint"))
    b = B.dynamic_batches(f, "shard", "frames", "doc_id", budget=12000, max_n=16)
    return b.select("doc_id", (F.col("shard") * 1_000_000 + F.col("batch")).alias("batch"))


WIN08_SQL = f"""
WITH RECURSIVE s AS (
  SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS i, doc_id, len FROM (
    SELECT doc_id, len, CAST(floor((len - 93) / (2812 - 93 + 1) * 20) AS INTEGER) AS bucket FROM (
      SELECT doc_id, {FRAMES_SQL} AS len FROM documents) WHERE len BETWEEN 93 AND 2812)),
r(bucket, i, doc_id, batch, batch_after, acc_after) AS (
  SELECT bucket, i, doc_id, 0, CASE WHEN len >= 6000 THEN 1 ELSE 0 END, CASE WHEN len >= 6000 THEN 0 ELSE len END
  FROM s WHERE i = 1
  UNION ALL
  SELECT s.bucket, s.i, s.doc_id, r.batch_after,
         r.batch_after + CASE WHEN r.acc_after + s.len >= 6000 THEN 1 ELSE 0 END,
         CASE WHEN r.acc_after + s.len >= 6000 THEN 0 ELSE r.acc_after + s.len END
  FROM r JOIN s ON s.bucket = r.bucket AND s.i = r.i + 1)
SELECT doc_id, bucket, CAST(batch AS BIGINT) AS batch FROM r"""


@register("win08_bucket_batches", WIN08_SQL)
def q_win08(spark, sf):
    """Bucketed batching (20 buckets over 1-30 s in frames, budget 6,000
    frames), items in id order within a bucket."""
    b = B.bucket_batches(_frames(spark, sf), "frames", "doc_id", 93, 2812, budget=6000, buckets=20)
    return b.select("doc_id", "bucket", "batch")


def _word_rate_model():
    """A stand-in user model: words per character; texts with ``ß`` are errors of their own rows."""
    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        text = pdf["text"]
        failed = text.str.contains("ß")
        return pd.DataFrame({"value": text.str.split().str.len() / text.str.len(),
                             "error": failed.map({True: "unsupported character", False: None})})
    return model


@register("udf01_score", oracle("""
SELECT doc_id, CASE WHEN contains(text, 'ß') THEN NULL
                    ELSE round(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) / length(text), 6) END AS value,
       contains(text, 'ß') AS failed FROM documents"""))
def q_udf01(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    s = U.score(d, _word_rate_model, ["text"])
    return rounded(s.select("doc_id", "value", F.col("error").isNotNull().alias("failed")))


def _char_count_batch(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), pc.utf8_length(b.column(1)).cast(pa.int64()),
                                       pa.array([b.num_rows] * b.num_rows, pa.int64())],
                                      names=["doc_id", "n_chars_arrow", "batch_rows"])


@register("udf03_map_batches", oracle("""
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars_arrow, (batch_rows <= 100) AS bounded FROM (
  SELECT doc_id, text, 100 AS batch_rows FROM documents)"""))
def q_udf03(spark, sf):
    """Batched conversion in chunks of at most 100 rows (Arrow)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars_arrow", T.LongType()),
                           T.StructField("batch_rows", T.LongType())])
    out = U.map_batches(d, _char_count_batch, 100, schema)
    return out.select("doc_id", "n_chars_arrow", (F.col("batch_rows") <= 100).alias("bounded"))


def _acc_partial(g: pd.DataFrame) -> dict:
    return {"n": len(g), "hits": float((g["wav_emo"] == g["pred_emo"]).sum())}


def _acc_final(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"tts_model": pdf["tts_model"], "n": pdf["n"].astype("int64"),
                         "accuracy": (pdf["hits"] / pdf["n"]).round(6)})


@register("uda01_mergeable_metric", oracle("""
SELECT tts_model, CAST(count(*) AS BIGINT) AS n,
       round(avg(CASE WHEN wav_emo = pred_emo THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS accuracy
FROM parsed GROUP BY tts_model""", ["predictions"], PARSED_CTES))
def q_uda01(spark, sf):
    """A user metric (accuracy) as partial sums merged by Spark."""
    from emoscope.plans.q_predictions import parsed_predictions
    p = parsed_predictions(spark, sf).select("tts_model", "wav_emo", "pred_emo")
    return U.mergeable_metric(p, ["tts_model"], _acc_partial, ["n", "hits"], _acc_final,
                              "tts_model string, n long, accuracy double")


@register("agg29_train_classifier", None, "iterative model fit (Spark ML); reported per split")
def q_agg29(spark, sf):
    e = table(spark, sf, "embeddings")
    return rounded(U.train_classifier(e, "embedding", "label", "vec_id", max_iter=50), 4)


# ---- streaming --------------------------------------------------------------------

def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return S.file_stream(spark, f"{sf}/{name}*.parquet", schema)


@register("str01_stream_counts", oracle("""
SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type"""))
def q_str01(spark, sf):
    out, ck = scratch_dir(spark, "str01"), scratch_dir(spark, "str01-ckpt")
    S.run_available(S.stream_counts(_stream(spark, sf, "events"), ["event_type"]), out, ck, mode="update",
                    foreach_batch=S.append_batches(out))
    return S.latest_state(spark, out, ["event_type"])


@register("str02_stream_latency", oracle("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, CAST(count(*) AS BIGINT) AS requests,
       round(sum(latency_s) / sum(audio_s), 6) AS rtf, round(avg(latency_s) * 1000, 6) AS mean_latency_ms,
       round(max(latency_s), 6) AS max_latency_s FROM latency_log GROUP BY ALL""", ["latency_log"]))
def q_str02(spark, sf):
    """Daily tumbling windows over the request log, watermark one hour."""
    out, ck = scratch_dir(spark, "str02"), scratch_dir(spark, "str02-ckpt")
    ev = _stream(spark, sf, "events")
    log = ev.select(F.col("event_id").alias("request_id"), (F.col("value") / F.lit(1000.0)).alias("latency_s"),
                    (F.lit(1) + F.col("event_id") % 10).cast("double").alias("audio_s"),
                    F.col("ts").cast("timestamp").alias("ts"))
    S.run_available(S.stream_latency(log, "ts", "1 day", "1 hour"), out, ck, mode="update",
                    foreach_batch=S.append_batches(out))
    st = S.latest_state(spark, out, ["window_start"])
    return rounded(st.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "requests", "rtf",
                             "mean_latency_ms", "max_latency_s"))


def _arriving(spark, df, name, part, parts=3):
    """A stream over ``df`` in as many micro-batches as parts: files that arrive one after the other, by ``part``."""
    path = scratch_dir(spark, name)
    for k in range(parts):
        df.where(part == k).drop("part").coalesce(1).write.mode("append").parquet(path)
    return S.file_stream(spark, path, df.schema, max_files_per_trigger=1)


@register("str03_stream_dedupe", oracle("""
SELECT DISTINCT md5(props) AS content_key, 1::BIGINT AS n FROM events"""))
def q_str03(spark, sf):
    """Contents kept by the dedupe over three micro-batches, and how often; the delay spans the whole log."""
    out, ck = scratch_dir(spark, "str03"), scratch_dir(spark, "str03-ckpt")
    ev = table(spark, sf, "events").select("event_id", "props", F.col("ts").cast("timestamp").alias("ts"))
    ev = _arriving(spark, ev, "str03-in", F.col("event_id") % 3)
    S.run_available(S.stream_dedupe(ev, "props", "ts", "3650 days").select("event_id", "content_key"), out, ck)
    return spark.read.parquet(out).groupBy("content_key").agg(F.count(F.lit(1)).alias("n"))


def _talk(spark, sf):
    """Conversation turns a minute apart."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return c.withColumn("ts", F.timestamp_seconds(F.lit(1_767_225_600) + F.col("turn") * 60))


@register("str04_stream_first_package", oracle("""
SELECT conn, turn, row_number() OVER (PARTITION BY conn, closed ORDER BY turn) = 1 AS first_package FROM (
  SELECT conv_id AS conn, turn, count(*) FILTER (WHERE turn % 4 = 3) OVER (PARTITION BY conv_id ORDER BY turn) AS closed
  FROM conversations) WHERE turn % 4 <> 3"""))
def q_str04(spark, sf):
    """Requests per connection (conversation turns; every fourth one closes the
    connection) in three micro-batches; the first one of each connection is
    marked (and would be chunked smaller, TVF04)."""
    out, ck = scratch_dir(spark, "str04"), scratch_dir(spark, "str04-ckpt")
    c = _talk(spark, sf).withColumnRenamed("conv_id", "conn").drop("role")
    c = _arriving(spark, c, "str04-in", F.least(F.floor(F.col("turn") / 3), F.lit(2)))
    S.run_available(S.stream_first_package(c, F.col("turn") % 4 == 3), out, ck)
    return spark.read.parquet(out).select("conn", "turn", "first_package")


@register("str05_stream_append", oracle("""
SELECT CAST(count(*) AS BIGINT) AS n, round(sum(n_chars / 1000e0), 6) AS score_sum FROM documents"""))
def q_str05(spark, sf):
    """Scored rows appended to a JSON log as they arrive (checkpointed)."""
    out, ck = scratch_dir(spark, "str05"), scratch_dir(spark, "str05-ckpt")
    d = _stream(spark, sf, "documents").select("doc_id", (F.col("n_chars") / F.lit(1000.0)).alias("score"))
    S.run_available(d, out, ck, fmt="json")
    back = spark.read.schema("doc_id long, score double").json(out)
    return rounded(back.agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum")))


@register("str06_stream_conversation", oracle("""
SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, max(turn) AS last_turn,
       md5(coalesce(CASE WHEN arg_max(role, turn) = 'assistant' THEN arg_max(text, turn) END, '')) AS last_assistant_md5
FROM conversations GROUP BY conv_id"""))
def q_str06(spark, sf):
    """Turns in three micro-batches, later turns before earlier ones."""
    out, ck = scratch_dir(spark, "str06"), scratch_dir(spark, "str06-ckpt")
    c = _arriving(spark, _talk(spark, sf), "str06-in", F.pmod(F.lit(2) - F.col("turn"), F.lit(3)))
    S.run_available(S.stream_conversation(c, keep=64), out, ck, mode="update", foreach_batch=S.append_batches(out))
    st = S.latest_state(spark, out, ["conv_id"])
    return st.select("conv_id", "turns", "last_turn",
                     F.md5(F.coalesce("last_assistant", F.lit(""))).alias("last_assistant_md5"))
