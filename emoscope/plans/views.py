"""Views that give the driver tables the meaning of the reference's inputs.

Each view is a lazy DataFrame over the parquet tables, so every query that
uses it grows with the tables.  ``plans/oracle_views.py`` holds the same
definitions as SQL for the DuckDB check; the two are written independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emoscope.operators.ordered import neighbours
from emoscope.sources.tables import table

# The four emotion labels of the reference, in its order.
EMOTIONS = ["angry", "happy", "neutral", "sad"]
# The five event types that play the labels on the driver tables.
EVENT_LABELS = ["click", "error", "purchase", "signup", "view"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_predictions: voice label = event type, answer = previous event of
    the user, text label = next event of the user; file name in the TTS grammar.

    The previous / next event per user come from the range-sharded scan, so a
    user holding a third of all events is still spread over many tasks.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    ev = neighbours(ev, ["user_id"], ["ts", "event_id"],
                    lag=[("event_type", "pred_emo")], lead=[("event_type", "txt_emo")])
    cond = (F.when(F.col("event_id") % 3 == 0, "explicit")
            .when(F.col("event_id") % 3 == 1, "implicit").otherwise("neutral"))
    tts = (F.when(F.col("user_id") % 3 == 0, "COSY")
           .when(F.col("user_id") % 3 == 1, "F5TTS").otherwise("STYLE"))
    p = (ev.where(F.col("pred_emo").isNotNull() & F.col("txt_emo").isNotNull())
         .select(
             "event_id",
             F.col("event_type").alias("wav_emo"),
             "pred_emo",
             "txt_emo",
             cond.alias("txt_cond"),
             F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("slm"),
             tts.alias("tts_model"),
             F.lpad(F.col("user_id").cast("string"), 4, "0").alias("speaker"),
             F.lpad((F.col("event_id") % 100).cast("string"), 2, "0").alias("nn"),
         ))
    name = F.when(
        F.col("txt_cond") == "neutral",
        F.concat_ws("_", "nn", F.lit("neutral"), "wav_emo", "speaker", "tts_model"),
    ).otherwise(
        F.concat_ws("_", "nn", "txt_emo", "txt_cond", "wav_emo", "speaker", "tts_model"))
    return p.withColumn("file_name", F.concat(name, F.lit(".wav")))


def binary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-label truth / answer table: quality is the truth, toxic the answer."""
    lb = table(spark, sf_dir, "labels")
    return lb.select("doc_id", F.col("quality").cast("string").alias("y_true"),
                     F.col("toxic").cast("string").alias("y_pred"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterance manifest / speaker-emotion corpus over ``documents``."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".wav"))).alias("audio_path"),
        "text",
        (F.col("n_chars") / F.lit(15.0)).alias("duration"),
        F.col("source").alias("speaker"),
        F.col("lang").alias("emotion"),
        "lang",
    )


def sentences_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide, ragged sentence table: one column per role, keyed by (conv_id, turn)."""
    c = table(spark, sf_dir, "conversations")
    return (c.groupBy("conv_id", "turn")
            .pivot("role", ["user", "assistant", "system"])
            .agg(F.first("text")))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame-energy series: one series per user, frames in (ts, event_id) order."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("utt_id"), "ts", F.col("event_id").alias("frame_id"),
                     (F.col("value") / F.lit(500.0)).alias("rms"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array columns: the embedding vectors."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("utt_id"), F.col("embedding").alias("wave"), "label")


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as hypothesis, against the benchmark text whose id its own
    id leaves modulo the number of benchmark items."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("ref_text"))
    n = b.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("hyp_text"), "lang",
                                                 (F.col("doc_id") % n).alias("item_id"))
    return d.join(b, "item_id").select("pair_id", "ref_text", "hyp_text", "lang")


def latency_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log: latency in seconds, generated audio seconds, event time."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("request_id"),
        (F.col("value") / F.lit(1000.0)).alias("latency_s"),
        (F.lit(1) + F.col("event_id") % 10).cast("double").alias("audio_s"),
        "ts",
        F.col("event_type").alias("kind"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence texts for job expansion: the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id"), "text")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthesis jobs: every benchmark text x every target emotion, numbered."""
    from emoscope.operators.joins import expand_jobs
    return expand_jobs(texts(spark, sf_dir), EMOTIONS)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthesis results: every 7th job failed."""
    j = jobs(spark, sf_dir)
    ok = F.col("job_number") % 7 != 0
    return j.select(
        "job_number",
        ok.alias("success"),
        F.when(ok, F.format_string("out/%06d.wav", F.col("job_number"))).alias("audio_path"),
        F.when(ok, F.char_length("text") / F.lit(15.0)).alias("duration"),
        F.when(ok, F.lit("instruct")).otherwise(F.lit(None)).alias("method_used"),
        F.when(~ok, F.lit("synthesis failed")).alias("error_message"),
    )


def tagged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``[voice] text`` script per conversation, turns in order."""
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("t"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda s: s["t"]), " ").alias("script"))
