"""Corpus preparation and statistics queries (FLT02-FLT14, AGG12-AGG30, SNK08).

They read the ``utterances`` view (documents as a speaker / emotion corpus),
``documents``, ``conversations``, ``events`` and the job views.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from emoscope.operators import corpus as C
from emoscope.operators import quality as Q
from emoscope.operators.reshape import melt_sentences
from emoscope.plans import views as V
from emoscope.plans.registry import oracle, register, rounded
from emoscope.sources.tables import table

HASH8_SQL = "CAST(('0x' || substr(md5(concat_ws(':', CAST({id} AS VARCHAR), '{seed}')), 1, 8)) AS BIGINT)"


@register("flt02_keep_range", oracle("""
SELECT lang, CAST(count(*) AS BIGINT) AS n FROM utterances WHERE duration BETWEEN 1 AND 30 GROUP BY lang""",
                                      ["utterances"]))
def q_flt02(spark, sf):
    u = Q.keep_range(V.utterances(spark, sf), "duration", 1.0, 30.0)
    return u.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register("flt03_keep_min_len", oracle("""
SELECT role, CAST(count(*) AS BIGINT) AS n FROM conversations WHERE length(trim(text)) >= 3 GROUP BY role"""))
def q_flt03(spark, sf):
    c = Q.keep_min_len(table(spark, sf, "conversations"), "text", 3, trim=True)
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@register("flt04_drop_blocklist", oracle("""
SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = d.doc_id) GROUP BY lang"""))
def q_flt04(spark, sf):
    """Block list = documents labelled toxic."""
    block = table(spark, sf, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    d = Q.drop_blocklist(table(spark, sf, "documents"), "doc_id", block)
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


# The "foreign script" markers used on the driver tables.
FOREIGN = ["ß", "ñ", "ç"]


@register("flt05_drop_contains_any", oracle("""
SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents
WHERE NOT (contains(text, 'ß') OR contains(text, 'ñ') OR contains(text, 'ç')) GROUP BY lang"""))
def q_flt05(spark, sf):
    d = Q.drop_contains_any(table(spark, sf, "documents"), "text", FOREIGN)
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register("flt06_repetition_found", oracle("""
SELECT DISTINCT doc_id FROM (
  SELECT doc_id, substr(text, i, 4) AS g, count(*) AS n
  FROM documents, range(1, length(text) - 4 + 2) r(i)
  GROUP BY doc_id, g HAVING count(*) > 10)"""))
def q_flt06(spark, sf):
    """Documents where some 4-character gram occurs more than 10 times
    (overlapping), over whole texts."""
    return Q.repetition_hits(table(spark, sf, "documents"), "doc_id", "text", n=4, tolerance=10)


def _ledger(spark, sf):
    u = V.utterances(spark, sf)
    return Q.quality_gate(u, [
        ("error path", F.col("audio_path").isNull()),
        ("duration > 30 sec", F.col("duration") > 30),
        ("duration < 1 sec", F.col("duration") < 1),
        ("very short text length 3", F.char_length("text") <= 3),
    ])


LEDGER_CTE = [("ledger", """
  SELECT *, CASE WHEN audio_path IS NULL THEN 'error path' WHEN duration > 30 THEN 'duration > 30 sec'
                 WHEN duration < 1 THEN 'duration < 1 sec' WHEN length(text) <= 3 THEN 'very short text length 3'
            END AS reason FROM utterances""")]


@register("flt11_quality_gate", oracle("""
SELECT coalesce(reason, 'accepted') AS reason, CAST(count(*) AS BIGINT) AS n FROM ledger GROUP BY ALL""",
                                        ["utterances"], LEDGER_CTE))
def q_flt11(spark, sf):
    led = _ledger(spark, sf)
    return led.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("flt13_reject_counts", oracle("""
SELECT lang, CAST(count(*) FILTER (WHERE reason IS NOT NULL) AS BIGINT) AS rejected, CAST(count(*) AS BIGINT) AS total
FROM ledger GROUP BY lang""", ["utterances"], LEDGER_CTE))
def q_flt13(spark, sf):
    return Q.reject_counts(_ledger(spark, sf), "lang")


@register("flt12_subsample", oracle(f"""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM documents
WHERE {HASH8_SQL.format(id='doc_id', seed=7)} / 4294967296e0 < 0.3"""))
def q_flt12(spark, sf):
    s = Q.subsample(table(spark, sf, "documents"), 0.3, 7, id_col="doc_id")
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


@register("flt14_drop_label", oracle("""
SELECT CAST(count(*) AS BIGINT) AS n FROM utterances WHERE lower(emotion) <> 'en'""", ["utterances"]))
def q_flt14(spark, sf):
    return Q.drop_label(V.utterances(spark, sf), "emotion", "EN").agg(F.count(F.lit(1)).alias("n"))


@register("agg12_distribution", oracle("""
SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share,
       CAST(row_number() OVER (ORDER BY n DESC, event_type) AS BIGINT) AS rank
FROM (SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type)"""))
def q_agg12(spark, sf):
    return rounded(C.distribution(table(spark, sf, "events"), "event_type"))


@register("agg12_distribution_summary", oracle("""
SELECT (SELECT event_type FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1) AS most_common,
       CAST(count(DISTINCT event_type) AS BIGINT) AS n_distinct FROM events"""))
def q_agg12s(spark, sf):
    return C.distribution_summary(table(spark, sf, "events"), "event_type")


def _sentences_long(spark, sf):
    """RSH01 over the wide sentence view: (conv_id, turn, csv_column, text)."""
    w = V.sentences_wide(spark, sf)
    return melt_sentences(w, ["conv_id", "turn"], ["user", "assistant", "system"])


SENT_LONG = [("sent_long", """
  SELECT conv_id, turn, csv_column, text FROM (
    SELECT conv_id, turn, 'user' AS csv_column, "user" AS text FROM sentences_wide
    UNION ALL SELECT conv_id, turn, 'assistant', assistant FROM sentences_wide
    UNION ALL SELECT conv_id, turn, 'system', system FROM sentences_wide) WHERE text IS NOT NULL""")]


@register("rsh01_melt_sentences", oracle("""
SELECT csv_column, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM sent_long
GROUP BY csv_column""", ["sentences_wide"], SENT_LONG))
def q_rsh01(spark, sf):
    lg = _sentences_long(spark, sf)
    return lg.groupBy("csv_column").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


@register("agg13_text_stats", oracle("""
SELECT CAST(count(*) AS BIGINT) AS n_texts, CAST(min(length(text)) AS INTEGER) AS min_len,
       CAST(max(length(text)) AS INTEGER) AS max_len, round(avg(length(text)), 6) AS avg_len,
       min(conv_id) AS first_line, max(conv_id) AS last_line, CAST(count(DISTINCT conv_id) AS BIGINT) AS distinct_lines,
       CAST(count(DISTINCT text) AS BIGINT) AS distinct_texts, CAST(count(DISTINCT csv_column) AS BIGINT) AS n_classes
FROM sent_long""", ["sentences_wide"], SENT_LONG))
def q_agg13(spark, sf):
    return rounded(C.text_stats(_sentences_long(spark, sf), "text", "csv_column", "conv_id"))


@register("agg14_coverage", oracle("""
SELECT f.speaker, f.emotion, CAST(f.files AS BIGINT) AS files, round(h.a, 6) AS avg_first5_duration,
       CAST(e.s AS BIGINT) AS speakers_with_emotion,
       (SELECT CAST(count(*) AS BIGINT) FROM utterances) AS total_files
FROM f JOIN h USING (speaker, emotion) JOIN e USING (emotion)""", ["utterances"], [
    ("f", "SELECT speaker, emotion, count(*) AS files FROM utterances GROUP BY ALL"),
    ("h", """SELECT speaker, emotion, avg(duration) AS a FROM (
               SELECT *, row_number() OVER (PARTITION BY speaker, emotion ORDER BY audio_path) AS rn FROM utterances)
             WHERE rn <= 5 GROUP BY ALL"""),
    ("e", "SELECT emotion, count(DISTINCT speaker) AS s FROM utterances GROUP BY emotion"),
]))
def q_agg14(spark, sf):
    return rounded(C.coverage(V.utterances(spark, sf)))


@register("agg15_manifest_summary", oracle("""
SELECT CAST(count(*) AS BIGINT) AS rows, round(sum(duration) / 3600, 6) AS hours, round(min(duration), 6) AS min_sec,
       round(max(duration), 6) AS max_sec,
       (SELECT CAST(count(DISTINCT c) AS BIGINT) FROM (SELECT unnest(string_split(text, '')) AS c FROM utterances)
        WHERE c <> '') AS vocab_size
FROM utterances""", ["utterances"]))
def q_agg15(spark, sf):
    return rounded(C.manifest_summary(V.utterances(spark, sf)))


@register("agg16_build_vocab", oracle("""
SELECT token, CAST(row_number() OVER (ORDER BY unicode(token)) - 1 AS BIGINT) AS idx FROM (
  SELECT DISTINCT unnest(string_split(text, '')) AS token FROM documents) WHERE token <> ''"""))
def q_agg16(spark, sf):
    return C.build_vocab(table(spark, sf, "documents"), "text")


@register("agg16_build_vocab_forced_ranges", oracle("""
SELECT token, CAST(row_number() OVER (ORDER BY unicode(token)) - 1 AS BIGINT) AS idx FROM (
  SELECT DISTINCT unnest(string_split(text, '')) AS token FROM benchmark
  UNION SELECT chr(CAST(i AS INTEGER)) FROM range(32, 127) r(i) UNION SELECT chr(CAST(i AS INTEGER)) FROM range(192, 256) r(i)) WHERE token <> ''"""))
def q_agg16b(spark, sf):
    return C.build_vocab(table(spark, sf, "benchmark"), "text", extra_ranges=[(32, 126), (192, 255)])


BENCH_VOCAB = [("bv", "SELECT DISTINCT unnest(string_split(text, '')) AS token FROM benchmark")]


@register("agg17_oov", oracle("""
SELECT token, CAST(count(*) AS BIGINT) AS n, CAST(min(doc_id * 1000000 + i - 1) // 1000000 AS BIGINT) AS first_row,
       CAST(arg_min(i - 1, doc_id * 1000000 + i - 1) AS INTEGER) AS first_pos
FROM (SELECT doc_id, i, substr(text, i, 1) AS token FROM documents, range(1, length(text) + 1) r(i))
WHERE token NOT IN (SELECT token FROM bv) GROUP BY token""", [], BENCH_VOCAB))
def q_agg17(spark, sf):
    vocab = C.build_vocab(table(spark, sf, "benchmark"), "text")
    return C.oov(table(spark, sf, "documents"), "doc_id", "text", vocab)


@register("agg18_extend_vocab", oracle("""
SELECT token, CAST(idx AS BIGINT) AS idx FROM v
UNION ALL SELECT token, CAST((SELECT max(idx) FROM v) + row_number() OVER (ORDER BY cp, token) AS BIGINT) FROM new""",
    [], BENCH_VOCAB + [
        ("v", "SELECT token, row_number() OVER (ORDER BY unicode(token)) - 1 AS idx FROM bv WHERE token <> ''"),
        ("req", """SELECT token, min(unicode(token)) AS cp FROM (SELECT unnest(string_split(text, '')) AS token FROM documents)
                   WHERE token <> '' GROUP BY token"""),
        ("new", "SELECT token, cp FROM req WHERE token NOT IN (SELECT token FROM v)"),
    ]))
def q_agg18(spark, sf):
    vocab = C.build_vocab(table(spark, sf, "benchmark"), "text")
    req = table(spark, sf, "documents").select(
        F.explode(F.array_distinct(F.filter(F.split("text", ""), lambda x: x != ""))).alias("token"))
    req = req.withColumn("cp", F.conv(F.hex(F.encode("token", "UTF-32")), 16, 10).cast("bigint"))
    return C.extend_vocab(vocab, req, "cp")


@register("agg19_mean_score", oracle("""
SELECT lang, round_even(avg(n_chars / 1000e0), 5) AS mean_score_wer, CAST(count(*) AS BIGINT) AS n
FROM documents GROUP BY lang"""))
def q_agg19(spark, sf):
    d = table(spark, sf, "documents").select("lang", (F.col("n_chars") / F.lit(1000.0)).alias("score_wer"))
    return C.mean_score(d, "score_wer", 5, ["lang"]).withColumnRenamed("mean_score_wer", "mean_score_wer")


@register("agg20_latency_report", oracle("""
SELECT kind, CAST(count(*) AS BIGINT) AS requests, round(sum(latency_s) / sum(audio_s), 6) AS rtf,
       round(avg(latency_s) * 1000, 6) AS mean_latency_ms, round(var_pop(latency_s) * 1000, 6) AS latency_variance,
       round(quantile_cont(latency_s, 0.5) * 1000, 6) AS p50_ms, round(quantile_cont(latency_s, 0.9) * 1000, 6) AS p90_ms,
       round(quantile_cont(latency_s, 0.95) * 1000, 6) AS p95_ms, round(quantile_cont(latency_s, 0.99) * 1000, 6) AS p99_ms
FROM latency_log GROUP BY kind""", ["latency_log"]))
def q_agg20(spark, sf):
    return rounded(C.latency_report(V.latency_log(spark, sf), by=["kind"]))


@register("agg21_batch_stats", oracle("""
SELECT batch_size, CAST(count(*) AS BIGINT) AS executions, round(sum(value * 1e6) / 1e6, 6) AS total_ms,
       round(sum(value * 1e6) / 1e6 / count(*), 6) AS avg_ms,
       round(sum(value * 1e6) / 1e6 / count(*) / batch_size, 6) AS avg_ms_per_sample
FROM (SELECT CAST(user_id % 8 + 1 AS INTEGER) AS batch_size, value FROM events) GROUP BY batch_size"""))
def q_agg21(spark, sf):
    """Server batch statistics over a per-execution log derived from events."""
    ev = table(spark, sf, "events").select((F.col("user_id") % 8 + 1).cast("int").alias("batch_size"),
                                           F.lit(1).cast("bigint").alias("count"),
                                           (F.col("value") * 1e6).alias("total_ns"))
    return rounded(C.batch_stats(ev))


@register("agg22_mean_std", oracle("""
SELECT lang, round(avg(duration), 6) AS mean_duration, round(stddev_pop(duration), 6) AS std_duration
FROM utterances GROUP BY lang""", ["utterances"]))
def q_agg22(spark, sf):
    return rounded(C.mean_std(V.utterances(spark, sf), "duration", ["lang"]))


@register("agg23_run_stats", oracle("""
SELECT emotion, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE job_number % 7 <> 0) AS BIGINT) AS succeeded,
       CAST(count(*) FILTER (WHERE job_number % 7 = 0) AS BIGINT) AS failed,
       round(avg(CASE WHEN job_number % 7 <> 0 THEN 1e0 ELSE 0e0 END), 6) AS success_rate
FROM jobs GROUP BY emotion""", ["jobs"]))
def q_agg23(spark, sf):
    from emoscope.operators.joins import join_results
    ok, bad = join_results(V.results(spark, sf), V.jobs(spark, sf))
    return rounded(C.run_stats(ok.unionByName(bad), by=["emotion"]))


@register("agg25_best_epoch", oracle("""
SELECT CAST(arg_max(epoch, wa * 1e6 - epoch) AS INTEGER) AS best_epoch, round(max(wa), 6) AS best_wa FROM (
  SELECT CAST(dayofmonth(ts) AS INTEGER) AS epoch, avg(value) AS wa FROM events GROUP BY ALL)"""))
def q_agg25(spark, sf):
    """Epoch log derived from events: epoch = day of month, metric = mean value."""
    log = table(spark, sf, "events").groupBy(F.dayofmonth("ts").alias("epoch")).agg(F.avg("value").alias("wa"))
    return rounded(C.best_epoch(log))


@register("agg26_training_plan", oracle("""
SELECT round(max(duration * 24000 / 256), 6) AS max_frame_len, CAST(count(*) AS BIGINT) AS samples,
       round(sum(duration) / 3600, 6) AS hours, round(sum(duration * 24000 / 256), 6) AS total_frames,
       CAST(ceil(sum(duration * 24000 / 256) / (8 * 38400)) AS BIGINT) AS updates_per_epoch,
       CAST(ceil(ceil(sum(duration * 24000 / 256) / (8 * 38400)) * 0.05) AS BIGINT) AS warmup_updates,
       round(1200000 / (sum(duration * 24000 / 256) / (8 * 38400)), 6) AS epochs
FROM utterances""", ["utterances"]))
def q_agg26(spark, sf):
    return rounded(C.training_plan(V.utterances(spark, sf), "duration", workers=8, frames_per_worker=38400,
                                   epochs_updates=1_200_000))


@register("agg27_validate", oracle("""
SELECT CAST(count(*) FILTER (WHERE length(trim(text)) = 0) AS BIGINT) AS empty_texts,
       CAST(count(*) FILTER (WHERE length(trim(text)) > 0 AND length(trim(text)) < 10) AS BIGINT) AS short_texts,
       CAST(count(*) - count(DISTINCT (conv_id * 10 + CASE csv_column WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END))
            AS BIGINT) AS duplicate_lines,
       CAST(count(*) FILTER (WHERE conv_id < 0) AS BIGINT) AS out_of_range,
       CASE WHEN count(*) FILTER (WHERE csv_column = 'narrator') = 0 THEN 'narrator' END AS missing
FROM sent_long""", ["sentences_wide"], SENT_LONG))
def q_agg27(spark, sf):
    """Validation of the melted sentence table: required classes include one
    that never occurs (``narrator``)."""
    v = Q.validate_table(_sentences_long(spark, sf), "text", "conv_id", "csv_column",
                         ["user", "assistant", "narrator"])
    return v.select("empty_texts", "short_texts", "duplicate_lines", "out_of_range",
                    F.array_join("missing_classes", ",").alias("missing"))


@register("agg30_epoch_log", oracle("""
SELECT CAST(dayofmonth(ts) AS INTEGER) AS epoch, round(avg(value), 6) AS mean_loss, CAST(count(*) AS BIGINT) AS batches
FROM events GROUP BY ALL"""))
def q_agg30(spark, sf):
    log = table(spark, sf, "events").select(F.dayofmonth("ts").alias("epoch"), F.col("value").alias("loss"))
    return rounded(C.epoch_log(log))


@register("snk08_dataset_card", oracle("""
SELECT emotion, emotion_type, CAST(count(*) AS BIGINT) AS n FROM jobs WHERE job_number % 7 <> 0 GROUP BY ALL""",
                                        ["jobs"]))
def q_snk08(spark, sf):
    from emoscope.operators.joins import join_results
    ok, _ = join_results(V.results(spark, sf), V.jobs(spark, sf))
    by_type, _by_method = C.dataset_card(ok)
    return by_type
