"""Source / sink round trips (SRC01-SRC16, SNK01-SNK07, AGG24).

Each query derives files in the reference's formats from the driver tables,
writes them with the sinks under the shared checkpoint folder, reads them
back with the readers and returns an aggregate that the oracle computes from
the tables directly.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from emoscope.functions import names as N
from emoscope.operators import corpus as C
from emoscope.plans import views as V
from emoscope.plans.q_predictions import PARSED_CTES
from emoscope.plans.registry import oracle, register, rounded
from emoscope.sources import readers as R
from emoscope.sources import sinks as K
from emoscope.sources.tables import table

MODEL_OF = {"m0": "desta2", "m1": "qwen", "m2": "salmonn", "m3": "flamingo3"}


@register("src01_read_predictions", oracle("""
SELECT lower(pred_emo) AS pred_label, CAST(count(*) AS BIGINT) AS n FROM predictions GROUP BY ALL""",
                                            ["predictions"]))
def q_src01(spark, sf):
    p = V.predictions(spark, sf)
    out = K.scratch_dir(spark, "src01")
    K.write_csv(p.select(F.col("file_name").alias("file_path"), F.col("file_name").alias("filename"),
                         F.col("pred_emo").alias("emotion"), F.lit("2024-01-01T00:00:00").alias("processed_at")), out)
    back = N.normalise_predictions(R.read_predictions(spark, out))
    return back.groupBy("pred_label").agg(F.count(F.lit(1)).alias("n"))


@register("src02_scan_results", oracle("""
SELECT CASE slm WHEN 'm0' THEN 'desta2' WHEN 'm1' THEN 'qwen' WHEN 'm2' THEN 'salmonn' ELSE 'flamingo3' END AS model,
       lower(pred_emo) AS pred_emo, CAST(count(*) AS BIGINT) AS n FROM predictions GROUP BY ALL""", ["predictions"]))
def q_src02(spark, sf):
    """Result folders per model (plus a version that must be skipped and a
    non-result folder), discovered and parsed by model."""
    from emoscope.plans.q_predictions import _shaped_tables
    base = K.scratch_dir(spark, "src02")
    p = V.predictions(spark, sf).select("slm", "file_name", "pred_emo").persist(StorageLevel.MEMORY_AND_DISK)
    try:  # eight tables are written of rows that are made once
        for (slm, model), t in zip(MODEL_OF.items(), _shaped_tables(p)):
            K.write_csv(t, f"{base}/results_cosy_{model}/preds_v4.csv")
            K.write_csv(t.limit(3), f"{base}/results_cosy_{model}/preds_v3.csv")
    finally:
        p.unpersist()
    K.write_csv(table(spark, sf, "region"), f"{base}/samples_cosy/preds_v4.csv")
    scanned = R.scan_results(spark, base, "v4")
    return (scanned.select("model", N.clean_label(N.label_by_model("model")).alias("pred_emo"))
            .groupBy("model", "pred_emo").agg(F.count(F.lit(1)).alias("n")))


@register("src03_read_sentences", oracle("""
SELECT csv_column, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
  SELECT 'user' AS csv_column, "user" AS text FROM sentences_wide UNION ALL
  SELECT 'assistant', assistant FROM sentences_wide UNION ALL SELECT 'system', system FROM sentences_wide)
WHERE text IS NOT NULL GROUP BY csv_column""", ["sentences_wide"]))
def q_src03(spark, sf):
    """Wide CSV with quoted multi-line texts, read back and melted (RSH01)."""
    from emoscope.operators.reshape import melt_sentences
    out = K.scratch_dir(spark, "src03")
    K.write_csv(V.sentences_wide(spark, sf), out)
    back = R.read_sentences(spark, out)
    long = melt_sentences(back, ["conv_id", "turn"], ["user", "assistant", "system"])
    return long.groupBy("csv_column").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


def _pipe_lines(spark, sf):
    u = V.utterances(spark, sf)
    return u.select("audio_path", F.regexp_replace("text", r"[\r\n|]+", " ").alias("text"))


@register("src04_read_pipe_manifest", oracle("""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(trim(regexp_replace(text, '[\\r\\n|]+', ' ', 'g')))) AS BIGINT) AS chars,
       CAST(count(*) FILTER (WHERE starts_with('wavs/' || audio_path, 'wavs/')) AS BIGINT) AS prefixed FROM utterances""",
                                              ["utterances"]))
def q_src04(spark, sf):
    """``audio_file|text`` with a header in every part file; the parent folder is prefixed."""
    out = K.scratch_dir(spark, "src04")
    _pipe_lines(spark, sf).write.mode("overwrite").option("sep", "|").option("header", True) \
        .option("quote", "\u0000").csv(out)
    back = R.read_pipe_manifest(spark, out, header=True, parent="wavs")
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"),
                    F.count_if(F.col("audio_path").startswith("wavs/")).alias("prefixed"))


@register("src05_read_pipe_manifest_arity", oracle("""
SELECT CAST(count(*) AS BIGINT) AS n FROM utterances WHERE doc_id % 3 <> 0""", ["utterances"]))
def q_src05(spark, sf):
    """No header, exactly two fields: every third line carries a third field and is dropped."""
    out = K.scratch_dir(spark, "src05")
    u = V.utterances(spark, sf)
    line = F.concat_ws("|", "audio_path", F.regexp_replace("text", r"[\r\n|]+", " "),
                       F.when(F.col("doc_id") % 3 == 0, F.lit("extra")))
    u.select(line.alias("value")).write.mode("overwrite").text(out)
    return R.read_pipe_manifest(spark, out, header=False, arity=2).agg(F.count(F.lit(1)).alias("n"))


@register("src06_read_pipe_manifest_three", oracle("""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(lang)) AS BIGINT) AS chars FROM utterances""", ["utterances"]))
def q_src06(spark, sf):
    """Three fields, the last (normalised text) is kept."""
    out = K.scratch_dir(spark, "src06")
    V.utterances(spark, sf).select(F.concat_ws("|", "audio_path", F.lit("raw"), "lang").alias("value")) \
        .write.mode("overwrite").text(out)
    back = R.read_pipe_manifest(spark, out, header=False, arity=3)
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


@register("src07_read_jsonl_manifest", oracle("""
SELECT lang AS language, CAST(count(*) AS BIGINT) AS n, round(sum(duration), 6) AS seconds,
       CAST(count(DISTINCT speaker) AS BIGINT) AS id_tokens FROM utterances GROUP BY lang""", ["utterances"]))
def q_src07(spark, sf):
    out = K.scratch_dir(spark, "src07")
    u = V.utterances(spark, sf)
    u.select("text", F.col("lang").alias("language"), F.concat(F.lit("emilia/"), "audio_path").alias("wav"),
             "duration").write.mode("overwrite").json(out)
    back = R.read_jsonl_manifest(spark, f"{out}/*.json")
    return rounded(back.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("seconds"),
                                                F.count_distinct("id_token").alias("id_tokens")))


@register("src08_read_sidecar_json", oracle("""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM benchmark"""))
def q_src08(spark, sf):
    """One JSON object per file (benchmark items); the audio path is the sibling ``.mp3``."""
    out = K.scratch_dir(spark, "src08")
    table(spark, sf, "benchmark").select("text", F.lit("en").alias("language"),
                                         F.format_string("b/%d.mp3", "item_id").alias("wav"),
                                         F.lit(1.0).alias("duration")) \
        .write.mode("overwrite").option("maxRecordsPerFile", 1).json(out)
    back = R.read_sidecar_json(spark, f"{out}/*.json")
    return back.where(F.col("audio_path").endswith(".mp3")).agg(F.count(F.lit(1)).alias("n"),
                                                                F.sum(F.char_length("text")).alias("chars"))


@register("src09_read_sidecar_text", oracle("""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS BIGINT) AS chars
FROM benchmark"""))
def q_src09(spark, sf):
    """One text file per item, read whole."""
    out = K.scratch_dir(spark, "src09")
    table(spark, sf, "benchmark").select("text").write.mode("overwrite").option("maxRecordsPerFile", 1).text(out)
    back = R.read_sidecar_text(spark, f"{out}/*.txt", mode="whole")
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


@register("src10_read_eval_list", oracle("""
SELECT CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE gt_wav = '/eval/' || CAST(pair_id AS VARCHAR) || '.wav') AS BIGINT) AS defaulted
FROM (SELECT pair_id, CASE WHEN pair_id % 2 = 0 THEN '/eval/gt_' || CAST(pair_id AS VARCHAR) || '.wav'
                           ELSE '/eval/' || CAST(pair_id AS VARCHAR) || '.wav' END AS gt_wav FROM text_pairs)""",
                                          ["text_pairs"]))
def q_src10(spark, sf):
    """Eval list with 4 or 5 fields; the missing 5th defaults, paths made absolute."""
    out = K.scratch_dir(spark, "src10")
    p = V.text_pairs(spark, sf)
    clean = lambda c: F.regexp_replace(c, r"[\r\n|]+", " ")
    line = F.concat_ws("|", F.col("pair_id").cast("string"), clean(F.col("ref_text")),
                       F.format_string("prompt_%d.wav", "pair_id"), clean(F.col("hyp_text")),
                       F.when(F.col("pair_id") % 2 == 0, F.format_string("gt_%d.wav", "pair_id")))
    p.select(line.alias("value")).write.mode("overwrite").text(out)
    back = R.read_eval_list(spark, out, "/eval")
    return back.agg(F.count(F.lit(1)).alias("n"),
                    F.count_if(F.col("gt_wav") == F.concat(F.lit("/eval/"), "utt", F.lit(".wav"))).alias("defaulted"))


@register("src11_read_cross_sentence_list", oracle("""
SELECT speaker, CAST(count(*) AS BIGINT) AS n FROM utterances GROUP BY speaker""", ["utterances"]))
def q_src11(spark, sf):
    """TSV of pairs whose ids are ``spk-chapter-utt``; speakers come back from the paths."""
    out = K.scratch_dir(spark, "src11")
    u = V.utterances(spark, sf)
    uid = F.concat_ws("-", "speaker", F.lit("0"), F.col("doc_id").cast("string"))
    u.select(uid.alias("a"), "duration", F.lit("ref"), uid, "duration", F.lit("gen")) \
        .write.mode("overwrite").option("sep", "\t").csv(out)
    back = R.read_cross_sentence_list(spark, out, "/libri")
    return back.groupBy(F.get(F.split("ref_wav", "/"), 2).alias("speaker")).agg(F.count(F.lit(1)).alias("n"))


@register("src12_read_rooted_tsv", oracle("""
SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS line_no,
       '/corpus/' || source || '/' || CAST(doc_id AS VARCHAR) || '.wav' AS path,
       n_chars * 10 AS frames, lang AS label FROM documents"""))
def q_src12(spark, sf):
    """SNK06 writes the positional triple, SRC12 reads the tsv back and JN03
    zips it with the label file by line number."""
    from emoscope.operators.joins import zip_by_line
    from emoscope.operators.ranking import number_rows
    out = K.scratch_dir(spark, "src12")
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source")
    u = number_rows(d, [], ["doc_id"], "line_no").withColumn("line_no", F.col("line_no") - 1)
    u = u.select("line_no", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".wav")))
                 .alias("rel_path"), (F.col("n_chars") * 10).alias("frames"),
                 F.col("doc_id").cast("string").alias("name"), F.col("lang").alias("label"))
    K.write_rooted_manifest(u, out, "/corpus")
    tsv = R.read_rooted_tsv(spark, f"{out}/tsv")
    emo = R.numbered_lines(spark, f"{out}/emo").select("line_no", F.get(F.split("value", "\t"), 1).alias("label"))
    return zip_by_line(tsv, emo).select("line_no", "path", "frames", "label")


@register("src13_read_vocab", oracle("""
SELECT token, CAST(CASE WHEN idx < 5 THEN idx + n ELSE idx END AS BIGINT) AS idx FROM (
  SELECT token, row_number() OVER (ORDER BY unicode(token)) - 1 AS idx, count(*) OVER () AS n FROM (
    SELECT DISTINCT unnest(string_split(replace(text, chr(10), ''), '')) AS token FROM benchmark) WHERE token <> '')"""))
def q_src13(spark, sf):
    """Vocabulary file whose first five tokens repeat at the end: a repeated
    token keeps its last line number."""
    out = K.scratch_dir(spark, "src13")
    b = table(spark, sf, "benchmark").select(F.regexp_replace("text", "\n", "").alias("text"))
    v = C.build_vocab(b, "text")
    n = v.groupBy().agg(F.count(F.lit(1))).scalar()
    lines = v.unionByName(v.where(F.col("idx") < 5).select("token", (F.col("idx") + n).alias("idx")))
    lines.orderBy("idx").select("token").write.mode("overwrite").text(out)
    return R.read_vocab(spark, out)


@register("src14_file_inventory", None, "listing of the table folder; sizes depend on the file system")
def q_src14(spark, sf):
    inv = R.file_inventory(spark, sf, ["*.parquet"], recursive=False)
    return inv.select("name", "suffix", "length")


@register("agg24_dir_size", None, "total bytes of a listing; sizes depend on the file system")
def q_agg24(spark, sf):
    return C.dir_size(R.file_inventory(spark, sf, ["*.parquet"], recursive=False), ["suffix"])


@register("src15_load_prepared", oracle("""
SELECT CAST(count(*) AS BIGINT) AS rows, round(sum(duration) / 3600, 6) AS hours FROM utterances""", ["utterances"]))
def q_src15(spark, sf):
    """SNK02/SNK03 write a prepared set in shards of 300 rows; SRC15 loads it."""
    out = K.scratch_dir(spark, "src15")
    K.write_prepared(V.utterances(spark, sf).select("audio_path", "text", "duration"), out, max_records=300)
    back = R.load_prepared(spark, out)
    return rounded(back.agg(F.count(F.lit(1)).alias("rows"), (F.sum("duration") / 3600).alias("hours")))


@register("src16_read_metrics_report", oracle("""
SELECT slm AS report, 'true' AS target, wav_emo AS actual, pred_emo AS predicted, CAST(count(*) AS BIGINT) AS n
FROM parsed GROUP BY ALL
UNION ALL
SELECT slm, 'proxy', txt_emo, pred_emo, CAST(count(*) AS BIGINT) FROM parsed GROUP BY ALL""", ["predictions"],
    PARSED_CTES))
def q_src16(spark, sf):
    """Reports written per model (true and proxy matrices), parsed back into
    long-form confusion cells; zero cells are dropped for the comparison."""
    from emoscope.operators.metrics import confusion
    from emoscope.plans.q_predictions import parsed_predictions
    p = parsed_predictions(spark, sf).withColumnRenamed("slm", "report")
    cm = (confusion(p, "wav_emo", "pred_emo", ["report"]).withColumn("target", F.lit("true"))
          .unionByName(confusion(p, "txt_emo", "pred_emo", ["report"]).withColumn("target", F.lit("proxy"))))
    out = K.scratch_dir(spark, "src16")
    K.write_metrics_report(cm, out)
    back = R.read_metrics_report(spark, f"{out}/*/*.txt")
    rep = F.regexp_extract("report", r"report=([^/]+)/", 1)
    return back.where(F.col("n") > 0).select(rep.alias("report"), "target", "actual", "predicted", "n")


@register("snk04_write_scores", oracle("""
SELECT round_even(avg(n_chars / 1000e0), 5) AS mean_score, CAST(count(*) AS BIGINT) AS n FROM documents"""))
def q_snk04(spark, sf):
    out = K.scratch_dir(spark, "snk04")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("wav"), (F.col("n_chars") / F.lit(1000.0)).alias("score"))
    K.write_scores(d, out, "score")
    return spark.read.json(f"{out}/summary").select("mean_score", "n")


@register("snk05_build_manifest", oracle("""
SELECT CAST(count(*) AS BIGINT) AS total_jobs, CAST(count(*) FILTER (WHERE job_number % 7 <> 0) AS BIGINT) AS successful,
       CAST(count(*) FILTER (WHERE job_number % 7 = 0) AS BIGINT) AS failed,
       round(avg(CASE WHEN job_number % 7 <> 0 THEN 1e0 ELSE 0e0 END), 6) AS success_rate,
       CAST(count(*) FILTER (WHERE job_number % 7 <> 0) AS BIGINT) AS samples,
       CAST(count(*) FILTER (WHERE job_number % 7 = 0) AS BIGINT) AS failed_rows FROM jobs""", ["jobs"]))
def q_snk05(spark, sf):
    out = K.scratch_dir(spark, "snk05")
    K.build_manifest(V.results(spark, sf), V.jobs(spark, sf), out)
    info = spark.read.json(f"{out}/dataset_info")
    samples = spark.read.json(f"{out}/samples").groupBy().agg(F.count(F.lit(1))).scalar()
    failed = spark.read.json(f"{out}/failed_jobs").groupBy().agg(F.count(F.lit(1))).scalar()
    return rounded(info.select("total_jobs", "successful", "failed", "success_rate")
                   .withColumn("samples", samples).withColumn("failed_rows", failed))


@register("snk07_write_run", oracle("""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE pred_emo <> 'error') AS BIGINT) AS successful,
       CAST(count(*) FILTER (WHERE pred_emo = 'error') AS BIGINT) AS failed FROM predictions""", ["predictions"]))
def q_snk07(spark, sf):
    """A scoring run where answers ``error`` are failures (PRJ29 sentinel)."""
    out = K.scratch_dir(spark, "snk07")
    p = V.predictions(spark, sf).select("file_name", "pred_emo", F.when(F.col("pred_emo") == "error",
                                                                        F.lit("ERROR: model failed")).alias("error"))
    K.write_run(p, out)
    return spark.read.json(f"{out}/metadata").select("total", "successful", "failed")
