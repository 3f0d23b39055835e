"""Prediction analytics queries: the flagship and the metric operators.

All read the ``predictions`` view (events -> prediction facts) or the
``binary_predictions`` view (labels).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from emoscope.functions import names as N
from emoscope.operators import metrics as M
from emoscope.operators.quality import keep_labels
from emoscope.plans import views as V
from emoscope.plans.registry import oracle, register, rounded

GROUP = ["slm", "tts_model", "txt_cond"]
LABELS_SQL = "('click', 'error', 'purchase', 'signup', 'view')"


def parsed_predictions(spark, sf):
    """PRJ02/03/07 over the view: labels from the file name, answer cleaned."""
    p = V.predictions(spark, sf)
    f = N.parse_name("file_name")
    return p.select(
        "event_id", "slm", "file_name",
        f["txt_emo"].alias("txt_emo"), f["txt_cond"].alias("txt_cond"), f["wav_emo"].alias("wav_emo"),
        f["lbl_full"].alias("lbl_full"), f["tts_model"].alias("tts_model"),
        N.clean_label("pred_emo").alias("pred_emo"))


# DuckDB twin of parsed_predictions (PRJ02/03/07).
PARSED_SQL = """
  SELECT event_id, slm, file_name, pred_emo, parts[2] AS txt_emo,
         CASE WHEN parts[2] = 'neutral' THEN 'neutral' ELSE parts[3] END AS txt_cond,
         CASE WHEN parts[2] = 'neutral' THEN parts[3] ELSE parts[4] END AS wav_emo,
         CASE WHEN parts[2] = 'neutral' THEN parts[5] ELSE parts[6] END AS tts_model
  FROM (SELECT event_id, slm, file_name, lower(replace(pred_emo, '.', '')) AS pred_emo,
               string_split(regexp_replace(file_name, '\\.[^.]*$', ''), '_') AS parts
        FROM predictions)"""
PARSED_CTES = [("parsed", PARSED_SQL)]


def flagship(spark, sf):
    """Do models follow the words or the voice, by model x TTS x condition?
    PRJ02/03/07 -> FLT01 -> AGG02/06/07, ordered."""
    p = keep_labels(parsed_predictions(spark, sf), "pred_emo", V.EVENT_LABELS)
    return rounded(M.metrics_by(p, GROUP)).orderBy(*GROUP)


FLAGSHIP_SQL = oracle(f"""
SELECT slm, tts_model, txt_cond, count(*) AS n,
       round(avg(CASE WHEN wav_emo = pred_emo THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS accuracy,
       round(avg(CASE WHEN txt_emo = pred_emo THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS accuracy_proxy,
       CAST(sum(CASE WHEN wav_emo <> pred_emo THEN 1 ELSE 0 END) AS BIGINT) AS errors,
       round(sum(CASE WHEN wav_emo <> pred_emo AND txt_emo = pred_emo THEN 1 ELSE 0 END)
             / nullif(sum(CASE WHEN wav_emo <> pred_emo THEN 1 ELSE 0 END), 0), 6) AS err_follow_text,
       round(sum(CASE WHEN wav_emo <> pred_emo AND txt_emo = pred_emo AND txt_cond = 'implicit' THEN 1 ELSE 0 END)
             / nullif(sum(CASE WHEN wav_emo <> pred_emo THEN 1 ELSE 0 END), 0), 6) AS err_follow_text_implicit,
       round(sum(CASE WHEN wav_emo <> pred_emo AND txt_emo = pred_emo AND txt_cond = 'explicit' THEN 1 ELSE 0 END)
             / nullif(sum(CASE WHEN wav_emo <> pred_emo THEN 1 ELSE 0 END), 0), 6) AS err_follow_text_explicit
FROM parsed WHERE pred_emo IN {LABELS_SQL}
GROUP BY slm, tts_model, txt_cond ORDER BY slm, tts_model, txt_cond""", ["predictions"], PARSED_CTES)

register("flagship_metrics_by_condition", FLAGSHIP_SQL)(flagship)
register("agg06_metrics_by", FLAGSHIP_SQL, "same plan as the flagship")(flagship)


@register("prj01_parse_positional", oracle("""
SELECT event_id,
       CASE WHEN len(parts) >= 3 THEN parts[len(parts) - 2] ELSE 'unknown' END AS true_emotion,
       CASE WHEN len(parts) >= 2 THEN parts[2] ELSE 'unknown' END AS proxy_emotion
FROM (SELECT event_id, string_split(file_name, '_') AS parts FROM predictions)""", ["predictions"]))
def q_prj01(spark, sf):
    p = V.predictions(spark, sf)
    s = N.parse_name_positional("file_name")
    return p.select("event_id", s["true_emotion"].alias("true_emotion"), s["proxy_emotion"].alias("proxy_emotion"))


@register("prj02_parse_name", oracle("""
SELECT event_id, txt_emo, txt_cond, wav_emo, tts_model,
       CASE WHEN wav_emo <> txt_emo THEN wav_emo || '_proxy_' || txt_emo ELSE wav_emo || '_cong' END AS lbl_full
FROM parsed""", ["predictions"], PARSED_CTES))
def q_prj02(spark, sf):
    return parsed_predictions(spark, sf).select("event_id", "txt_emo", "txt_cond", "wav_emo", "tts_model", "lbl_full")


@register("prj04_condition_flag", oracle("""
SELECT condition_flag, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN contains(file_name, 'explicit') THEN 1 WHEN contains(file_name, 'implicit') THEN 0 ELSE -1 END
         AS condition_flag FROM predictions) GROUP BY condition_flag""", ["predictions"]))
def q_prj04(spark, sf):
    p = V.predictions(spark, sf)
    return p.groupBy(N.condition_flag("file_name").alias("condition_flag")).agg(F.count(F.lit(1)).alias("n"))


def _shaped_tables(p):
    """Four differently shaped prediction tables, one per model, cut from the predictions ``p``."""
    a = p.where(F.col("slm") == "m0").select(F.col("file_name").alias("filename"),
                                              F.upper("pred_emo").alias("predicted_emotion"))
    b = p.where(F.col("slm") == "m1").select(F.col("file_name").alias("file_path"),
                                              F.col("file_name").alias("filename"),
                                              F.col("pred_emo").alias("emotion"),
                                              F.lit("2024-01-01T00:00:00").alias("processed_at"))
    c = p.where(F.col("slm") == "m2").select(F.col("file_name").alias("file_path"),
                                              F.concat(F.col("pred_emo"), F.lit(".")).alias("output"))
    d = p.where(F.col("slm") == "m3").select(F.col("file_name").alias("file_name"),
                                              F.initcap("pred_emo").alias("response"))
    return a, b, c, d


@register("prj05_normalise_predictions", oracle("""
SELECT coalesce(filename, file_name, file_path) AS pred_path,
       lower(coalesce(predicted_emotion, emotion, output, response)) AS pred_label
FROM (
  SELECT file_name AS filename, NULL AS file_name, NULL AS file_path, upper(pred_emo) AS predicted_emotion,
         NULL AS emotion, NULL AS output, NULL AS response FROM predictions WHERE slm = 'm0'
  UNION ALL SELECT file_name, NULL, file_name, NULL, pred_emo, NULL, NULL FROM predictions WHERE slm = 'm1'
  UNION ALL SELECT NULL, NULL, file_name, NULL, NULL, pred_emo || '.', NULL FROM predictions WHERE slm = 'm2'
  UNION ALL SELECT NULL, file_name, NULL, NULL, NULL, NULL,
                   upper(substr(pred_emo, 1, 1)) || lower(substr(pred_emo, 2)) FROM predictions WHERE slm = 'm3')
""", ["predictions"]))
def q_prj05(spark, sf):
    """PRJ05 + SET01: union of differently shaped tables, then the fallback chains."""
    from emoscope.operators.reshape import union_predictions
    u = union_predictions(list(_shaped_tables(V.predictions(spark, sf))))
    return N.normalise_predictions(u).select("pred_path", "pred_label")


@register("prj06_label_by_model", oracle("""
SELECT slm, path, lower(replace(label, '.', '')) AS pred_emo FROM (
  SELECT 'desta2' AS slm, file_name AS path, upper(pred_emo) AS label FROM predictions WHERE slm = 'm0'
  UNION ALL SELECT 'qwen', file_name, pred_emo FROM predictions WHERE slm = 'm1'
  UNION ALL SELECT 'salmonn', file_name, pred_emo || '.' FROM predictions WHERE slm = 'm2'
  UNION ALL SELECT 'flamingo3', file_name, upper(substr(pred_emo, 1, 1)) || lower(substr(pred_emo, 2))
  FROM predictions WHERE slm = 'm3')""", ["predictions"]))
def q_prj06(spark, sf):
    """PRJ06: answer column chosen by model name over the aligned union."""
    from emoscope.operators.reshape import union_predictions
    a, b, c, d = _shaped_tables(V.predictions(spark, sf))
    tagged = [a.withColumn("slm", F.lit("desta2")), b.withColumn("slm", F.lit("qwen")),
              c.withColumn("slm", F.lit("salmonn")), d.withColumn("slm", F.lit("flamingo3"))]
    u = union_predictions(tagged)
    return u.select("slm", N.path_by_model("slm").alias("path"),
                    N.clean_label(N.label_by_model("slm")).alias("pred_emo"))


# A short-name dictionary, as the reference's recode tables.
SHORT = {"click": "clk", "purchase": "buy", "signup": "new"}


@register("prj08_recode", oracle("""
SELECT event_id, CASE wav_emo WHEN 'click' THEN 'clk' WHEN 'purchase' THEN 'buy' WHEN 'signup' THEN 'new'
                 ELSE wav_emo END AS short_label FROM predictions""", ["predictions"]))
def q_prj08(spark, sf):
    p = V.predictions(spark, sf)
    return p.select("event_id", N.recode("wav_emo", SHORT).alias("short_label"))


@register("prj09_encode_labels", oracle("""
SELECT event_id, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], wav_emo) - 1 AS INTEGER) AS label_id,
       wav_emo AS decoded FROM predictions""", ["predictions"]))
def q_prj09(spark, sf):
    p = V.predictions(spark, sf)
    enc = N.encode_label("wav_emo", V.EVENT_LABELS)
    return p.select("event_id", enc.cast("int").alias("label_id"),
                    N.decode_label(enc, V.EVENT_LABELS).alias("decoded"))


@register("flt01_keep_labels", oracle(f"""
SELECT CAST(count(*) AS BIGINT) AS n_kept FROM parsed WHERE pred_emo IN ('click', 'view', 'purchase')""",
                                       ["predictions"], PARSED_CTES))
def q_flt01(spark, sf):
    p = keep_labels(parsed_predictions(spark, sf), "pred_emo", ["click", "view", "purchase"])
    return p.agg(F.count(F.lit(1)).alias("n_kept"))


@register("flt10_slice_predictions", oracle("""
SELECT slm, CAST(sum(CASE WHEN contains(lbl_full, 'cong') THEN 1 ELSE 0 END) AS BIGINT) AS n_cong,
       CAST(sum(CASE WHEN contains(lbl_full, 'proxy') THEN 1 ELSE 0 END) AS BIGINT) AS n_proxy
FROM (SELECT slm, CASE WHEN wav_emo <> txt_emo THEN wav_emo || '_proxy_' || txt_emo ELSE wav_emo || '_cong' END
      AS lbl_full FROM parsed WHERE txt_cond = 'neutral') GROUP BY slm""", ["predictions"], PARSED_CTES))
def q_flt10(spark, sf):
    """FLT10: conjunctive slices (cong / proxy x model x neutral text)."""
    from emoscope.operators.quality import slice_predictions
    p = parsed_predictions(spark, sf)
    cong = slice_predictions(p, kind="cong", txt_cond="neutral").groupBy("slm").agg(F.count(F.lit(1)).alias("n_cong"))
    prox = slice_predictions(p, kind="proxy", txt_cond="neutral").groupBy("slm").agg(F.count(F.lit(1)).alias("n_proxy"))
    return cong.join(prox, "slm", "full").fillna(0)


@register("agg01_confusion", oracle("""
SELECT slm, wav_emo AS actual, pred_emo AS predicted, CAST(count(*) AS BIGINT) AS n
FROM parsed GROUP BY slm, wav_emo, pred_emo""", ["predictions"], PARSED_CTES))
def q_agg01(spark, sf):
    return M.confusion(parsed_predictions(spark, sf), "wav_emo", "pred_emo", ["slm"])


@register("agg02_accuracy", oracle("""
SELECT tts_model, CAST(count(*) AS BIGINT) AS n,
       round(avg(CASE WHEN wav_emo = pred_emo THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS accuracy
FROM parsed GROUP BY tts_model""", ["predictions"], PARSED_CTES))
def q_agg02(spark, sf):
    return rounded(M.accuracy(parsed_predictions(spark, sf), "wav_emo", "pred_emo", ["tts_model"]))


PER_CLASS_CTES = PARSED_CTES + [
    ("roles", """
      SELECT slm, wav_emo AS label, 1 AS t, 0 AS p, CASE WHEN wav_emo = pred_emo THEN 1 ELSE 0 END AS tp FROM parsed
      UNION ALL SELECT slm, pred_emo, 0, 1, 0 FROM parsed"""),
    ("pc", """
      SELECT slm, label, sum(t) AS support, sum(p) AS predicted, sum(tp) AS tp,
             CASE WHEN sum(p) > 0 THEN sum(tp) / sum(p) ELSE 0 END AS precision,
             CASE WHEN sum(t) > 0 THEN sum(tp) / sum(t) ELSE 0 END AS recall
      FROM roles GROUP BY slm, label"""),
    ("pcf", """
      SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
      FROM pc"""),
]


@register("agg03_f1_macro", oracle("""
SELECT slm, round(avg(f1), 6) AS f1_macro, CAST(count(*) AS BIGINT) AS n_labels FROM pcf GROUP BY slm""",
                                    ["predictions"], PER_CLASS_CTES))
def q_agg03(spark, sf):
    return rounded(M.f1_macro(parsed_predictions(spark, sf), "wav_emo", "pred_emo", ["slm"]))


@register("agg04_classification_report", oracle("""
SELECT slm, label AS "row", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM pcf
UNION ALL
SELECT slm, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pcf GROUP BY slm
UNION ALL
SELECT slm, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT)
FROM pcf GROUP BY slm
UNION ALL
SELECT slm, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pcf GROUP BY slm""",
                                                ["predictions"], PER_CLASS_CTES))
def q_agg04(spark, sf):
    return rounded(M.classification_report(parsed_predictions(spark, sf), "wav_emo", "pred_emo", ["slm"]))


@register("agg05_wa_ua_f1", oracle("""
SELECT slm, round(sum(tp) / sum(support) * 100, 6) AS wa,
       round(avg(CASE WHEN support > 0 THEN recall END) * 100, 6) AS ua,
       round(sum(f1 * support) / sum(support) * 100, 6) AS wf1
FROM pcf GROUP BY slm""", ["predictions"], PER_CLASS_CTES))
def q_agg05(spark, sf):
    return rounded(M.wa_ua_f1(parsed_predictions(spark, sf), "wav_emo", "pred_emo", ["slm"]))


@register("agg07_error_attribution", oracle("""
SELECT tts_model, CAST(sum(CASE WHEN wav_emo <> pred_emo THEN 1 ELSE 0 END) AS BIGINT) AS errors,
       round(sum(CASE WHEN wav_emo <> pred_emo AND txt_emo = pred_emo THEN 1 ELSE 0 END)
             / nullif(sum(CASE WHEN wav_emo <> pred_emo THEN 1 ELSE 0 END), 0), 6) AS err_follow_text,
       round(sum(CASE WHEN wav_emo <> pred_emo AND txt_emo = pred_emo AND txt_cond = 'implicit' THEN 1 ELSE 0 END)
             / nullif(sum(CASE WHEN wav_emo <> pred_emo THEN 1 ELSE 0 END), 0), 6) AS err_follow_text_implicit,
       round(sum(CASE WHEN wav_emo <> pred_emo AND txt_emo = pred_emo AND txt_cond = 'explicit' THEN 1 ELSE 0 END)
             / nullif(sum(CASE WHEN wav_emo <> pred_emo THEN 1 ELSE 0 END), 0), 6) AS err_follow_text_explicit
FROM parsed GROUP BY tts_model""", ["predictions"], PARSED_CTES))
def q_agg07(spark, sf):
    return rounded(M.error_attribution(parsed_predictions(spark, sf), ["tts_model"]))


@register("agg08_crosstab", oracle("""
SELECT pred_emo, txt_emo, CAST(count(*) AS BIGINT) AS n FROM parsed GROUP BY pred_emo, txt_emo""",
                                    ["predictions"], PARSED_CTES))
def q_agg08(spark, sf):
    return M.crosstab(parsed_predictions(spark, sf), "pred_emo", "txt_emo")


@register("agg09_crosstab_norm", oracle("""
SELECT pred_emo, wav_emo, n, round(n / sum(n) OVER (PARTITION BY wav_emo), 6) AS share
FROM (SELECT pred_emo, wav_emo, CAST(count(*) AS BIGINT) AS n FROM parsed GROUP BY pred_emo, wav_emo)""",
                                         ["predictions"], PARSED_CTES))
def q_agg09(spark, sf):
    return rounded(M.crosstab_norm(parsed_predictions(spark, sf), "pred_emo", "wav_emo"))


CHI_CTES = PARSED_CTES + [
    ("ct", "SELECT tts_model, pred_emo AS a, wav_emo AS b, count(*) AS n FROM parsed GROUP BY ALL"),
    ("ra", "SELECT tts_model, a, sum(n) AS ra FROM ct GROUP BY ALL"),
    ("cb", "SELECT tts_model, b, sum(n) AS cb FROM ct GROUP BY ALL"),
    ("tot", "SELECT tts_model, sum(n) AS tot, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM ct GROUP BY ALL"),
    ("grid", """
      SELECT ra.tts_model, ra.a, cb.b, coalesce(ct.n, 0) AS n, ra.ra * cb.cb / tot.tot AS e, tot.tot, tot.r, tot.c
      FROM ra JOIN cb ON ra.tts_model = cb.tts_model JOIN tot ON tot.tts_model = ra.tts_model
      LEFT JOIN ct ON ct.tts_model = ra.tts_model AND ct.a = ra.a AND ct.b = cb.b"""),
]


@register("agg10_chi2_test", oracle("""
SELECT tts_model, round(sum((n - e) * (n - e) / e), 6) AS chi2, CAST((any_value(r) - 1) * (any_value(c) - 1) AS BIGINT) AS dof,
       CAST(any_value(tot) AS BIGINT) AS n_total
FROM grid GROUP BY tts_model""", ["predictions"], CHI_CTES))
def q_agg10(spark, sf):
    t = M.chi2_test(parsed_predictions(spark, sf), "pred_emo", "wav_emo", ["tts_model"])
    return rounded(t.select("tts_model", "chi2", "dof", "n_total"))


@register("agg10_expected_counts", oracle("""
SELECT g.tts_model, x.l AS actual, y.l AS predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
       round(coalesce(r.n, 0) * coalesce(k.n, 0) / g.n, 6) AS expected
FROM g CROSS JOIN l x CROSS JOIN l y
LEFT JOIN c ON c.tts_model = g.tts_model AND c.pred_emo = x.l AND c.wav_emo = y.l
LEFT JOIN r ON r.tts_model = g.tts_model AND r.pred_emo = x.l
LEFT JOIN k ON k.tts_model = g.tts_model AND k.wav_emo = y.l""", ["predictions"], [
    ("g", "SELECT tts_model, CAST(count(*) AS DOUBLE) AS n FROM predictions GROUP BY tts_model"),
    ("l", "SELECT pred_emo AS l FROM predictions UNION SELECT wav_emo FROM predictions"),
    ("c", "SELECT tts_model, pred_emo, wav_emo, count(*) AS n FROM predictions GROUP BY ALL"),
    ("r", "SELECT tts_model, pred_emo, count(*) AS n FROM predictions GROUP BY ALL"),
    ("k", "SELECT tts_model, wav_emo, count(*) AS n FROM predictions GROUP BY ALL"),
]))
def q_agg10_expected(spark, sf):
    return rounded(M.expected_counts(parsed_predictions(spark, sf), "pred_emo", "wav_emo", ["tts_model"]))


@register("agg01_confusion_full", oracle("""
SELECT g.slm, x.l AS actual, y.l AS predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM g CROSS JOIN l x CROSS JOIN l y
LEFT JOIN c ON c.slm = g.slm AND c.wav_emo = x.l AND c.pred_emo = y.l""", ["predictions"], [
    ("g", "SELECT DISTINCT slm FROM predictions"),
    ("l", """SELECT pred_emo AS l FROM predictions UNION SELECT wav_emo FROM predictions
             UNION SELECT string_split(file_name, '_')[2] FROM predictions"""),
    ("c", "SELECT slm, wav_emo, pred_emo, count(*) AS n FROM predictions GROUP BY ALL"),
]))
def q_agg01_full(spark, sf):
    """The full matrix over the labels of three columns, zero cells included."""
    return M.confusion(parsed_predictions(spark, sf), "wav_emo", "pred_emo", ["slm"],
                       label_cols=["wav_emo", "pred_emo", "txt_emo"])


@register("agg11_cramers_v", oracle("""
SELECT tts_model, round(sqrt(sum((n - e) * (n - e) / e) / any_value(tot) / (least(any_value(r), any_value(c)) - 1)), 6)
       AS cramers_v
FROM grid GROUP BY tts_model""", ["predictions"], CHI_CTES))
def q_agg11(spark, sf):
    t = M.cramers_v(parsed_predictions(spark, sf), "pred_emo", "wav_emo", ["tts_model"])
    return rounded(t.select("tts_model", "cramers_v"))


@register("agg10_chi2_binary_yates", oracle("""
SELECT round(sum(power(o + sign(e - o) * least(0.5, abs(e - o)) - e, 2) / e), 6) AS chi2 FROM g""",
    ["binary_predictions"], [
        ("ct", "SELECT y_pred AS a, y_true AS b, count(*) AS n FROM binary_predictions GROUP BY ALL"),
        ("ra", "SELECT a, sum(n) AS ra FROM ct GROUP BY a"),
        ("cb", "SELECT b, sum(n) AS cb FROM ct GROUP BY b"),
        ("tot", "SELECT sum(n) AS tot FROM ct"),
        ("g", """SELECT coalesce(ct.n, 0) AS o, ra.ra * cb.cb / tot.tot AS e FROM ra CROSS JOIN cb CROSS JOIN tot
                 LEFT JOIN ct ON ct.a = ra.a AND ct.b = cb.b"""),
    ]))
def q_agg10_yates(spark, sf):
    """2 x 2 table (dof = 1), so the continuity correction applies."""
    t = M.chi2_test(V.binary_predictions(spark, sf), "y_pred", "y_true")
    return rounded(t.select("chi2"))


@register("rsh02_to_matrix", oracle("""
SELECT wav_emo,
  CAST(count(*) FILTER (WHERE pred_emo = 'click') AS BIGINT) AS click,
  CAST(count(*) FILTER (WHERE pred_emo = 'error') AS BIGINT) AS error,
  CAST(count(*) FILTER (WHERE pred_emo = 'purchase') AS BIGINT) AS purchase,
  CAST(count(*) FILTER (WHERE pred_emo = 'signup') AS BIGINT) AS signup,
  CAST(count(*) FILTER (WHERE pred_emo = 'view') AS BIGINT) AS "view"
FROM parsed GROUP BY wav_emo""", ["predictions"], PARSED_CTES))
def q_rsh02(spark, sf):
    return M.crosstab_wide(parsed_predictions(spark, sf), "wav_emo", "pred_emo", V.EVENT_LABELS)


@register("set03_label_domain", oracle("""
SELECT DISTINCT label FROM (SELECT unnest([wav_emo, txt_emo, pred_emo]) AS label FROM parsed) WHERE label IS NOT NULL""",
                                        ["predictions"], PARSED_CTES))
def q_set03(spark, sf):
    return M.label_domain(parsed_predictions(spark, sf), ["wav_emo", "txt_emo", "pred_emo"])


@register("agg28_same_labels", oracle("""
SELECT (SELECT list_sort(list(DISTINCT wav_emo)) FROM parsed) = (SELECT list_sort(list(DISTINCT txt_emo)) FROM parsed)
   AND (SELECT list_sort(list(DISTINCT wav_emo)) FROM parsed) = (SELECT list_sort(list(DISTINCT pred_emo)) FROM parsed)
   AS same_labels,
   CAST((SELECT count(DISTINCT wav_emo) FROM parsed) AS INTEGER) AS n_labels""", ["predictions"], PARSED_CTES))
def q_agg28(spark, sf):
    return M.same_labels(parsed_predictions(spark, sf), ["wav_emo", "txt_emo", "pred_emo"])
