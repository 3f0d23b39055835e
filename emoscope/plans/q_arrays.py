"""Array-column queries over the ``waves`` view (embeddings) and token arrays
(ARR05-ARR18, JN11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from emoscope.functions import arrays as A
from emoscope.functions.hashing import stable_hash_sql
from emoscope.plans import views as V
from emoscope.plans.registry import oracle, register, rounded
from emoscope.sources.tables import table


def _dbl(col):
    return F.transform(col, lambda x: x.cast("double"))


def _waves(spark, sf):
    w = V.waves(spark, sf)
    return w.select("utt_id", "label", _dbl(F.col("wave")).alias("wave"))


def _sum(col):
    return F.aggregate(col, F.lit(0.0).cast("double"), lambda a, x: a + x)


EMB = "embedding::DOUBLE[]"


@register("arr05_pad_batch", oracle("""
SELECT conv_id, turn, CAST(len(w) AS INTEGER) AS length, CAST(max(len(w)) OVER (PARTITION BY conv_id) AS INTEGER) AS padded_len,
       CAST(max(len(w)) OVER (PARTITION BY conv_id) - len(w) AS INTEGER) AS n_pad
FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS w FROM conversations)"""))
def q_arr05(spark, sf):
    """Word-length arrays of the turns, padded to the longest turn of their
    conversation (the batch)."""
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.transform(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""),
                                       lambda w: F.char_length(w)).alias("lens"))
    p = A.pad_batch(c, "conv_id", "lens", 0)
    return p.select("conv_id", "turn", "length", F.size("padded").alias("padded_len"),
                    F.size(F.filter("mask", lambda m: m)).alias("n_pad"))


@register("arr06_length_mask", oracle("""
SELECT doc_id, CAST(greatest(64 - least(n_chars // 100, 64), 0) AS INTEGER) AS masked FROM documents"""))
def q_arr06(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.least(F.floor(F.col("n_chars") / 100), F.lit(64)).alias("len"))
    m = d.select("doc_id", A.length_mask(F.col("len"), 64).alias("mask"))
    return m.select("doc_id", F.size(F.filter("mask", lambda x: x)).alias("masked"))


@register("arr07_rms_normalise", oracle(f"""
SELECT vec_id, round(r, 6) AS rms, round(CASE WHEN r < 0.1 THEN sqrt(list_sum(list_transform(e, lambda x: x * x * 0.01 / (r * r))) / len(e)) ELSE r END, 6) AS rms_after
FROM (SELECT vec_id, {EMB} AS e, sqrt(list_sum(list_transform({EMB}, lambda x: x * x)) / len(embedding)) AS r FROM embeddings)"""))
def q_arr07(spark, sf):
    w = _waves(spark, sf)
    return rounded(w.select(F.col("utt_id").alias("vec_id"), A.rms("wave").alias("rms"),
                            A.rms(A.rms_normalise("wave", 0.1)).alias("rms_after")))


@register("arr08_peak_loudness", oracle(f"""
SELECT vec_id, round(list_max(list_transform(e, lambda x: abs(x / p * 0.95))), 6) AS peak_after,
       round(list_sum(list_transform(e, lambda x: x / p * 0.5 + x * 0.5)), 6) AS blend_sum
FROM (SELECT vec_id, {EMB} AS e, list_max(list_transform({EMB}, lambda x: abs(x))) AS p FROM embeddings)"""))
def q_arr08(spark, sf):
    w = _waves(spark, sf)
    return rounded(w.select(F.col("utt_id").alias("vec_id"),
                            F.array_max(F.transform(A.peak_normalise("wave", 0.95), lambda x: F.abs(x))).alias("peak_after"),
                            _sum(A.loudness_blend("wave")).alias("blend_sum")))


@register("arr09_trim_quiet", oracle(f"""
SELECT vec_id, CAST(CASE WHEN f = 0 THEN len(e) ELSE len(e) - l + 1 - f + 1 END AS INTEGER) AS kept FROM (
  SELECT vec_id, {EMB} AS e, list_position(list_transform({EMB}, lambda x: abs(x) > 0.2), true) AS f,
         list_position(list_reverse(list_transform({EMB}, lambda x: abs(x) > 0.2)), true) AS l FROM embeddings)"""))
def q_arr09(spark, sf):
    w = _waves(spark, sf)
    return w.select(F.col("utt_id").alias("vec_id"), F.size(A.trim_quiet("wave", 0.2)).alias("kept"))


@register("arr10_to_mono", oracle(f"""
SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.{EMB}, b.{EMB}), lambda p: (p[1] + p[2]) / 2)), 6) AS mono_sum
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""".replace("a.embedding::DOUBLE[]", "a.embedding::DOUBLE[]")))
def q_arr10(spark, sf):
    """Two consecutive vectors as left / right channel."""
    w = _waves(spark, sf)
    r = w.select((F.col("utt_id") - 1).alias("utt_id"), F.col("wave").alias("right"))
    j = w.join(r, "utt_id")
    return rounded(j.select(F.col("utt_id").alias("vec_id"), _sum(A.to_mono("wave", "right")).alias("mono_sum")))


@register("arr11_layer_norm", oracle(f"""
SELECT vec_id, round(list_sum(list_transform(e, lambda x: (x - m) * (x - m) / (v + 1e-5))) / len(e), 6) AS norm_var,
       round(list_max(list_transform(e, lambda x: (x - m) / sqrt(v + 1e-5))), 6) AS norm_max FROM (
  SELECT vec_id, e, m, list_sum(list_transform(e, lambda x: (x - m) * (x - m))) / len(e) AS v FROM (
    SELECT vec_id, {EMB} AS e, list_sum({EMB}) / len(embedding) AS m FROM embeddings))"""))
def q_arr11(spark, sf):
    w = _waves(spark, sf).select(F.col("utt_id").alias("vec_id"), A.layer_norm("wave").alias("n"))
    return rounded(w.select("vec_id", (_sum(F.transform("n", lambda x: x * x)) / F.size("n")).alias("norm_var"),
                            F.array_max("n").alias("norm_max")))


@register("arr12_mean_pool", oracle("""
SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean
FROM embeddings, range(1, 65) r(i) GROUP BY label, i"""))
def q_arr12(spark, sf):
    return rounded(A.mean_pool(_waves(spark, sf), "label", "wave"))


# Class names for the argmax query, one per score position.
CLASSES = [f"c{i}" for i in range(64)]


@register("arr13_argmax_label", oracle("""
SELECT vec_id, 'c' || CAST(list_position(embedding, list_max(embedding)) - 1 AS VARCHAR) AS top_class FROM embeddings"""))
def q_arr13(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", A.argmax_label("embedding", CLASSES).alias("top_class"))


@register("arr14_concat_capped", oracle("""
SELECT label, CAST(sum(least(64, 200 - prev)) AS INTEGER) AS joined_len FROM (
  SELECT label, vec_id, sum(64) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) - 64 AS prev
  FROM embeddings) WHERE prev < 200 GROUP BY label"""))
def q_arr14(spark, sf):
    w = _waves(spark, sf)
    j = A.concat_capped(w, ["label"], ["utt_id"], "wave", 200)
    return j.select("label", F.size("joined").alias("joined_len"))


@register("arr15_crossfade", None, "overlap by the running minimum; checked against a plain fold in tests")
def q_arr15(spark, sf):
    """The vectors of each label, in id order, joined with 8-sample fades."""
    w = _waves(spark, sf)
    p = A.crossfade_pieces(w, "label", "utt_id", "wave", 8)
    p = p.select("label", F.when(F.col("piece").isNotNull(), F.size("piece")).alias("n"), _sum(F.col("piece")).alias("x"))
    # a NULL segment makes the wave NULL, a NULL sample its total
    c = p.groupBy("label").agg(F.when(F.count("n") == F.count(F.lit(1)), F.sum("n").cast("int")).alias("length"),
                               F.when(F.count("x") == F.count(F.lit(1)), F.sum("x")).alias("total"))
    return rounded(c)


@register("arr16_edit_mask", oracle("""
SELECT vec_id, CAST(64 - (least(label + 5, 64) - label) - 10 AS INTEGER) AS kept_frames FROM embeddings"""))
def q_arr16(spark, sf):
    """Mask of 64 frames with two edited parts: [label, label + 5) and [40, 50)."""
    e = table(spark, sf, "embeddings")
    parts = F.array(F.struct(F.col("label").alias("start"), (F.col("label") + 5).alias("end")),
                    F.struct(F.lit(40).alias("start"), F.lit(50).alias("end")))
    m = e.select("vec_id", A.edit_mask(F.lit(64), parts).alias("mask"))
    return m.select("vec_id", F.size(F.filter("mask", lambda x: x)).alias("kept_frames"))


@register("arr17_random_crop", oracle(f"""
SELECT vec_id, round(list_sum(e[s + 1:s + 16]), 6) AS crop_sum FROM (
  SELECT vec_id, {EMB} AS e, CAST({stable_hash_sql('vec_id', 0)} % 49 AS INTEGER) AS s FROM embeddings)"""))
def q_arr17(spark, sf):
    w = _waves(spark, sf)
    return rounded(w.select(F.col("utt_id").alias("vec_id"), _sum(A.random_crop("wave", 16, F.col("utt_id"))).alias("crop_sum")))


@register("arr18_signal_quality", oracle(f"""
SELECT vec_id, round(avg(en), 6) AS mean_energy, round(quantile_cont(en, 0.3), 6) AS noise_energy,
       CAST(count(*) AS BIGINT) AS n_frames FROM (
  SELECT vec_id, list_sum(list_transform(e[s:s + 7], lambda x: x * x)) / 8 AS en
  FROM (SELECT vec_id, {EMB} AS e FROM embeddings), range(1, 58, 4) r(s)) GROUP BY vec_id"""))
def q_arr18(spark, sf):
    w = _waves(spark, sf)
    q = A.signal_quality(w, "utt_id", "wave", win=8, hop=4)
    return rounded(q.select(F.col("utt_id").alias("vec_id"), "mean_energy", "noise_energy", "n_frames"))


@register("jn11_pick_reference", oracle("""
SELECT job_number, speaker, CAST(count(*) AS BIGINT) AS n_refs, round(sum(least(duration, 30 - prev)), 6) AS ref_seconds
FROM run WHERE prev < 30 GROUP BY job_number, speaker""", ["utterances", "jobs"], [
    ("refs", """SELECT doc_id AS ref_id, speaker, duration,
                       CASE emotion WHEN 'en' THEN 'angry' WHEN 'fr' THEN 'happy' WHEN 'de' THEN 'neutral' ELSE 'sad' END
                       AS emotion FROM utterances"""),
    ("spk", f"""SELECT emotion, speaker,
                       row_number() OVER (PARTITION BY emotion ORDER BY {stable_hash_sql('speaker', 11)}, speaker) AS r,
                       count(*) OVER (PARTITION BY emotion) AS n FROM (SELECT DISTINCT emotion, speaker FROM refs)"""),
    ("pick", f"""SELECT j.job_number, j.emotion, s.speaker FROM jobs j
                 JOIN (SELECT DISTINCT emotion, n FROM spk) c ON c.emotion = j.emotion
                 JOIN spk s ON s.emotion = j.emotion AND s.r = {stable_hash_sql('j.job_number', 11)} % c.n + 1"""),
    ("top", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY speaker, emotion ORDER BY duration DESC, ref_id) AS k
               FROM refs) WHERE k <= 7"""),
    ("run", """SELECT p.job_number, p.speaker, t.duration,
                      sum(t.duration) OVER (PARTITION BY p.job_number ORDER BY t.k ROWS UNBOUNDED PRECEDING) - t.duration AS prev
               FROM pick p JOIN top t ON t.speaker = p.speaker AND t.emotion = p.emotion"""),
]))
def q_jn11(spark, sf):
    """Each job (text x target emotion) gets a speaker who has the emotion
    (languages stand for emotions), then up to 7 longest files, 30 s cap."""
    from emoscope.functions.names import recode
    from emoscope.operators.joins import pick_reference
    u = V.utterances(spark, sf)
    refs = u.select(F.col("doc_id").alias("ref_id"), "speaker", "duration",
                    recode("emotion", {"en": "angry", "fr": "happy", "de": "neutral"}).alias("emotion"))
    refs = refs.withColumn("emotion", F.when(F.col("emotion").isin(V.EMOTIONS), F.col("emotion")).otherwise(F.lit("sad")))
    p = pick_reference(V.jobs(spark, sf).select("job_number", "emotion"), refs, 7, 11, 30.0)
    return rounded(p.groupBy("job_number", "speaker").agg(F.count(F.lit(1)).alias("n_refs"),
                                                          F.sum("taken").alias("ref_seconds")))
