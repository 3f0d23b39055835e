"""Ordered-window, split and join queries (WIN*, SPL*, JN*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from emoscope.functions.hashing import stable_hash_sql
from emoscope.operators import joins as J
from emoscope.operators import ranking as R
from emoscope.operators import splits as S
from emoscope.operators.batching import silence_clips, silent_runs
from emoscope.plans import views as V
from emoscope.plans.q_text import PUNCT_SQL
from emoscope.plans.registry import oracle, register, rounded
from emoscope.sources.tables import table


@register("win01_top_n", oracle("""
SELECT doc_id, speaker, emotion, round(duration, 6) AS duration, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY speaker, emotion ORDER BY duration DESC, audio_path) AS rank FROM utterances)
WHERE rank <= 3""", ["utterances"]))
def q_win01(spark, sf):
    u = V.utterances(spark, sf)
    t = R.top_n(u, ["speaker", "emotion"], [F.desc("duration"), F.asc("audio_path")], 3)
    return rounded(t.select("doc_id", "speaker", "emotion", "duration", "rank"))


@register("win02_head_n", oracle("""
SELECT conv_id, turn, role FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 2"""))
def q_win02(spark, sf):
    return R.head_n(table(spark, sf, "conversations"), ["conv_id"], "turn", 2).select("conv_id", "turn", "role")


@register("win03_number_rows", oracle("""
SELECT job_number, text_id, emotion, printf('sample_%06d', job_number) AS job_number_label FROM jobs""", ["jobs"]))
def q_win03(spark, sf):
    j = V.jobs(spark, sf).drop("job_number")
    n = R.number_rows(j, [], ["text_id", F.array_position(F.array(*[F.lit(e) for e in V.EMOTIONS]), F.col("emotion"))],
                      "job_number", fmt="sample_%06d")
    return n.select("job_number", "text_id", "emotion", "job_number_label")


@register("win03_number_rows_per_key", oracle("""
SELECT doc_id, speaker, CAST(row_number() OVER (PARTITION BY speaker ORDER BY doc_id) AS BIGINT) AS row_no
FROM utterances""", ["utterances"]))
def q_win03k(spark, sf):
    u = V.utterances(spark, sf)
    return R.number_rows(u, ["speaker"], ["doc_id"], "row_no").select("doc_id", "speaker", "row_no")


@register("win04_running_offset", oracle("""
SELECT doc_id, speaker, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars AS BIGINT) AS "offset"
FROM (SELECT doc_id, source, source AS speaker, n_chars FROM documents)"""))
def q_win04(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("speaker"), "n_chars")
    return R.running_offset(d, ["speaker"], ["doc_id"], "n_chars").select("doc_id", "speaker", "offset")


@register("win05_take_until", oracle("""
SELECT doc_id, speaker, round(taken, 6) AS taken FROM (
  SELECT doc_id, speaker, duration,
         sum(duration) OVER (PARTITION BY speaker ORDER BY duration DESC, doc_id ROWS UNBOUNDED PRECEDING) - duration AS prev
  FROM utterances) q, LATERAL (SELECT least(duration, 600 - prev) AS taken) t
WHERE prev < 600""", ["utterances"]))
def q_win05(spark, sf):
    u = V.utterances(spark, sf).select("doc_id", "speaker", "duration")
    t = R.take_until(u, ["speaker"], [-F.col("duration"), F.col("doc_id")], "duration", 600.0)
    return rounded(t.select("doc_id", "speaker", "taken"))


@register("win06_clip_segments", oracle("""
SELECT user_id, CAST(count(*) AS BIGINT) AS kept, round(max(incl), 6) AS kept_total,
       round(least(max(incl), 12), 6) AS clipped_total FROM f WHERE stops = 0 GROUP BY user_id""", [], [
    ("s", """SELECT user_id, event_id, ts, value / 100e0 AS seg,
                    sum(value / 100e0) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS incl
             FROM events"""),
    ("f", """SELECT *, sum(CASE WHEN incl - seg > 6 AND incl > 12 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stops FROM s"""),
]))
def q_win06(spark, sf):
    """Segments = the events of a user in time order, length = value / 100 s."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("value") / F.lit(100.0)).alias("seg"))
    kept = R.clip_segments(ev, ["user_id"], ["ts", "event_id"], "seg")
    return rounded(kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"), F.max("kept_total").alias("kept_total"),
                                               F.max("clipped_total").alias("clipped_total")))


@register("win09_split_even", oracle("""
SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS part FROM documents"""))
def q_win09(spark, sf):
    return R.split_even(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 7)


@register("win10_split_block", oracle("""
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // (count(*) OVER () // 7 + 1) AS INTEGER) AS part
FROM documents"""))
def q_win10(spark, sf):
    return R.split_block(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 7)


@register("win11_split_fixed", oracle("""
SELECT event_id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 64 AS INTEGER) AS batch FROM events"""))
def q_win11(spark, sf):
    return R.split_fixed(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 64).select(
        "event_id", "batch")


@register("win12_silent_runs", oracle("""
SELECT utt_id, CAST(run AS BIGINT) AS run_id, CAST(min(pos) AS BIGINT) AS first_frame, CAST(max(pos) AS BIGINT) AS last_frame,
       CAST(count(*) AS BIGINT) AS run_frames, CAST(arg_min(pos, rms * 1e9 + pos) AS BIGINT) AS cut_frame
FROM g WHERE s = 1 GROUP BY utt_id, run HAVING count(*) >= 2""", ["frames"], [
    ("f", """SELECT utt_id, frame_id, ts, rms, CAST(rms < 0.1 AS INTEGER) AS s,
                    row_number() OVER (PARTITION BY utt_id ORDER BY ts, frame_id) AS pos,
                    lag(CAST(rms < 0.1 AS INTEGER)) OVER (PARTITION BY utt_id ORDER BY ts, frame_id) AS prev FROM frames"""),
    ("g", """SELECT *, sum(CASE WHEN s = 1 AND coalesce(prev, 0) = 0 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY utt_id ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS run FROM f"""),
]))
def q_win12(spark, sf):
    """Silent runs (rms below 0.1) of at least two frames per series, with
    the quietest frame as cut point."""
    return silent_runs(V.frames(spark, sf), "utt_id", ["ts", "frame_id"], "rms", 0.1, min_run=2)


@register("win12_silence_clips", oracle("""
SELECT utt_id, CAST(row_number() OVER (PARTITION BY utt_id ORDER BY k) - 1 AS BIGINT) AS clip,
       CAST(b AS BIGINT) AS clip_begin, CAST(e AS BIGINT) AS clip_end
FROM (SELECT utt_id, k, coalesce(lag(e) OVER (PARTITION BY utt_id ORDER BY k), 0) AS b, b AS e,
             row_number() OVER (PARTITION BY utt_id ORDER BY k) AS i FROM walk WHERE taken)
WHERE i > 1 OR e > 0
UNION ALL
SELECT n.utt_id, CAST(count(w.k) - count(w.k) FILTER (WHERE w.b = 0 AND w.k = w.k1) AS BIGINT), CAST(coalesce(max(w.e), 0) AS BIGINT), CAST(n.n AS BIGINT)
FROM n LEFT JOIN (SELECT *, min(k) OVER (PARTITION BY utt_id) AS k1 FROM walk WHERE taken) w USING (utt_id)
GROUP BY n.utt_id, n.n HAVING coalesce(max(w.e), 0) < n.n""", ["frames"], [
    ("f", "SELECT utt_id, rms, row_number() OVER (PARTITION BY utt_id ORDER BY ts, frame_id) - 1 AS p FROM frames"),
    ("n", "SELECT utt_id, count(*) AS n FROM f GROUP BY utt_id"),
    ("g", "SELECT utt_id, rms, p, p - row_number() OVER (PARTITION BY utt_id ORDER BY p) AS island FROM f WHERE rms < 0.1"),
    ("r", """SELECT g.*, min(p) OVER w AS s, max(p) OVER w + 1 AS z, n.n FROM g JOIN n USING (utt_id)
             WINDOW w AS (PARTITION BY g.utt_id, island)"""),
    ("q", """SELECT utt_id, s, z, n, arg_min(p, rms) FILTER (p <= s + 4) AS lo, arg_min(p, rms) FILTER (p >= z - 4) AS hi,
                    arg_min(p, rms) FILTER (p BETWEEN z - 4 AND s + 4) AS mid
             FROM (SELECT * FROM r ORDER BY utt_id, p) WHERE z - s >= 3 OR (s = 0 AND z > 4 AND z < n) GROUP BY ALL"""),
    ("c", """SELECT utt_id, z, row_number() OVER (PARTITION BY utt_id ORDER BY s) AS k, z = n OR (s = 0 AND z > 4) AS must,
                    CASE WHEN z = n THEN lo WHEN s = 0 THEN 0 WHEN z - s BETWEEN 5 AND 8 THEN least(lo, mid) ELSE lo END AS b,
                    CASE WHEN z = n THEN n + 1 WHEN z - s <= 4 THEN lo WHEN s > 0 AND z - s <= 8 THEN greatest(hi, mid)
                         ELSE hi END AS e FROM q"""),
    ("walk", """SELECT utt_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS e,
                       false AS taken FROM n
                UNION ALL
                SELECT c.utt_id, c.k, CASE WHEN c.must OR c.z - walk.since >= 8 THEN c.e ELSE walk.since END, c.b, c.e,
                       c.must OR c.z - walk.since >= 8 FROM walk JOIN c ON c.utt_id = walk.utt_id AND c.k = walk.k + 1"""),
]).replace("WITH ", "WITH RECURSIVE ", 1))
def q_win12_clips(spark, sf):
    """Clips between silences: rms below 0.1 for 3 frames or more, clips of 8
    frames or more, at most 4 silent frames kept on a side."""
    c = silence_clips(V.frames(spark, sf), "utt_id", ["ts", "frame_id"], "rms", 0.1, 8, 3, 4)
    return c.select("utt_id", "clip", F.col("begin").alias("clip_begin"), F.col("end").alias("clip_end"))


@register("win13_dedupe_text", oracle("""
SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1"""))
def q_win13(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return R.dedupe_text(d, "text", ["doc_id"]).select("doc_id", "lang")


@register("win14_carry_forward", oracle("""
SELECT conv_id, turn, md5(coalesce(last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS)
       OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '')) AS system_md5 FROM conversations"""))
def q_win14(spark, sf):
    c = table(spark, sf, "conversations").withColumn("sys", F.when(F.col("role") == "system", F.col("text")))
    out = R.carry_forward(c, ["conv_id"], ["turn"], "sys")
    return out.select("conv_id", "turn", F.md5(F.coalesce("sys", F.lit(""))).alias("system_md5"))


@register("win15_shuffle", oracle(f"""
SELECT doc_id, {stable_hash_sql('doc_id', 666 + 3)} AS shuffle_key FROM documents"""))
def q_win15(spark, sf):
    return R.shuffle_order(table(spark, sf, "documents").select("doc_id"), "doc_id", seed=666, epoch=3)


@register("win16_assemble_conversation", oracle("""
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages,
       md5(coalesce(CASE WHEN arg_max(role, turn) = 'assistant' THEN arg_max(text, turn) END, '')) AS last_assistant_md5,
       CAST(count(*) + 1 AS INTEGER) AS n_with_guard, CAST(min(turn) AS BIGINT) AS first_turn
FROM conversations GROUP BY conv_id"""))
def q_win16(spark, sf):
    a = R.assemble_conversation(table(spark, sf, "conversations"))
    return a.select("conv_id", F.size("messages").alias("n_messages"),
                    F.md5(F.coalesce("last_assistant", F.lit(""))).alias("last_assistant_md5"),
                    F.size("with_guard").alias("n_with_guard"), F.col("messages")[0]["turn"].alias("first_turn"))


@register("win17_sort_by_cost", oracle("""
SELECT doc_id, round(duration, 6) AS duration FROM utterances ORDER BY duration DESC, doc_id""", ["utterances"]))
def q_win17(spark, sf):
    return rounded(R.sort_by_cost(V.utterances(spark, sf).select("doc_id", "duration"), "duration", "doc_id"))


@register("win18_best_reference", oracle(f"""
SELECT doc_id, speaker, emotion, round(score, 6) AS score, CAST(pick AS INTEGER) AS pick FROM (
  SELECT *, row_number() OVER (PARTITION BY emotion ORDER BY {stable_hash_sql('speaker', 0)}, speaker) AS pick FROM b)
WHERE pick <= 3""", ["utterances"], [
    ("s", "SELECT *, CASE WHEN duration BETWEEN 3 AND 10 THEN 10 - abs(6.5 - duration) END AS score FROM utterances"),
    ("b", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY speaker, emotion
                            ORDER BY score DESC NULLS LAST, doc_id) AS r FROM s) WHERE r = 1"""),
]))
def q_win18(spark, sf):
    b = R.best_reference(V.utterances(spark, sf), "speaker", "emotion", "duration", "doc_id", 3)
    return rounded(b.select("doc_id", "speaker", "emotion", "score", "pick"))


@register("win19_next_valid", oracle("""
SELECT n.doc_id, coalesce(n.nxt, (SELECT min(doc_id) FROM v WHERE ok)) AS use_doc FROM n""", ["utterances"], [
    ("v", "SELECT doc_id, duration, duration BETWEEN 1 AND 30 AS ok FROM utterances"),
    ("n", """SELECT doc_id, ok, first_value(CASE WHEN ok THEN doc_id END IGNORE NULLS)
               OVER (ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM v"""),
]))
def q_win19(spark, sf):
    u = V.utterances(spark, sf).select("doc_id", "duration", F.col("doc_id").alias("use_doc"))
    out = R.next_valid(u, ["doc_id"], F.col("duration").between(1, 30), ["use_doc"])
    return out.select("doc_id", "use_doc")


@register("spl01_holdout_top_n", oracle("""
SELECT doc_id, CASE WHEN rn <= 5 THEN 'test' ELSE 'train_val' END AS split FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY emotion, speaker ORDER BY duration DESC, doc_id) AS rn FROM utterances)""",
                                         ["utterances"]))
def q_spl01(spark, sf):
    u = V.utterances(spark, sf)
    rest, test = S.holdout_top_n(u, ["emotion", "speaker"], [F.desc("duration"), F.asc("doc_id")], 5, "doc_id")
    return (test.select("doc_id", F.lit("test").alias("split"))
            .unionByName(rest.select("doc_id", F.lit("train_val").alias("split"))))


@register("spl02_stratified_split", oracle(f"""
SELECT doc_id, CASE WHEN rn <= ceil(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY emotion, speaker ORDER BY {stable_hash_sql('doc_id', 42)}, doc_id) AS rn,
         count(*) OVER (PARTITION BY emotion, speaker) AS n FROM utterances)""", ["utterances"]))
def q_spl02(spark, sf):
    u = V.utterances(spark, sf).select("doc_id", "emotion", "speaker")
    return S.stratified_split(u, ["emotion", "speaker"], "doc_id", 0.1, 42).select("doc_id", "split")


@register("spl03_random_split", oracle(f"""
SELECT event_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM (
  SELECT event_id, row_number() OVER (ORDER BY {stable_hash_sql('event_id', 42)}, event_id) AS rn,
         count(*) OVER () AS n FROM events)"""))
def q_spl03(spark, sf):
    return S.random_split(table(spark, sf, "events").select("event_id"), "event_id", 0.8, 42).select("event_id", "split")


@register("spl04_fold_split", oracle("""
SELECT doc_id, split, CAST(sum(n_chars) OVER (PARTITION BY split ORDER BY doc_id) - n_chars AS BIGINT) AS "offset" FROM (
  SELECT doc_id, n_chars, CASE WHEN doc_id BETWEEN 100 AND 199 THEN 'test' ELSE 'train_val' END AS split FROM documents)"""))
def q_spl04(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return S.fold_split(d, "doc_id", 100, 200, "n_chars").select("doc_id", "split", "offset")


# Sampling weight per corpus (source) for the mixing query.
MIX = {"src0": 1.0, "src1": 0.5, "src2": 0.25}


@register("spl05_mix_corpora", oracle(f"""
SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents
WHERE {stable_hash_sql('doc_id', 5)} / 1152921504606846976e0 <
      CASE source WHEN 'src0' THEN 1.0 WHEN 'src1' THEN 0.5 WHEN 'src2' THEN 0.25 ELSE 0 END GROUP BY source"""))
def q_spl05(spark, sf):
    m = S.mix_corpora(table(spark, sf, "documents"), "source", MIX, "doc_id", 5)
    return m.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("spl06_read_split_list", oracle("""
SELECT split_part(line, '|', 1) AS path, split_part(line, '|', 2) AS text,
       CASE WHEN len(string_split(line, '|')) >= 3 THEN split_part(line, '|', 3) ELSE '0' END AS speaker FROM (
  SELECT audio_path || '|' || lang || CASE WHEN doc_id % 2 = 0 THEN '|' || speaker ELSE '' END AS line FROM utterances)""",
                                           ["utterances"]))
def q_spl06(spark, sf):
    """Train list lines ``path|text[|speaker]`` built from the utterance view."""
    u = V.utterances(spark, sf)
    lines = u.select(F.concat("audio_path", F.lit("|"), "lang",
                              F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("|"), "speaker")).otherwise(F.lit("")))
                     .alias("value"))
    return S.read_split_list(lines)


@register("jn01_semi", oracle("""
SELECT lang, CAST(count(*) AS BIGINT) AS n FROM utterances u WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang""",
                               ["utterances"]))
def q_jn01(spark, sf):
    s = J.semi(V.utterances(spark, sf), table(spark, sf, "labels"), "doc_id")
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register("jn02_anti", oracle("""
SELECT lang, CAST(count(*) AS BIGINT) AS n FROM utterances u WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang""",
                               ["utterances"]))
def q_jn02(spark, sf):
    a = J.anti(V.utterances(spark, sf), table(spark, sf, "labels"), "doc_id")
    return a.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register("jn03_zip_by_line", oracle("""
SELECT doc_id AS line_no, length(text) AS hyp_chars, lang AS ref_lang, strlen(text) AS ref_bytes FROM documents"""))
def q_jn03(spark, sf):
    """Two column sets of all documents, zipped by line."""
    d = table(spark, sf, "documents")
    a = d.select(F.col("doc_id").alias("line_no"), F.char_length("text").alias("hyp_chars"))
    b = d.select(F.col("doc_id").alias("line_no"), F.col("lang").alias("ref_lang"), F.octet_length("text").alias("ref_bytes"))
    return J.zip_by_line(a, b)


@register("jn04_expand_jobs", oracle("""
SELECT job_number, text_id, emotion, emotion_type FROM jobs""", ["jobs"]))
def q_jn04(spark, sf):
    return V.jobs(spark, sf).select("job_number", "text_id", "emotion", "emotion_type")


@register("jn05_lookup_default", oracle("""
SELECT c.conv_id, c.turn, coalesce(v.ref_audio, 'voices/main.wav') AS ref_audio
FROM conversations c LEFT JOIN (VALUES ('main', 'voices/main.wav'), ('user', 'voices/user.wav'),
                                       ('assistant', 'voices/assistant.wav')) v(role, ref_audio) ON v.role = c.role"""))
def q_jn05(spark, sf):
    """Voice lookup by role with the ``main`` voice as default (the voice
    table is a three-row configuration)."""
    voices = spark.createDataFrame([("main", "voices/main.wav"), ("user", "voices/user.wav"),
                                    ("assistant", "voices/assistant.wav")], "role string, ref_audio string")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return J.lookup_default(c, voices, "role", ["ref_audio"], "main").select("conv_id", "turn", "ref_audio")


@register("jn06_join_results", oracle("""
SELECT emotion, CAST(count(*) FILTER (WHERE job_number % 7 <> 0) AS BIGINT) AS ok,
       CAST(count(*) FILTER (WHERE job_number % 7 = 0) AS BIGINT) AS failed FROM jobs GROUP BY emotion""", ["jobs"]))
def q_jn06(spark, sf):
    ok, bad = J.join_results(V.results(spark, sf), V.jobs(spark, sf))
    a = ok.groupBy("emotion").agg(F.count(F.lit(1)).alias("ok"))
    b = bad.groupBy("emotion").agg(F.count(F.lit(1)).alias("failed"))
    return a.join(b, "emotion", "full").fillna(0)


@register("jn07_merge_struct", oracle("""
SELECT job_number, CASE WHEN job_number % 7 <> 0 THEN 'instruct' ELSE 'none' END AS method,
       emotion AS target_emotion FROM jobs""", ["jobs"]))
def q_jn07(spark, sf):
    """Job metadata merged with result metadata; the result side wins when set."""
    j = V.jobs(spark, sf).select("job_number", F.struct(F.lit("none").alias("method"),
                                                         F.col("emotion").alias("target_emotion")).alias("meta"))
    r = V.results(spark, sf).select("job_number", F.struct(F.col("method_used").alias("method"),
                                                            F.lit(None).cast("string").alias("target_emotion")).alias("rmeta"))
    m = j.join(r, "job_number").select("job_number", J.merge_struct(F.col("meta"), F.col("rmeta"),
                                                                     ["method", "target_emotion"]).alias("m"))
    return m.select("job_number", "m.method", "m.target_emotion")


@register("jn08_pair_similarity", oracle("""
SELECT a.vec_id AS vec_id, b.vec_id AS next_id,
       round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
             / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
             / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS sim
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""))
def q_jn08(spark, sf):
    e = table(spark, sf, "embeddings")
    pairs = e.select("vec_id", (F.col("vec_id") + 1).alias("next_id"))
    emb = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return rounded(J.pair_similarity(pairs, emb, "vec_id", "next_id").select("vec_id", "next_id", "sim"))


def _rate_sql(parts: str) -> str:
    """Edits over reference length from lists ``r`` and ``h``: a word or character of the reference becomes one
    ASCII character by its place among the distinct ones (under 120 in the given tables), all others one more."""
    def coded(x: str) -> str:
        return f"array_to_string(list_transform({x}, lambda w: chr((coalesce(list_position(rd, w), 0) + 1)::INTEGER)), '')"
    return f"""
SELECT pair_id, edits, ref_len, CASE WHEN ref_len > 0 THEN round(edits / ref_len, 6) END AS wer FROM (
  SELECT pair_id, levenshtein({coded("r")}, {coded("h")})::BIGINT AS edits, len(r)::BIGINT AS ref_len FROM (
    SELECT *, list_distinct(r) AS rd FROM ({parts})))"""


_NORMAL = " ".join(f"""replace(regexp_replace({c}, {PUNCT_SQL}, '', 'g'), '  ', ' ') AS {c[0]}_,""" for c in ("ref_text", "hyp_text"))
_WORDS = ", ".join(f"list_filter(regexp_split_to_array(CASE WHEN lang = 'en' THEN lower({c}_) ELSE {c}_ END, '[\\s\\x0B]+'), "
                   f"lambda w: w <> '') AS {c}" for c in "rh")
_CHARS = ", ".join(f"list_filter(string_split(regexp_replace({c}, '[\\s\\x0B]+', '', 'g'), ''), lambda w: w <> '') AS {c[0]}"
                   for c in ("ref_text", "hyp_text"))


@register("jn09_word_error_rate", oracle(_rate_sql(
    f"SELECT pair_id, {_WORDS} FROM (SELECT pair_id, lang, {_NORMAL} FROM text_pairs)"), ["text_pairs"]))
def q_jn09(spark, sf):
    """WER of document text (hypothesis) against benchmark text (reference),
    after WER normalisation; whole texts."""
    from emoscope.functions.text import wer_normalise
    p = V.text_pairs(spark, sf)
    p = p.select("pair_id", wer_normalise("ref_text", F.col("lang")).alias("ref"),
                 wer_normalise("hyp_text", F.col("lang")).alias("hyp"),
                 "lang")
    return rounded(J.word_error_rate(p, "ref", "hyp", char_level=F.col("lang") == "zh")
                   .select("pair_id", "edits", "ref_len", "wer"))


@register("jn09_char_error_rate", oracle(_rate_sql(f"SELECT pair_id, {_CHARS} FROM text_pairs"), ["text_pairs"]))
def q_jn09c(spark, sf):
    p = V.text_pairs(spark, sf)
    return rounded(J.word_error_rate(p, "ref_text", "hyp_text", char_level=True).select("pair_id", "edits", "ref_len", "wer"))


@register("jn10_sample_same_key", oracle(f"""
SELECT a.speaker, a.doc_id, b.doc_id AS partner_id FROM (
  SELECT speaker, doc_id, {stable_hash_sql("doc_id", 4)} % count(*) OVER (PARTITION BY speaker) + 1 AS want FROM utterances) a
JOIN (SELECT speaker, doc_id, row_number() OVER (PARTITION BY speaker ORDER BY {stable_hash_sql("doc_id", 3)}, doc_id) AS pos
      FROM utterances) b ON a.speaker = b.speaker AND a.want = b.pos""", ["utterances"]))
def q_jn10(spark, sf):
    u = V.utterances(spark, sf).select("doc_id", "speaker")
    return J.sample_same_key(u, "speaker", "doc_id", seed=3)


@register("jn12_pick_preferred", oracle("""
SELECT emotion, arg_min(doc_id, (CASE WHEN contains(speaker, 'src1') THEN 0 ELSE 1 END) * 1e12 + doc_id) AS doc_id
FROM utterances GROUP BY emotion""", ["utterances"]))
def q_jn12(spark, sf):
    u = V.utterances(spark, sf).select("emotion", "doc_id", "speaker")
    return J.pick_preferred(u, "emotion", "speaker", "src1", ["doc_id"]).select("emotion", "doc_id")


@register("jn13_pair_by_stem", oracle("""
SELECT g.stem, g.path AS gen_path, r.path AS ref_path FROM
  (SELECT CAST(doc_id // 2 AS VARCHAR) AS stem, source || '/' || CAST(doc_id // 2 AS VARCHAR) || '_gen.wav' AS path
   FROM documents WHERE doc_id % 2 = 0) g
JOIN (SELECT CAST(doc_id // 2 AS VARCHAR) AS stem, source || '/' || CAST(doc_id // 2 AS VARCHAR) || '_ref.wav' AS path
      FROM documents WHERE doc_id % 2 = 1) r USING (stem)"""))
def q_jn13(spark, sf):
    d = table(spark, sf, "documents")
    paths = d.select(F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 2).cast("string"),
                              F.when(F.col("doc_id") % 2 == 0, F.lit("_gen.wav")).otherwise(F.lit("_ref.wav"))).alias("p"))
    return J.pair_by_stem(paths, "p")
