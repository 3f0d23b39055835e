"""Text, path and tokenizer queries (PRJ10-PRJ30, ARR01-ARR04, TVF01-TVF05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from emoscope.functions import names as N
from emoscope.functions import text as T
from emoscope.operators import segments as G
from emoscope.operators.corpus import build_vocab, encode_chars
from emoscope.operators.parallel import spread
from emoscope.plans import views as V
from emoscope.plans.registry import oracle, register, rounded
from emoscope.sources.tables import table


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Ordered URL rules for the classifier query.
URL_RULES = [("/en/", "english"), ("/fr/", "french"), (".net", "network"), ("example", "example")]


@register("prj10_classify_by_substring", oracle("""
SELECT page_id, CASE WHEN contains(lower(url), '/en/') THEN 'english' WHEN contains(lower(url), '/fr/') THEN 'french'
                     WHEN contains(lower(url), '.net') THEN 'network' WHEN contains(lower(url), 'example') THEN 'example'
                     ELSE split_part(url, '_', 1) END AS kind FROM pages"""))
def q_prj10(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", N.classify_by_substring("url", URL_RULES).alias("kind"))


@register("prj11_clean_text", oracle("""
SELECT role, CAST(count(t) AS BIGINT) AS kept, CAST(sum(length(t)) AS BIGINT) AS chars FROM (
  SELECT role, CASE WHEN length(trim(text)) > 0 THEN trim(text) END AS t FROM conversations) GROUP BY role"""))
def q_prj11(spark, sf):
    c = table(spark, sf, "conversations").select("role", N.clean_text("text").alias("t"))
    return c.groupBy("role").agg(F.count("t").alias("kept"), F.sum(F.char_length("t")).alias("chars"))


@register("prj12_safe_name", oracle(r"""
SELECT item_id, CASE WHEN length(s) > 0 THEN s ELSE 'untitled' END AS name FROM (
  SELECT item_id, substr(regexp_replace(regexp_replace(text, '[ \t]', '_', 'g'), '[^A-Za-z0-9_\-]', '', 'g'), 1, 50) AS s
  FROM benchmark)"""))
def q_prj12(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", N.safe_name("text", 50).alias("name"))


@register("prj13_output_name", oracle("""
SELECT job_number, CASE WHEN job_number % 5 <> 0 THEN printf('%02d', job_number % 100) ELSE substr(md5(text), 1, 8) END
       || '_' || emotion || '_' || emotion_type || '.wav' AS file_name FROM jobs""", ["jobs"]))
def q_prj13(spark, sf):
    j = V.jobs(spark, sf)
    num = F.when(F.col("job_number") % 5 != 0, F.col("job_number") % 100)
    return j.select("job_number", N.output_name(num, "emotion", "emotion_type", "text").alias("file_name"))


@register("prj14_content_hash", oracle("SELECT doc_id, md5(text) AS content_key FROM documents"))
def q_prj14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.content_hash("text").alias("content_key"))


@register("prj15_zfill", oracle("""
SELECT event_id, CASE WHEN length(CAST(event_id AS VARCHAR)) < 3 THEN lpad(CAST(event_id AS VARCHAR), 3, '0')
                      ELSE CAST(event_id AS VARCHAR) END AS padded FROM events"""))
def q_prj15(spark, sf):
    return table(spark, sf, "events").select("event_id", N.zfill("event_id", 3).alias("padded"))


@register("prj16_path_helpers", oracle(r"""
SELECT doc_id, regexp_replace(regexp_extract(audio_path, '[^/]*$'), '\.[^.]*$', '') AS stem,
       regexp_extract(audio_path, '[^/]*$') AS basename,
       CASE WHEN contains(audio_path, '/') THEN regexp_extract(audio_path, '^(.*)/[^/]*$', 1) ELSE '' END AS parent,
       regexp_extract(regexp_extract(audio_path, '[^/]*$'), '(\.[^.]*)$', 1) AS suffix,
       regexp_replace(audio_path, '\.[^./]*$', '') || '.flac' AS flac_path,
       CASE WHEN starts_with(audio_path, '/') THEN audio_path ELSE '/data/' || audio_path END AS abs_path
FROM utterances""", ["utterances"]))
def q_prj16(spark, sf):
    u = V.utterances(spark, sf)
    return u.select("doc_id", N.path_stem("audio_path").alias("stem"), N.path_basename("audio_path").alias("basename"),
                    N.path_parent("audio_path").alias("parent"), N.path_suffix("audio_path").alias("suffix"),
                    N.swap_suffix("audio_path", ".flac").alias("flac_path"),
                    N.absolute_or_join("audio_path", "/data").alias("abs_path"))


@register("prj18_translate_punct", oracle(f"""
SELECT doc_id, md5(CASE WHEN lang = 'zh' THEN translate(t, ',!?', '，！？') ELSE t END) AS text_md5 FROM (
  SELECT doc_id, lang, translate(text, {_sql_str(T.OOV_FIX_FROM)}, {_sql_str(T.OOV_FIX_TO)}) AS t FROM documents)"""))
def q_prj18(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.translate_punct("text", F.col("lang"))).alias("text_md5"))


@register("prj19_ensure_terminal", oracle("""
SELECT conv_id, turn, md5(CASE WHEN ends_with(text, '. ') OR ends_with(text, '。') THEN text
                               WHEN ends_with(text, '.') THEN text || ' ' ELSE text || '. ' END) AS text_md5
FROM conversations"""))
def q_prj19(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.md5(T.ensure_terminal("text")).alias("text_md5"))


@register("prj20_pad_ascii_tail", oracle("""
SELECT doc_id, CAST(strlen(CASE WHEN strlen(right(text, 1)) = 1 THEN text || ' ' ELSE text END) AS INTEGER) AS n_bytes
FROM documents"""))
def q_prj20(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.octet_length(T.pad_ascii_tail("text")).alias("n_bytes"))


PAIR_SIZES = """
SELECT pair_id, length(ref_text) * 7 AS ref_frames, length(ref_text) / 15e0 AS ref_seconds,
       strlen(ref_text) AS ref_bytes, strlen(hyp_text) AS gen_bytes, length(ref_text) AS ref_chars,
       length(hyp_text) AS gen_chars FROM text_pairs"""


def _pairs(spark, sf):
    p = V.text_pairs(spark, sf)
    return p.select("pair_id", "ref_text", "hyp_text", (F.char_length("ref_text") * 7).alias("ref_frames"),
                    (F.char_length("ref_text") / F.lit(15.0)).alias("ref_seconds"))


@register("prj21_estimate_frames", oracle("""
SELECT pair_id, CAST(ref_frames + trunc(ref_frames / ref_bytes * gen_bytes / CASE WHEN gen_bytes < 10 THEN 0.3 ELSE 1.0 END)
       AS BIGINT) AS total_frames FROM ps""", ["text_pairs"], [("ps", PAIR_SIZES)]))
def q_prj21(spark, sf):
    p = _pairs(spark, sf)
    return p.select("pair_id", T.estimate_frames("ref_frames", "ref_text", "hyp_text").alias("total_frames"))


@register("prj22_estimate_seconds", oracle("""
SELECT pair_id, round(ref_seconds * (1 + gen_chars / ref_chars) / 1.0, 6) AS est_seconds FROM ps""",
                                            ["text_pairs"], [("ps", PAIR_SIZES)]))
def q_prj22(spark, sf):
    p = _pairs(spark, sf)
    return rounded(p.select("pair_id", T.estimate_seconds("ref_seconds", "ref_text", "hyp_text").alias("est_seconds")))


@register("prj23_chunk_budget", oracle("""
SELECT pair_id, CAST(trunc(ref_bytes / ref_seconds * (22 - ref_seconds) * 1.0) AS BIGINT) AS max_chars FROM ps""",
                                        ["text_pairs"], [("ps", PAIR_SIZES)]))
def q_prj23(spark, sf):
    p = _pairs(spark, sf)
    return p.select("pair_id", T.chunk_budget("ref_text", "ref_seconds").alias("max_chars"))


@register("prj24_frame_len", oracle("""
SELECT doc_id, round(duration * 24000e0 / 256e0, 6) AS frames FROM utterances""", ["utterances"]))
def q_prj24(spark, sf):
    return rounded(V.utterances(spark, sf).select("doc_id", T.frame_len("duration").alias("frames")))


@register("prj25_fmt_hms_bytes", oracle("""
SELECT lang, printf('%d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) AS hms FROM (
  SELECT lang, CAST(trunc(sum(duration) * 100) AS BIGINT) AS s FROM utterances GROUP BY lang)""", ["utterances"]))
def q_prj25(spark, sf):
    u = V.utterances(spark, sf).groupBy("lang").agg((F.sum("duration") * 100).alias("s"))
    return u.select("lang", T.fmt_hms("s").alias("hms"))


@register("prj25_fmt_bytes", oracle("""
SELECT source, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024)
                    WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576)
                    WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824) ELSE printf('%.1f TB', b / 1099511627776) END
       AS size FROM (SELECT source, CAST(sum(strlen(text)) * 4096 AS DOUBLE) AS b FROM documents GROUP BY source)"""))
def q_prj25b(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg((F.sum(F.octet_length("text")) * 4096).alias("b"))
    return d.select("source", T.fmt_bytes("b").alias("size"))


#: The punctuation that WER normalisation deletes, as a DuckDB pattern.
PUNCT_SQL = "'[!-/:-@\\[-`{-~\\x{FF02}-\\x{FF0D}\\x{FF0F}\\x{FF1A}-\\x{FF1E}\\x{FF20}\\x{FF3B}-\\x{FF40}\\x{FF5B}-\\x{FF60}\\x{FF62}-\\x{FF64}\\x{3000}-\\x{3001}\\x{3003}\\x{3008}-\\x{3011}\\x{3014}-\\x{301F}\\x{3030}\\x{303E}\\x{303F}\\x{2013}\\x{2014}\\x{2018}\\x{2019}\\x{201B}-\\x{201F}\\x{2026}\\x{2027}\\x{FE4F}\\x{FE51}\\x{FE54}\\x{00B7}\\x{FF01}\\x{FF1F}\\x{FF61}\\x{3002}]'"


@register("prj26_wer_normalise", oracle(f"""
SELECT doc_id, md5(CASE WHEN lang = 'zh' THEN array_to_string(string_split(t, ''), ' ')
                       WHEN lang = 'en' THEN lower(t) ELSE t END) AS norm_md5 FROM (
  SELECT doc_id, lang, replace(regexp_replace(text, {PUNCT_SQL}, '', 'g'), '  ', ' ') AS t FROM documents)"""))
def q_prj26(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.wer_normalise("text", F.col("lang"))).alias("norm_md5"))


@register("prj27_chat_prompt", oracle("""
SELECT doc_id, 2 AS n_messages, md5('system' || 'You label the emotion of speech.' || 'user' || '<audio>' || audio_path ||
       '</audio> ' || 'Which emotion?') AS prompt_md5 FROM utterances""", ["utterances"]))
def q_prj27(spark, sf):
    u = V.utterances(spark, sf)
    p = u.select("doc_id", T.chat_prompt(F.lit("You label the emotion of speech."), F.lit("Which emotion?"),
                                         F.col("audio_path")).alias("msgs"))
    flat = F.aggregate("msgs", F.lit(""), lambda acc, m: F.concat(acc, m["role"], m["content"]))
    return p.select("doc_id", F.size("msgs").alias("n_messages"), F.md5(flat).alias("prompt_md5"))


@register("prj28_lookup_instruction", oracle("""
SELECT j.job_number, coalesce(e.instr, f.instr, 'Speak in a ' || j.emotion || ' tone.') AS instruction
FROM jobs j
LEFT JOIN (VALUES ('happy', 'emotional', 'Speak happily.'), ('sad', 'emotional', 'Speak sadly.'),
                  ('angry', 'neutral', 'Speak angrily but calm.')) e(emotion, kind, instr)
  ON e.emotion = j.emotion AND e.kind = j.emotion_type
LEFT JOIN (SELECT emotion, min(instr) AS instr FROM (VALUES ('happy', 'emotional', 'Speak happily.'),
                  ('sad', 'emotional', 'Speak sadly.'), ('angry', 'neutral', 'Speak angrily but calm.')) x(emotion, kind, instr)
           GROUP BY emotion) f ON f.emotion = j.emotion""", ["jobs"]))
def q_prj28(spark, sf):
    """Instruction by (emotion, type); else the emotion's first instruction;
    else a template.  The instruction table is configuration (three rows)."""
    from emoscope.operators.joins import lookup_instruction
    dim = spark.createDataFrame([("happy", "emotional", "Speak happily."), ("sad", "emotional", "Speak sadly."),
                                 ("angry", "neutral", "Speak angrily but calm.")], "emotion string, kind string, instr string")
    j = V.jobs(spark, sf)
    return lookup_instruction(j, dim).select("job_number", "instruction")


@register("prj29_split_errors", oracle("""
SELECT starts_with(answer, 'ERROR') AS failed, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN event_type = 'error' THEN 'ERROR: ' || props ELSE event_type END AS answer FROM events) GROUP BY ALL"""))
def q_prj29(spark, sf):
    e = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", F.concat(F.lit("ERROR: "), "props")).otherwise(F.col("event_type"))
        .alias("answer"))
    return e.groupBy(T.is_error("answer").alias("failed")).agg(F.count(F.lit(1)).alias("n"))


@register("prj30_pad_duration", oracle("""
SELECT request_id, (floor(CAST(trunc(latency_s * 10 + audio_s) AS BIGINT) / 2e0) + 1) * 2e0 AS padded FROM latency_log""",
                                        ["latency_log"]))
def q_prj30(spark, sf):
    lg = V.latency_log(spark, sf)
    return lg.select("request_id", T.pad_duration(F.col("latency_s") * 10, F.col("audio_s"), 2.0).alias("padded"))


@register("arr01_tokenize_char", oracle("""
SELECT doc_id, len(list_filter(string_split(text, ''), lambda x: x <> '')) AS n_tokens,
       md5(array_to_string(list_filter(string_split(text, ''), lambda x: x <> ''), '|')) AS tokens_md5 FROM documents"""))
def q_arr01(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokenize_char("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", "|")).alias("tokens_md5"))


@register("arr02_encode_tokens", oracle("""
WITH v AS (SELECT token, row_number() OVER (ORDER BY unicode(token)) - 1 AS idx FROM (
             SELECT DISTINCT unnest(string_split(text, '')) AS token FROM benchmark) WHERE token <> ''),
c AS (SELECT doc_id, substr(text, i, 1) AS token FROM documents, range(1, length(text) + 1) r(i))
SELECT c.doc_id, CAST(count(*) AS INTEGER) AS n_ids, CAST(sum(coalesce(v.idx, 0)) AS BIGINT) AS id_sum
FROM c LEFT JOIN v USING (token) GROUP BY c.doc_id"""))
def q_arr02(spark, sf):
    """Tokens of every document encoded with the benchmark vocabulary (join,
    unknown -> 0)."""
    vocab = build_vocab(table(spark, sf, "benchmark"), "text")
    d = table(spark, sf, "documents").select("doc_id", T.tokenize_char("text").alias("t"))
    enc = encode_chars(d, "t", vocab)
    return enc.select("doc_id", F.size("ids").alias("n_ids"),
                      F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


@register("arr03_tokenize_bytes", oracle("""
SELECT doc_id, CAST(strlen(text) AS INTEGER) AS n_bytes,
       CAST(coalesce(list_sum(list_transform(regexp_extract_all(hex(text), '..'),
            lambda x: CAST(('0x' || x) AS INTEGER))), 0) AS BIGINT) AS byte_sum
FROM documents"""))
def q_arr03(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokenize_bytes("text").alias("b"))
    return d.select("doc_id", F.size("b").alias("n_bytes"),
                    F.aggregate("b", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("byte_sum"))


# Symbol table for the symbol encoder (pad first).
SYMBOLS = ["_"] + list(" abcdefghijklmnopqrstuvwxyz.,")


@register("arr04_encode_symbols", oracle(f"""
SELECT item_id, CAST(len(ids) + 2 AS INTEGER) AS n_ids, CAST(coalesce(list_sum(ids), 0) AS BIGINT) AS id_sum FROM (
  SELECT item_id, list_transform(list_filter(string_split(lower(text), ''), lambda c: list_contains({SYMBOLS!r}, c)),
                                 lambda c: list_position({SYMBOLS!r}, c) - 1) AS ids FROM benchmark)"""))
def q_arr04(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", T.encode_symbols(T.tokenize_char(F.lower("text")), SYMBOLS).alias("ids"))
    return b.select("item_id", F.size("ids").alias("n_ids"),
                    F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


@register("tvf01_chunk_text", None, "greedy byte packing; checked against a brute-force packer in tests")
def q_tvf01(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    c = G.chunk_text(spread(d, "doc_id"), "text", 135)
    return c.select("doc_id", "chunk_idx", F.octet_length("chunk").alias("chunk_bytes"), F.md5("chunk").alias("chunk_md5"))


@register("tvf02_segment_voices", oracle(r"""
SELECT conv_id, voice, CAST(count(*) AS BIGINT) AS segments, CAST(sum(length(seg)) AS BIGINT) AS chars FROM (
  SELECT conv_id, CASE WHEN tag IN ('user', 'assistant') THEN tag ELSE 'main' END AS voice,
         trim(regexp_replace(part, '\[(\w+)\]', '', 'g')) AS seg FROM (
    SELECT conv_id, part, regexp_extract(part, '^\[(\w+)\]', 1) AS tag FROM (
      SELECT conv_id, unnest(string_split(regexp_replace(script, '(\[\w+\])', chr(1) || '\1', 'g'), chr(1))) AS part
      FROM tagged_text)
    WHERE length(trim(part)) > 0))
GROUP BY conv_id, voice""", [], [("tagged_text", """
  SELECT conv_id, string_agg('[' || role || '] ' || text, ' ' ORDER BY turn) AS script FROM conversations GROUP BY conv_id""")]))
def q_tvf02(spark, sf):
    s = G.segment_voices(V.tagged_text(spark, sf), "script", ["user", "assistant"])
    return s.groupBy("conv_id", "voice").agg(F.count(F.lit(1)).alias("segments"),
                                             F.sum(F.char_length("segment_text")).alias("chars"))


def _style_scripts(spark, sf):
    c = table(spark, sf, "conversations")
    mark = (F.when(F.col("role") == "assistant",
                   F.format_string('{"name": "calm", "seed": %d, "speed": 1.0}', F.col("turn")))
            .when(F.col("role") == "user", F.concat(F.lit("{"), "role", F.lit("}"))).otherwise(F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat(mark, F.lit(" "), "text").alias("t"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda s: s["t"]), " ").alias("script"))


@register("tvf03_segment_styles", oracle(r"""
SELECT conv_id, name, CAST(count(*) AS BIGINT) AS segments FROM (
  SELECT conv_id,
         CASE WHEN i = 1 THEN 'Regular' WHEN starts_with(marks[i - 1], '{"') THEN json_extract_string(marks[i - 1], '$.name')
              ELSE substr(marks[i - 1], 2, length(marks[i - 1]) - 2) END AS name,
         trim(texts[i]) AS t
  FROM (SELECT conv_id, regexp_split_to_array(script, '\{.*?\}') AS texts, regexp_extract_all(script, '\{.*?\}') AS marks
        FROM scripts), range(1, 64) r(i)
  WHERE i <= len(texts))
WHERE length(t) > 0 GROUP BY conv_id, name""", [], [("scripts", """
  SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN '{"name": "calm", "seed": ' || turn || ', "speed": 1.0}'
                                  WHEN role = 'user' THEN '{' || role || '}' ELSE '' END || ' ' || text, ' ' ORDER BY turn)
         AS script FROM conversations GROUP BY conv_id""")]))
def q_tvf03(spark, sf):
    s = G.segment_styles(_style_scripts(spark, sf), "script")
    return s.groupBy("conv_id", F.col("style.name").alias("name")).agg(F.count(F.lit(1)).alias("segments"))


@register("tvf04_chunk_progressive", None, "re-chunking of the first chunk; checked in tests")
def q_tvf04(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    c = G.chunk_text_progressive(spread(d, "doc_id"), "text", 135, 60, 30)
    return c.select("doc_id", "chunk_idx", F.octet_length("chunk").alias("chunk_bytes"))


@register("tvf05_rechunk", oracle("""
SELECT vec_id, CAST(c - 1 AS INTEGER) AS chunk_idx, CAST(len(embedding[(c - 1) * 16 + 1:c * 16]) AS INTEGER) AS chunk_len,
       round(list_sum(embedding[(c - 1) * 16 + 1:c * 16]::DOUBLE[]), 6) AS chunk_sum
FROM embeddings, range(1, 5) r(c)"""))
def q_tvf05(spark, sf):
    from emoscope.functions.arrays import rechunk
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    ex = e.select("vec_id", F.posexplode(rechunk("e", 16)).alias("chunk_idx", "c"))
    return rounded(ex.select("vec_id", "chunk_idx", F.size("c").alias("chunk_len"),
                             F.aggregate("c", F.lit(0.0).cast("double"), lambda a, x: a + x).alias("chunk_sum")))
