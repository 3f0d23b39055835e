"""Remaining operator queries: existence filters, offsets before filters,
path resolution, set operations, and the Python hooks (UDF02, UDT01), plus
the queries named after operators that other queries exercise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from emoscope.functions import names as N
from emoscope.operators import quality as Q
from emoscope.operators import udf as U
from emoscope.operators.ranking import running_offset
from emoscope.operators.reshape import missing
from emoscope.plans import q_io, q_predictions
from emoscope.plans import views as V
from emoscope.plans.q_predictions import PARSED_CTES
from emoscope.plans.registry import REGISTRY, oracle, register
from emoscope.sources import readers as R
from emoscope.sources import sinks as K
from emoscope.sources.tables import table

# Queries named after operators that run inside other queries.
for alias, target in [("prj03_congruence", "prj02_parse_name"), ("set01_union_predictions", "prj05_normalise_predictions"),
                      ("snk01_write_csv", "src01_read_predictions"), ("snk06_write_rooted_manifest", "src12_read_rooted_tsv")]:
    q = REGISTRY[target]
    register(alias, q.sql, f"same plan as {target}")(q.build)

_ = (q_io, q_predictions)


@register("snk02_write_prepared", oracle("""
SELECT 'vocab' AS part, ch AS item, 1::BIGINT AS n FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM utterances) WHERE ch <> ''
UNION ALL
SELECT 'summary', 'hours ' || printf('%.4f', sum(duration) / 3600), count(*) FROM utterances
UNION ALL
SELECT 'vocab size', '', (SELECT count(DISTINCT ch) FROM (SELECT unnest(string_split(text, '')) AS ch FROM utterances) WHERE ch <> '')
UNION ALL
SELECT 'raw', audio_path || ' ' || md5(text) || ' ' || printf('%.4f', duration), 1 FROM utterances""", ["utterances"]))
def q_snk02(spark, sf):
    """The prepared set as written: raw rows, vocabulary and summary."""
    out = K.scratch_dir(spark, "snk02")
    K.write_prepared(V.utterances(spark, sf).select("audio_path", "text", "duration"), out)
    summary = spark.read.json(f"{out}/summary")
    one = F.lit(1).cast("long").alias("n")
    raw = spark.read.parquet(f"{out}/raw").select(F.lit("raw").alias("part"), F.concat_ws(
        " ", "audio_path", F.md5("text"), F.format_string("%.4f", "duration")).alias("item"), one)
    vocab = spark.read.parquet(f"{out}/vocab").select(F.lit("vocab").alias("part"), F.col("token").alias("item"), one)
    return raw.unionByName(vocab).unionByName(summary.select(
        F.lit("summary").alias("part"), F.concat(F.lit("hours "), F.format_string("%.4f", "hours")).alias("item"),
        F.col("rows").alias("n"))).unionByName(summary.select(
            F.lit("vocab size").alias("part"), F.lit("").alias("item"), F.col("vocab_size").alias("n")))


SHARD_BYTES = 1 << 18


@register("snk03_sharded_write", f"""
WITH RECURSIVE s AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS i, strlen(doc_id || chr(9) || regexp_replace(text, '[\\t\\n\\r]', ' ', 'g')) + 1 AS size
  FROM documents
), r(i, shard, total, size) AS (
  SELECT i, 0, size, size FROM s WHERE i = 1
  UNION ALL
  SELECT s.i, r.shard + CASE WHEN r.total + s.size > {SHARD_BYTES} THEN 1 ELSE 0 END,
         CASE WHEN r.total + s.size > {SHARD_BYTES} THEN s.size ELSE r.total + s.size END, s.size FROM r JOIN s ON s.i = r.i + 1)
SELECT shard::BIGINT AS shard, count(*)::BIGINT AS rows, sum(size)::BIGINT AS bytes, 1::BIGINT AS files FROM r GROUP BY shard""")
def q_snk03(spark, sf):
    """Documents as lines in shards of at most 256 KiB; the shards that were written, by file."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.regexp_replace("text", r"[\t\n\r]", " "))
    return K.list_shards(spark, K.write_shards(d, K.scratch_dir(spark, "snk03"), ["doc_id"], line, SHARD_BYTES))


def _table_paths(spark, sf, missing="missing_table"):
    """Manifest rows pointing at table files: en -> documents, fr -> pages,
    de -> labels, others -> ``missing``, a file that may not exist."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    name = (F.when(F.col("lang") == "en", "documents").when(F.col("lang") == "fr", "pages")
            .when(F.col("lang") == "de", "labels").otherwise(missing))
    return d.withColumn("path", F.concat(F.lit(sf.rstrip("/") + "/"), name, F.lit(".parquet")))


@register("flt07_keep_existing", oracle("""
SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY lang"""))
def q_flt07(spark, sf):
    inv = R.entries(spark, sf)
    kept = Q.keep_existing(_table_paths(spark, sf), "path", inv)
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register("flt08_assert_existing", oracle("""
SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang"""))
def q_flt08(spark, sf):
    """The strict variant over all rows, each of which points at a file that exists (it raises on a missing one)."""
    inv = R.entries(spark, sf)
    rows = _table_paths(spark, sf, missing="conversations")
    return Q.assert_existing(rows, "path", inv).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register("flt09_keep_len_with_offsets", oracle("""
SELECT doc_id, "offset" FROM (
  SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS BIGINT) AS "offset" FROM documents)
WHERE n_chars BETWEEN 100 AND 20000"""))
def q_flt09(spark, sf):
    """Offsets are computed over all rows first, so skipped rows still advance them."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    with_off = running_offset(d, [], ["doc_id"], "n_chars")
    return with_off.where(F.col("n_chars").between(100, 20000)).select("doc_id", "offset")


@register("prj07_clean_label", oracle("""
SELECT lower(replace(upper(pred_emo) || '.', '.', '')) AS label, CAST(count(*) AS BIGINT) AS n FROM predictions GROUP BY ALL""",
                                       ["predictions"]))
def q_prj07(spark, sf):
    p = V.predictions(spark, sf).select(F.concat(F.upper("pred_emo"), F.lit(".")).alias("answer"))
    return p.groupBy(N.clean_label("answer").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("prj17_resolve_path", oracle("""
SELECT doc_id, CASE WHEN lang = 'fr' THEN '/data/pages.wav'
                    WHEN lang = 'de' THEN '/abs/x.wav'
                    WHEN lang = 'en' THEN '/data/documents.parquet'
                    ELSE '/data/nothing.wav' END AS resolved_path FROM documents"""))
def q_prj17(spark, sf):
    """Three cases against the table folder listing: bare names resolve to the
    first suffix that exists (``documents`` -> ``.parquet``) else the first
    suffix; relative names with a suffix are joined under the root; absolute
    ones are kept.  The root is mapped to ``/data`` for the output."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    raw = (F.when(F.col("lang") == "en", "documents").when(F.col("lang") == "fr", "pages.wav")
           .when(F.col("lang") == "de", "/abs/x.wav").otherwise("nothing"))
    inv = R.entries(spark, sf)
    root = sf.rstrip("/")
    r = N.resolve_path(d.withColumn("p", raw), "p", inv, root, suffixes=(".wav", ".parquet"))
    return r.select("doc_id", F.regexp_replace("resolved_path", "^" + root, "/data").alias("resolved_path"))


@register("set02_union_partial_results", oracle("""
SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source"""))
def q_set02(spark, sf):
    """Per-directory partial outputs (one folder per source) read back by one glob scan."""
    out = K.scratch_dir(spark, "set02")
    table(spark, sf, "documents").select("doc_id", "source", "n_chars").write.mode("overwrite") \
        .partitionBy("source").parquet(out)
    back = spark.read.parquet(f"{out}/source=*").withColumn(
        "source", F.regexp_extract(F.col("_metadata.file_path"), r"source=([^/]+)/", 1))
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@register("set04_missing", oracle("""
SELECT DISTINCT token FROM (SELECT unnest(string_split(text, '')) AS token FROM documents)
WHERE token <> '' AND token NOT IN (SELECT unnest(string_split(text, '')) FROM benchmark)"""))
def q_set04(spark, sf):
    """Requested symbols (document characters) minus known ones (benchmark characters)."""
    from emoscope.functions.text import tokenize_char
    req = table(spark, sf, "documents").select(F.explode(F.array_distinct(tokenize_char("text"))).alias("token"))
    known = table(spark, sf, "benchmark").select(F.explode(F.array_distinct(tokenize_char("text"))).alias("token"))
    return missing(req, known, "token")


def _pandas_parser(names: pd.Series) -> pd.DataFrame:
    """A user file-name parser (vectorised over a batch of names)."""
    parts = names.str.replace(r"\.[^.]*$", "", regex=True).str.split("_")
    neutral = parts.str[1] == "neutral"
    txt = parts.str[1]
    cond = parts.str[2].where(~neutral, "neutral")
    wav = parts.str[3].where(~neutral, parts.str[2])
    tts = parts.str[5].where(~neutral, parts.str[4])
    full = (wav + "_proxy_" + txt).where(wav != txt, wav + "_cong")
    return pd.DataFrame({"txt_emo": txt, "txt_cond": cond, "wav_emo": wav, "lbl_full": full, "tts_model": tts})


@register("udf02_with_parsed", oracle("""
SELECT event_id, txt_emo, txt_cond, wav_emo, tts_model FROM parsed""", ["predictions"], PARSED_CTES))
def q_udf02(spark, sf):
    p = V.predictions(spark, sf).select("event_id", "file_name")
    out = U.with_parsed(p, "file_name", _pandas_parser)
    return out.select("event_id", "parsed.txt_emo", "parsed.txt_cond", "parsed.wav_emo", "parsed.tts_model")


def _split_words(text: str) -> list[str]:
    return text.split()


@register("udt01_python_segments", oracle("""
SELECT item_id, CAST(count(*) AS BIGINT) AS n_segments FROM (
  SELECT item_id, unnest(regexp_split_to_array(trim(text), '\\s+')) AS w FROM benchmark) WHERE w <> '' GROUP BY item_id"""))
def q_udt01(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", "text")
    s = U.python_segments(b, "text", ["item_id"], _split_words)
    return s.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_segments"))
