"""Join operators (JN01-JN13).

Join strategy is left to Catalyst and AQE (broadcast when statistics say a
side is small, sort-merge otherwise, skew splitting at run time).  Explicit
``broadcast`` hints appear only on sides whose size is bounded by a parameter
(a label list), never on data that grows with the tables.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emoscope.functions.hashing import stable_hash
from emoscope.operators.edits import edits
from emoscope.operators.ordered import global_row_number
from emoscope.operators.parallel import spread


def semi(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """JN01 keep rows that have a partner (left semi join)."""
    return df.join(other.select(on if isinstance(on, str) else list(on)), on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """JN02 rows without a partner (left anti join): train = all minus test.
    Matching is by key, so no positional leak."""
    return df.join(other.select(on if isinstance(on, str) else list(on)), on, "left_anti")


def zip_by_line(a: DataFrame, b: DataFrame, line_col: str = "line_no") -> DataFrame:
    """JN03 positional zip of aligned files: inner join on the line number."""
    return a.join(b, line_col, "inner")


def expand_jobs(texts: DataFrame, emotions: Sequence[str], text_id: str = "text_id",
                number_col: str = "job_number") -> DataFrame:
    """JN04 every text x every target emotion, numbered 1..N in (text, emotion
    order).  The emotion list is a parameter, so the expansion is a generator
    (``posexplode`` of a literal array), not a join; the global numbering uses
    the range-sharded row number (no single-task window)."""
    arr = F.array(*[F.lit(e) for e in emotions])
    exp = texts.select("*", F.posexplode(arr).alias("__k", "emotion"))
    exp = exp.withColumn("emotion_type", F.when(F.col("emotion") == "neutral", "neutral").otherwise("emotional"))
    numbered = global_row_number(exp, [text_id, "__k"], number_col)
    return numbered.drop("__k")


def lookup_default(df: DataFrame, dim: DataFrame, key: str, value_cols: Sequence[str],
                   default_key: str) -> DataFrame:
    """JN05 left join to a dimension; missing keys take the default row's values."""
    d = dim.select(key, *value_cols)
    out = df.join(d, key, "left")
    for c in value_cols:
        # the default row's value as a scalar subquery (one value, no join)
        dflt = d.where(F.col(key) == default_key).select(c).limit(1).scalar()
        out = out.withColumn(c, F.coalesce(F.col(c), dflt))
    return out


def join_results(results: DataFrame, jobs: DataFrame, key: str = "job_number") -> tuple[DataFrame, DataFrame]:
    """JN06 results joined to their jobs by job number; (succeeded, failed)."""
    j = results.join(jobs, key, "inner")
    return j.where(F.col("success")), j.where(~F.col("success"))


def merge_struct(a: Column, b: Column, fields: Sequence[str]) -> Column:
    """JN07 merge two structs with the same fields; ``b`` wins when not NULL."""
    return F.struct(*[F.coalesce(b[f], a[f]).alias(f) for f in fields])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two equal-length vectors (higher-order functions)."""
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def pair_similarity(pairs: DataFrame, emb: DataFrame, left_key: str, right_key: str,
                    emb_key: str = "vec_id", emb_col: str = "embedding") -> DataFrame:
    """JN08 two equi-joins to the embedding table, then cosine similarity."""
    e1 = emb.select(F.col(emb_key).alias(left_key), F.col(emb_col).alias("__e1"))
    e2 = emb.select(F.col(emb_key).alias(right_key), F.col(emb_col).alias("__e2"))
    j = pairs.join(e1, left_key).join(e2, right_key)
    return j.withColumn("sim", cosine(F.col("__e1"), F.col("__e2"))).drop("__e1", "__e2")


def words(col: Column) -> Column:
    """Whitespace tokens (empty strings removed), as a WER tool splits."""
    return F.filter(F.split(F.trim(col), r"\s+"), lambda w: w != "")


def word_error_rate(df: DataFrame, ref: str, hyp: str, char_level: Column | bool = False,
                    key: str = "pair_id") -> DataFrame:
    """JN09 WER = (S + D + I) / N on normalised texts; NULL for an empty
    reference.  Word level: the bit-parallel distance of ``edits.py``, whole
    texts, no limit to their words.  With ``char_level`` (per row or fixed)
    characters are scored instead (for Chinese), blanks removed.  Pairs are
    dealt out by ``key``, as one may be as much work as thousands of others."""
    cl = char_level if isinstance(char_level, Column) else F.lit(bool(char_level))
    none = F.array().cast("array<string>")

    def words_of(col: str) -> Column:
        return F.when(F.col("__cl"), none).otherwise(F.coalesce(words(F.col(col)), none))

    def chars_of(col: str) -> Column:
        return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"\s+", "")

    base = spread(df.withColumn("__cl", F.coalesce(cl, F.lit(False))), key)
    base = base.withColumn("__r", words_of(ref)).withColumn("__h", words_of(hyp))
    # a string goes to the bit-parallel distance as it is; its characters are its items
    if char_level is True:
        dist = edits(chars_of(ref), chars_of(hyp))
    elif char_level is False:
        dist = edits("__r", "__h")
    else:
        chars = edits(F.when(F.col("__cl"), chars_of(ref)), F.when(F.col("__cl"), chars_of(hyp)))
        dist = F.when(F.col("__cl"), chars).otherwise(edits("__r", "__h"))
    n = F.when(F.col("__cl"), F.char_length(chars_of(ref))).otherwise(F.size("__r"))
    return (base.withColumn("edits", dist.cast("bigint")).withColumn("ref_len", n.cast("bigint"))
            .withColumn("wer", F.when(F.col("ref_len") > 0, F.col("edits") / F.col("ref_len")))
            .drop("__cl", "__r", "__h"))


def _hash_rank(seed: int, col: str) -> Column:
    return stable_hash(col, seed)


def sample_same_key(df: DataFrame, key: str, id_col: str, seed: int = 0) -> DataFrame:
    """JN10 for each row, one other row of the same key drawn by hash.

    Each row draws position ``hash(id, seed) mod key_size`` among its key's
    rows (numbered by the range-sharded scan, so a hot key is not one task),
    then an equi-join on ``(key, position)`` fetches the partner."""
    from emoscope.operators.ordered import ordered_scan, key_sizes
    numbered = ordered_scan(df.select(key, id_col), [key], [_hash_rank(seed, id_col), id_col], row_number="__pos")
    sized = key_sizes(numbered, [key], "__n")
    draw = df.join(sized.select(key, id_col, "__n"), [key, id_col])
    draw = draw.withColumn("__want", F.pmod(stable_hash(id_col, seed + 1), F.col("__n")) + 1)
    partner = numbered.select(key, F.col("__pos").alias("__want"), F.col(id_col).alias("partner_id"))
    return draw.join(partner, [key, "__want"]).drop("__want", "__n")


def pick_preferred(df: DataFrame, key: str, text_col: str, preference: str, order_cols: Sequence[str]) -> DataFrame:
    """JN12 one row per key: rows whose ``text_col`` contains the preference
    first, then the smallest ``order_cols``.  Top-1 per key is a ``min_by``
    aggregate (partial aggregation map-side, so a hot key is no single sort)."""
    not_pref = (~F.coalesce(F.col(text_col).contains(preference), F.lit(False))).cast("int")
    cols = [c for c in df.columns if c != key]
    rank = F.struct(not_pref.alias("p"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)])
    best = df.groupBy(key).agg(F.min_by(F.struct(*cols), rank).alias("__b"))
    return best.select(key, "__b.*")


def pair_by_stem(df: DataFrame, path_col: str, gen_suffix: str = "_gen", ref_suffix: str = "_ref") -> DataFrame:
    """JN13 pair generated and reference files by their common stem."""
    import re
    from emoscope.functions.names import path_stem
    stem = path_stem(path_col)
    gen = df.where(stem.endswith(gen_suffix)).select(
        F.regexp_replace(stem, re.escape(gen_suffix) + "$", "").alias("stem"), F.col(path_col).alias("gen_path"))
    ref = df.where(stem.endswith(ref_suffix)).select(
        F.regexp_replace(stem, re.escape(ref_suffix) + "$", "").alias("stem"), F.col(path_col).alias("ref_path"))
    return gen.join(ref, "stem")


def lookup_instruction(jobs: DataFrame, dim: DataFrame, emotion: str = "emotion", kind: str = "emotion_type",
                       template: str = "Speak in a %s tone.") -> DataFrame:
    """PRJ28 instruction for each job: the (emotion, kind) entry; else the
    emotion's first entry (smallest text); else a template.  ``dim`` has
    columns (emotion, kind, instr); both lookups are left equi-joins."""
    exact = dim.select(F.col("emotion").alias("__e1"), F.col("kind").alias("__k1"), F.col("instr").alias("__i1"))
    first = dim.groupBy(F.col("emotion").alias("__e2")).agg(F.min("instr").alias("__i2"))
    out = (jobs.join(exact, (F.col(emotion) == F.col("__e1")) & (F.col(kind) == F.col("__k1")), "left")
           .join(first, F.col(emotion) == F.col("__e2"), "left"))
    instr = F.coalesce(F.col("__i1"), F.col("__i2"), F.format_string(template, F.col(emotion)))
    return out.withColumn("instruction", instr).drop("__e1", "__k1", "__i1", "__e2", "__i2")


def pick_reference(jobs: DataFrame, refs: DataFrame, n: int, seed: int, cap: float,
                   job_key: str = "job_number", emotion: str = "emotion", speaker: str = "speaker",
                   duration: str = "duration", ref_id: str = "ref_id") -> DataFrame:
    """JN11 for each job, a speaker drawn by hash among the speakers that
    have the job's emotion, then that speaker's ``n`` longest files of the
    emotion, taken in length order until ``cap`` seconds (the last one cut).

    Speakers are ranked per emotion by the range-sharded row number, the
    draw is an equi-join on (emotion, rank), and the top-N is a pre-limited
    window: no per-emotion task holds all speakers' files.  The speakers are
    counted apart from their ranks, as each use of a scan plans it anew."""
    from emoscope.operators.ordered import key_sizes, ordered_scan
    from emoscope.operators.ranking import take_until, top_n
    spk = refs.select(emotion, speaker).distinct()
    sizes = key_sizes(spk, [emotion], "__nspk").select(emotion, "__nspk").distinct()
    spk = ordered_scan(spk, [emotion], [stable_hash(speaker, seed), speaker], row_number="__srank")
    draw = jobs.join(sizes, emotion).withColumn(
        "__srank", F.pmod(stable_hash(job_key, seed), F.col("__nspk")) + 1)
    chosen = draw.join(spk.select(emotion, "__srank", speaker), [emotion, "__srank"]).drop("__srank", "__nspk")
    longest = top_n(refs.select(speaker, emotion, ref_id, duration), [speaker, emotion],
                    [F.desc(duration), F.asc(ref_id)], n, "__ref_rank")
    picked = chosen.join(longest, [speaker, emotion])
    return take_until(picked, [job_key], ["__ref_rank"], duration, cap)
