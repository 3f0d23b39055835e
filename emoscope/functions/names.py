"""File-name grammar, label cleaning and path helpers (PRJ01-PRJ17).

All functions return Columns built from Spark SQL expressions, so they run
inside whole-stage codegen and need no Python per row.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def path_stem(path: str | Column) -> Column:
    """File name without directory and last suffix (``a/b/c.wav`` -> ``c``)."""
    base = F.substring_index(_c(path), "/", -1)
    return F.regexp_replace(base, r"\.[^.]*$", "")


def path_basename(path: str | Column) -> Column:
    return F.substring_index(_c(path), "/", -1)


def path_parent(path: str | Column) -> Column:
    """Directory part; empty string when there is none."""
    p = _c(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_extract(p, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def path_suffix(path: str | Column) -> Column:
    """Last suffix with the dot, or empty string."""
    return F.regexp_extract(path_basename(path), r"(\.[^.]*)$", 1)


def swap_suffix(path: str | Column, suffix: str) -> Column:
    """Replace the last suffix (or append one)."""
    p = _c(path)
    return F.concat(F.regexp_replace(p, r"\.[^./]*$", ""), F.lit(suffix))


def absolute_or_join(path: str | Column, root: str | Column) -> Column:
    """Keep absolute paths; join relative ones under ``root``."""
    p = _c(path)
    r = F.lit(root) if isinstance(root, str) else root
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.regexp_replace(r, "/+$", ""), F.lit("/"), p))


def parse_name_positional(filename: str | Column) -> Column:
    """PRJ01: true label = token -3, proxy label = token 1 (0-based) of the
    ``_``-split name; ``unknown`` when there are too few tokens."""
    parts = F.split(_c(filename), "_")
    n = F.size(parts)
    true = F.when(n >= 3, F.element_at(parts, -3)).otherwise(F.lit("unknown"))
    proxy = F.when(n >= 2, F.element_at(parts, 2)).otherwise(F.lit("unknown"))
    return F.struct(true.alias("true_emotion"), proxy.alias("proxy_emotion"))


def congruence(wav_emo: str | Column, txt_emo: str | Column) -> Column:
    """PRJ03: ``{wav}_proxy_{txt}`` when they differ, else ``{wav}_cong``."""
    w, t = _c(wav_emo), _c(txt_emo)
    return F.when(w != t, F.concat_ws("_", w, F.lit("proxy"), t)).otherwise(F.concat(w, F.lit("_cong")))


def parse_name(filename: str | Column) -> Column:
    """PRJ02: ``{NN}_{txt}_{cond}_{wav}_{spk}_{TTS}.wav``, or for neutral text
    ``{NN}_neutral_{wav}_{spk}_{TTS}.wav``; returns a struct of five labels."""
    parts = F.split(path_stem(filename), "_")
    neutral = F.get(parts, 1) == "neutral"
    txt = F.get(parts, 1)
    cond = F.when(neutral, F.lit("neutral")).otherwise(F.get(parts, 2))
    wav = F.when(neutral, F.get(parts, 2)).otherwise(F.get(parts, 3))
    tts = F.when(neutral, F.get(parts, 4)).otherwise(F.get(parts, 5))
    return F.struct(
        txt.alias("txt_emo"), cond.alias("txt_cond"), wav.alias("wav_emo"),
        congruence(wav, txt).alias("lbl_full"), tts.alias("tts_model"))


def condition_flag(filename: str | Column) -> Column:
    """PRJ04: 1 if the name contains ``explicit``, 0 for ``implicit``, else -1."""
    f = _c(filename)
    return (F.when(f.contains("explicit"), F.lit(1))
            .when(f.contains("implicit"), F.lit(0)).otherwise(F.lit(-1)))


# Fallback chains of the reference's prediction tables, in order.
LABEL_COLUMNS = ["predicted_emotion", "emotion", "output", "response"]
PATH_COLUMNS = ["filename", "file_name", "file_path"]
# Label column by model name.
MODEL_LABEL_COLUMN = {"salmonn": "output", "flamingo3": "response", "desta2": "predicted_emotion",
                      "qwen": "emotion"}
MODEL_PATH_COLUMN = {"salmonn": "file_path", "flamingo3": "file_name"}


def normalise_predictions(df: DataFrame, lower: bool = True) -> DataFrame:
    """PRJ05: pick the first present label column and the first present path
    column (schema inspection on the driver, one ``coalesce`` per row)."""
    labels = [c for c in LABEL_COLUMNS if c in df.columns]
    paths = [c for c in PATH_COLUMNS if c in df.columns]
    if not labels or not paths:
        raise ValueError("no label or path column in prediction table")
    label = F.coalesce(*[F.col(c) for c in labels])
    if lower:
        label = F.lower(label)
    return df.withColumn("pred_label", label).withColumn("pred_path", F.coalesce(*[F.col(c) for c in paths]))


def label_by_model(model: str | Column) -> Column:
    """PRJ06: the answer column chosen by model name over a union-aligned table."""
    m = _c(model)
    expr = None
    for name, col in MODEL_LABEL_COLUMN.items():
        expr = (F.when(m == name, F.col(col)) if expr is None else expr.when(m == name, F.col(col)))
    return expr.otherwise(F.lit(None))


def path_by_model(model: str | Column) -> Column:
    m = _c(model)
    return (F.when(m == "salmonn", F.col("file_path"))
            .when(m == "flamingo3", F.col("file_name")).otherwise(F.col("filename")))


def clean_label(col: str | Column, strip_dot: bool = True) -> Column:
    """PRJ07: remove every ``.`` and lower-case (``strip_dot=False`` keeps dots,
    as the per-run reports do)."""
    c = _c(col)
    if strip_dot:
        c = F.replace(c, F.lit("."), F.lit(""))
    return F.lower(c)


def recode(col: str | Column, mapping: Mapping[str, str]) -> Column:
    """PRJ08: dictionary recode; values not in the dictionary pass through."""
    if not mapping:
        return _c(col)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, _c(col)), _c(col))


def encode_label(col: str | Column, order: Sequence[str]) -> Column:
    """PRJ09: label -> integer id by a fixed order (NULL for unknown labels)."""
    arr = F.array(*[F.lit(x) for x in order])
    pos = F.array_position(arr, _c(col))
    return F.when(pos > 0, pos - 1)


def decode_label(col: str | Column, order: Sequence[str]) -> Column:
    """PRJ09 inverse: integer id -> label."""
    arr = F.array(*[F.lit(x) for x in order])
    return F.try_element_at(arr, _c(col).cast("int") + 1)


def classify_by_substring(col: str | Column, rules: Sequence[tuple[str, str]]) -> Column:
    """PRJ10: first rule whose substring occurs wins (ordered); fallback is the
    token before the first ``_``."""
    c = _c(col)
    low = F.lower(c)
    expr = None
    for needle, label in rules:
        cond = low.contains(needle.lower())
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    fallback = F.substring_index(c, "_", 1)
    return fallback if expr is None else expr.otherwise(fallback)


def clean_text(col: str | Column) -> Column:
    """PRJ11: trim; empty becomes NULL so that a null filter drops it."""
    t = F.trim(_c(col))
    return F.when(F.char_length(t) > 0, t)


def safe_name(col: str | Column, n: int = 50) -> Column:
    """PRJ12: keep ``[A-Za-z0-9_-]``, blanks and tabs become ``_``, drop the
    rest, cut to ``n`` characters, ``untitled`` when nothing is left."""
    c = F.regexp_replace(_c(col), r"[ \t]", "_")
    c = F.regexp_replace(c, r"[^A-Za-z0-9_\-]", "")
    c = F.substring(c, 1, n)
    return F.when(F.char_length(c) > 0, c).otherwise(F.lit("untitled"))


def output_name(number: str | Column, emotion: str | Column, condition: str | Column,
                text: str | Column, suffix: str = ".wav") -> Column:
    """PRJ13: ``{NN}_{emotion}_{condition}{suffix}`` with a two-digit number;
    when the number is missing an 8-character md5 of the text stands in."""
    num = _c(number)
    head = F.when(num.isNotNull(), F.format_string("%02d", num)).otherwise(F.substring(F.md5(_c(text)), 1, 8))
    return F.concat(F.concat_ws("_", head, _c(emotion), _c(condition)), F.lit(suffix))


def content_hash(col: str | Column) -> Column:
    """PRJ14: md5 content key."""
    return F.md5(_c(col))


def zfill(col: str | Column, width: int = 4) -> Column:
    """PRJ15: left-pad with zeros; longer values are kept whole (plain lpad
    would cut them)."""
    c = _c(col).cast("string")
    return F.when(F.char_length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def resolve_path(df: DataFrame, path_col: str, inventory: DataFrame, root: str,
                 suffixes: Sequence[str] = (".wav", ".mp3", ".flac")) -> DataFrame:
    """PRJ17: resolve audio paths in three cases.

    * absolute with suffix: kept;
    * relative with suffix: joined under ``root``;
    * bare name: the first suffix (in ``suffixes`` order) under which a file
      exists in ``inventory`` (column ``path``), else the first suffix.
    The inventory join is an equi-join on the candidate path.
    """
    p = F.col(path_col)
    has_suffix = F.regexp_extract(path_basename(p), r"(\.[^.]+)$", 1) != ""
    base = absolute_or_join(p, root)
    cands = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat(base, F.lit(s)).alias("cand"))
                      for i, s in enumerate(suffixes)])
    # by the path itself: equal paths resolve alike, and no row id has to be stable
    bare = df.where(~has_suffix).select(p.alias("__path"), F.inline(cands)).distinct()
    inv = inventory.select(F.regexp_replace("path", "^file:", "").alias("cand")).distinct()
    found = (bare.join(inv, "cand", "left_semi")
             .groupBy("__path").agg(F.min_by("cand", "rank").alias("__found")))
    out = df.join(found, p == F.col("__path"), "left")
    resolved = (F.when(has_suffix, base)
                .otherwise(F.coalesce(F.col("__found"), F.concat(base, F.lit(suffixes[0])))))
    return out.withColumn("resolved_path", resolved).drop("__path", "__found")
