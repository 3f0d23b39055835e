"""Text normalisation, size estimates and tokenisers (PRJ18-PRJ30, ARR01-ARR04).

Byte counts use ``octet_length`` (UTF-8 bytes), character counts use
``char_length`` (code points), matching Python's ``len(s.encode())`` and
``len(s)``.  ``int()`` truncation toward zero is a cast to ``bigint``.
"""

from __future__ import annotations

import string
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# Full-width replacements for Chinese text, and the
# out-of-vocabulary fixes applied before tokenising.
ZH_PUNCT_FROM = ",!?"
ZH_PUNCT_TO = "，！？"
OOV_FIX_FROM = ";“”‘’"
OOV_FIX_TO = ",\"\"''"


def translate_punct(col, lang=None) -> Column:
    """PRJ18: curly quotes and ``;`` to ASCII; for ``zh`` also ``,!?`` to
    full width.  One ``translate`` per table, no regex."""
    c = F.translate(_c(col), OOV_FIX_FROM, OOV_FIX_TO)
    if lang is None:
        return c
    return F.when(_c(lang) == "zh", F.translate(c, ZH_PUNCT_FROM, ZH_PUNCT_TO)).otherwise(c)


def ensure_terminal(col) -> Column:
    """PRJ19: end with ``". "`` unless it already ends with ``". "`` or ``。``;
    a bare final ``.`` gets a blank."""
    c = _c(col)
    return (F.when(c.endswith(". ") | c.endswith("。"), c)
            .when(c.endswith("."), F.concat(c, F.lit(" ")))
            .otherwise(F.concat(c, F.lit(". "))))


def pad_ascii_tail(col) -> Column:
    """PRJ20: append a blank when the last character is one UTF-8 byte."""
    c = _c(col)
    return F.when(F.octet_length(F.right(c, F.lit(1))) == 1, F.concat(c, F.lit(" "))).otherwise(c)


def estimate_frames(ref_frames, ref_text, gen_text, speed=1.0, slow_below_bytes: int = 10,
                    slow_speed: float = 0.3) -> Column:
    """PRJ21: ``ref + int(ref / ref_bytes * gen_bytes / speed)``; texts shorter
    than ``slow_below_bytes`` bytes use ``slow_speed``."""
    gen_b = F.octet_length(_c(gen_text))
    spd = F.when(gen_b < slow_below_bytes, F.lit(slow_speed)).otherwise(_lit(speed))
    ref = _c(ref_frames).cast("double")
    return (_c(ref_frames) + (ref / F.octet_length(_c(ref_text)) * gen_b / spd).cast("bigint")).cast("bigint")


def estimate_seconds(ref_seconds, ref_text, gen_text, speed=1.0) -> Column:
    """PRJ22: estimate by character ratio, in seconds:
    ``ref * (1 + gen_chars / ref_chars) / speed``."""
    ref = _c(ref_seconds).cast("double")
    return ref * (F.lit(1.0) + F.char_length(_c(gen_text)) / F.char_length(_c(ref_text))) / _lit(speed)


def chunk_budget(ref_text, ref_seconds, speed=1.0, horizon: float = 22.0) -> Column:
    """PRJ23: max bytes per chunk from the speaking rate of the reference:
    ``int(bytes / dur * (horizon - dur) * speed)``."""
    d = _c(ref_seconds).cast("double")
    return (F.octet_length(_c(ref_text)) / d * (F.lit(horizon) - d) * _lit(speed)).cast("bigint")


def frame_len(duration, sample_rate: int = 24000, hop: int = 256) -> Column:
    """PRJ24: mel frames of a duration in seconds."""
    return _c(duration) * F.lit(float(sample_rate)) / F.lit(float(hop))


def fmt_hms(seconds) -> Column:
    """PRJ25: ``H:MM:SS`` of whole seconds."""
    s = _c(seconds).cast("bigint")
    return F.format_string("%d:%02d:%02d", (s / 3600).cast("bigint"), ((s % 3600) / 60).cast("bigint"), s % 60)


def fmt_bytes(n) -> Column:
    """PRJ25: byte size with the largest unit below 1024 (``%.1f UNIT``)."""
    b = _c(n).cast("double")
    expr = F.when(b < 1024, F.format_string("%.1f B", b))
    for i, unit in enumerate(["KB", "MB", "GB"], start=1):
        expr = expr.when(b < float(1024 ** (i + 1)), F.format_string(f"%.1f {unit}", b / float(1024 ** i)))
    return expr.otherwise(F.format_string("%.1f TB", b / float(1024 ** 4)))


# Punctuation removed before scoring, ASCII (Python's
# string.punctuation) followed by the full-width and CJK marks, in code order
# by block.
CJK_PUNCT = ("＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､"
             "\u3000、〃〈〉《》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿"
             "–—‘’‛“”„‟…‧﹏﹑﹔·！？｡。")
WER_PUNCT = string.punctuation + CJK_PUNCT


def wer_normalise(col, lang) -> Column:
    """PRJ26: delete punctuation, one pass of double blank -> blank, then
    lower-case for ``en`` or put a blank between every character for ``zh``."""
    c = F.translate(_c(col), WER_PUNCT, "")
    c = F.replace(c, F.lit("  "), F.lit(" "))
    lg = _c(lang) if not isinstance(lang, str) else F.lit(lang)
    return (F.when(lg == "zh", F.array_join(F.split(c, ""), " "))
            .when(lg == "en", F.lower(c)).otherwise(c))


def chat_prompt(system_text, user_text, audio_path) -> Column:
    """PRJ27: the per-file conversation sent to a model."""
    return F.array(
        F.struct(F.lit("system").alias("role"), _c(system_text).alias("content")),
        F.struct(F.lit("user").alias("role"),
                 F.concat(F.lit("<audio>"), _c(audio_path), F.lit("</audio> "), _c(user_text)).alias("content")),
    )


def is_error(col, sentinel: str = "ERROR") -> Column:
    """PRJ29: a row failed when its answer starts with the sentinel."""
    return F.coalesce(_c(col).startswith(sentinel), F.lit(False))


def pad_duration(estimate, duration, step: float = 1.0) -> Column:
    """PRJ30: ``(int(est + dur) // step + 1) * step``."""
    whole = (_c(estimate) + _c(duration)).cast("bigint").cast("double")
    return (F.floor(whole / F.lit(step)) + 1) * F.lit(step)


# ---- tokenisers (ARR01-ARR04) -------------------------------------------------

def tokenize_char(col) -> Column:
    """ARR01: text to code points (empty text -> empty array)."""
    return F.filter(F.split(_c(col), ""), lambda x: x != "")


def tokenize_bytes(col) -> Column:
    """ARR03: UTF-8 bytes as integers 0..255.  The hex string is cut into
    pairs by one regex pass (linear; positional substrings on a UTF-8 string
    would rescan it for every byte)."""
    pairs = F.regexp_extract_all(F.hex(F.encode(_c(col), "UTF-8")), F.lit("(..)"), 1)
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def encode_tokens(tokens, vocab: DataFrame | dict, token_col="token", idx_col="idx") -> Column:
    """ARR02: tokens -> vocabulary ids, unknown -> 0.

    ``vocab`` is a mapping built on the driver only from a vocabulary whose
    size is bounded (a character set); for large vocabularies explode and join
    instead (see ``operators.corpus.encode_by_join``)."""
    if isinstance(vocab, DataFrame):
        raise TypeError("pass a dict here; use operators.corpus.encode_by_join for a table")
    m = F.create_map(*[F.lit(x) for kv in vocab.items() for x in kv])
    return F.transform(_c(tokens), lambda t: F.coalesce(F.try_element_at(m, t), F.lit(0)))


def encode_symbols(tokens, symbols: Sequence[str]) -> Column:
    """ARR04: keep only known symbols, map to index, and add 0 at both ends."""
    arr = F.array(*[F.lit(s) for s in symbols])
    kept = F.filter(_c(tokens), lambda t: F.array_contains(arr, t))
    ids = F.transform(kept, lambda t: F.array_position(arr, t).cast("int") - 1)
    zero = F.array(F.lit(0))
    return F.concat(zero, ids, zero)
