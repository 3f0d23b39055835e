"""One row -> many: sentence chunks, voice and style segments (TVF01-TVF05).

Each text is processed whole inside one row with higher-order functions
(``split`` + ``aggregate``), then ``posexplode`` fans the pieces out; the
work is spread by row, and no Python runs per row.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Sentence boundaries -- after ASCII ``;:,.!?`` plus whitespace,
# or right after the full-width marks ``；：，。！？``.  ``(?U)`` makes ``\s``
# Unicode-aware as in Python.
SENTENCE_SPLIT = r"(?U)(?<=[;:,.!?])\s+|(?<=[；：，。！？])"
VOICE_SPLIT = r"(?=\[\w+\])"
VOICE_TAG = r"\[(\w+)\]"
STYLE_MARK = r"\{.*?\}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _with_blank(s: Column) -> Column:
    """A sentence gets a trailing blank when its last character is one byte."""
    return F.when((F.char_length(s) > 0) & (F.octet_length(F.right(s, F.lit(1))) == 1),
                  F.concat(s, F.lit(" "))).otherwise(s)


def chunk_array(text, max_bytes) -> Column:
    """TVF01 as a column: sentence split, then greedy packing by UTF-8 bytes
    (a sentence joins the current chunk while bytes(cur) + bytes(sentence) <=
    max_bytes); chunks are stripped."""
    sentences = F.split(_c(text), SENTENCE_SPLIT)
    mb = max_bytes if isinstance(max_bytes, Column) else F.lit(max_bytes)
    init = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit("").alias("cur"))

    def step(acc, s):
        fits = F.octet_length(acc["cur"]) + F.octet_length(s) <= mb
        flushed = F.when(F.char_length(acc["cur"]) > 0,
                         F.concat(acc["chunks"], F.array(F.trim(acc["cur"])))).otherwise(acc["chunks"])
        return F.when(fits, F.struct(acc["chunks"].alias("chunks"), F.concat(acc["cur"], _with_blank(s)).alias("cur"))) \
            .otherwise(F.struct(flushed.alias("chunks"), _with_blank(s).alias("cur")))

    def finish(acc):
        return F.when(F.char_length(acc["cur"]) > 0, F.concat(acc["chunks"], F.array(F.trim(acc["cur"])))) \
            .otherwise(acc["chunks"])

    return F.aggregate(sentences, init, step, finish)


def chunk_text(df: DataFrame, col: str, max_bytes: int = 135, out: str = "chunk") -> DataFrame:
    """TVF01 one row per chunk with its index."""
    return df.select("*", F.posexplode(chunk_array(col, max_bytes)).alias(f"{out}_idx", out))


def chunk_text_progressive(df: DataFrame, col: str, max_bytes: int, few_bytes: int, min_bytes: int,
                           out: str = "chunk") -> DataFrame:
    """TVF04 first package smaller: chunk, re-chunk chunk 0 at ``few_bytes``,
    then the new chunk 0 at ``min_bytes``; chunks renumbered."""
    b = chunk_array(col, max_bytes)

    from emoscope.functions.arrays import let

    def refine(arr, budget):
        # the chunk array is bound once (lambdas do not share sub-expressions)
        def on(a):
            head = chunk_array(F.element_at(a, 1), budget)
            return F.when(F.size(a) > 0, F.concat(head, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))))) \
                .otherwise(a)
        return let(arr, on)

    b = refine(refine(b, few_bytes), min_bytes)
    return df.select("*", F.posexplode(b).alias(f"{out}_idx", out))


def segment_voices(df: DataFrame, col: str, voices: Sequence[str], default: str = "main") -> DataFrame:
    """TVF02 split before ``[voice]`` tags; untagged or unknown voice ->
    ``default``; tags removed, blank parts dropped."""
    parts = df.select("*", F.posexplode(F.split(_c(col), VOICE_SPLIT)).alias("segment_idx", "__part"))
    parts = parts.where(F.char_length(F.trim("__part")) > 0)
    tag = F.regexp_extract("__part", "^" + VOICE_TAG, 1)
    known = F.array(*[F.lit(v) for v in voices])
    voice = F.when((tag != "") & F.array_contains(known, tag), tag).otherwise(F.lit(default))
    text = F.trim(F.regexp_replace("__part", VOICE_TAG, ""))
    return parts.withColumn("voice", voice).withColumn("segment_text", text).drop("__part")


STYLE_SCHEMA = "name string, seed bigint, speed double"


def segment_styles(df: DataFrame, col: str) -> DataFrame:
    """TVF03 split on ``{...}`` markers; a marker is JSON ``{name, seed,
    speed}`` or a bare name; the style holds until the next marker (each text
    piece takes the marker just before it, the first takes ``Regular``).
    Every piece gets its own struct (no shared, aliased dictionary)."""
    texts = F.split(_c(col), STYLE_MARK)
    marks = F.regexp_extract_all(_c(col), F.lit("(" + STYLE_MARK + ")"), 1)
    regular = F.struct(F.lit("Regular").alias("name"), F.lit(-1).cast("bigint").alias("seed"),
                       F.lit(1.0).alias("speed"))
    ex = df.select("*", F.posexplode(texts).alias("segment_idx", "__t"), marks.alias("__marks"))
    mark = F.get(F.col("__marks"), F.col("segment_idx") - 1)  # marker before piece i (NULL for i = 0)
    is_json = mark.rlike(r'^\{\s*"')
    bare = F.struct(F.expr("substring(__m, 2, char_length(__m) - 2)").alias("name"),
                    F.lit(-1).cast("bigint").alias("seed"), F.lit(1.0).alias("speed"))
    ex = ex.withColumn("__m", mark)
    style = (F.when(F.col("segment_idx") == 0, regular)
             .when(is_json, F.from_json(F.col("__m"), STYLE_SCHEMA))
             .otherwise(bare))
    out = ex.withColumn("style", style).withColumn("segment_text", F.trim("__t"))
    return out.where(F.char_length("segment_text") > 0).drop("__t", "__marks", "__m")
