"""Operator 2: I-Match document fingerprints (native).

Terms are the lower-cased words of a text.  The lexicon is every term whose
document frequency lies in a band [low, high] of all documents (a band of
inverse document frequency).  It holds at most (mean distinct terms) / low
terms however large the corpus is, which bounds the list that goes into the
plan.  A document keeps its distinct lexicon terms, sorted; sixteen randomised
subsets of the lexicon each hash the terms they hold.  A term is in subset r if
byte r of its MD5 is below the subset's rate; rates fall from 1/4 to 1/64, so
that large edits still leave some subsets untouched.

A fingerprint is the sixteen hashes joined by '-', an empty part where a subset
holds no term.  A text without any lexicon term is fingerprinted by all its
sorted terms instead ('x' and a hash).  The likeness of two fingerprints is 1
if they are equal, else the share of equal parts among the parts that are
filled in either.

Defined results: null text counts as empty; null ids sort last; rows with the
same id are ordered by text; every input row gives one output row; the empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emoscope.llm.common import WHITE_RE, text_of, words_of

LOW, HIGH = 0.01, 0.3
_SQL_WHITE = WHITE_RE.replace("\\", "\\\\")
#: Two hex digits below which a term belongs to the subset: 1/4, 1/16, 1/32 and 1/64 of the lexicon.
RATES = ("40",) * 4 + ("10",) * 4 + ("08",) * 4 + ("04",) * 4


def terms_of(text: Column) -> Column:
    return F.array_distinct(words_of(F.lower(text)))


def _among(terms: list[str]) -> str:
    """The terms as an SQL list; parsed at once, where a Column per term would take a call each."""
    escaped = (t.replace("\\", "\\\\").replace("'", "\\'") for t in terms)
    return ", ".join(f"'{t}'" for t in escaped)


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[str]:
    """Terms of the band; at most mean-distinct-terms / low of them."""
    n = docs.count()
    df = (docs.select(F.explode(terms_of(text_of())).alias("term"))
          .groupBy("term").agg(F.count("*").alias("df")))
    return [r[0] for r in df.filter((F.col("df") >= low * n) & (F.col("df") <= high * n))
            .select("term").collect()]


def fingerprint(name: str, terms: list[str]) -> Column:
    """Fingerprint of the text column ``name`` under a lexicon."""
    text = F.col(name)
    known = F.array().cast("array<string>")
    if terms:
        known = F.expr(f"filter(array_distinct(filter(split(lower(`{name}`), '{_SQL_WHITE}'), w -> w != '')), "
                       f"w -> w IN ({_among(terms)}))")
    coded = F.transform(F.sort_array(known),
                        lambda w: F.struct(F.md5(w.cast("binary")).alias("h"), w.alias("w")))

    def hashed(t: Column) -> Column:
        joined = F.array_join(F.transform(t, lambda x: x["w"]), " ")
        return F.when(F.size(t) > 0, F.substring(F.md5(joined.cast("binary")), 1, 12)).otherwise("")

    def subset(c: Column, r: int, top: str) -> Column:
        return F.filter(c, lambda x: F.substring(x["h"], 2 * r + 1, 2) < top)

    def parts(c: Column) -> Column:
        return F.concat_ws("-", *[F.transform(F.array(subset(c, r, top)), hashed)[0]
                                  for r, top in enumerate(RATES)])

    # one-element transforms evaluate a value once and give it a name
    inside = F.transform(F.array(coded), parts)
    whole = F.concat(F.lit("x"), F.md5(F.array_join(F.sort_array(terms_of(text)), " ").cast("binary")))
    return F.transform(inside, lambda p: F.when(
        F.replace(p, F.lit("-"), F.lit("")) == "", whole).otherwise(p))[0]


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among the parts filled in either fingerprint."""
    pairs = F.arrays_zip(F.split(a, "-").alias("a"), F.split(b, "-").alias("b"))
    filled = F.filter(pairs, lambda x: (F.coalesce(x["a"], F.lit("")) != "")
                      | (F.coalesce(x["b"], F.lit("")) != ""))
    same = F.filter(filled, lambda x: x["a"].eqNullSafe(x["b"]))
    return F.when(a == b, 1.0).otherwise(
        F.size(same).cast("double") / F.greatest(F.size(filled), F.lit(1)))


def with_next(rows: DataFrame, columns: tuple[str, ...] = ("text",), slices: int | None = None) -> DataFrame:
    """``rows`` (with ``doc_id`` and ``text``) plus ``next``: the named columns of
    the next document by descending id (after the last, the first).

    Ids are cut into slices at quantiles; a window orders each slice.  The rows
    of a slice's first id are also placed behind the slice before it, so no row
    needs a second look-up.  Only one id per slice reaches the driver, and the
    bounds set the balance alone, never the answer.
    """
    spark = rows.sparkSession
    slices = slices or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    ids = rows.select("_k")
    cuts = sorted(set(ids.select(F.percentile_approx(
        "_k", [i / slices for i in range(1, slices)], 10_000)).first()[0] or []))
    number = F.lit(0)  # slice 0 has the largest ids
    if cuts:
        number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("_k") <= c))
    firsts = [tuple(r) for r in ids.groupBy(number.alias("s")).agg(F.max("_k")).orderBy("s").collect()]
    behind = F.lit(None).cast("int")
    if firsts:
        pairs = [F.lit(x) for i, (_, first) in enumerate(firsts) for x in (first, firsts[i - 1][0])]
        behind = F.element_at(F.create_map(*pairs), F.col("_k"))
    copies = F.array(F.struct(number.cast("int").alias("s"), F.lit(False).alias("ghost")),
                     F.struct(behind.alias("s"), F.lit(True).alias("ghost")))
    spread = rows.withColumn("_c", F.explode(F.filter(copies, lambda c: c["s"].isNotNull())))
    # ghosts come behind all rows of the slice, ids descending
    w = Window.partitionBy("_c.s").orderBy("_c.ghost", F.col("_k").desc(), "text")
    return (spread.withColumn("next", F.lead(F.struct(*columns)).over(w))
            .filter(~F.col("_c.ghost")).drop("_c", "_k"))


def document_fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, with likenesses."""
    terms = lexicon(docs, low, high)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("fingerprint", fingerprint("text", terms))
    rows = with_next(rows, ("text", "fingerprint")).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = rows.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring(F.col("next.text"), F.lit(1), half)))
    done = edited.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", fingerprint("edited", terms).alias("edited_fingerprint"),
        F.col("next.fingerprint").alias("_next"))
    return done.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
