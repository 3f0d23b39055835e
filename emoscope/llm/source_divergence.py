"""Operator 12: source divergence audit over iceberg terms.

How far does a source's use of words lie from that of the other sources of its
language, and which words make the difference?  Only terms found in at least
``min_docs`` documents of a language count.

They are found by iceberg prefix refinement.  ``write_postings`` takes the
distinct terms of each document in byte order, a terminator behind each, with
the first level at which the term's prefix differs from its predecessor's, and
writes them once, added up over some documents at a time.  Level by level,
``kept_terms`` counts the distinct documents of every byte prefix, discards
prefixes below the threshold, and extends the others to twice the length, until
all that is left ends with its terminator, which makes it a complete term.  A
document counts once for a prefix because only the first of its terms with that
prefix counts at that level.  A level counts only prefixes whose parents are
left; the test for it is a hashed bitmap of ``BITS`` bits, so what every task
gets has a fixed size at any scale.  It may let a discarded prefix through, whose
own count is then below the threshold as well: every level is exact.

With p and q the smoothed shares (in billionths, rounded down) of a term in two
places and f = (p - q)^2 / q rounded down, the divergence of a source g from h
is the sum of f over all kept terms.  Terms that one of the two sources or both
lack take few different values: their part is a sum over g's and h's counts of
counts.  Only terms that both have are met as pairs, inside the row of the term,
and added up by pair before they leave the task, about ``PAIRS`` held at a time.

All arithmetic is in whole numbers and exact; sums that pass 63 bits are errors.

Defined results: null text, lang and source are empty; every row is a document,
repeated rows too; ids are not read, so null ids do no harm; a text without
terms still makes its (lang, source) a group; a language without kept terms has
divergence 0 between its sources and no terms; ties go by the bytes of the item;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emoscope.llm.common import saved
from emoscope.session import ensure_checkpoint_dir

BITS = 1 << 23
PAIRS = 1 << 19
FIRST_BYTES = 6
SLICE_BYTES = 1 << 23
UNIT = 1_000_000_000
#: The bytes of terms (letters, and all bytes of other characters), A-Z in lower case; 0 for the rest.
_BYTE = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 0 for c in range(256)], np.uint8)


def _places(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def _fresh(terms: list[bytes]) -> list[int]:
    """For each sorted term the first level at which its prefix is not its predecessor's."""
    out, before = [], b""
    for t in terms:
        level, size = 0, FIRST_BYTES
        while before[:size] == t[:size]:
            level, size = level + 1, 2 * size
        out.append(level)
        before = t
    return out


def _terms(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Every occurrence of a term in some texts: the text's number, and the term."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    lowered = _BYTE[data]
    inside = lowered != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][np.diff(offsets) > 0]
    begins[at] = inside[at]  # a term ends with its text
    letters = np.concatenate([[0], np.cumsum(inside)])
    starts = np.flatnonzero(begins)
    row = np.searchsorted(offsets, starts, "right") - 1
    cuts = np.append(letters[starts], letters[-1]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(lowered[inside])])
    return row, words.dictionary_encode()


def _postings(langs: list[str], sources: list[str], texts: pa.Array) -> pa.RecordBatch:
    """Some documents' rows of ``write_postings``."""
    row, words = _terms(texts)
    order = pc.array_sort_indices(words.dictionary).to_numpy()
    terms = [t + b"\0" for t in words.dictionary.take(pa.array(order)).to_pylist()]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    v = max(1, len(terms))
    # a document's distinct terms in byte order, and where their prefixes first differ
    found, n = np.unique(row * v + rank[words.indices.to_numpy()], return_counts=True)
    doc, term = found // v, found % v
    apart = np.array(_fresh(terms), np.int64)
    fresh = np.zeros(len(found), np.int64)
    for level in range(int(apart.max(initial=0))):
        prefix = np.cumsum(apart <= level)[term]
        fresh[1:] += (prefix[1:] == prefix[:-1]) & (doc[1:] == doc[:-1]) & (fresh[1:] == level)
    # added up over the documents of one language and source
    names: dict[tuple, int] = {}
    group = np.array([names.setdefault(x, len(names)) for x in zip(langs, sources)], np.int64)
    levels = int(fresh.max(initial=0)) + 1
    key, at = np.unique((group[doc] * levels + fresh) * v + term, return_inverse=True)
    total, docs = np.zeros(len(key), np.int64), np.bincount(at, minlength=len(key))
    np.add.at(total, at, n)
    which = pa.array(key // v // levels)
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in names], pa.string()).take(which), pa.array([x for _, x in names], pa.string()).take(which),
         pa.array(terms, pa.binary()).take(pa.array(key % v)), pa.array((key // v % levels).astype(np.int32)),
         pa.array(total), pa.array(docs.astype(np.int64))], names=["lang", "source", "term", "fresh", "n", "docs"])


def write_postings(docs: DataFrame, path: str) -> DataFrame:
    """``lang, source, term, fresh, n, docs``: occurrences of a term (bytes with a terminator, a zero byte, which no
    term has) in some ``docs`` documents, in which its prefixes are new from level ``fresh`` on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            a = 0
            while a < len(texts):
                z = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SLICE_BYTES, "right")))
                yield _postings(langs[a:z], sources[a:z], texts.slice(a, z - a))
                a = z

    rows = docs.select(*_places(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows.mapInArrow(run, "lang string, source string, term binary, fresh int, n long, docs long").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _bit(lang: str, prefix: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(lang), prefix), F.lit(BITS))


def _bitmap(kept: DataFrame) -> Column:
    """A bit for each ``lang, prefix``, as one array of ``BITS`` / 64 longs."""
    bit = _bit("lang", F.col("prefix"))
    words = kept.select((bit / 64).cast("long").alias("w"), F.call_function(
        "shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bits"))
    zero = kept.sparkSession.range(BITS // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))
    each = words.unionByName(zero).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"])).scalar()


def _has_bit(bitmap: Column, lang: str, prefix: Column) -> Column:
    bit = _bit(lang, prefix)
    word = F.get(bitmap, (bit / 64).cast("int"))
    return F.call_function("shiftright", word, (bit % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def kept_terms(posted: DataFrame, min_docs: int = 3) -> DataFrame:
    """``lang, prefix``: the terms (with terminator) found in ``min_docs`` documents of the language."""
    level, size, bitmap, done = 0, FIRST_BYTES, None, None
    while True:
        rows = posted.filter(F.col("fresh") <= level).select("lang", "term", "docs")
        if bitmap is not None:  # terms no longer than the last level's prefix were complete there
            rows = rows.filter(F.octet_length("term") > size // 2).filter(_has_bit(bitmap, "lang", F.substring("term", 1, size // 2)))
        counted = rows.groupBy("lang", F.substring("term", 1, size).alias("prefix")).agg(F.sum("docs").alias("n_docs"))
        left = saved(counted.filter(F.col("n_docs") >= min_docs).select("lang", "prefix"))
        complete = F.substring("prefix", -1, 1) == F.lit(b"\0")
        done = left.filter(complete) if done is None else done.unionByName(left.filter(complete))
        open_ = left.filter(~complete)
        if open_.isEmpty():
            return done
        level, size, bitmap = level + 1, 2 * size, _bitmap(open_)


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + v)); null where no term is kept."""
    whole = F.nullif(total + v, F.lit(0).cast("long")).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), whole)


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _f_np(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def shared_terms(terms: DataFrame) -> DataFrame:
    """``g, h, both``: over the terms that both sources have, the sum of f less what
    it would be with one of the two counts, or both, at zero (see ``pair_rows``)."""
    def summed(g: np.ndarray, h: np.ndarray, x: np.ndarray) -> tuple:
        names, code = np.unique(np.concatenate([g, h]), return_inverse=True)
        key, at = np.unique(code[:len(g)] * len(names) + code[len(g):], return_inverse=True)
        out = np.zeros(len(key), np.int64)
        np.add.at(out, at, x)
        return names[key // len(names)], names[key % len(names)], out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def batch_of(rows: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["g", "h", "both"])

        for batch in batches:
            lists = batch.column(0)
            offsets = lists.offsets.to_numpy()
            gid, p, p0 = (lists.values.field(k).to_numpy() for k in ("gid", "p", "p0"))
            size = np.diff(offsets)
            first, many = np.repeat(offsets[:-1], size), np.repeat(size, size)  # of each entry's list
            left = np.arange(offsets[0], offsets[-1])
            ends = np.cumsum(many)
            a = 0
            while a < len(left):  # some entries at a time, each with all entries of its list
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
                n = many[a:z]
                i = np.repeat(left[a:z], n)
                j = np.repeat(first[a:z], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i, j = i[i != j], j[i != j]
                x = _f_np(p[i], p[j]) - _f_np(p[i], p0[j]) - _f_np(p0[i], p[j]) + _f_np(p0[i], p0[j])
                held.append(summed(gid[i], gid[j], x))
                if sum(len(k[0]) for k in held) > PAIRS:
                    held = [summed(*(np.concatenate(c) for c in zip(*held)))]
                    if len(held[0][0]) > PAIRS // 2:
                        yield batch_of(held.pop())
                a = z
        if held:
            yield batch_of(summed(*(np.concatenate(c) for c in zip(*held))))

    each = terms.filter(F.size("sources") > 1).select(
        F.transform("sources", lambda s: F.struct(s["gid"].alias("gid"), s["p"].alias("p"), s["p0"].alias("p0"))).alias("sources"))
    return each.mapInArrow(run, "g long, h long, both long").groupBy("g", "h").agg(F.sum("both").alias("both"))


def pair_rows(groups: DataFrame, counts: DataFrame, terms: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the divergence of every source from every other of its language.

    With p0 the share at count zero, the sum of f(p, q) over all V terms is V f(p0, q0), plus
    f(p, q0) - f(p0, q0) over g's terms, plus f(p0, q) - f(p0, q0) over h's, plus ``both``."""
    some = counts.groupBy("gid", "p").agg(F.count("*").alias("m")).groupBy("gid").agg(
        F.collect_list(F.struct("p", "m")).alias("some"))
    each = groups.join(some, "gid", "left").select("lang", "source", "gid", "v", "p0", F.coalesce(
        "some", F.array().cast("array<struct<p:long,m:long>>")).alias("some"))
    g = each.select("lang", "v", *[F.col(c).alias(f"{c}_g") for c in ("source", "gid", "p0", "some")])
    h = each.select("lang", *[F.col(c).alias(f"{c}_h") for c in ("source", "gid", "p0", "some")])
    both = shared_terms(terms).select(F.col("g").alias("gid_g"), F.col("h").alias("gid_h"), "both")
    pairs = g.join(h, "lang").filter("gid_g != gid_h").join(both, ["gid_g", "gid_h"], "left")
    p, q, zero = F.col("p0_g"), F.col("p0_h"), F.lit(0).cast("long")
    base = _f(p, q)
    only_g = F.aggregate("some_g", zero, lambda s, x: s + x["m"] * (_f(x["p"], q) - base))
    only_h = F.aggregate("some_h", zero, lambda s, x: s + x["m"] * (_f(p, x["p"]) - base))
    value = F.col("v") * base + only_g + only_h + F.coalesce("both", zero)
    return pairs.select("lang", F.col("source_g").alias("source"), F.col("source_h").alias("item"),
                        F.when(F.col("v") > 0, value).otherwise(zero).alias("value"))


def term_rows(groups: DataFrame, langs: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """``lang, source, item, value, rank``: the terms that a source uses more than its language does."""
    rows = terms.join(langs, "lang").select("term", _share(F.col("total"), F.col("n_lang"), F.col("v")).alias("q"),
                                            F.explode("sources").alias("s"))
    over = rows.filter(F.col("s.p") > F.col("q")).select(
        F.col("s.gid").alias("gid"), F.col("term").substr(F.lit(1), F.octet_length("term") - 1).cast("string").alias("item"),
        _f(F.col("s.p"), F.col("q")).alias("value"))
    order = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    best = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(groups.select("gid", "lang", "source"), "gid").select("lang", "source", "item", "value", "rank")


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: parts ``pair`` (all other sources) and ``term`` (the ``top`` terms)."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/divergence-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    posted = write_postings(docs, f"{folder}/postings")
    kept = kept_terms(posted, min_docs)
    likely = posted.filter(_has_bit(_bitmap(kept), "lang", F.col("term")))
    seen = likely.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    counts = written(seen.join(kept.withColumnRenamed("prefix", "term"), ["lang", "term"], "left_semi"), "counts")

    zero = F.lit(0).cast("long")
    langs = counts.groupBy("lang").agg(F.sum("n").alias("n_lang")).join(
        kept.groupBy("lang").agg(F.count("*").alias("v")), "lang")
    langs = written(langs, "langs")
    each = docs.select(*_places(docs)).distinct().join(
        counts.groupBy("lang", "source").agg(F.sum("n").alias("n_source")), ["lang", "source"], "left")
    each = each.join(langs, "lang", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_source", "n_lang", "v")})
    groups = written(each.select("lang", "source", F.monotonically_increasing_id().alias("gid"), "n_source", "v",
                                 _share(zero, F.col("n_source"), F.col("v")).alias("p0")), "groups")
    placed = counts.join(groups, ["lang", "source"]).select(
        "lang", "term", "gid", "n", _share(F.col("n"), F.col("n_source"), F.col("v")).alias("p"), "p0")
    terms = written(placed.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("gid", "p", "p0")).alias("sources")), "terms")

    pairs = pair_rows(groups, placed, terms)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    parts = [df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
             for name, df in (("pair", pairs), ("term", term_rows(groups, langs, terms, top)))]
    return parts[0].unionByName(parts[1])
