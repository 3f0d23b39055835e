"""Operator 4: mixing sources to target weights by pivotal rounding (native).

Every source gets a target number of words: a weighted share of ``multiple``
times all words, at most ``cap`` times its own words, the excess reshared by
weight.  A document of a source with ratio r = target / size is taken floor(r)
times for certain and once more with probability p = r - floor(r).  Pivotal
rounding makes those probabilities integral: two fractional documents duel,
words move from one to the other until one of them is at 0 or 1, and the sum of
p * size stays what it was.  The direction is drawn so that each document keeps
its probability on average.

The duels form a reduction tree: documents are dealt into groups of about
``fanin`` within their source, each group is folded to decisions and at most one
fractional residual, and the residuals go to the next level until one per
source is left, which a coin decides; no group grows with the source.  A duel
settles the smaller document first, so the last one tends to be large.  The
documents of at most median size therefore wait: what the coin adds or takes is
spread over their probabilities before they are rounded by a tree of their own,
and a source misses its target by one document of at most median size (more
only where they are too few to make up for it).  Draws are hashes of ids and
seed, so reruns agree.

Defined results: null text has size 0; documents of size 0 take 0; a null
source is a source of its own and sorts last; repeated rows are documents of
their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emoscope.llm.common import n_words_of, saved, text_of

WEIGHTS = (3.0, 1.0, 2.0)
_EPS = 1e-9
ITEM = "struct<p:double,size:double,doc_id:bigint,text_hash:bigint>"
DONE = "array<struct<doc_id:bigint,text_hash:bigint,size:double,bit:int>>"


def source_targets(sized: DataFrame, weights: Sequence[float], multiple: float, cap: float) -> DataFrame:
    """``sid, source, source_size, n, middle, small_words, target``: one row per source;
    ``small_words`` are those in documents of at most median size (``middle``).

    The level at which uncapped sources stand is found by repeating the reshare;
    each round is one aggregate over the source table and only sums reach the
    driver.
    """
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                      F.count(F.when(F.col("size") > 0, 1)).alias("n"),
                                      F.percentile_approx("size", 0.5, 1000).alias("middle"))
    small = sized.join(src.select(F.col("source").alias("_source"), "middle"),
                       F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") <= F.col("middle")))
    small = small.groupBy("_source").agg(F.sum("size").alias("small_words"))
    src = src.join(small, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    # one row per source: the numbering that the cyclic weights need
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.withColumn("sid", nth)
    src = saved(src.withColumn("weight", F.element_at(
        F.array(*map(F.lit, map(float, weights))), (F.col("sid") % len(weights) + 1).cast("int"))))
    most = cap * F.col("source_size")
    total = src.agg(F.sum("source_size")).first()[0]
    total = multiple * float(total or 0)
    level, full = 0.0, -1
    while True:
        above = most <= level * F.col("weight")
        row = src.agg(F.sum(F.when(above, most).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))),
                      F.count(F.when(above, 1))).first()
        if row[2] == full or not row[1]:
            break
        full, level = row[2], (total - row[0]) / row[1]
    return src.withColumn("target", F.least(most, F.lit(level) * F.col("weight"))).drop("weight")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body``."""
    return F.transform(F.array(value), body)[0]


def _duel(state: Column, b: Column, seed: int) -> Column:
    """Fold step: the residual of the state meets item ``b``."""
    a = state["res"]
    up = lambda v: F.least((1 - v["a"]["p"]) * v["a"]["size"], v["b"]["p"] * v["b"]["size"])
    down = lambda v: F.least(v["a"]["p"] * v["a"]["size"], (1 - v["b"]["p"]) * v["b"]["size"])
    draw = lambda v: (F.pmod(F.xxhash64(v["a"]["doc_id"], v["a"]["text_hash"], v["b"]["doc_id"],
                                        v["b"]["text_hash"], F.lit(seed)), F.lit(1 << 53)) / float(1 << 53))
    snap = lambda p: F.when(p < _EPS, 0.0).when(p > 1 - _EPS, 1.0).otherwise(p)

    def decided(x: Column, p: Column) -> Column:
        entry = F.struct(x["doc_id"].alias("doc_id"), x["text_hash"].alias("text_hash"),
                         x["size"].alias("size"), p.cast("int").alias("bit"))
        return F.when((p == 0) | (p == 1), F.array(entry)).otherwise(F.array().cast(DONE))

    def settle(v: Column) -> Column:
        moved = F.struct(v["v"]["a"].alias("a"), v["v"]["b"].alias("b"),
                         snap(v["v"]["a"]["p"] + v["move"] / v["v"]["a"]["size"]).alias("pa"),
                         snap(v["v"]["b"]["p"] - v["move"] / v["v"]["b"]["size"]).alias("pb"))
        return _let(moved, lambda m: F.struct(
            F.when((m["pa"] > 0) & (m["pa"] < 1), _item(m["a"], m["pa"]))
            .when((m["pb"] > 0) & (m["pb"] < 1), _item(m["b"], m["pb"])).alias("res"),
            F.concat(v["done"], decided(m["a"], m["pa"]), decided(m["b"], m["pb"])).alias("done")))

    def meet(v: Column) -> Column:
        limits = F.struct(v.alias("v"), up(v).alias("up"), down(v).alias("down"), draw(v).alias("u"))
        return _let(limits, lambda x: _let(F.struct(
            x["v"].alias("v"), state["done"].alias("done"),
            F.when(x["u"] * (x["up"] + x["down"]) < x["down"], x["up"]).otherwise(-x["down"]).alias("move")),
            settle))

    first = F.struct(b.alias("res"), state["done"].alias("done"))
    return F.when(a.isNull(), first).otherwise(
        _let(F.struct(a.alias("a"), b.alias("b")), meet))


def _item(x: Column, p: Column) -> Column:
    return F.struct(p.alias("p"), x["size"].alias("size"), x["doc_id"].alias("doc_id"),
                    x["text_hash"].alias("text_hash"))


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def pivotal_round(items: DataFrame, most: int, fanin: int = 64, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Round ``items`` (``sid, n, p, size, doc_id, text_hash`` with 0 < p < 1 and
    up to ``n`` items in source ``sid``, at most ``most``).

    Returns the decided ``sid, doc_id, text_hash, size, bit`` and, with the same
    columns and ``gained`` (words over the expectation), the last document of
    each source, decided by a coin."""
    out, level = None, 0
    while True:
        level += 1
        groups = F.ceil(F.col("n") / fanin)
        g = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(level)), groups).alias("g")
        item = F.struct((-F.col("size")).alias("o"), "doc_id", "text_hash", "p", "size")
        dealt = items.groupBy("sid", groups.alias("n"), g).agg(F.collect_list(item).alias("xs"))
        xs = F.transform(F.sort_array("xs"), lambda x: _item(x, x["p"]))
        start = F.struct(F.lit(None).cast(ITEM).alias("res"), F.array().cast(DONE).alias("done"))
        folded = saved(dealt.select("sid", "n", F.aggregate(
            xs, start, lambda s, b: _duel(s, b, seed + level)).alias("s")))
        done = folded.select("sid", F.explode("s.done").alias("d")).select("sid", "d.*")
        left = folded.filter("s.res is not null").select("sid", "n", "s.res.*")
        out = done if out is None else out.unionByName(done)
        most = math.ceil(most / fanin)
        if most <= 1:
            last = left.select("sid", "doc_id", "text_hash", "size", "p",
                               (_draw(seed) < F.col("p")).cast("int").alias("bit"))
            return out, last.withColumn("gained", (F.col("bit") - F.col("p")) * F.col("size")).drop("p")
        items = left


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, multiple: float = 1.5, cap: float = 2.0,
        fanin: int = 64, seed: int = 1) -> DataFrame:
    """``doc_id, source, text_hash, size, source_size, target, copies`` for every document."""
    text = text_of()
    sized = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                              n_words_of(text).alias("size"), F.xxhash64(text).alias("text_hash")))
    targets = saved(source_targets(sized, weights, multiple, cap))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = targets.withColumnRenamed("source", "_source").withColumn("base", F.floor(ratio + _EPS).cast("int")
                                                                  ).withColumn("p", ratio - F.col("base"))
    rows = sized.join(t, sized["source"].eqNullSafe(t["_source"])).drop("_source", "source")
    open_ = (F.col("size") > 0) & (F.col("p") > _EPS)
    most = targets.agg(F.max("n")).first()[0] or 0
    columns = ["sid", "doc_id", "text_hash", "size", "bit"]
    items = rows.filter(open_).select("sid", "n", "p", F.col("size").cast("double").alias("size"), "doc_id",
                                      "text_hash", "middle", "small_words")
    large, last = pivotal_round(items.filter("size > middle"), most, fanin, seed)
    gained = last.select(F.col("sid").alias("_s"), "gained")
    small = items.filter("size <= middle").join(gained, F.col("sid") == F.col("_s"), "left")
    p = F.col("p") - F.coalesce("gained", F.lit(0.0)) / F.col("small_words")
    small = small.withColumn("p", F.when(p < _EPS, 0.0).when(p > 1 - _EPS, 1.0).otherwise(p))
    whole = (F.col("p") == 0) | (F.col("p") == 1)
    rest, end = pivotal_round(small.filter(~whole), most, fanin, seed + 100)
    every = rows.filter(~open_).select("sid", "doc_id", "text_hash", "size", F.lit(0).alias("bit"))
    for part in (large, last, small.filter(whole).withColumn("bit", F.col("p").cast("int")), rest, end):
        every = every.unionByName(part.select(*columns).withColumn("size", F.col("size").cast("long")))
    done = every.join(t.select("sid", "_source", "source_size", "target", "base"), "sid")
    return done.select("doc_id", F.col("_source").alias("source"), "text_hash", "size", F.col("source_size").cast("long").alias("source_size"),
                       "target", F.when(F.col("size") > 0, F.col("base") + F.col("bit")).otherwise(0).alias("copies"))


def source_mixing(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document."""
    return mix(docs, **how).select("doc_id", "size", "source_size", "target",
                                   (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (rows equal in id,
    text and source are interchangeable: their copies are added up over one of them)."""
    copies = (mix(docs, **how).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"),
                                       F.col("source").alias("_src"))
              .agg(F.sum("copies").alias("_n")).filter("_n > 0"))
    # the row travels as one struct, so no column of it can clash with the copies'
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_rid"),
                       F.xxhash64(text_of()).alias("_rth"), F.col("source").cast("string").alias("_rsrc")
                       ).dropDuplicates(["_rid", "_rth", "_rsrc"])
    both = rows.join(copies, F.col("_rid").eqNullSafe(F.col("_id")) & (F.col("_rth") == F.col("_th"))
                     & F.col("_rsrc").eqNullSafe(F.col("_src")))
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("_row.*")
