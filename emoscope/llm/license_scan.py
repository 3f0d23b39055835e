"""Operator 11: license scans by diagonal voting (native).

Every rolling ``K``-gram of a text's words is hashed and joined to the places
that the same gram has in the templates.  A gram at word ``i`` of a document
and word ``j`` of a template votes for the diagonal ``i - j``, so an untouched
copy puts all its votes on one diagonal, and a copy with words put in or left
out spreads them over neighbouring ones.  Votes are added up by (document,
template, diagonal), diagonals at most ``gap`` words apart are merged into one
span, and a span is verified by the words of the template that its grams cover,
compared as words, not as hashes.  Of spans that overlap, those that cover most
words stay, so that a notice of one license is not also one of its neighbour's.

A *phrase* is a template of which every place is wanted, word for word: a
diagonal that has the votes of all its grams.

Texts are cut into pieces of ``PIECE`` words, which overlap by a gram, before
their grams are built, so a very long text needs little more memory than its words.
Only grams that a template has are shuffled.  The templates are the one
broadcast, a few hundred grams, whatever the corpus holds.

Defined results: A-Z is lower-cased; a null text is empty, and an empty text or
one shorter than a gram has no spans; repeated rows of one id and text give
equal rows, and their votes count once; one id with several texts, and null
ids, are told apart by the text; equal spans stay side by side; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emoscope.llm.common import saved, text_of

K = 3
PIECE = 1024
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


class Template(NamedTuple):
    label: str
    text: str


# Phrases that name a license outright.
PHRASES = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)

# Sentences of public license notices, as words.
NOTICES = (
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("gpl", "licensed under the gnu general public license"),
    Template("gpl-2", "licensed under the gnu general public license version 2"),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "licensed under the gnu lesser general public license"),
    Template("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1"),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def scan_words(text: Column) -> Column:
    """Runs of lower-cased ASCII letters, digits and all other characters, as an array."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, NO_WORD), "")


def _grams(rows: DataFrame, keep: list[str], k: int) -> DataFrame:
    """``keep, place, h, gram`` for every window of ``k`` words of the array ``w``."""
    each = rows.select(*keep, "w", F.posexplode("w").alias("place", "w0")).filter(F.col("place") <= F.size("w") - k)
    window = [F.col("w0"), *[F.get("w", F.col("place") + n) for n in range(1, k)]]
    return each.select(*keep, "place", F.xxhash64(*window).alias("h"), F.concat_ws(" ", *window).alias("gram"))


def template_grams(spark: SparkSession, phrases: Sequence[Template], notices: Sequence[Template], k: int) -> DataFrame:
    """``h, t_gram, t, label, phrase, size, j``: the places of every gram in the templates."""
    rows = [F.struct(F.lit(t).alias("t"), F.lit(x.label).alias("label"), F.lit(t < len(phrases)).alias("phrase"),
                     F.lit(x.text).alias("text")) for t, x in enumerate([*phrases, *notices])]
    each = spark.range(1).select(F.inline(F.array(*rows)))
    words = each.select("t", "label", "phrase", scan_words(F.col("text")).alias("w")).withColumn("size", F.size("w"))
    return _grams(words, ["t", "label", "phrase", "size"], k).select(
        "h", F.col("gram").alias("t_gram"), "t", "label", "phrase", "size", F.col("place").alias("j"))


def _identified(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text``: a document is an id with a text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn(
        "text_hash", F.xxhash64("text"))


def document_grams(docs: DataFrame, k: int = K) -> DataFrame:
    """``doc_id, text_hash, i, gram, h`` for every rolling gram of every whole text."""
    def pieces(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(PIECE))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(w, s + 1, F.lit(PIECE + k - 1)).alias("w")))

    cut = _identified(docs).select("doc_id", "text_hash", F.explode(
        F.transform(F.array(scan_words(F.col("text"))), pieces)[0]).alias("p"))
    rows = cut.select("doc_id", "text_hash", F.col("p.start").alias("start"), F.col("p.w").alias("w"))
    return _grams(rows, ["doc_id", "text_hash", "start"], k).select(
        "doc_id", "text_hash", (F.col("start") + F.col("place")).alias("i"), "gram", "h")


def diagonals(docs: DataFrame, phrases: Sequence[Template], notices: Sequence[Template], k: int = K) -> DataFrame:
    """``doc_id, text_hash, t, label, phrase, size, d, js``: for each diagonal with a
    vote the template places that voted, sorted and distinct."""
    known = template_grams(docs.sparkSession, phrases, notices, k)
    votes = document_grams(docs, k).join(F.broadcast(known), "h").filter("gram = t_gram")  # a hash may lie, words don't
    return votes.groupBy("doc_id", "text_hash", "t", "label", "phrase", "size", (F.col("i") - F.col("j")).alias("d")).agg(
        F.sort_array(F.collect_set("j")).alias("js"))


def phrase_places(voted: DataFrame, k: int = K) -> DataFrame:
    """``doc_id, text_hash, label, start, end``: every place of a phrase."""
    whole = voted.filter(F.col("phrase") & (F.size("js") == F.col("size") - k + 1))
    return whole.select("doc_id", "text_hash", "label", F.col("d").cast("long").alias("start"),
                        (F.col("d") + F.col("size")).cast("long").alias("end"))


def notice_spans(voted: DataFrame, gap: int = 3, cover: float = 0.75, k: int = K) -> DataFrame:
    """``doc_id, text_hash, label, start, end, covered, coverage``: merged and verified spans of notices."""
    one = ["doc_id", "text_hash", "t"]
    along = Window.partitionBy(*one).orderBy("d")
    apart = F.coalesce(F.col("d") - F.lag("d").over(along) > gap, F.lit(True))
    marked = voted.filter(~F.col("phrase")).withColumn("new", apart.cast("int")).withColumn(
        "span", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    js = F.array_distinct(F.flatten(F.collect_list("js")))
    spans = marked.groupBy(*one, "label", "size", "span").agg(
        F.min(F.col("d") + F.element_at("js", 1)).cast("long").alias("start"),
        F.max(F.col("d") + F.element_at("js", -1) + k).cast("long").alias("end"),
        F.size(F.array_distinct(F.flatten(F.transform(js, lambda j: F.sequence(j, j + k - 1))))).alias("covered"))
    good = spans.withColumn("coverage", F.col("covered") / F.col("size")).filter(F.col("coverage") >= cover)
    doc = ["doc_id", "text_hash"]
    by = Window.partitionBy(*doc).orderBy("start", "end", "t")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = good.withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn(
        "island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct("covered", "coverage")).over(Window.partitionBy(*doc, "island"))
    return islands.withColumn("best", best).filter(F.struct("covered", "coverage") == F.col("best")).select(
        *doc, "label", "start", "end", "covered", "coverage")


def license_spans(docs: DataFrame, phrases: Sequence[Template] = PHRASES, notices: Sequence[Template] = NOTICES,
                  gap: int = 3, cover: float = 0.75) -> DataFrame:
    """``doc_id, text_hash, label, phrase, start, end, coverage``: all that was found; words from 0, end exclusive."""
    voted = saved(diagonals(docs, phrases, notices))  # few rows, and both branches read them
    exact = phrase_places(voted).select("*", F.lit(True).alias("phrase"), F.lit(1.0).alias("coverage"))
    fuzzy = notice_spans(voted, gap, cover).drop("covered").withColumn("phrase", F.lit(False))
    return exact.unionByName(fuzzy).select("doc_id", "text_hash", "label", "phrase", "start", "end", "coverage")


def license_scan(docs: DataFrame, phrases: Sequence[Template] = PHRASES, notices: Sequence[Template] = NOTICES,
                 gap: int = 3, cover: float = 0.75) -> DataFrame:
    """Digest per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is the coverage of the best span, 1 where a phrase stands, 0 without any."""
    found = license_spans(docs, phrases, notices, gap, cover)
    place = F.when(F.col("phrase"), F.col("start"))
    per = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).agg(
        F.count(place).alias("n"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("all_"), F.max("coverage").alias("best"))
    thin = _identified(docs).select("doc_id", "text_hash", F.size(scan_words(F.col("text"))).cast("long").alias("n_words"))
    both = thin.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_h")), "left")
    return both.select("doc_id", "n_words", F.coalesce("n", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                       F.coalesce("base", F.lit("")).alias("base_labels"), F.coalesce("all_", F.lit("")).alias("labels"),
                       F.coalesce("best", F.lit(0.0)).alias("score"))
