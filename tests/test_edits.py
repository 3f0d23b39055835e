"""Bit-parallel word distance against the dynamic program."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emoscope.operators import edits as E
from emoscope.operators.joins import word_error_rate


def table(a, b):
    """The dynamic program, a row at a time."""
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=45), st.lists(st.integers(0, 6), max_size=45))
def test_random_pairs_equal_the_table(a, b):
    assert E.edit_distance(a, b) == table(a, b)


def test_edited_copies_equal_the_table(monkeypatch):
    rnd = random.Random(3)
    for bits in (1 << 28, 0):  # place masks kept, or built for each word
        monkeypatch.setattr(E, "MASK_BITS", bits)
        for _ in range(60):
            a = [rnd.choice("the of and a word other thing".split()) for _ in range(rnd.randrange(1, 150))]
            b = list(a)
            for _ in range(rnd.randrange(12)):
                b[rnd.randrange(len(b)):][:rnd.randrange(2)] = []
                b.insert(rnd.randrange(len(b) + 1), rnd.choice(["new", "the"]))
                if len(b) > 1:
                    del b[rnd.randrange(len(b))]
            assert E.edit_distance(a, b) == table(a, b) == E.edit_distance(b, a)


def test_a_pair_of_a_hundred_thousand_words():
    """All words differ, so edits far apart cannot be had cheaper than one each."""
    n = 100_000
    a = [f"w{i}" for i in range(n)]
    b = [w for i, w in enumerate(a) if i % 2500 != 7]
    for at in range(50, len(b), 5000):
        b.insert(at, f"new{at}")
    for at in range(1000, len(b), 10_000):
        b[at] = f"other{at}"
    edits = sum(1 for i in range(n) if i % 2500 == 7) + sum(w[0] == "n" for w in b) + sum(w[0] == "o" for w in b)
    assert E.edit_distance(a, b) == edits
    assert E.edit_distance(a, [f"x{i}" for i in range(n)]) == n


def test_more_spellings_than_code_points(spark):
    """No limit to the words of a pair: 1,200,000 spellings common to both texts."""
    n = 1_200_000
    df = spark.range(1).select(F.col("id").alias("pair_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.hex(i)), " ").alias("ref"))
    df = df.withColumn("hyp", F.regexp_replace("ref", " (FF|1000) ", " "))
    got = word_error_rate(df, "ref", "hyp").select("edits", "ref_len").collect()
    assert [tuple(r) for r in got] == [(2, n)]


def test_odd_rows(spark):
    rows = [(1, None, "a b"), (2, "a b", None), (3, "", ""), (4, " \t ", "a"), (5, "a\nb  c", "a b c"), (None, "x y", "x z"), (6, "一二三", "一三")]
    df = spark.createDataFrame(rows, "pair_id long, ref string, hyp string").withColumn("zh", F.col("pair_id") == 6)
    got = {r.pair_id: (r.edits, r.ref_len, r.wer) for r in word_error_rate(df, "ref", "hyp", char_level=F.col("zh")).collect()}
    assert got == {1: (2, 0, None), 2: (2, 2, 1.0), 3: (0, 0, None), 4: (1, 0, None), 5: (0, 3, 0.0), None: (1, 2, 0.5),
                   6: (1, 3, 1 / 3)}
