"""Characters to ids by code point, and characters outside a vocabulary."""

import pytest
from pyspark.sql import functions as F

from emoscope.functions.text import tokenize_char
from emoscope.operators.corpus import encode_by_join, encode_chars, oov

TEXTS = [(1, "hello é 漢\U0001F600"), (2, ""), (3, None), (4, "zz\U0010FFFFa"), (5, "a" * 3000 + "é"), (6, "éa\né")]
VOCAB = [("a", 3), ("é", 7), ("漢", 1), ("\U0001F600", 9), (" ", 4), ("\U0010FFFF", 2)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(TEXTS, "id long, text string").withColumn("t", tokenize_char("text"))
    return docs, spark.createDataFrame(VOCAB, "token string, idx int")


def test_ids_by_code_point(tables):
    docs, vocab = tables
    known = dict(VOCAB)
    got = {r.id: r.ids for r in encode_chars(docs, "t", vocab).collect()}
    assert got == {i: None if t is None else [known.get(c, 0) for c in t] for i, t in TEXTS}
    joined = {r.id: r.ids for r in encode_by_join(docs, "id", "t", vocab).collect()}
    assert all(got[i] == ids for i, ids in joined.items())


def test_rows_are_not_moved(tables):
    docs, vocab = tables
    plan = encode_chars(docs, "t", vocab)._jdf.queryExecution().executedPlan()
    main = plan.toString().split("Subquery")[0]
    assert "Exchange" not in main and "Generate" not in main and "Join" not in main


def test_empty_vocabulary_and_long_tokens(spark, tables):
    docs, vocab = tables
    assert {r.id: r.ids for r in encode_chars(docs, "t", vocab.limit(0)).collect()}[6] == [0, 0, 0, 0]
    with pytest.raises(Exception, match="not a single character: ab"):
        encode_chars(docs, "t", spark.createDataFrame([("ab", 1)], "token string, idx int")).collect()


def test_oov_first_places_and_numbers(tables):
    docs, vocab = tables
    known = {t for t, _ in VOCAB} - {"a"}
    seen = {}
    for i, t in TEXTS:
        for pos, c in enumerate(t or ""):
            if c not in known:
                first, n = seen.get(c, ((i, pos), 0))
                seen[c] = (min(first, (i, pos)), n + 1)
    got = oov(docs.repartition(4), "id", "text", vocab.where("token != 'a'")).collect()
    assert {r.token: ((r.first_row, r.first_pos), r.n) for r in got} == seen
    plan = oov(docs, "id", "text", vocab)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join LeftAnti" if "Join LeftAnti" in plan else "LeftAnti") < plan.index("Generate")  # the join is above
