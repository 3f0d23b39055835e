"""Source divergence: brute force over odd texts, iceberg levels, hot terms."""

import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("emoscope.llm")

from emoscope.llm import source_divergence as D  # noqa: E402

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, fresh int, gid long, p long, value long"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, 2, 3, 4, 5) for i, r in enumerate(rows)], SCHEMA)


def brute(rows, min_docs=3, top=200):
    docs, count = defaultdict(lambda: defaultdict(set)), defaultdict(Counter)
    groups = defaultdict(set)
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low):
            docs[lang][t].add(k)
            count[lang, source][t] += 1
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if len(d) >= min_docs]
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        whole = sum(total.values())

        def share(n, of):
            return 1 + 10 ** 9 * (n + 1) // (of + len(kept))

        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s][t] for s in sources), whole) for t in kept}
        for s in sources:
            pair = [(sum((p[s][t] - p[h][t]) ** 2 // p[h][t] for t in kept), h) for h in sources if h != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, v, r) for r, (v, item) in enumerate(ranked, 1)}
    return out


def got(df, **how):
    out = D.source_divergence(df, **how)
    assert out.columns == COLUMNS
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ODD = [("Alpha beta gamma. " * 3, "en", "a"), ("ALPHA beta", "en", "b"), ("alpha Beta x1y", "en", "b"), (None, "en", "c"),
       ("", "en", None), ("beta", None, None), ("beta", None, "z"), ("beta zebra", None, None), ("1234 --", "de", "a"),
       ("alpha", "de", "b"), ("Ärger ärger é ß 漢字", "fr", "a"), ("ärger Ärger 漢字", "fr", "b"), ("Ärger 漢字 😀", "fr", "b"),
       ("Ärger", "fr", "b"), ("beta", None, "z"), ("beta", None, "z"), ("a" * 300 + " " + "a" * 301, "en", "a"),
       ("a" * 300, "en", "b"), ("a" * 300 + "b", "en", "b"), ("a" * 300, "en", "d"), ("only", "xx", "s"), (None, "yy", "s")]


def test_odd_rows_equal_brute_force(spark):
    assert got(frame(spark, ODD)) == brute(ODD)
    assert got(frame(spark, ODD), min_docs=1, top=2) == brute(ODD, 1, 2)
    assert got(frame(spark, ODD), min_docs=2) == brute(ODD, 2)


def test_empty_tables(spark):
    assert got(frame(spark, [])) == set()
    assert got(frame(spark, [(None, None, None)])) == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_skewed_corpora_equal_brute_force(spark, monkeypatch, seed):
    """One source with a third of the rows, a term in every document, shared prefixes; little held at a time."""
    monkeypatch.setattr(D, "PAIRS", 50)
    monkeypatch.setattr(D, "SLICE_BYTES", 2000 * seed)
    monkeypatch.setattr(D, "BITS", 1 << 8)  # a bitmap that lets nearly everything through
    rnd = random.Random(seed)
    stems = ["the", "ther", "thermal", "thermodynamics", "thermodynamical", "un", "une", "über"]
    words = [s + x for s in stems for x in ("", "a", "ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz")]
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{rnd.randrange(9)}"
        text = " ".join(["the", *rnd.choices(words, k=rnd.randrange(30)), f"rare{rnd.randrange(150)}x"])
        rows.append((text, rnd.choice(["en", "en", "de"]), source))
    assert got(frame(spark, rows)) == brute(rows)


def test_levels_keep_prefixes_by_distinct_documents(spark, tmp_path, monkeypatch):
    """Three terms of one document share a prefix: one document, not three."""
    rows = [("thermala thermalb thermalc", "en", "a"), ("other", "en", "a"), ("other", "en", "b"), ("other", "en", "c")]
    posted = D.write_postings(frame(spark, rows), f"{tmp_path}/p")
    fresh = {bytes(r.term): r.fresh for r in posted.filter("term != encode('other', 'utf-8')").collect() if r.term[:1] == b"t"}
    assert fresh == {b"thermala\0": 0, b"thermalb\0": 1, b"thermalc\0": 1}  # "therma" counts once
    assert {(r.lang, bytes(r.prefix)) for r in D.kept_terms(posted, 3).collect()} == {("en", b"other\0")}
    monkeypatch.setattr(D, "FIRST_BYTES", 4)
    assert D._fresh([b"a\0", b"ab\0", b"abcdefgh\0", b"abcdefghi\0", b"abd\0"]) == [0, 0, 0, 2, 0]


def test_large_counts_stay_exact(spark):
    """Shares of counts whose product with a billion passes 63 bits."""
    from pyspark.sql import functions as F
    n, total, v = 9 * 10 ** 15, 9 * 10 ** 17, 12345
    got_ = spark.range(1).select(D._share(F.lit(n), F.lit(total), F.lit(v))).collect()[0][0]
    assert got_ == 1 + 10 ** 9 * (n + 1) // (total + v)
