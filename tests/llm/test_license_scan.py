"""License scan: brute force of the phrases, edited notices, odd rows."""

import re

import pytest

pytest.importorskip("emoscope.llm")

from pyspark.sql import functions as F  # noqa: E402

from emoscope.llm import license_scan as L  # noqa: E402

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
SCHEMA = "doc_id long, text string, label string, start int, w string, size int, t int, i int, best double"
NOTICE = {x.label: x.text for x in L.NOTICES}
FILLER = " ".join(f"filler{i}" for i in range(40))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    """Places of the phrases, one window after the other."""
    w, found = words(text), []
    for x in L.PHRASES:
        p = x.text.split()
        found += [(i, x.label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return (len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None),
            ",".join(sorted({x for _, x in found})))


def scan(spark, texts):
    rows = [(i, t, "x", 1, "w", 2, 3, 4, 0.5) for i, t in enumerate(texts)]
    got = L.license_scan(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == COLUMNS
    return [tuple(r) for r in got.orderBy("doc_id").collect()]


def test_phrases_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECE", 5)  # so that phrases lie across pieces
    texts = ["Released under the MIT License. " * 3, "CC-BY-NC", "cc by", "CC BY NC by nc cc by nc", None, "", " \n\t",
             "the apache license, VERSION 2; under the mit license", "ünder the mit license", "Ünder THE MIT license",
             "under the mit license", "under the mit\x00license", FILLER + " under the mit license " + FILLER,
             "apache license version 2" * 2, "under the mit license under the mit licens"]
    for t, row in zip(texts, scan(spark, texts)):
        assert row[1:6] == base(t), t
        assert (row[7] == 1.0) == (row[2] > 0) and set(row[5].split(",")) <= set(row[6].split(","))


def test_a_very_long_text(spark):
    text = (FILLER + " ") * 2000 + "under the mit license " + (FILLER + " ") * 2000 + "cc by nc"
    assert scan(spark, [text])[0][1:6] == base(text) == (160007, 2, 80000, 160004, "cc-by-nc,mit")


def test_edited_notices_are_found_and_clean_texts_left_alone(spark):
    isc = NOTICE["isc"].split()
    put_in = " ".join([*isc[:8], "really", *isc[8:15], "and", "truly", *isc[15:]])
    left_out = " ".join(isc[:9] + isc[11:])
    half = " ".join(isc[:len(isc) // 2])
    texts = [f"{FILLER} {NOTICE['isc']} {FILLER}", f"{FILLER} {put_in} {FILLER}", f"{FILLER} {left_out} {FILLER}",
             f"{FILLER} {half} {FILLER}", FILLER, "the license of the software is the license of the work"]
    got = scan(spark, texts)
    assert [r[6] for r in got] == ["isc", "isc", "isc", "", "", ""]
    assert got[0][7] == 1.0 and 0.75 <= got[1][7] <= 1 and 0.75 <= got[2][7] < 1 and got[3][7] == 0


def test_of_overlapping_notices_the_fuller_one_stays(spark):
    texts = ["licensed under the GNU Lesser General Public License, version 3",
             "This work is licensed under the GNU General Public License, version 3.",
             "This work is licensed under the GNU General Public License, version 2.",
             "This work is licensed under the GNU General Public License.",
             "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
             "licensed under a Creative Commons Attribution 4.0 International License",
             f"{NOTICE['unlicense']} {FILLER} {NOTICE['bsd']}"]
    assert [r[6] for r in scan(spark, texts)] == ["lgpl-3", "gpl-3", "gpl-2", "gpl", "cc-by-sa", "cc-by", "bsd,unlicense"]


def test_spans_tell_the_words(spark):
    docs = spark.createDataFrame([(1, f"{FILLER} {NOTICE['mpl-2']} {FILLER} cc by nc")], "doc_id long, text string")
    got = {(r.label, r.phrase, r.start, r.end, r.coverage) for r in L.license_spans(docs).collect()}
    n = len(NOTICE["mpl-2"].split())
    assert got == {("mpl-2", False, 40, 40 + n, 1.0), ("cc-by-nc", True, 80 + n, 83 + n, 1.0)}


def test_repeated_rows_null_ids_and_one_id_with_two_texts(spark):
    mit = "under the mit license"
    rows = [(1, mit), (1, mit), (1, "other"), (None, mit), (None, "cc by nc"), (None, None), (2, None)]
    got = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).select(*COLUMNS[:6])
    expect = [(1, 4, 1, 0, 0, "mit"), (1, 4, 1, 0, 0, "mit"), (1, 1, 0, None, None, ""), (None, 4, 1, 0, 0, "mit"),
              (None, 3, 1, 0, 0, "cc-by-nc"), (None, 0, 0, None, None, ""), (2, 0, 0, None, None, "")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expect))


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert L.license_scan(docs).columns == COLUMNS and L.license_scan(docs).count() == 0
    plan = L.diagonals(docs.select("doc_id", F.col("text")), L.PHRASES, L.NOTICES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
