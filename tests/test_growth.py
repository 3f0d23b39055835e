"""Steps that have to grow with the input: what is read, counted and held."""

import pytest
from pyspark.sql import functions as F


def counted(df, seen):
    """``df``, with its rows added to the accumulator each time they are made."""
    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema)


def test_a_table_in_a_folder_exists(spark, tmp_path):
    import __spark_entry__ as entry
    rows = [(i, "t", lang, "s", 1) for i, lang in enumerate(["en", "fr", "de", "es", "en"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("documents", "pages", "labels", "conversations"):
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
    want = {"en": 2, "fr": 1, "de": 1, "es": 1}
    for sf in (str(tmp_path), f"{tmp_path}/"):
        assert {r.lang: r.n for r in entry.queries()["flt08_assert_existing"](spark, sf).collect()} == want
    got = {r.lang: r.n for r in entry.queries()["flt07_keep_existing"](spark, str(tmp_path)).collect()}
    assert got == {"en": 2, "fr": 1, "de": 1}
    got = {r.doc_id: r.resolved_path for r in entry.queries()["prj17_resolve_path"](spark, str(tmp_path)).collect()}
    assert got[0] == "/data/documents.parquet" and got[3] == "/data/nothing.wav"
    with pytest.raises(Exception, match="missing file"):
        from emoscope.operators.quality import assert_existing
        from emoscope.sources.readers import entries
        assert_existing(docs.select(F.lit(f"{tmp_path}/none.parquet").alias("path")), "path", entries(spark, str(tmp_path))).collect()


def test_characters_by_the_bit_parallel_distance(spark):
    from emoscope.operators.joins import word_error_rate
    rows = [(1, "ab cé", "abc"), (2, "\U0001f600x", "x"), (3, None, "ab"), (4, "ab", None), (5, "x" * 50_000, "y" * 50_000)]
    df = spark.createDataFrame(rows, "pair_id long, ref string, hyp string")
    out = word_error_rate(df, "ref", "hyp", char_level=True)
    assert {r.pair_id: (r.edits, r.ref_len) for r in out.collect()} == {1: (1, 4), 2: (1, 2), 3: (2, 0), 4: (2, 2), 5: (50_000, 50_000)}
    assert "levenshtein" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_slices_are_found_without_a_fold_over_the_bounds(spark):
    from emoscope.operators.ordered import ordered_scan
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    out = ordered_scan(df, ["k"], ["id"], row_number="n", num_partitions=37)
    assert all(r.n == r.id // 3 + 1 for r in out.collect())
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_the_full_matrix_counts_its_rows_once(spark):
    from emoscope.operators.metrics import confusion
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([("g", "a", "b", "c"), ("g", "a", "a", "d"), (None, "b", None, "a")], "k string, y string, p string, t string")
    got = {(r.k, r.actual, r.predicted): r.n for r in confusion(counted(rows, seen), "y", "p", ["k"], ["y", "p", "t"]).collect()}
    assert got == {(k, a, b): 0 for k in ("g", None) for a in "abcd" for b in "abcd"} | {
        ("g", "a", "b"): 1, ("g", "a", "a"): 1, (None, "b", None): 1}
    assert seen.value == 3


def test_expected_counts_count_their_rows_once(spark):
    from emoscope.operators.metrics import expected_counts
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([("g", "a", "b"), ("g", "a", "a"), (None, "b", "a")], "k string, a string, b string")
    got = {(r.k, r.actual, r.predicted): (r.n, r.expected) for r in expected_counts(counted(rows, seen), "a", "b", ["k"]).collect()}
    assert got == {("g", "a", "a"): (1, 1.0), ("g", "a", "b"): (1, 1.0), ("g", "b", "a"): (0, 0.0), ("g", "b", "b"): (0, 0.0)}
    assert seen.value == 3

def test_expected_counts_of_made_labels_share_one_exchange(spark):
    """Labels that are expressions: no filter on them reaches the rows, so all readers of the counts have one plan."""
    from emoscope.operators.metrics import expected_counts
    rows = spark.range(40).selectExpr("id % 2 AS k", "lower(concat('X', id % 3)) AS a", "lower(concat('X', id % 4)) AS b")
    out = expected_counts(rows, "a", "b", ["k"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(array(" not in plan and "size(array(lower" not in plan
    assert len(out.collect()) == 2 * 4 * 4



def test_a_run_is_scored_once(spark, tmp_path):
    from emoscope.sources.sinks import write_run
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(10).select("id", F.when(F.col("id") % 5 == 0, "ERROR: x").alias("error"))
    out = write_run(counted(rows, seen), str(tmp_path))
    assert seen.value == 10
    assert [tuple(r)[:3] for r in spark.read.json(f"{out}/metadata").select("total", "successful", "failed").collect()] == [(10, 8, 2)]
    assert spark.read.option("header", True).csv(f"{out}/results").count() == 8 and spark.read.json(f"{out}/failed_files").count() == 2


def test_repetitions_are_found_inside_a_row(spark):
    from emoscope.operators.quality import repetition_hits
    rows = [(1, "ab" * 12), (2, "abcd"), (3, "xy" * 3), (3, "xy" * 3), (None, "q" * 30), (4, None), (5, "ab" * 11), (6, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    out = repetition_hits(df, "id", "t", n=2, tolerance=5)
    assert {r.id for r in out.collect()} == {1, 3, None, 5} and out.count() == 4
    assert {r.id for r in repetition_hits(df, "id", "t", n=2, tolerance=11).collect()} == {1, None}
    assert "sort_array" in out._jdf.queryExecution().optimizedPlan().toString()  # the n-grams of a row stay in it


def test_result_tables_are_cut_from_rows_made_once(spark, monkeypatch):
    from emoscope.plans import q_io
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(80).select(F.format_string("m%d", F.col("id") % 4).alias("slm"), F.lit("f").alias("file_name"),
                                  F.lit("view").alias("pred_emo"))
    monkeypatch.setattr(q_io.V, "predictions", lambda s, sf: counted(rows, seen))
    out = q_io.q_src02(spark, "/root/testdata/sf0.001")
    assert seen.value == 80
    assert {(r.model, r.pred_emo): r.n for r in out.collect()} == {(m, "view"): 20 for m in q_io.MODEL_OF.values()}


def test_a_model_gets_rows_in_blocks(spark):
    from emoscope.operators import udf as U

    def make():
        return lambda pdf: pdf["id"] * 0 + len(pdf)
    got = U.score(spark.range(0, 1000, 1, 1), make, ["id"]).collect()
    assert [r.id for r in got] == list(range(1000)) and max(r.value for r in got) <= U.MODEL_ROWS


def test_frequent_words_of_all_documents(spark):
    from emoscope.llm.bpe import frequent_words
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.format_string("w%d", "id").alias("text"))
    docs = docs.unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit("often").alias("text")))
    words = frequent_words(docs, most=10_000)
    assert words[0] == "often" and {"w"} | {str(i) for i in range(1500)} <= set(words)


def test_a_slice_is_not_written_out_in_terms_of_its_steps(spark):
    """What Catalyst does with a join key: each step that it finds below repeats the ones below that."""
    from emoscope.operators.ordered import ordered_scan, slices_of
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    plan = slices_of(df, ["k"], [F.col("id")], 400)._jdf.queryExecution().analyzed()
    pruning = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.dynamicpruning, "PartitionPruning$"), "MODULE$")
    assert pruning.findExpressionAndTrackLineageDown(plan.output().last(), plan).isEmpty()
    assert all(r.n == r.id // 3 + 1 for r in ordered_scan(df, ["k"], ["id"], row_number="n", num_partitions=400).collect())


def test_references_of_repeated_and_missing_keys(spark):
    from hashlib import md5
    from itertools import groupby
    from emoscope.operators.joins import pick_reference

    def drawn(value, seed=11):
        return int(md5(":".join([value] * (value is not None) + [str(seed)]).encode()).hexdigest()[:15], 16)
    refs = [(i, f"s{i % 7}" if i % 11 else None, ("a", "b", None)[i % 3], None if i % 13 == 5 else float(i % 17 + 1)) for i in range(120)]
    refs += refs[:9]
    jobs = [(j, ("a", "b", "none", None)[j % 4]) for j in range(40)] + [(3, "a"), (4, "a"), (None, "a"), (None, "a")]
    r = spark.createDataFrame(refs, "ref_id long, speaker string, emotion string, duration double")
    out = pick_reference(spark.createDataFrame(jobs, "job_number long, emotion string"), r, 4, 11, 20.0)

    speakers, files, want = {}, {}, {}
    for ref_id, s, e, d in refs:
        speakers.setdefault(e, set()).add(s)
        files.setdefault((s, e), []).append((d is None, -(d or 0), ref_id))
    for job, e in jobs:
        if e and e in speakers:
            ranked = sorted((drawn(s), s or "") for s in speakers[e])
            s = ranked[drawn(None if job is None else str(job)) % len(ranked)][1] or None
            if s:  # a file without a speaker has no partner
                want.setdefault(job, []).extend((k, -d) for k, (none, d, _) in enumerate(sorted(files[s, e])[:4]) if not none)
    for job, rows in want.items():
        left, want[job] = 20.0, []
        for _, d in sorted(rows):
            if left > 0:
                want[job].append(min(d, left))
                left -= d
    got = {job: sorted(x.taken for x in rows) for job, rows in groupby(
        sorted(out.select("job_number", "taken").collect(), key=lambda x: (x.job_number is None, x.job_number or 0)), lambda x: x.job_number)}
    assert None in want and len(want) > 15 and got == {job: sorted(x) for job, x in want.items()}


def test_speakers_are_counted_before_they_are_ranked(spark):
    """Each reading of the ranks plans the ranking anew, and the scan of the picked files names them four times."""
    from emoscope.operators.joins import pick_reference
    jobs = spark.createDataFrame([(1, "a")], "job_number long, emotion string")
    refs = spark.range(9).selectExpr("id AS ref_id", "concat('s', id % 2) AS speaker", "'a' AS emotion", "1.0D AS duration")
    out = pick_reference(jobs, refs, 4, 11, 20.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 28
    assert out.count() == 4
