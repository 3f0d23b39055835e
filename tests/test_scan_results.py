"""Result tables of many folders in one scan."""

import pytest

from emoscope.sources.readers import scan_results


def put(base, folder, name, text):
    (base / folder).mkdir(parents=True, exist_ok=True)
    (base / folder / name).write_text(text, encoding="utf-8")


def test_a_thousand_folders_in_one_scan(spark, tmp_path):
    for i in range(1000):
        columns = ["name", "answer", "score"][: 2 + i % 2]
        columns = columns[::-1] if i % 3 else columns  # in another order, some without a score
        rows = "".join(",".join({"name": f"f{i}_{k}", "answer": f'"yes, {k}"', "score": str(k)}[c] for c in columns) + "\n" for k in range(3))
        put(tmp_path, f"results_cosy_m{i % 7}_x{i}", "preds_v4.csv", ",".join(columns) + "\n" + rows)
    put(tmp_path, "results_cosy_m1_x1", "preds_v3.csv", "name,answer\nold,no\n")
    put(tmp_path, "samples_m1", "preds_v4.csv", "name,answer\nother,no\n")
    put(tmp_path, "results_cosy_dir/preds_v4.csv", "part-0.csv", "name,extra\nd1,e1\n")
    put(tmp_path, "results_cosy_dir/preds_v4.csv", "part-1.csv", "name,extra\nd2,\n")
    out = scan_results(spark, str(tmp_path), "v4")
    assert set(out.columns) == {"name", "answer", "score", "extra", "model", "source_file"}
    got = {(r.model, r.name): (r.answer, r.score, r.extra) for r in out.collect()}
    want = {(f"x{i}", f"f{i}_{k}"): (f"yes, {k}", str(k) if i % 2 else None, None) for i in range(1000) for k in range(3)}
    assert got == want | {("dir", "d1"): (None, None, "e1"), ("dir", "d2"): (None, None, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation [") == 2  # headers and rows, whatever the number of folders


def test_files_in_many_splits(spark, tmp_path):
    put(tmp_path, "results_a_b", "p_v1.csv", "name,n\n" + "".join(f"row{i},{i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = scan_results(spark, str(tmp_path), "v1")
        assert {(r.name, r.n) for r in got.collect()} == {(f"row{i}", str(i)) for i in range(20_000)} and got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nothing_to_read(spark, tmp_path):
    put(tmp_path, "results_a_b", "p_v1.csv", "name,n\nx,1\n")
    with pytest.raises(FileNotFoundError, match="v9"):
        scan_results(spark, str(tmp_path), "v9")
