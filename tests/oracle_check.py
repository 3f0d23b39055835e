"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
Compares row counts, sorted column names and order-insensitive values
(floats to 6 digits), like the driver's correctness gate.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from emoscope.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<nan>"
        return f"{round(v, 6):.6f}"
    if isinstance(v, bool):
        return str(v).lower()
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, int):
        return str(v)
    return str(v)


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns differ: {sorted(spark_cols)} vs {sorted(duck_cols)}"
    if len(spark_rows) != len(duck_rows):
        return f"rows differ: {len(spark_rows)} vs {len(duck_rows)}"
    order_s = sorted(range(len(spark_cols)), key=lambda i: spark_cols[i])
    order_d = sorted(range(len(duck_cols)), key=lambda i: duck_cols[i])
    a = sorted(tuple(_norm(r[i]) for i in order_s) for r in spark_rows)
    b = sorted(tuple(_norm(r[i]) for i in order_d) for r in duck_rows)
    if a != b:
        for x, y in zip(a, b):
            if x != y:
                return f"values differ, e.g. {x} vs {y}"
    return None


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as entry
    from emoscope.session import get_spark
    spark = get_spark(shuffle_partitions=8)
    con = duck(sf_dir)
    qs = entry.queries()
    sq = entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sq:
            print(f"rows-only  {name}: {len(rows)} rows ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(sq[name])
            drows = cur.fetchall()
            dcols = [d[0] for d in cur.description]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-DUCK  {name}: {str(e)[:400]}")
            bad += 1
            continue
        msg = compare(rows, cols, drows, dcols)
        if msg:
            bad += 1
            print(f"MISMATCH   {name}: {msg}")
        else:
            print(f"ok         {name}: {len(rows)} rows ({ts:.1f}s)")
    print(f"done, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
