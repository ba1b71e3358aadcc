"""Run registered queries on Spark and their DuckDB oracles; report matches.

usage: python scripts/compare.py [sf_dir] [name ...]
"""
from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

import duckdb  # noqa: E402

from hexlens.catalog import load_all  # noqa: E402
from hexlens.session import build_session  # noqa: E402
from hexlens.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = build_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    reg = load_all()
    ok = bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = q.fn(spark, sf_dir)
            srows = df.collect()
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        t1 = time.time()
        try:
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        td = time.time() - t1
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns spark={scols} duckdb={dcols}")
            bad += 1
            continue
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        if a == b:
            ok += 1
            print(f"OK   {name}: {len(a)} rows spark {ts:.1f}s duckdb {td:.1f}s")
        else:
            bad += 1
            diff_a = [r for r in a if r not in set(b)][:3]
            diff_b = [r for r in b if r not in set(a)][:3]
            print(f"FAIL {name}: rows spark={len(a)} duckdb={len(b)} cols={sorted(scols)}\n  spark-only {diff_a}\n  duckdb-only {diff_b}")
    print(f"matched {ok}, failed {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
