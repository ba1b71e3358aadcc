"""Every registered query vs its DuckDB oracle on the smallest driver tables."""
import math

import duckdb
import pytest

import __spark_entry__ as entry_mod
from hexlens.catalog import load_all
from hexlens.sources.tables import TABLES

from conftest import SF_SMALL

REG = load_all()
WITH_SQL = [n for n, q in REG.items() if q.sql]
# ML fits: invariants only (no oracle); keep the default test run fast
SLOW = {"train_evaluate", "feature_importance_top"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_oracle(spark, con, name):
    q = REG[name]
    df = q.fn(spark, SF_SMALL)
    res = con.execute(q.sql.replace("/root/testdata/sf0.01", SF_SMALL))
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, df.collect()) == _rows(dcols, res.fetchall())


@pytest.mark.parametrize("name", [n for n, q in REG.items() if not q.sql and n not in SLOW])
def test_query_without_oracle_runs(spark, name):
    assert REG[name].fn(spark, SF_SMALL).count() > 0


def test_entry_contract(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
