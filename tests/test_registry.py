"""Every registered query against its DuckDB oracle (sf0.01), and the driver entry."""

import math

import duckdb
import pytest

from tessera.plans.registry import load_all

from .conftest import SF_CHECK, SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
REG = load_all()


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        return tuple(sorted(v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_CHECK}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if q.sql))
def test_query_matches_oracle(spark, con, name):
    q = REG[name]
    df = q.run(spark, SF_CHECK)
    rel = con.sql(q.sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = df.collect(), rel.fetchall()
    assert len(got) == len(want)
    assert _rows(df.columns, got) == _rows(list(rel.columns), want)


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if not q.sql))
def test_rows_only_queries_run(spark, name):
    assert REG[name].run(spark, SF_CHECK).count() > 0


def test_entry_smoke(spark):
    import importlib.util
    import os

    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    assert set(mod.oracle_sql()) <= set(mod.queries())
    assert SF_SMALL in mod.SMOKE_DIR
