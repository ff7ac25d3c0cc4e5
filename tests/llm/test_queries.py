"""Registered queries against their SQL, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from tessera.llm.queries import ORACLES, QUERIES

from ..conftest import SF_CHECK, SF_SMALL
from ..test_registry import _rows


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_CHECK}/{t}.parquet')")
    df = QUERIES[name](spark, SF_CHECK)
    rel = con.sql(ORACLES[name])
    assert _rows(df.columns, df.collect()) == _rows(list(rel.columns), rel.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert 0 < docs.count() <= n
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
    assert corpus_pipeline.run(spark, SF_SMALL).count() > 0
