"""Scoring calls under a token budget, and jobs that go on after being killed."""

import collections
import glob
import hashlib
import os

import pandas as pd
import pytest

from tessera.operators import calls as K
from tessera.operators.batches import batch_of, round_up
from tessera.operators.scoring import Scorer
from tests.stand_in import CountingScorer


def greedy(rows, budget):
    """call -> ids, by one walk over all rows."""
    wide = lambda n: -(-max(n or 0, 1) // 8) * 8
    order = sorted(rows, key=lambda r: (-wide(r[1]), hashlib.md5(f"{r[0]}:42".encode()).hexdigest(), r[0]))
    out, width = [], 0
    for i, n in order:
        if not out or width * (len(out[-1]) + 1) > budget:
            out.append([])
            width = wide(n)
        out[-1].append(i)
    return {i: k for k, ids in enumerate(out) for i in ids}


@pytest.mark.parametrize("budget", [8, 64, 500, 4096])
def test_calls_equal_one_greedy_walk(spark, budget):
    rows = [(i, (i * i * 7919) % 300 + (5000 if i == 77 else 0)) for i in range(400)] + [(1000, None), (1001, 0)]
    df = spark.createDataFrame(rows, "id long, n int").repartition(5)
    got = K.token_budget_calls(df, "id", df["n"], budget).collect()
    assert {r.id: r.call for r in got} == greedy(rows, budget)
    sizes = collections.Counter(r.call for r in got)
    assert all(r.call_width >= (r.n or 0) and (sizes[r.call] == 1 or sizes[r.call] * r.call_width <= budget) for r in got)
    assert K.token_budget_calls(df.limit(0), "id", df["n"], budget).count() == 0


def test_less_padding_than_consecutive_batches(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(2000).selectExpr("id", "int(id * id * 31 % 977) + 1 as n")
    padded = K.token_budget_calls(df, "id", F.col("n"), 16 * 1024).agg(F.sum("call_width")).first()[0]
    fixed = df.withColumn("b", batch_of(F.col("id") + 1, 16)).withColumn(
        "w", round_up(F.max("n").over(Window.partitionBy("b")), 8)).agg(F.sum("w")).first()[0]
    assert df.agg(F.sum("n")).first()[0] <= padded < 0.6 * fixed


class RowsPerCall(Scorer):
    schema = "size int, widest int"
    inputs = ("n",)

    def score(self, model, pdf):
        return pd.DataFrame({"size": [len(pdf)] * len(pdf), "widest": [int(pdf["n"].max())] * len(pdf)})


def test_one_model_call_per_call(spark):
    df = spark.createDataFrame([(i, (i * 37) % 90 + 1, f"e{i}") for i in range(300)], "id long, n int, `expected text` string")
    planned = K.token_budget_calls(df, "id", df["n"], 400)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = K.score_calls(planned, RowsPerCall(), passthrough=["expected text"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = collections.defaultdict(list)
    for r in planned.collect():
        want[r.call].append(r.n)
    assert len(got) == 300
    assert all((r["size"], r.widest) == (len(want[r.call]), max(want[r.call])) and r["expected text"] == f"e{r.id}" for r in got)


def test_killed_job_goes_on(spark, tmp_dir):
    out, log = os.path.join(tmp_dir, "scores"), os.path.join(tmp_dir, "log")
    os.makedirs(log)
    df = spark.createDataFrame([(i, f"p{i}") for i in range(160)], "id long, prompts string")
    with pytest.raises(Exception):
        K.score_resumable(df, CountingScorer(log=log, dies_at=133), out, tasks=40)
    done = {r.id for r in spark.read.parquet(f"{out}/attempt-0000").collect()}
    assert 0 < len(done) < 160
    got = K.score_resumable(df, CountingScorer(log=log, dies_at=-1), out, tasks=40)
    assert sorted((r.id, r.generated) for r in got.collect()) == [(i, f"P{i}") for i in range(160)]
    calls = collections.Counter(int(os.path.basename(f).split("-")[0]) for f in glob.glob(f"{log}/*"))
    assert set(calls) == set(range(160)) and all(calls[i] == 1 for i in done)
    before = sum(calls.values())
    again = K.score_resumable(df, CountingScorer(log=log, dies_at=-1), out, tasks=4)
    assert again.count() == 160 and len(glob.glob(f"{log}/*")) == before
    with pytest.raises(Exception, match="null id"):
        K.score_resumable(spark.createDataFrame([(None, "p")], "id long, prompts string"), CountingScorer(log=log, dies_at=-1), out)
