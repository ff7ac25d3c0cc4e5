"""End-to-end jobs, and plan shape checks (where the shuffles are)."""

import glob
import os

from pyspark.sql import functions as F

from tessera.functions.templates import get_template
from tessera.functions.tokens import CP_PAD, CodePoints
from tessera.plans import evaluation as EV
from tessera.plans import training as TR
from tessera.plans.registry import load_all
from tessera.sources import tables

from .conftest import SF_CHECK
from .stand_in import WORDS, RuleReplyScorer

REG = load_all()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_job_equals_query(spark, tmp_dir):
    recs = tables.inst(spark, SF_CHECK)
    df = TR.training_batches(recs, get_template("alpaca"), CodePoints(), 256, 16, 2,
                             val_set_size=20)
    out = os.path.join(tmp_dir, "batches")
    TR.write_batches(df, out)
    back = spark.read.parquet(out)
    assert back.filter("split = 'validation'").count() == 20
    q = REG["train_batches"].run(spark, SF_CHECK)
    from tessera.functions.tokens import ids_text
    mine = back.select("id", "split", "position", "batch", "width",
                       ids_text(F.col("input_ids")).alias("input_ids"),
                       ids_text(F.col("attention_mask")).alias("attention_mask"),
                       ids_text(F.col("labels")).alias("labels"))
    assert sorted(map(tuple, mine.select(*q.columns).collect())) == sorted(map(tuple, q.collect()))


def test_training_plan_moves_text_once(spark):
    q = REG["train_batches"].run(spark, SF_CHECK)
    plan = _plan(q)
    # the data moves once (main and correction branch share it at run time); the other
    # bucket exchanges carry only bucket counts
    assert plan.count("REPARTITION_BY_COL") == 2
    assert "substring(" in plan.split("REPARTITION_BY_COL")[1]     # cut before it moves
    assert "rangepartitioning" not in plan               # no sampling pass over the input
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    # the width window reuses the bucket partitioning: no exchange on (split, _bucket, batch)
    assert "hashpartitioning(split#" not in plan.split("BroadcastExchange")[0]


def test_few_shot_plan_limits_before_shuffle(spark):
    plan = _plan(REG["nli_prompts_few_shot"].run(spark, SF_CHECK))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_nli_job_matches_query(spark, tmp_dir):
    pairs = tables.nli(spark, SF_CHECK)
    report, results = EV.nli_accuracy_job(pairs, RuleReplyScorer(), max_length=100_000,
                                          save_dir=tmp_dir, model_path="org/m1", lora=True)
    ev = REG["nli_prompts"].run(spark, SF_CHECK).collect()
    hits = sum(WORDS[len(r.prompts) % 3] == r.expected for r in ev)
    task, n, value = report.first()
    assert (task, n) == ("jnli", len(ev)) and abs(value - hits / len(ev)) < 1e-4
    assert results.count() == n
    files = glob.glob(os.path.join(tmp_dir, "jnli_*_m1_lora.csv", "part-*"))
    assert files and open(files[0], encoding="utf-8").readline().strip() == "ground,generated"


def test_perplexity_job_matches_query(spark):
    qa = tables.inst(spark, SF_CHECK).select("id", F.col("instruction").alias("question"),
                                             F.col("output").alias("answer"))
    got = EV.perplexity_job(qa, max_length=4096).first()
    assert tuple(got) == tuple(REG["vqa_perplexity"].run(spark, SF_CHECK).first())


def test_identical_records_spread_and_split_exactly(spark, tmp_dir):
    import json
    path = os.path.join(tmp_dir, "dups.jsonl")
    with open(path, "w", encoding="utf-8") as fh:
        for i in range(600):
            rec = {"instruction": "same", "input": "", "output": "same"} if i % 3 else \
                {"instruction": f"q{i}", "input": "", "output": f"a{i}"}
            fh.write(json.dumps(rec) + "\n")
    pq = os.path.join(tmp_dir, "dups_pq")
    spark.read.json(path).write.parquet(pq)
    from tessera.sources.readers import read_instructions
    for src in (path, pq):
        recs = read_instructions(spark, src)
        df = TR.training_batches(recs, get_template("alpaca"), CodePoints(), 64, 8, 1,
                                 val_set_size=50)
        rows = df.select("id", "split", "position").collect()
        assert len({r.id for r in rows}) == 600
        assert sorted(r.position for r in rows if r.split == "validation") == list(range(1, 51))
        assert sorted(r.position for r in rows if r.split == "train") == list(range(1, 551))
        keyed = TR.with_record_id(read_instructions(spark, src))
        from tessera.operators.order import exact_rank
        per_bucket = exact_rank(keyed, "id", digits=1).ranked.groupBy("_bucket").count().collect()
        assert max(r["count"] for r in per_bucket) < 600 / 16 * 2


def test_copies_beyond_one_run_and_split(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(TR, "COPIES", 4)
    path = os.path.join(tmp_dir, "copies.jsonl")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write('{"instruction": "a", "output": "b", "split": "train"}\n' * 10)
        fh.write('{"instruction": "c", "input": "", "output": "d", "split": "test"}\n' * 3)
    src = spark.read.schema("instruction string, input string, output string, split string").json(path)
    rows = TR.with_record_id(src).collect()
    assert len(rows) == len({r.id for r in rows}) == 13
    assert sum(r.instruction == "a" and r.input is None for r in rows) == 10
    df = TR.training_batches(src, get_template("alpaca"), CodePoints(), 64, 8, 1, val_set_size=4,
                             split="train")
    assert df.count() == 10


def test_training_job_group_by_length(spark):
    import hashlib
    import math

    from .test_order_batches import py_length_grouped

    recs = tables.inst(spark, SF_CHECK)
    df = TR.training_batches(recs, get_template("alpaca"), CodePoints(), 256, 16, 2,
                             val_set_size=20, group_by_length=True)
    rows = df.collect()
    base = {r.id: r for r in REG["train_batches"].run(spark, SF_CHECK).collect()}
    val = [r for r in rows if r.split == "validation"]
    assert len(val) == 20 and all(r.position == base[r.id].position for r in val)
    train = [r for r in rows if r.split == "train"]
    ids = [r.id for r in recs.select("id").collect()]
    keyed = sorted(ids, key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i))[20:]
    lens = {r.id: len(r.input_ids) - r.input_ids.count(CP_PAD) for r in train}
    order = py_length_grouped([lens[i] for i in keyed], 8)
    want_pos = {keyed[k]: p for p, k in enumerate(order, start=1)}
    assert {r.id: r.position for r in train} == want_pos
    by_batch = {}
    for r in train:
        by_batch.setdefault(r.batch, []).append(r)
    for b, rs in by_batch.items():
        w = math.ceil(max(lens[r.id] for r in rs) / 8) * 8
        assert all(r.width == w and len(r.input_ids) == w for r in rs)


def test_group_by_length_moves_no_token_array(spark):
    """Only text (before encoding) and narrow rows are exchanged."""
    import re

    recs = spark.createDataFrame([(i, "a" * (i * 7 % 90), "", "b") for i in range(500)],
                                 "id long, instruction string, input string, output string")
    df = TR.training_batches(recs, get_template("alpaca"), CodePoints(), 64, 8, val_set_size=20, group_by_length=True)
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)
    assert inputs and not [i for i in inputs if "input_ids" in i or "labels" in i or "attention_mask" in i]
