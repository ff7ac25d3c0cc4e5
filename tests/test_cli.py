"""The command lines of the jobs, run in-process on the test session."""

import glob
import json
import os

import pytest

from pyspark.sql import functions as F

from tessera.plans import chat as CH
from tessera.plans import evaluation as EV
from tessera.plans import training as TR
from tessera.sources import tables

from .conftest import SF_CHECK


def test_evaluation_cli(spark, tmp_dir, capsys):
    qa = os.path.join(tmp_dir, "qa")
    tables.inst(spark, SF_CHECK).select(F.col("instruction").alias("question"),
                                        F.col("output").alias("answer")).write.parquet(qa)
    pairs = os.path.join(tmp_dir, "pairs")
    tables.nli(spark, SF_CHECK).write.parquet(pairs)
    EV.main(["--task", "ppl-vqa", "--data", qa, "--max-length", "4096"])
    EV.main(["--task", "jnli", "--data", pairs, "--scorer",
             "tests.stand_in:RuleReplyScorer", "--max-length", "100000",
             "--save-dir", os.path.join(tmp_dir, "res"), "--model-path", "org/m"])
    out = capsys.readouterr().out
    assert "ppl-vqa: n=233" in out and "jnli: n=1745" in out
    assert glob.glob(os.path.join(tmp_dir, "res", "jnli_*_m.csv", "part-*"))
    with pytest.raises(SystemExit):      # a flag would not reach the report
        EV.main(["--task", "jnli", "--data", pairs, "--scorer", "x:y", "--guard", "flag"])


def test_chat_and_training_cli(spark, tmp_dir, capsys):
    out = os.path.join(tmp_dir, "prompts")
    CH.main(["--conversations", os.path.join(SF_CHECK, "conversations.parquet"), "--out", out,
             "--no-context"])
    rows = [json.loads(line) for f in glob.glob(out + "/part-*") for line in open(f, encoding="utf-8")]
    assert len(rows) == 279 and all(r["prompt"].endswith("返答:") for r in rows)
    data = os.path.join(tmp_dir, "records.jsonl")
    with open(data, "w", encoding="utf-8") as fh:
        for i in range(40):
            fh.write(json.dumps({"instruction": f"q{i}", "input": "", "output": f"a{i}"}) + "\n")
    batches = os.path.join(tmp_dir, "batches")
    TR.main(["--data", data, "--out", batches, "--micro-batch-size", "8", "--val-set-size", "10"])
    assert "validation: 10 rows" in capsys.readouterr().out
