"""S1, S3-S5 and K1, K2 with hand-made files."""

import csv
import glob
import io
import json
import os

import pandas as pd
import pytest

from tessera.sources import readers as R
from tessera.sources import sinks as K

RECORDS = [{"instruction": "a", "input": "", "output": "x"},
           {"instruction": "日本", "input": "b", "output": None}]


def _write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


@pytest.mark.parametrize("suffix", [".json", ".jsonl"])
@pytest.mark.parametrize("kind", ["array", "pretty", "lines"])
def test_json_forms(spark, tmp_dir, suffix, kind):
    path = os.path.join(tmp_dir, "data" + suffix)
    if kind == "array":
        _write(path, json.dumps(RECORDS, ensure_ascii=False))
    elif kind == "pretty":
        _write(path, "\n  " + json.dumps(RECORDS, ensure_ascii=False, indent=2))
    else:
        _write(path, "\n".join(json.dumps(r, ensure_ascii=False) for r in RECORDS) + "\n")
    rows = [r.asDict() for r in R.read_instructions(spark, path).collect()]
    assert rows == RECORDS


def test_dataset_name_reads_parquet(spark, tmp_dir):
    path = os.path.join(tmp_dir, "ds")
    spark.createDataFrame(pd.DataFrame(RECORDS)).write.parquet(path)
    assert R.read_instructions(spark, path).count() == 2


def test_nested_qa_flatten_and_keys(spark, tmp_dir):
    docs = [{"image_id": 1, "qas": [{"question": "q1", "answer": "a1", "qa_id": 9},
                                    {"question": "q2", "qa_id": 10}]},
            {"image_id": 2, "qas": [{"question": "q3", "answer": "a3"}]}]
    path = os.path.join(tmp_dir, "question_answers.json")
    _write(path, json.dumps(docs, ensure_ascii=False, indent=1))
    flat = R.read_nested_qa(spark, path)
    assert flat.columns == ["question", "answer"]
    assert [tuple(r) for r in flat.collect()] == [("q1", "a1"), ("q2", None), ("q3", "a3")]
    # S5 + K1: stored once as JSON lines (null field left out), reused afterwards
    out = os.path.join(tmp_dir, "vqa_jsonl")
    first = R.materialize_once(flat, out)
    lines = [json.loads(line) for f in sorted(glob.glob(out + "/part-*")) for line in open(f, encoding="utf-8")]
    assert {"question": "q2"} in lines
    assert sorted(map(tuple, first.collect()), key=str) == sorted(map(tuple, flat.collect()), key=str)
    again = R.materialize_once(flat.limit(0), out, schema=flat.schema)
    assert again.count() == 3


def test_jsonl_sink_unescaped(spark, tmp_dir):
    out = os.path.join(tmp_dir, "k1")
    K.write_jsonl(spark.createDataFrame([("日本語 \"q\"",)], "t string"), out)
    text = "".join(open(f, encoding="utf-8").read() for f in glob.glob(out + "/part-*"))
    assert "日本語" in text


def test_csv_sink_matches_pandas(spark, tmp_dir):
    rows = [("含意", "a, b"), ('say "hi"', "line1\nline2"), ("", "x"), ("plain", "")]
    df = spark.createDataFrame(rows, "ground string, generated string").coalesce(1)
    out = os.path.join(tmp_dir, "k2")
    K.write_csv(df, out)
    got = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(out + "/part-*")))
    buf = io.StringIO()
    pd.DataFrame(rows, columns=["ground", "generated"]).to_csv(buf, index=False)
    assert got == buf.getvalue()
    assert list(csv.reader(io.StringIO(got)))[2] == ['say "hi"', "line1\nline2"]


def test_result_name():
    import datetime
    when = datetime.datetime(2024, 1, 2, 3, 4)
    assert K.result_name("jnli", "org/model-7b/", True, when) == "jnli_20240102_0304_model-7b_lora"


def test_mixed_directory_is_an_error(spark, tmp_dir):
    d = os.path.join(tmp_dir, "mixed")
    os.makedirs(d)
    _write(os.path.join(d, "a.json"), json.dumps(RECORDS))
    _write(os.path.join(d, "b.json"), "\n".join(json.dumps(r) for r in RECORDS))
    with pytest.raises(Exception):
        R.read_json_records(spark, d).collect()
    d2 = os.path.join(tmp_dir, "mixed2")
    os.makedirs(d2)
    _write(os.path.join(d2, "a.json"), "\n".join(json.dumps(r) for r in RECORDS))
    _write(os.path.join(d2, "b.json"), json.dumps(RECORDS, indent=2))
    with pytest.raises(Exception):
        R.read_json_records(spark, d2).collect()


def test_many_blanks_and_empty_files_before_an_array(spark, tmp_dir):
    import os

    from tessera.sources.readers import read_json_records
    folder = os.path.join(tmp_dir, "d.json")
    os.makedirs(folder)
    open(os.path.join(folder, "a.json"), "w").close()
    with open(os.path.join(folder, "b.json"), "w") as fh:
        fh.write(" " * 70_000 + '[{"instruction": "q",\n "input": "", "output": "a"}]')
    assert read_json_records(spark, folder).filter("instruction = 'q'").count() == 1


def test_failed_first_write_is_not_a_result(spark, tmp_dir):
    import os

    from tessera.sources.readers import materialize_once
    path = os.path.join(tmp_dir, "once")
    os.makedirs(path)
    df = spark.createDataFrame([("q", "a")], "question string, answer string")
    assert materialize_once(df, path).count() == 1
    assert materialize_once(df.limit(0), path).count() == 1


def test_record_ids_of_equal_part_names_differ(spark, tmp_dir):
    from tessera.plans.training import with_record_id

    df = spark.createDataFrame([("i", "", "o")], "instruction string, input string, output string").coalesce(1)
    base = os.path.join(tmp_dir, "a b")
    for part in ("x", "y"):
        df.write.parquet(os.path.join(base, part))
        for f in glob.glob(os.path.join(base, part, "part-*")):
            os.rename(f, os.path.join(base, part, "part-0.parquet"))
    both = with_record_id(spark.read.parquet(os.path.join(base, "x"), os.path.join(base, "y")))
    assert sorted(r.id.rsplit(":", 1)[0] for r in both.collect()) == ["x/part-0.parquet:0", "y/part-0.parquet:0"]
    one = with_record_id(spark.read.parquet(os.path.join(base, "x")))
    assert one.first().id.startswith("part-0.parquet:0:")


def test_cluster_needs_a_shared_folder(monkeypatch):
    from tessera import session

    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"getConf": staticmethod(lambda: Conf()), "master": "yarn"})

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def _logged(spark, log, n=40):
    """A table that leaves a file in ``log`` for every task that builds a part of it."""
    def run(batches):
        import time
        import uuid
        for b in batches:
            open(os.path.join(log, uuid.uuid4().hex), "w").close()
            time.sleep(0.3)
            yield b
    return spark.range(n).coalesce(1).selectExpr("string(id) as question").mapInPandas(run, "question string")


def test_concurrent_builders_write_once(spark, tmp_dir):
    from concurrent.futures import ThreadPoolExecutor

    log, out = os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "out")
    os.makedirs(log)
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: R.materialize_once(_logged(spark, log), out, poll=0.05).count(), range(4)))
    assert got == [40] * 4 and len(os.listdir(log)) == 1
    assert sorted(os.listdir(tmp_dir)) == ["log", "out"]


def test_changed_input_is_built_again(spark, tmp_dir):
    src, out = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "out")
    for n in (3, 3, 5):
        if not os.path.exists(src) or spark.read.parquet(src).count() != n:
            spark.range(n).selectExpr("string(id) as question").write.mode("overwrite").parquet(src)
        df = spark.read.parquet(src)
        stamp = os.path.getmtime(out) if os.path.exists(out) else None
        assert R.materialize_once(df, out, key=R.input_key(df)).count() == n
        assert (os.path.getmtime(out) == stamp) == (n == 3 and stamp is not None)
    assert R.materialize_once(df, out, key=R.input_key(df, "other steps")).count() == 5
    assert R.materialize_once(df.limit(0), out, schema=df.schema).count() == 5      # without a key any result will do


def test_claim_of_a_dead_builder_is_taken_over(spark, tmp_dir):
    out = os.path.join(tmp_dir, "out")
    os.makedirs(out)                                       # a write that never finished
    open(out + ".claim", "w").close()
    os.utime(out + ".claim", (1, 1))
    df = spark.range(4).selectExpr("string(id) as question")
    assert R.materialize_once(df, out, lease=5, poll=0.01).count() == 4
    failing = df.selectExpr("raise_error('no') as question")
    with pytest.raises(Exception):
        R.materialize_once(failing, out + "2").collect()
    assert not [f for f in os.listdir(tmp_dir) if f.startswith("out2")]
