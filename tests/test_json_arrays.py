"""JSON arrays cut into splits against the standard library and Spark's multiLine reader."""

import json
import os
import random

import pytest

from tessera.sources import json_arrays as J
from tessera.sources import readers as R

SCHEMA = "a string, b struct<c:array<struct<d:string>>,e:long>, `é` string"


def random_value(rng, depth=0):
    if depth < 3 and rng.random() < 0.5:
        return ({f"k{i}": random_value(rng, depth + 1) for i in range(rng.randrange(4))} if rng.random() < 0.5
                else [random_value(rng, depth + 1) for _ in range(rng.randrange(3))])
    return rng.choice([1, None, True, "", "}", "{\"", "\\", "\\\"}", "日本語{}", "x" * rng.randrange(90), "\n\t", "a]b[,"])


def random_records(rng, n):
    return [{"a": rng.choice(["}", "{", "\"", "\\", "é}\"{", "plain", "\\\\\"", "😀" * rng.randrange(30), ""]),
             **({"b": {"c": [{"d": "}" * rng.randrange(4)}] * rng.randrange(3), "e": rng.randrange(99)}} if rng.random() < 0.6 else {}),
             "é": "ü" * rng.randrange(40), "other": random_value(rng)} for _ in range(n)]


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


FORMS = [dict(), dict(indent=2), dict(ensure_ascii=False), dict(ensure_ascii=False, indent=1), dict(separators=(",", ":"))]


@pytest.mark.parametrize("few", [True, False])
def test_every_object_comes_out_whole(spark, tmp_dir, small_splits, few):
    rng = random.Random(few)
    want, paths = [], []
    for i, form in enumerate(FORMS):
        records = random_records(rng, 40 if i else 1)
        want += records
        paths.append(write(os.path.join(tmp_dir, f"f{i}.json"), ("﻿ \n" if i == 2 else "") + json.dumps(records, **form)
                           + ("\n \n" if i % 2 else "")))
    paths += [write(os.path.join(tmp_dir, "none.json"), " [ ]\n"), write(os.path.join(tmp_dir, "empty.json"), "")]
    texts = J.object_texts(spark, paths, few)
    got = [json.loads(r.text) for r in texts.collect()]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want))


def test_equal_to_multiline_in_more_than_one_task(spark, tmp_dir, small_splits):
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(SCHEMA)
    path = write(os.path.join(tmp_dir, "one.json"), json.dumps(random_records(random.Random(5), 300), ensure_ascii=False, indent=1))
    got = R.read_json_records(spark, path, schema)
    want = spark.read.schema(schema).option("multiLine", True).json(path)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert J._fragments(spark, [path]).rdd.getNumPartitions() > 8


@pytest.mark.parametrize("text", [
    '[{"a": "x"}', '[{"a": "x"} {"a": "y"}]', '[{"a": "x"}, "text"]', '["text"]', '{"a": "x"}', '[{"a": "x"}]]', '[{"a": "x"',
    '[{"a": "x}]', '[{"a": "x"}] trailing', '[{"a": "x"},]', ',{"a": "x"}]', '[{"a": "x"}}]', '[{"a": x}]'])
def test_malformed_arrays_fail(spark, tmp_dir, text):
    from pyspark.sql.types import StructType
    path = write(os.path.join(tmp_dir, "bad.json"), text)
    with pytest.raises(Exception):
        J.read_json_arrays(spark, [path], StructType.fromDDL("a string"), [len(text)]).collect()


def test_bound_of_splits(spark, tmp_dir, small_splits):
    path = write(os.path.join(tmp_dir, "f.json"), json.dumps([{"a": "x" * 50}] * 200))
    n = J._fragments(spark, [path]).select("file", "start").distinct().count()
    assert 8 < n <= J.split_bound(spark, [os.path.getsize(path)])


def test_lists_globs_and_own_ids(spark, tmp_dir):
    recs = [{"id": f"r{i}", "instruction": "a", "input": "", "output": "x"} for i in range(6)]
    write(os.path.join(tmp_dir, "p0.json"), json.dumps(recs[:2]))
    write(os.path.join(tmp_dir, "p1.json"), json.dumps(recs[2:4], indent=3))
    write(os.path.join(tmp_dir, "_skip"), "nothing")
    write(os.path.join(tmp_dir, "p2.jsonl"), "\n".join(map(json.dumps, recs[4:])))
    glob = os.path.join(tmp_dir, "p*.json")
    assert [r.asDict() for r in R.read_instructions(spark, glob).orderBy("id").collect()] == recs[:4]
    both = R.read_instructions(spark, [os.path.join(tmp_dir, "p1.json"), glob])
    assert both.columns == ["id", "instruction", "input", "output"] and both.count() == 4
    lines = R.read_instructions(spark, [os.path.join(tmp_dir, "p2.jsonl")])
    assert sorted(r.id for r in lines.collect()) == ["r4", "r5"]
    with pytest.raises(ValueError):
        R.read_instructions(spark, [glob, os.path.join(tmp_dir, "p2.jsonl")]).collect()
    with pytest.raises(FileNotFoundError):
        R.read_instructions(spark, os.path.join(tmp_dir, "q*.json"))
    numbers = write(os.path.join(tmp_dir, "n.json"), json.dumps([{"id": 17, "instruction": "i", "input": "", "output": "o"}]))
    assert R.read_instructions(spark, numbers).first().id == "17"
    # a first record longer than what is read at once
    long = write(os.path.join(tmp_dir, "long.json"), json.dumps([{"instruction": "日" * 90_000, "id": "z"}]))
    assert R.first_record_keys(spark, long) == ["instruction", "id"]
