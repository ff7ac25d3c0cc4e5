"""The stored order of a growing table against the order of the whole table."""

import hashlib
import os
import re

import pytest

from tessera.operators.growing import GrowingOrder


def full_order(ids):
    return {i: k + 1 for k, i in enumerate(sorted(ids, key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i)))}


def frame(spark, ids):
    return spark.createDataFrame([(i, f"text {i}") for i in ids], "id long, text string")


@pytest.mark.parametrize("digits", [2, 4])
def test_appends_equal_the_full_order(spark, tmp_dir, digits):
    order, so_far, split = GrowingOrder(spark, os.path.join(tmp_dir, "o"), digits=digits, rows_per_group=200), [], {}
    for ids in (range(0, 300), range(1000, 1001), [], range(300, 500), [7_000, -3]):
        part = order.append(frame(spark, ids))
        so_far += ids
        want = full_order(so_far)
        assert {r.id: r.rank for r in order.ranks(part).collect()} == {i: want[i] for i in ids}
        assert {r.id: r.rank for r in order.ranks().collect()} == want
        changes = {r.id: r.split for r in order.split_changes(25, part).collect()}
        moved = {i: s for i, s in changes.items() if i not in set(ids)}
        assert all(split[i] == "validation" and s == "train" for i, s in moved.items())
        split.update(changes)
        whole = {i: "validation" if r <= 25 else "train" for i, r in want.items()}
        assert split == whole == {r.id: r.split for r in order.split(25).collect()}


def test_append_reads_only_touched_folders(spark, tmp_dir):
    order = GrowingOrder(spark, os.path.join(tmp_dir, "o"), rows_per_group=100)
    order.append(frame(spark, range(4000)))                      # 64 folders
    part = order.append(frame(spark, [99_999]))
    bucket = int(hashlib.md5(b"99999:42").hexdigest()[:4], 16)
    assert 0 < order._keys([0], [(bucket, bucket)]).count() < 200
    plan = order.ranks(part)
    assert re.search(r"PartitionFilters: \[[^\]]*_group#\d+ (IN|=|INSET)", plan._jdf.queryExecution().executedPlan().toString())
    assert plan.count() == 1


def test_killed_append_and_repeated_ids(spark, tmp_dir):
    order = GrowingOrder(spark, os.path.join(tmp_dir, "o"))
    with pytest.raises(ValueError):
        order.ranks()
    order.append(frame(spark, range(10)))
    killed = order.append(frame(spark, range(100, 110)))
    os.remove(os.path.join(tmp_dir, "o", f"part-{killed:06d}", "counts", "_SUCCESS"))
    assert order.parts() == [0] and order.ranks().count() == 10
    assert order.append(frame(spark, range(10, 15))) == 2
    assert {r.id: r.rank for r in order.ranks().collect()} == full_order(range(15))
    with pytest.raises(ValueError):
        order.cut(15)
    part = order.append(frame(spark, [3]))
    with pytest.raises(Exception, match="repeated id"):
        order.ranks(part).collect()
    with pytest.raises(Exception, match="null id"):
        order.append(spark.createDataFrame([(None,)], "id long"))
