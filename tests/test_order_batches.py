"""W3-W6 and B1-B4 against brute-force pandas models, for several bucket widths
(1 hex digit: large buckets, most batches inside one bucket; 4: tiny buckets,
most batches cut by a bucket boundary)."""

import hashlib
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import batches as B
from tessera.operators import order as O


def md5_rank(ids, seed=42):
    keyed = sorted(ids, key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i))
    return {i: r + 1 for r, i in enumerate(keyed)}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i * 7 + 3, "x" * ((i * 37) % 50 + 1)) for i in range(500)]
    return rows, spark.createDataFrame(rows, "id long, text string")


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_exact_rank(table, digits):
    rows, df = table
    got = {r.id: r.rank for r in O.exact_rank(df, "id", 42, digits).ranked.collect()}
    assert got == md5_rank([r[0] for r in rows])


@pytest.mark.parametrize("n_val", [0, 1, 37, 499])
def test_exact_split(table, n_val):
    rows, df = table
    want = md5_rank([r[0] for r in rows])
    got = O.exact_split(df, "id", n_val, 42, digits=2).ranked.collect()
    assert len(got) == len(rows)
    for r in got:
        g = want[r.id]
        assert r.split == ("validation" if g <= n_val else "train")
        assert r.position == (g if g <= n_val else g - n_val)
    assert sum(r.split == "validation" for r in got) == n_val


def test_exact_split_too_large(table):
    _, df = table
    with pytest.raises(Exception, match="more than 500 rows"):
        O.exact_split(df, "id", 500, 42).ranked.collect()


def test_reshuffle_positions_complete(table):
    rows, df = table
    got = O.exact_split(df, "id", 50, 42, digits=2, shuffle_seed=9).ranked.collect()
    for split, n in (("validation", 50), ("train", 450)):
        assert sorted(r.position for r in got if r.split == split) == list(range(1, n + 1))


@pytest.mark.parametrize("digits", [1, 2, 4])
@pytest.mark.parametrize("size", [1, 3, 8])
def test_pad_batches_brute_force(table, digits, size):
    rows, df = table
    tok = df.select("id", F.transform(F.split("text", ""), lambda c: F.ascii(c)).alias("input_ids"))
    tok = tok.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))) \
             .withColumn("labels", F.col("input_ids"))
    order = O.exact_split(tok, "id", 37, 42, digits=digits)
    got = B.pad_batches(order, size, pad_id=-1).collect()
    pdf = pd.DataFrame([(r.id, r.split, r.position, len(r.input_ids) - r.input_ids.count(-1)) for r in got],
                       columns=["id", "split", "position", "n"])
    pdf["batch"] = (pdf.position - 1) // size
    width = pdf.groupby(["split", "batch"]).n.transform("max").map(lambda m: math.ceil(m / 8) * 8)
    by_id = dict(zip(pdf.id, width))
    lens = {r[0]: len(r[1]) for r in rows}
    for r in got:
        assert r.width == by_id[r.id] and len(r.input_ids) == r.width
        assert r.input_ids[: r.width - lens[r.id]] == [-1] * (r.width - lens[r.id])
        assert r.attention_mask == [0] * (r.width - lens[r.id]) + [1] * lens[r.id]
        assert r.labels[: r.width - lens[r.id]] == [-100] * (r.width - lens[r.id])
        assert r.batch == (r.position - 1) // size


def test_device_batch_size():
    assert B.device_batch_size(16, 2) == 8
    assert B.device_batch_size(7, 2) == 3
    with pytest.raises(ValueError):
        B.device_batch_size(1, 2)


def py_length_grouped(lengths_in_order, size):
    n = len(lengths_in_order)
    mult = min(n // (size * 4), 50) or 1
    ms = mult * size
    idx = list(range(n))
    megas = [sorted(idx[i:i + ms], key=lambda k: -lengths_in_order[k]) for i in range(0, n, ms)]
    maxima = [lengths_in_order[m[0]] for m in megas]
    top = maxima.index(max(maxima))
    megas[0][0], megas[top][0] = megas[top][0], megas[0][0]
    return [k for m in megas for k in m]


@pytest.mark.parametrize("size", [2, 8])
def test_length_grouped_matches_python(table, size):
    rows, df = table
    rank = md5_rank([r[0] for r in rows])
    by_rank = sorted(rows, key=lambda r: rank[r[0]])
    want = py_length_grouped([len(r[1]) for r in by_rank], size)
    order = O.exact_rank(df, "id", 42, 2)
    got = {r.id: r.grouped_rank for r in
           B.length_grouped_order(order, size, F.length("text")).collect()}
    for new_pos, k in enumerate(want, start=1):
        assert got[by_rank[k][0]] == new_pos


def test_footprint(table):
    rows, df = table
    rep = {r.batch_size: r for r in B.footprint(df, "id", F.length("text"), [1, 4]).collect()}
    assert rep[1].rows == 500 and rep[1].padded_tokens == sum(math.ceil(len(t) / 8) * 8 for _, t in rows)
    assert rep[4].batches == 125 and rep[4].real_tokens == sum(len(t) for _, t in rows)


def test_no_single_partition_over_data(spark, table):
    """The only one-partition exchange in a rank plan is over the bucket counts."""
    _, df = table
    ranked = O.exact_rank(df, "id", 42).ranked
    text = ranked._jdf.queryExecution().executedPlan().toString()
    singles = text.count("SinglePartition")
    assert singles == 1
    assert "rangepartitioning" not in text


def test_null_id_fails(spark):
    df = spark.createDataFrame([(1,), (None,)], "id long")
    with pytest.raises(Exception, match="null id"):
        O.exact_rank(df, "id").ranked.collect()


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=20, deadline=None)
@given(st.sets(st.integers(min_value=-10**12, max_value=10**12), min_size=1, max_size=60),
       st.data(), st.sampled_from([1, 2, 4]))
def test_exact_split_property(spark, ids, data, digits):
    ids = sorted(ids)
    n_val = data.draw(st.integers(min_value=0, max_value=len(ids) - 1))
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = O.exact_split(df, "id", n_val, 42, digits=digits).ranked.collect()
    want = md5_rank(ids)
    assert len(got) == len(ids)
    val = sorted((r.position, r.id) for r in got if r.split == "validation")
    train = sorted((r.position, r.id) for r in got if r.split == "train")
    assert [p for p, _ in val] == list(range(1, n_val + 1))
    assert [p for p, _ in train] == list(range(1, len(ids) - n_val + 1))
    assert [i for _, i in val] == sorted(ids, key=lambda i: want[i])[:n_val]


def test_null_group_is_ranked(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(30)], "id long, g string")
    got = O.exact_rank(df, "id", by=("g",)).ranked.collect()
    assert sorted(r["rank"] for r in got if r.g is None) == list(range(1, 11))
    assert sorted(r["rank"] for r in got if r.g == "a") == list(range(1, 21))


def test_scale_conf():
    from tessera.session import scale_conf
    conf = scale_conf(100 * 10 ** 12)
    assert int(conf["spark.sql.shuffle.partitions"]) > 300_000
    assert scale_conf(10)["spark.sql.shuffle.partitions"] == "200"


@pytest.mark.parametrize("size", [1, 3, 8, 500])
def test_batch_tensors_decode_to_the_padded_rows(spark, size):
    import zlib

    import numpy as np

    df = spark.createDataFrame([(i, [(i * 7 + k) % 70_000 - 3 for k in range(i % 23 + 1)]) for i in range(400)],
                               "id long, input_ids array<int>")
    df = df.selectExpr("id", "input_ids", "array_repeat(1, size(input_ids)) as attention_mask",
                       "concat(array(-100), input_ids) as labels")
    order = O.exact_split(df, "id", 37, 42, digits=2)
    padded = B.pad_batches(order, size, pad_id=5)
    want = {}
    for r in padded.collect():
        want.setdefault((r.split, r.batch), []).append((r.position, r.input_ids, r.attention_mask, r.labels))
    got = B.batch_tensors(order, padded, size).collect()
    assert len(got) == len(want)
    for r in got:
        rows = sorted(want[r.split, r.batch])
        assert r.n_rows == len(rows)
        for data, width, k in ((r.ids, r.width, 1), (r["mask"], r.width, 2), (r.labels, r.label_width, 3)):
            assert np.frombuffer(data, "<i4").reshape(r.n_rows, width).tolist() == [x[k] for x in rows]
        assert r.checksum == zlib.crc32(bytes(r.ids) + bytes(r["mask"]) + bytes(r.labels))


def test_too_many_groups_for_the_broadcast(table, monkeypatch):
    _, df = table
    monkeypatch.setattr(O, "MAX_OFFSETS", 100)
    with pytest.raises(Exception, match="too many groups"):
        O.exact_rank(df, "id", 42, 4, by=("text",)).ranked.collect()
    assert O.exact_rank(df, "id", 42, 4).ranked.count() == 500
