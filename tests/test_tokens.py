"""Code point encoder, end-of-text, masks, decode; vocabulary encoders."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.templates import get_template, render
from tessera.functions.tokens import (CP_EOS, IGNORE_INDEX, CodePoints, cut_prompt,
                                      get_encoder)
from tessera.operators.tokenize import tokenize_records


def expected(spark, t, rows, cutoff, on_inputs):
    """ids and labels per row from the rules: code points and one end id, cut once; the
    labels of the user prompt's share are ignored."""
    df = spark.createDataFrame(rows, "id long, instruction string, input string, output string")
    texts = df.select("id", render(t, F.col("instruction"), F.col("input"), F.col("output")).alias("whole"),
                      render(t, F.col("instruction"), F.col("input")).alias("user")).collect()
    out = {}
    for r in texts:
        ids = [*map(ord, r.whole), CP_EOS][:cutoff]
        hidden = 0 if on_inputs else len(r.user[:cutoff])
        out[r.id] = ids, [IGNORE_INDEX] * hidden + ids[hidden:]
    return out


EDGE = [
    ("short", "", "x"),
    ("short", "ctx", None),
    ("a" * 300, "", "out"),
    ("b", "", "c" * 500),
    ("😀 emoji and 日本", "ü", "ok"),
]


@pytest.mark.parametrize("cutoff", [None, 120, 153, 154, 155, 400])
@pytest.mark.parametrize("train_on_inputs", [True, False])
def test_record_builder_matches_python(spark, cutoff, train_on_inputs):
    t = get_template("alpaca")
    rows = [(i, *r) for i, r in enumerate(EDGE)]
    df = spark.createDataFrame(rows, "id long, instruction string, input string, output string")
    got = {r.id: r for r in tokenize_records(df, t, CodePoints(), cutoff_len=cutoff,
                                              train_on_inputs=train_on_inputs).collect()}
    for i, (ids, labels) in expected(spark, t, rows, cutoff, train_on_inputs).items():
        assert got[i].input_ids == ids
        assert got[i].attention_mask == [1] * len(ids)
        assert got[i].labels == labels


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=40), st.one_of(st.none(), st.text(max_size=10)),
                          st.one_of(st.none(), st.text(max_size=30))), min_size=1, max_size=6),
       st.sampled_from([None, 60, 130]), st.booleans())
def test_record_builder_property(spark, rows, cutoff, train_on_inputs):
    t = get_template("alpaca_japanese")
    data = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, instruction string, input string, output string")
    got = {r.id: r for r in tokenize_records(df, t, CodePoints(), cutoff_len=cutoff,
                                              train_on_inputs=train_on_inputs).collect()}
    for i, (ids, labels) in expected(spark, t, data, cutoff, train_on_inputs).items():
        assert got[i].input_ids == ids and got[i].labels == labels


def test_eos_not_doubled_and_mask_growth(spark):
    t = get_template("alpaca")
    eos = chr(CP_EOS) if CP_EOS < 0x110000 else None
    assert eos is None  # the end-of-text id lies outside Unicode, text never holds it
    # user prompt longer than the cutoff: every label masked, labels longer than ids never shorter
    df = spark.createDataFrame([(1, "z" * 200, "", "tail")], "id long, instruction string, input string, output string")
    r = tokenize_records(df, t, CodePoints(), cutoff_len=100, train_on_inputs=False).first()
    assert len(r.input_ids) == 100 and r.labels == [IGNORE_INDEX] * 100


def test_encoder_with_bos_counts_in_cutoff(spark):
    enc = CodePoints(bos_id=7)
    df = spark.createDataFrame([("abcdef",), ("",)], "t string")
    got = [r.ids for r in df.select(enc.encode(F.col("t"), 4).alias("ids")).collect()]
    assert got == [[7, 97, 98, 99], [7]]


def test_decode_and_cut(spark):
    enc = CodePoints()
    df = spark.createDataFrame([("héllo 😀 世界",)], "t string")
    r = df.select(enc.encode(F.col("t")).alias("ids")).select(
        enc.decode(F.concat("ids", F.array(F.lit(CP_EOS)))).alias("back"),
        cut_prompt(F.col("ids"), F.lit(3)).alias("rest")).first()
    assert r.back == "héllo 😀 世界"
    assert r.rest == [ord(c) for c in "héllo 😀 世界"][3:]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_50k_tiktoken", "piece_bpe_32k", "word_bpe_49k"])
def test_vocab_encoders_match_library(spark, name):
    from tessera.functions.tokens import encode_texts
    enc = get_encoder(name)
    texts = ["### Response:\n", "Hello world, 日本語のテキスト。", "a\n\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.ids for r in df.select(enc.encode(F.col("t"), 5).alias("ids")).collect()]
    want = [(([enc.bos_id] if enc.bos_id is not None else []) + x)[:5]
            for x in encode_texts(enc.kind, enc.path, texts)]
    assert got == want


def test_byte_bpe_boundary_merge(spark):
    # the response header merges differently when the output starts with a newline
    from tessera.functions.tokens import encode_texts
    enc = get_encoder("byte_bpe_50k")
    a, b = encode_texts(enc.kind, enc.path, ["### Response:\n", "### Response:\n\n"])
    assert a[:3] == b[:3] and a[3] != b[3]
    t = get_template("alpaca")
    df = spark.createDataFrame([(1, "x", "", "\nreply")], "id long, instruction string, input string, output string")
    r = tokenize_records(df, t, enc, cutoff_len=None, train_on_inputs=False).first()
    n_user = len(encode_texts(enc.kind, enc.path, [t.prompt_no_input.format(instruction="x")])[0])
    assert r.labels[:n_user] == [IGNORE_INDEX] * n_user
    assert r.labels[n_user:] == r.input_ids[n_user:]
