"""R7-R10, W1/W2, X1-X3, M1-M5, G1-G3 edge cases against Python models."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import evalsets as E
from tessera.operators import scoring as S

from .stand_in import WORDS, RuleReplyScorer


def py_nli_prompt(s1, s2, response, example=""):
    return E.NLI_PROMPT.format(example=example, input1=s1, input2=s2, response=response)


@pytest.fixture(scope="module")
def pairs(spark):
    rows = []
    for i in range(30):
        rows.append((i, f"premise {i}", f"hypothesis {i}", i % 3 if i < 20 else (i * 5) % 3,
                     "train" if i % 2 == 0 else "validation"))
    return rows, spark.createDataFrame(rows, "sentence_pair_id long, sentence1 string, sentence2 string, label int, split string")


# even ids are train rows; (id, word) of the examples in order, label by label
EXAMPLES = [(0, "含意"), (4, "矛盾"), (2, "中立"), (6, "含意"), (10, "矛盾"), (8, "中立"), (12, "含意")]
BLOCK = "### 前提文:\npremise {0}\n### 仮説文:\nhypothesis {0}\n### 返答:\n{1}\n\n"


@pytest.mark.parametrize("shot,language", [(0, "ja"), (1, "en"), (5, "ja"), (7, "en")])
def test_eval_set_prompts(pairs, shot, language):
    rows, df = pairs
    got = {r.sentence_pair_id: r for r in E.nli_eval_set(df, shot, language).collect()}
    examples = "".join(BLOCK.format(*x) for x in EXAMPLES[:shot])
    val = [r for r in rows if r[4] == "validation"]
    assert len(got) == len(val)
    for r in val:
        assert got[r[0]].prompts == py_nli_prompt(r[1], r[2], E.RESPONSE_MARKERS[language], examples)
        assert got[r[0]].expected == E.NLI_LABEL_WORDS[r[3]]


def test_other_labels_are_no_examples(spark, pairs):
    _, df = pairs
    extra = spark.createDataFrame([(-1, "p", "h", 3, "train"), (-2, "p", "h", None, "train")], df.schema)
    whole = df.union(extra).filter("split = 'train' or label < 3")
    assert E.nli_eval_set(whole, 4, "ja").count() == E.nli_eval_set(df, 4, "ja").count()


def test_shot_shortage_fails(pairs):
    _, df = pairs
    with pytest.raises(Exception, match="shots asked"):
        E.nli_eval_set(df, 40, "ja").collect()


def test_unknown_label_and_language(spark):
    df = spark.createDataFrame([(3,)], "label int")
    with pytest.raises(Exception, match="unknown label"):
        df.select(E.label_word(F.col("label"))).collect()
    assert df.select(E.label_word(F.col("label"), strict=False).alias("w")).first().w is None
    with pytest.raises(ValueError):
        E.response_marker("fr")


REPLIES = ["no marker here", "pre ### 返答:\n　含意\n", "a ### 返答:\nx ### 返答:\n 矛盾 ",
           "### 返答:\n", "　中立　", None]


def test_answer_extraction_matches_python(spark):
    m1, m2 = "### 返答:", "### 返答:\n"
    df = spark.createDataFrame([(r,) for r in REPLIES], "s string")
    got = df.select(S.answer_after_first(F.col("s"), m1).alias("a"),
                    S.answer_after_last(F.col("s"), m2).alias("b"),
                    S.py_strip(F.col("s")).alias("c")).collect()
    for s, r in zip(REPLIES, got):
        if s is None:
            assert r.a is None and r.b is None
            continue
        assert r.a == (s.split(m1)[1].strip() if m1 in s else None)
        assert r.b == s.split(m2)[-1].strip()
        assert r.c == s.strip()


def test_strict_marker(spark):
    df = spark.createDataFrame([("nothing",)], "s string")
    with pytest.raises(Exception, match="not in the reply"):
        df.select(S.answer_after_first(F.col("s"), "###", strict=True)).collect()


def test_accuracy_rules(spark):
    rows = [("a", "xay"), ("", "anything"), (None, "x"), ("b", None), ("B", "abc")]
    df = spark.createDataFrame(rows, "expected string, generated string")
    r = S.report(df, "t", S.accuracy(F.col("expected"), F.col("generated")), 4).first()
    assert (r.task, r.n, r.value) == ("t", 5, round(2 / 5, 4))
    empty = df.filter("false")
    assert S.report(empty, "t", S.accuracy(F.col("expected"), F.col("generated")), 4).first().value is None
    share = df.agg(S.choice_share(F.col("generated"), ["xay", "abc"]).alias("v")).first().v
    assert share == pytest.approx(2 / 5)


def test_scoring_job_keeps_ids(spark):
    df = spark.createDataFrame([(i, f"p{i}", "e") for i in range(50)], "id long, prompts string, expected string")
    out = S.score(df.repartition(4), RuleReplyScorer())
    got = {r.id: r.generated for r in out.collect()}
    assert got == {i: f"p{i}" + WORDS[len(f"p{i}") % 3] + "\n" for i in range(50)}


def test_loss_and_perplexity(spark):
    rows = [(1, [5, 6, 7, 5], [-100, -100, 7, 5]), (2, [5, 6], [-100, -100]), (3, [6, 6, 7], [6, 6, 7])]
    df = spark.createDataFrame(rows, "id long, input_ids array<int>, labels array<int>")
    lp, loss_df = S.count_model(df)
    table = {r.tok: r.logprob for r in lp.collect()}
    N, V = 9, 3
    assert table[5] == pytest.approx(math.log((3 + 1) / (N + V)))
    losses = {r.id: r.loss for r in loss_df.collect()}
    assert losses[1] == pytest.approx(-(table[7] + table[5]) / 2)
    assert math.isnan(losses[2])
    assert losses[3] == pytest.approx(-(table[6] + table[7]) / 2)
    # the array form (per-row log-probabilities, as a model returns them) agrees
    arr = df.select("id", S.example_loss(F.col("labels"), F.transform(
        "input_ids", lambda t: F.log((F.lit(1.0) + F.when(t == 5, 3).when(t == 6, 4).otherwise(2)) / (N + V)))
    ).alias("loss")).collect()
    for r in arr:
        if math.isnan(losses[r.id]):
            assert math.isnan(r.loss)
        else:
            assert r.loss == pytest.approx(losses[r.id])
    ppl = S.report(loss_df.filter("id <> 2"), "p", S.perplexity(F.col("loss")), 6).first().value
    assert ppl == pytest.approx(round(math.exp((losses[1] + losses[3]) / 2), 6))
    all_losses = loss_df
    assert math.isnan(all_losses.agg(S.perplexity(F.col("loss")).alias("p")).first().p)
    skipped = all_losses.agg(S.perplexity(F.col("loss"), skip_nan=True).alias("p")).first().p
    assert skipped == pytest.approx(math.exp((losses[1] + losses[3]) / 2))


def test_require_columns(spark):
    df = spark.createDataFrame(pd.DataFrame({"prompts": ["a"]}))
    with pytest.raises(ValueError):
        E.require_columns(df)


def test_length_guard_modes(spark):
    from tessera.operators.guards import length_guard
    df = spark.createDataFrame([(1, [1] * 3), (2, [1] * 6)], "id long, input_ids array<int>")
    assert [r.id for r in length_guard(df, 8, reserve=5, mode="drop").collect()] == [1]
    assert {r.id: r.fits for r in length_guard(df, 8, reserve=5, mode="flag").collect()} == {1: True, 2: False}
    assert length_guard(df, 6, mode="fail").count() == 2
    with pytest.raises(Exception, match="more than 8 tokens: 11"):
        length_guard(df, 8, reserve=5, mode="fail").collect()


def test_vocab_decode_skips_special(spark):
    from tessera.functions.tokens import encode_texts, get_encoder
    enc = get_encoder("byte_bpe_50k")
    ids = encode_texts(enc.kind, enc.path, ["hello 日本"])[0] + [enc.eos_id]
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    assert df.select(enc.decode(F.col("ids")).alias("t")).first().t == "hello 日本"


def test_pair_is_inner_join_on_id(spark):
    exp = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, expected string")
    gen = spark.createDataFrame([(2, "xb"), (3, "zz"), (4, "d")], "id long, generated string")
    got = sorted(tuple(r) for r in S.pair(exp, gen).collect())
    assert got == [(2, "b", "xb"), (3, "c", "zz")]
    r = S.report(S.pair(exp, gen), "t", S.accuracy(F.col("expected"), F.col("generated")), 4).first()
    assert (r.n, r.value) == (2, 0.5)
