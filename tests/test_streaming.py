"""Row-wise operators on a stream give the batch result."""

import os

from pyspark.sql import functions as F

from tessera.functions.templates import get_template
from tessera.functions.tokens import CodePoints
from tessera.operators.tokenize import tokenize_records
from tessera.sources.tables import inst
from tessera.streaming import stream as ST

from .conftest import SF_SMALL
from .stand_in import RuleReplyScorer


def test_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    recs = inst(spark, SF_SMALL).select("id", "instruction", "input", "output")
    recs.write.parquet(src)
    t = get_template("alpaca")
    batch = tokenize_records(recs, t, CodePoints(), cutoff_len=64, train_on_inputs=False)
    stream = ST.read_records_stream(spark, src, recs.schema)
    tok = ST.tokenize_stream(stream, t, CodePoints(), cutoff_len=64, train_on_inputs=False)
    out = os.path.join(tmp_dir, "out")
    q = ST.write_stream(tok, out, "tok_test", trigger_once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    key = [F.col("id")]
    assert sorted(map(tuple, got.orderBy(*key).collect())) == sorted(map(tuple, batch.orderBy(*key).collect()))


def test_row_wise_chat_and_answers_on_stream(spark, tmp_dir):
    from tessera.operators import chat as C
    from tessera.operators import scoring as S
    from tessera.sources.tables import conversations

    src = os.path.join(tmp_dir, "conv")
    conv = conversations(spark, SF_SMALL)
    conv.write.parquet(src)

    def build(df):
        users = C.non_empty_user_turns(df)
        return users.select(
            "conv_id", "turn",
            C.no_context_prompt(F.col("text")).alias("p2"),
            C.single_turn_prompt(F.col("text")).alias("p3"),
            S.answer_after_last(F.concat(F.col("text"), F.lit("\n### 返答:\n　ok ")), "### 返答:\n").alias("a"))

    batch = build(conv)
    out = os.path.join(tmp_dir, "conv_out")
    q = ST.write_stream(build(ST.read_records_stream(spark, src, conv.schema)), out,
                        "chat_test", trigger_once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert {r.a for r in got.collect()} == {"ok"}


def test_scoring_job_on_stream(spark, tmp_dir):
    from tessera.operators import evalsets as E
    from tessera.operators import scoring as S
    from tessera.sources.tables import nli

    src = os.path.join(tmp_dir, "pairs")
    nli(spark, SF_SMALL).write.parquet(src)
    pairs = spark.read.parquet(src)

    def build(df):
        ev = E.nli_eval_set(df, shot=0, language="ja")
        gen = S.score(ev, RuleReplyScorer(), id_col="sentence_pair_id", passthrough=["expected"])
        return gen.withColumn("answer", S.answer_after_last(F.col("generated"), "### 返答:\n"))

    batch = build(pairs)
    out = os.path.join(tmp_dir, "replies")
    q = ST.write_stream(build(ST.read_records_stream(spark, src, pairs.schema)), out,
                        "score_test", trigger_once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_conversation_history_on_a_stream(spark, tmp_dir):
    """Replayed over several triggers and a restart, the stream gives the batch prompts."""
    import uuid

    from tessera.operators import chat as C
    from tessera.sources import tables

    conv = tables.conversations(spark, SF_SMALL)
    conv = conv.unionByName(spark.createDataFrame(
        [(None, None, "user", "no key"), (None, 3, None, "no role"), (None, 9, "user", "")], conv.schema))
    src, out, name = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "out"), f"c1-{uuid.uuid4().hex}"
    cuts = [None, 2, 3, 5, 100]

    def add(lo, hi):
        early = F.coalesce(F.col("turn"), F.lit(-1))
        conv.filter((early < hi) & (early >= (-1 if lo is None else lo))).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = ST.read_records_stream(spark, src, conv.schema, max_files_per_trigger=1)
        q = ST.write_stream(ST.conversation_prompts_stream(stream), out, name, trigger_once=True)
        q.awaitTermination(120)
        assert q.exception() is None
        return len([p for p in q.recentProgress if p.numInputRows])

    add(cuts[0], cuts[1])
    add(cuts[1], cuts[2])
    assert run() == 2
    add(cuts[2], cuts[3])      # after a restart from the checkpoint
    add(cuts[3], cuts[4])
    assert run() == 2
    got = sorted((str(r.conv_id), str(r.turn), r.prompt) for r in spark.read.parquet(out).collect())
    want = sorted((str(r.conv_id), str(r.turn), r.prompt) for r in C.conversation_prompts(conv).collect())
    assert got == want


def test_idle_conversation_is_forgotten(spark, tmp_dir):
    import time

    schema = "conv_id long, turn long, role string, text string"
    src = os.path.join(tmp_dir, "src")
    spark.createDataFrame([(1, 0, "user", "first")], schema).coalesce(1).write.parquet(src)
    stream = ST.read_records_stream(spark, src, spark.createDataFrame([], schema).schema)
    q = (ST.conversation_prompts_stream(stream, idle=1.0).writeStream.format("memory").queryName("idle_c1")
         .outputMode("append").option("checkpointLocation", os.path.join(tmp_dir, "ckpt")).start())

    def prompts(n):
        for _ in range(200):
            rows = {r.turn: r.prompt for r in spark.table("idle_c1").collect()}
            if len(rows) >= n or not q.isActive:
                return rows
            time.sleep(0.3)

    try:
        assert "first" in prompts(1)[0]
        for _ in range(200):               # until a batch has removed the state
            p = q.lastProgress
            if p and p["stateOperators"] and p["stateOperators"][0]["numRowsTotal"] == 0:
                break
            time.sleep(0.3)
        spark.createDataFrame([(1, 1, "user", "second")], schema).coalesce(1).write.mode("append").parquet(src)
        later = prompts(2)
        assert "second" in later[1] and "first" not in later[1]
    finally:
        q.stop()
