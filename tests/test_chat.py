"""C1-C6 against a Python model of the 'role: text + separator' style."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import chat as C


def py_prompt(system, messages):
    ret = system + C.JAPANESE_SEP
    for role, msg in messages:
        ret += f"{role}: {msg}{C.JAPANESE_SEP}" if msg else f"{role}:"
    return ret


ROLE = {"user": C.JAPANESE_ROLES[0], "assistant": C.JAPANESE_ROLES[1]}
ROWS = [
    (1, 0, "system", "own system\n\n"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
    (1, 3, "user", "more"), (1, 4, "assistant", ""), (1, 5, "user", "again"),
    (2, 0, "user", "solo"), (2, 1, "assistant", "a<NL>b###rest"),
]


@pytest.fixture(scope="module")
def conv(spark):
    return spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("max_messages,chunk", [
    (None, 256), (None, 1), (None, 2), (None, 4), (2, 256), (3, 256),
    (1, 1), (2, 1), (3, 1), (3, 2), (4, 2), (5, 3), (6, 1)])
def test_history_prompts(conv, max_messages, chunk):
    got = {(r.conv_id, r.turn): r.prompt for r in
           C.conversation_prompts(conv, max_messages=max_messages, chunk=chunk).collect()}
    for cid in (1, 2):
        rows = sorted(r for r in ROWS if r[0] == cid)
        system = next((r[3] for r in rows if r[2] == "system"), C.JAPANESE_SYSTEM)
        msgs = [r for r in rows if r[2] != "system"]
        for k, (_, turn, role, _) in enumerate(msgs):
            if role != "user":
                continue
            hist = [(ROLE[r[2]], r[3]) for r in msgs[: k + 1]]
            if max_messages:
                hist = hist[-max_messages:]
            assert got[(cid, turn)] == py_prompt(system, hist + [(C.JAPANESE_ROLES[1], None)])


def test_no_context_and_single_turn(conv, spark):
    got = {(r.conv_id, r.turn): r.prompt for r in C.no_context_prompts(conv).collect()}
    assert got[(1, 3)] == py_prompt("own system\n\n", [("指示", "more"), ("返答", None)])
    assert got[(2, 0)] == py_prompt(C.JAPANESE_SYSTEM, [("指示", "solo"), ("返答", None)])
    df = spark.createDataFrame([("x\ny",), ("",)], "text string")
    assert df.select(C.single_turn_prompt(F.col("text")).alias("p")).first().p == "ユーザー: x\ny<NL>システム: "
    assert C.non_empty_user_turns(conv).count() == 4


def test_reply_cleanup(spark):
    df = spark.createDataFrame([("a<NL>b###rest",), ("plain",), ("###x",)], "r string")
    got = [r.c for r in df.select(C.cut_at_stop(C.decode_newlines(F.col("r"))).alias("c")).collect()]
    assert got == ["a\nb", "plain", ""]


def test_first_system_text_by_turn(spark):
    from tessera.operators import chat as CH
    rows = [(1, 0, "system", "zz"), (1, 1, "user", "hi"), (1, 2, "system", "aa"), (1, 3, "user", "ho")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert all(r.prompt.startswith("zz") for r in CH.conversation_prompts(df).collect())


@pytest.mark.parametrize("max_messages", [None, 2, 5])
def test_null_keys_and_roles_keep_their_rows(spark, max_messages):
    rows = [(1, 0, "system", "own"), (1, None, "user", "early"), (1, 1, "user", "hi"), (1, 2, None, "aside"),
            (1, 3, "user", "more"), (None, 0, "system", "nobody"), (None, 1, "user", "lost"),
            (None, 2, "assistant", "found"), (None, 300, "user", "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.prompt for r in C.conversation_prompts(df, max_messages=max_messages).collect()}
    u, a = C.JAPANESE_ROLES
    for cid, system, msgs in (
            (1, "own", [(None, u, "early"), (1, u, "hi"), (2, "", "aside"), (3, u, "more")]),
            (None, "nobody", [(1, u, "lost"), (2, a, "found"), (300, u, "late")])):
        for k, (turn, role, _) in enumerate(msgs):
            if role == u:
                hist = [m[1:] for m in msgs[:k + 1]][-(max_messages or 99):]
                assert got.pop((cid, turn)) == py_prompt(system, hist + [(a, None)])
    assert not got
    alone = {(r.conv_id, r.turn): r.prompt for r in C.no_context_prompts(df).collect()}
    assert alone[(None, 1)] == py_prompt("nobody", [(u, "lost"), (a, None)]) and len(alone) == 5


def _history_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_frame_over_a_conversation(conv):
    import re
    plan = _history_plan(C.conversation_prompts(conv))
    frames = re.findall(r"windowspecdefinition\(([^)]*?) (?:ASC|DESC)", plan)
    assert frames and all("_c#" in f for f in frames)
    assert not re.search(r"Exchange hashpartitioning\(conv_id#\d+L?, \d+\)[^\n]*\n[^\n]*_t#", plan)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7])
def test_histories_of_sparse_null_and_negative_turns(spark, chunk):
    """Gaps, negative and missing turns, several null conversations, chunk numbers far apart."""
    turns = [None, -9, -8, -1, 0, 1, 2, 3, 6, 7, 50, 51, 1_000_000, 1_000_001, 2 ** 40]
    rows = [(c, t, ("user", "assistant", None)[(i + (c or 0)) % 3], f"m{i}") for c in (None, 1, 2)
            for i, t in enumerate(turns) if (i + (c or 5)) % 4]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.prompt for r in C.conversation_prompts(df, chunk=chunk).collect()}
    want = {}
    for c in (None, 1, 2):
        here = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        for i, (_, turn, role, _) in enumerate(here):
            if role == "user":
                want[c, turn] = py_prompt(C.JAPANESE_SYSTEM, [(ROLE.get(r[2], ""), r[3]) for r in here[:i + 1]]
                                          + [(C.JAPANESE_ROLES[1], None)])
    assert got == want


def test_conversation_of_200_000_turns(spark):
    """One conversation, 782 chunks: every prompt is a prefix of the whole history."""
    n = 200_000
    df = spark.range(n).selectExpr("7L as conv_id", "id as turn",
                                   "if(id % 20011 = 20010, 'user', 'x') as role", "'' as text").repartition(8)
    got = {r.turn: r.prompt for r in C.conversation_prompts(df).collect()}
    assert sorted(got) == [20011 * i - 1 for i in range(1, n // 20011 + 1)]
    head = C.JAPANESE_SYSTEM + C.JAPANESE_SEP
    line = [f"{C.JAPANESE_ROLES[0]}:" if i % 20011 == 20010 else "x:" for i in range(n)]
    for turn, prompt in got.items():
        assert prompt == head + "".join(line[:turn + 1]) + f"{C.JAPANESE_ROLES[1]}:"
