"""Conversation prompts and reply handling.

Input is a conversations table ``(conv_id, turn, role, text)`` with roles
``system``, ``user``, ``assistant``; ``turn`` orders the messages. Output is
one prompt row per user turn, also where its ``conv_id`` or ``turn`` is null:
the rows without a ``conv_id`` are one conversation, and a message without a
``turn`` comes before all others of its conversation. A message without a role
is part of the history, with an empty role name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.templates import fill, parse_format

# ---------------------------------------------------------------------------
# The Japanese conversation style (system text, the two role
# names, separator, stop string), and the single-turn prompt of the
# instruction-tuned chat model with its newline marker.
# ---------------------------------------------------------------------------
JAPANESE_SYSTEM = "以下はタスクを説明する指示です。要求を適切に満たすような返答を書いてください。\n\n"
JAPANESE_ROLES = ("指示", "返答")
JAPANESE_SEP = "\n###"
JAPANESE_STOP = "###"
SINGLE_TURN_PROMPT = "ユーザー: {text}<NL>システム: "
NEWLINE_MARKER = "<NL>"


@dataclass(frozen=True)
class ConversationStyle:
    """A conversation style where each message is ``role: text`` plus one
    separator, and an empty message is only ``role:`` (the reply slot)."""

    system: str = JAPANESE_SYSTEM
    roles: tuple[str, str] = JAPANESE_ROLES
    sep: str = JAPANESE_SEP
    stop: str = JAPANESE_STOP


JAPANESE = ConversationStyle()


def _role_name(role: Column, style: ConversationStyle) -> Column:
    return F.when(role == "user", F.lit(style.roles[0])).when(
        role == "assistant", F.lit(style.roles[1])).otherwise(F.coalesce(role, F.lit("")))


def _message(role_name: Column, text: Column, sep: str) -> Column:
    return F.when(F.coalesce(F.length(text) > 0, F.lit(False)),
                  F.concat(role_name, F.lit(": "), text, F.lit(sep))
                  ).otherwise(F.concat(role_name, F.lit(":")))


def _system_text(conv: DataFrame, style: ConversationStyle) -> DataFrame:
    """conv_id -> text of the conversation's first system row (by turn); none: the style's."""
    return (conv.filter(F.col("role") == "system").groupBy("conv_id")
            .agg(F.min_by("text", "turn").alias("_sys")))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys where null equals null; the left side's keys stay."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, on, "left").drop(*[f"_r_{k}" for k in keys])


def conversation_prompts(conv: DataFrame, style: ConversationStyle = JAPANESE,
                         max_messages: int | None = None, chunk: int = 256) -> DataFrame:
    """For every user turn, the prompt of the whole conversation so far:
    system text + separator, every earlier message and the current user
    message as ``role: text`` + separator, then the empty reply slot
    ``role:``. ``max_messages`` keeps only that many latest messages (a
    sliding frame); ``None`` keeps the whole history, as the chat loop does.

    The whole history is built without a frame or a group over a conversation. Turns
    fall into chunks of ``chunk`` turns; a running frame inside each chunk gives the
    local history. The text before a chunk comes from dyadic blocks: chunk c of a
    conversation (numbered from 0) follows the blocks of 2^k chunks, one per set bit
    k of c, so its prefix joins at most log2(c) texts. Only blocks that a later chunk
    uses are built, so a conversation of one chunk sends no text beyond its own task.
    A block's text is part of some prompt, and no group holds more than that; the output
    itself grows with the square of a conversation's length, as every prompt
    repeats the history.
    """
    msgs = conv.filter(~F.col("role").eqNullSafe("system")).select(
        "conv_id", "turn", "role",
        _message(_role_name(F.col("role"), style), F.col("text"), style.sep).alias("_m"))
    if max_messages is not None:
        return _recent_prompts(conv, msgs, style, max_messages, chunk)
    msgs = msgs.withColumn("_c", F.floor(F.col("turn") / F.lit(chunk)).cast("bigint"))
    inside = Window.partitionBy("conv_id", "_c").orderBy("turn").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = msgs.withColumn("_l", F.array_join(F.collect_list("_m").over(inside), ""))
    # a chunk's text is the local history at its last turn; the aggregate reuses the
    # window's (conv_id, chunk) partitioning: no exchange (messages without a turn are
    # a chunk of their own: the longest text is the last)
    last = F.struct(F.col("turn"), F.length("_l").alias("n"))
    texts = local.groupBy("conv_id", "_c").agg(F.max_by("_l", last).alias("_t"))
    places = _chunk_places(msgs, _system_text(conv, style), style)
    prefix = _block_prefixes(_join_null_safe(texts, places.drop("_sys").filter("_last > 0"), ["conv_id", "_c"]))
    users = _join_null_safe(local.filter(F.col("role") == "user"), places, ["conv_id", "_c"])
    whole = _join_null_safe(users, prefix, ["conv_id", "_c"])
    return whole.select("conv_id", "turn", F.concat(
        "_sys", F.coalesce(F.col("_p"), F.lit("")), "_l", F.lit(style.roles[1] + ":")).alias("prompt"))


def _chunk_places(msgs: DataFrame, system: DataFrame, style: ConversationStyle) -> DataFrame:
    """Per chunk, without its text: its number ``_x`` from 0 in its conversation, the last
    chunk's number, and the conversation's opening. The chunk of messages without a
    turn comes first."""
    chunks = msgs.select("conv_id", "_c").distinct()
    span = chunks.groupBy("conv_id").agg(
        (F.min("_c") - F.max(F.col("_c").isNull().cast("int"))).alias("_lo"), F.max("_c").alias("_hi"))
    opened = _join_null_safe(_join_null_safe(chunks, span, ["conv_id"]), system, ["conv_id"])
    lo = F.coalesce("_lo", F.lit(0))
    return opened.select(
        "conv_id", "_c", (F.coalesce(F.col("_c"), lo) - lo).alias("_x"),
        (F.coalesce(F.col("_hi"), lo) - lo).alias("_last"),
        F.concat(F.coalesce(F.col("_sys"), F.lit(style.system)), F.lit(style.sep)).alias("_sys"))


def _block_prefixes(chunks: DataFrame) -> DataFrame:
    """``conv_id, _c, _p``: the text before each chunk but the first. ``chunks``: ``conv_id,
    _c, _t, _x, _last`` of the conversations with several chunks."""
    levels = F.explode(F.sequence(F.lit(0), F.length(F.bin("_last")) - 1))
    block = F.expr("shiftright(_x, _k)")
    several = chunks.filter(F.col("_last").isNotNull())
    # an even block is used by the chunks of the block after it
    used = (several.withColumn("_k", levels).withColumn("_b", block)
            .filter((F.col("_b") % 2 == 0) & (F.col("_b") < F.expr("shiftright(_last, _k)"))))
    blocks = used.groupBy("conv_id", "_k", "_b").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_x", "_t"))), lambda p: p["_t"]), "").alias("_bt"))
    needs = (several.select("conv_id", "_c", "_x", levels.alias("_k")).withColumn("_b", block)
             .filter(F.col("_b") % 2 == 1).select("conv_id", "_c", "_k", (F.col("_b") - 1).alias("_b")))
    # higher blocks lie further back
    return _join_null_safe(needs, blocks, ["conv_id", "_k", "_b"]).groupBy("conv_id", "_c").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_k")).alias("_k"), "_bt"))), lambda p: p["_bt"]),
        "").alias("_p"))


def _recent_prompts(conv: DataFrame, msgs: DataFrame, style: ConversationStyle, k: int,
                    chunk: int) -> DataFrame:
    """C1 with the latest ``k`` messages, spread over tasks like the whole
    history: inside a chunk of turns a sliding frame gives the local part;
    the messages a chunk's first rows need from before the chunk (its "tail",
    the last ``k - 1`` messages before it) come from the ``k - 1`` chunks
    before it, each of which holds at least one message, through a bounded
    frame over the chunk rows. Every frame holds at most ``k`` items."""
    if k < 1:
        raise ValueError("max_messages must be >= 1")
    msgs = msgs.withColumn("_c", F.floor(F.col("turn") / F.lit(chunk)).cast("bigint"))
    inside = Window.partitionBy("conv_id", "_c").orderBy("turn")
    local = (msgs.withColumn("_l", F.collect_list("_m").over(
                 inside.rowsBetween(-(k - 1), Window.currentRow)))
             .withColumn("_back", F.row_number().over(
                 Window.partitionBy("conv_id", "_c").orderBy(F.col("turn").desc()))))
    # each chunk's own last k-1 messages, in order (at most k-1 items)
    # (one row per chunk, also when k = 1 and the list is empty)
    own = (local.groupBy("conv_id", "_c")
           .agg(F.transform(F.array_sort(F.collect_list(
               F.when(F.col("_back") <= F.lit(k - 1), F.struct("turn", "_m")))),
               lambda x: x["_m"]).alias("_own")))
    before = Window.partitionBy("conv_id").orderBy("_c").rowsBetween(-max(k - 1, 1), -1)
    tails = own.select("conv_id", "_c", F.flatten(F.collect_list("_own").over(before))
                       .alias("_all")).select(
        "conv_id", "_c",
        F.when(F.size("_all") > 0, F.slice("_all", F.greatest(F.size("_all") - F.lit(k - 2), F.lit(1)),
                                           F.lit(max(k - 1, 0))))
        .otherwise(F.array().cast("array<string>")).alias("_tail"))
    tails = _join_null_safe(tails, _system_text(conv, style), ["conv_id"]).select(
        "conv_id", "_c", "_tail",
        F.concat(F.coalesce(F.col("_sys"), F.lit(style.system)), F.lit(style.sep)).alias("_p"))
    users = _join_null_safe(local.filter(F.col("role") == "user"), tails, ["conv_id", "_c"])
    need = F.lit(k) - F.size("_l")
    tail = F.coalesce(F.col("_tail"), F.array().cast("array<string>"))
    picked = F.when(need > 0, F.slice(tail, F.greatest(F.size(tail) - need + 1, F.lit(1)), need)) \
        .otherwise(F.array().cast("array<string>"))
    return users.select("conv_id", "turn", F.concat(
        F.coalesce(F.col("_p"), F.concat(F.lit(style.system), F.lit(style.sep))),
        F.array_join(F.concat(picked, F.col("_l")), ""),
        F.lit(style.roles[1] + ":")).alias("prompt"))


def no_context_prompts(conv: DataFrame, style: ConversationStyle = JAPANESE) -> DataFrame:
    """Only the current user message and the empty reply slot (the system
    text is kept). Row-wise, so it also runs on a stream (without the
    conversation's own system row, which needs a join: pass ``system`` rows
    through a batch join first, or rely on the style's system text)."""
    users = conv.filter(F.col("role") == "user")
    sys = _system_text(conv, style)
    return _join_null_safe(users, sys, ["conv_id"]).select(
        "conv_id", "turn",
        F.concat(F.coalesce(F.col("_sys"), F.lit(style.system)), F.lit(style.sep),
                 _message(F.lit(style.roles[0]), F.col("text"), style.sep),
                 F.lit(style.roles[1] + ":")).alias("prompt"))


def no_context_prompt(text: Column, style: ConversationStyle = JAPANESE) -> Column:
    """C2 as a pure row expression with the style's system text (streams)."""
    return F.concat(F.lit(style.system), F.lit(style.sep),
                    _message(F.lit(style.roles[0]), text, style.sep),
                    F.lit(style.roles[1] + ":"))


def single_turn_prompt(text: Column) -> Column:
    """``ユーザー: {text}<NL>システム: `` (the text is used verbatim)."""
    return fill(parse_format(SINGLE_TURN_PROMPT), {"text": text})


def decode_newlines(reply: Column) -> Column:
    """C4: the newline marker back to a newline."""
    return F.replace(reply, F.lit(NEWLINE_MARKER), F.lit("\n"))


def cut_at_stop(reply: Column, stop: str = JAPANESE_STOP) -> Column:
    """The reply up to the first stop string."""
    return F.substring_index(reply, stop, 1)


def non_empty_user_turns(conv: DataFrame) -> DataFrame:
    """User messages with text (an empty one ends the chat loop)."""
    return conv.filter((F.col("role") == "user") & (F.length("text") > 0))
