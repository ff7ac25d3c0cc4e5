"""Structured Streaming: the row-wise operators on unbounded input.

Rendering, encoding, end-of-text, masks (R*, T*), single-turn and
no-context chat prompts (C2-C6), the scoring job (G1, ``mapInPandas``) and
answer extraction (X*) hold no state and contain no action, so the same
functions take a streaming DataFrame. The conversation history (C1) keeps state:
``conversation_prompts_stream``. The operators that need a whole table (exact rank,
batches, few-shot choice: W*, B*) are batch only; Spark refuses their row windows on a
stream.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.templates import Template
from ..functions.tokens import Encoder
from ..operators.chat import JAPANESE, ConversationStyle, _message, _role_name
from ..operators.tokenize import tokenize_records
from ..session import checkpoint_dir, ship_package


def read_records_stream(spark: SparkSession, path: str, schema: T.StructType,
                        fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Files arriving under ``path`` as a stream (explicit schema, as streams need)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def tokenize_stream(records: DataFrame, template: Template, encoder: Encoder | None = None,
                    cutoff_len: int | None = None, train_on_inputs: bool = True,
                    keep: list[str] | None = None) -> DataFrame:
    """T5 on a stream: the batch function itself (it is row-wise)."""
    return tokenize_records(records, template, encoder, cutoff_len=cutoff_len,
                            train_on_inputs=train_on_inputs, keep=keep)


def conversation_prompts_stream(conv: DataFrame, style: ConversationStyle = JAPANESE,
                                idle: float | None = None) -> DataFrame:
    """C1 on a stream of ``conv_id, turn, role, text``: for every user turn the prompt of its
    conversation so far, ``conv_id, turn, prompt``.

    The state of a conversation is its system text (the first that arrived) and the
    history as text, which every prompt repeats anyway. Rows of one micro-batch are taken by
    turn (nulls first), micro-batches as they come: a message that arrives after a later turn
    joins the history where it arrives. With ``idle`` (seconds) a conversation
    without new messages is forgotten; if it goes on later, it begins anew (such a stream
    never runs out of batches, so it needs a periodic trigger, not availableNow).
    """
    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        system, history = state.get if state.exists else (None, "")
        rows = pd.concat(list(frames)).sort_values(["turn", "role"], na_position="first", kind="stable")
        turns, prompts = [], []
        for turn, role, text in zip(rows["turn"], rows["role"], rows["_m"]):
            if role == "system":
                system = text if system is None else system
                continue
            history += text
            if role == "user":
                opening = style.system if system is None else system
                turns.append(None if pd.isna(turn) else int(turn))
                prompts.append(f"{opening}{style.sep}{history}{style.roles[1]}:")
        state.update((system, history))
        if idle is not None:
            state.setTimeoutDuration(int(idle * 1000))
        yield pd.DataFrame({"conv_id": [key[0]] * len(turns), "turn": pd.array(turns, dtype="Int64"),
                            "prompt": pd.array(prompts, dtype="object")})

    ship_package(conv.sparkSession)
    messages = conv.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.when(
        F.col("role") == "system", F.col("text")).otherwise(
        _message(_role_name(F.col("role"), style), F.col("text"), style.sep)).alias("_m"))
    kind = conv.schema["conv_id"].dataType.simpleString()
    return messages.groupBy("conv_id").applyInPandasWithState(
        step, f"conv_id {kind}, turn long, prompt string", "system string, history string", "append",
        GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)


def write_stream(df: DataFrame, path: str, name: str, fmt: str = "parquet",
                 trigger_once: bool = False) -> StreamingQuery:
    """Append a stream to files; progress is kept under the session's shared
    checkpoint folder (``spark.checkpoint.dir``), so a restarted job resumes
    where it stopped and a lost executor only re-runs its micro-batch."""
    ckpt = os.path.join(checkpoint_dir(df.sparkSession), "streams", name)
    writer = (df.writeStream.format(fmt).option("path", path)
              .option("checkpointLocation", ckpt).outputMode("append"))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
