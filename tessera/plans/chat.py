"""Chat prompt job: a conversations table -> one prompt per user turn.

    python -m tessera.plans.chat --conversations conv.parquet --out prompts/ [--no-context]
        [--max-messages N] [--single-turn]

The interactive chat loops become table jobs: every user turn gets the prompt
the loop would have sent (whole history, no-context, or the single-turn form).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat as C


def chat_prompts(conv: DataFrame, no_context: bool = False, single_turn: bool = False,
                 max_messages: int | None = None) -> DataFrame:
    if single_turn:
        users = C.non_empty_user_turns(conv)
        return users.select("conv_id", "turn", C.single_turn_prompt(F.col("text")).alias("prompt"))
    if no_context:
        return C.no_context_prompts(conv)
    return C.conversation_prompts(conv, max_messages=max_messages)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--conversations", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--no-context", action="store_true")
    ap.add_argument("--single-turn", action="store_true")
    ap.add_argument("--max-messages", type=int)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("tessera-chat-prompts").getOrCreate()
    conv = spark.read.parquet(args.conversations)
    chat_prompts(conv, args.no_context, args.single_turn, args.max_messages) \
        .write.mode("errorifexists").json(args.out)


if __name__ == "__main__":
    main()
