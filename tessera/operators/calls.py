"""Scoring calls (G1): rows grouped under a budget of padded tokens, and jobs that go on
after being killed.

A model call pads its rows to the longest one. ``token_budget_calls`` takes the rows longest
first (widths rounded up, equal widths in seeded order) and fills a call as long as rows x
width of its first row stays within the budget. That is one sequence over the whole table,
but a call's limits depend on the widths only: the greedy walk runs over the table (width,
rows), which has a row per distinct width, and a row finds its call from its place among the rows of
its width (an exact rank).
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from ..sources.readers import path_exists
from .batches import round_up
from .order import DEFAULT_SEED, exact_rank
from .scoring import Scorer, _model_of, score

WIDTH_DIGITS = 2     # 256 buckets a width: the broadcast offsets have at most 256 rows per distinct width


def plan_calls(widths: list[tuple[int, int]], budget: int) -> Iterator[tuple]:
    """The greedy walk over ``(width, rows)``, widest first: per width ``(width, rows that still fit
    into the open call, that call, its width, first call of the others, rows of a call)``."""
    call, room, open_width = -1, 0, 0
    for width, rows in widths:
        joined = min(rows, room)
        per_call = max(1, budget // width)
        yield width, joined, call, open_width, call + 1, per_call
        room -= joined
        rest = rows - joined
        if rest:
            new = -(-rest // per_call)
            call, open_width = call + new, width
            room = new * per_call - rest


def token_budget_calls(df: DataFrame, id_col: str, length: Column, budget: int, multiple: int = 8,
                       seed: int | str = DEFAULT_SEED) -> DataFrame:
    """``df`` with ``call`` (from 0, widest rows first) and ``call_width``: every call holds at most
    ``budget`` padded tokens, or one row that is longer. Empty rows and null lengths are as wide as one token."""
    width = round_up(F.greatest(F.coalesce(length, F.lit(0)), F.lit(1)), multiple).cast("bigint")
    order = exact_rank(df.withColumn("_w", width), id_col, seed, WIDTH_DIGITS, by=("_w",), rank_col="_at")
    per_width = order.offsets.groupBy("_w").agg(F.sum("_n").alias("_n"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_w", ascending=False)
        return pd.DataFrame(list(plan_calls(list(zip(pdf["_w"].tolist(), pdf["_n"].tolist())), budget)),
                            columns=["_cw", "_joined", "_open", "_open_width", "_first", "_per"])

    # one row per distinct width (a few thousand): the only step in one task
    ship_package(df.sparkSession)
    plan = per_width.groupBy().applyInPandas(
        walk, "_cw bigint, _joined bigint, _open bigint, _open_width bigint, _first bigint, _per bigint")
    joins = F.col("_at") <= F.col("_joined")
    own = F.col("_first") + F.floor((F.col("_at") - F.col("_joined") - 1) / F.col("_per"))
    return (order.ranked.join(F.broadcast(plan), F.col("_w") == F.col("_cw"))
            .withColumn("call", F.when(joins, F.col("_open")).otherwise(own).cast("bigint"))
            .withColumn("call_width", F.when(joins, F.col("_open_width")).otherwise(F.col("_w")).cast("bigint"))
            .select(*[F.col(f"`{c}`") for c in df.columns], "call", "call_width"))


def score_calls(df: DataFrame, scorer: Scorer, id_col: str = "id", call_col: str = "call",
                passthrough: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """G1 with one model call per ``call``: its rows meet in one task (they fit the budget) and
    the scorer gets exactly these rows. Output as ``scoring.score``, with the call."""
    ship_package(df.sparkSession)
    keep = [c for c in dict.fromkeys((call_col, *passthrough)) if c not in scorer.inputs and c != id_col]
    cols = [id_col, *scorer.inputs, *keep]
    schema = T.StructType([df.schema[c] for c in (id_col, *keep)] + T.StructType.fromDDL(scorer.schema).fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held = _model_of(scorer), None

        def one(pdf):
            res = scorer.score(model, pdf.reset_index(drop=True)).reset_index(drop=True)
            for i, c in enumerate((id_col, *keep)):
                res.insert(i, c, pdf[c].values)
            return res

        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = pdf[call_col].iloc[-1]
            for _, rows in pdf[pdf[call_col] != last].groupby(call_col, sort=False):
                yield one(rows)
            held = pdf[pdf[call_col] == last]        # may go on in the next batch
        if held is not None and len(held):
            yield one(held)

    dealt = df.select(*cols).repartition(call_col).sortWithinPartitions(call_col, id_col)
    return dealt.mapInPandas(run, schema)


def score_resumable(df: DataFrame, scorer: Scorer, path: str, id_col: str = "id",
                    passthrough: tuple[str, ...] | list[str] = (), tasks: int | None = None) -> DataFrame:
    """G1 with stored results that survive a killed job: every run writes below ``path`` to an
    attempt of its own, whose task files become visible as each task ends, and scores only
    ids that no earlier attempt holds. Rows that were under way when the job died are scored
    again, finished ones never. Returns all results once every id is scored; a later call with the same
    ids scores nothing. Ids must be unique and not null; one run at a time."""
    spark, attempts = df.sparkSession, []
    while path_exists(spark, f"{path.rstrip('/')}/attempt-{len(attempts):04d}"):
        attempts.append(f"{path.rstrip('/')}/attempt-{len(attempts):04d}")
    checked = df.withColumn(id_col, F.coalesce(F.col(id_col), F.raise_error(F.lit(
        "null id: a resumable job needs an id for every row")).cast(df.schema[id_col].dataType)))
    keep = [c for c in passthrough if c not in scorer.inputs and c != id_col]
    schema = T.StructType([df.schema[c] for c in (id_col, *keep)] + T.StructType.fromDDL(scorer.schema).fields)
    if attempts:
        done = spark.read.schema(schema).parquet(*attempts).select(id_col)
        checked = checked.join(done, id_col, "left_anti")
    if tasks:
        checked = checked.repartition(tasks, id_col)
    new = f"{path.rstrip('/')}/attempt-{len(attempts):04d}"
    # committer version 2 moves a task's file into place when the task ends, not when the job ends
    (score(checked, scorer, id_col, passthrough).write
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(new))
    return spark.read.schema(schema).parquet(*attempts, new)
