"""Scoring: the batch scoring job (G1), per-example loss (G2), a count-based
token scorer (G3), answer extraction (X1-X3) and metrics (M1-M5)."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PY_WHITESPACE
from ..session import ship_package
from ..functions.tokens import IGNORE_INDEX


# --- G1: batch scoring job ----------------------------------------------------

class Scorer:
    """A model wrapped for the scoring job.

    ``schema`` is the DDL of the columns it adds; ``load()`` builds the model
    (called once per Python worker process, the result is cached there);
    ``score(model, pdf)`` maps an Arrow batch (pandas) to the added columns.
    ``options`` are opaque generation settings handed through.
    """

    schema: str = "generated string"
    inputs: tuple[str, ...] = ("prompts",)

    def __init__(self, **options):
        self.options = options

    def load(self):
        return None

    def score(self, model, pdf: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError


class CountScorer(Scorer):
    """The count model (G3) as a scorer: ``loss`` (G2) from token ids and labels. ``table``: token
    -> log-probability, as many rows as the encoder's vocabulary has at most."""

    schema = "loss double"
    inputs = ("input_ids", "labels")

    def __init__(self, table: dict[int, float]):
        super().__init__()
        self.table = table

    def score(self, model, pdf: pd.DataFrame) -> pd.DataFrame:
        def loss(ids, labels):
            scored = [self.table[t] for t, y in zip(ids[1:], labels[1:]) if y != IGNORE_INDEX]
            return -sum(scored) / len(scored) if scored else float("nan")
        return pd.DataFrame({"loss": [loss(i, y) for i, y in zip(pdf["input_ids"], pdf["labels"])]}, dtype=float)


_MODELS: dict[tuple, object] = {}


def _model_of(scorer: Scorer):
    key = (type(scorer).__module__, type(scorer).__qualname__,
           tuple(sorted((k, repr(v)) for k, v in scorer.options.items())))
    if key not in _MODELS:
        _MODELS[key] = scorer.load()
    return _MODELS[key]


def score(df: DataFrame, scorer: Scorer, id_col: str = "id",
          passthrough: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """G1: run ``scorer`` over every row as Arrow batches (``mapInPandas``).

    Only the id, the scorer's input columns and the ``passthrough`` columns
    cross into Python (the projection is applied first, because
    ``mapInPandas`` stops pruning). Passing a small column such as the
    expected answer through keeps it on its row, so pairing the replies with
    it needs no join (and no shuffle). Batch size follows
    ``spark.sql.execution.arrow.maxRecordsPerBatch``. Output: the id, the
    passthrough columns and the scorer's columns, one row per input row.
    """
    ship_package(df.sparkSession)
    keep = [c for c in passthrough if c not in scorer.inputs and c != id_col]
    cols = [id_col, *scorer.inputs, *keep]
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"scoring input lacks {missing}")
    out_schema = T.StructType([df.schema[c] for c in (id_col, *keep)] + T.StructType.fromDDL(scorer.schema).fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model_of(scorer)
        for pdf in batches:
            res = scorer.score(model, pdf).reset_index(drop=True)
            for i, c in enumerate((id_col, *keep)):
                res.insert(i, c, pdf[c].values)
            yield res

    return df.select(*cols).mapInPandas(run, out_schema)


# --- G3: count-based token scorer ------------------------------------------------

def count_model(tok: DataFrame, id_col: str = "id", ids: str = "input_ids",
                labels: str = "labels") -> tuple[DataFrame, DataFrame]:
    """G3 + G2 in one pass over the token arrays: (token table, losses).

    The add-one unigram model of all tokens of the table, ``log((n + 1) /
    (N + V))``, scores each example's targets (labels at positions 2..n that
    are not -100; their mean negative log-probability is the loss; no target:
    NaN). The token table is counted with partial aggregation, so only (vocabulary x
    tasks) rows move; its target tokens (bounded by the vocabulary) are broadcast back to
    the tokens, and as an example's tokens lie in one task, one row per example moves.
    """
    n = F.size(ids)
    pairs = F.zip_with(ids, F.slice(labels, 1, n), lambda t, l: F.struct(t.alias("t"), l.alias("l")))
    exploded = tok.select(id_col, F.posexplode_outer(pairs).alias("_p", "_x")).select(
        id_col, F.col("_x.t").alias("tok"),
        F.coalesce((F.col("_p") >= 1) & (F.col("_x.l") != F.lit(IGNORE_INDEX)), F.lit(False))
        .cast("int").alias("_tgt"))
    # (a row without tokens yields a null token with n = 0: it adds nothing to N,
    # and V counts non-null tokens)
    counts = exploded.groupBy("tok").agg(F.count("tok").alias("n"), F.sum("_tgt").alias("n_target"))
    everything = Window.partitionBy()
    table = counts.select("tok", F.col("n").cast("bigint").alias("n"), "n_target", F.log(
        (F.col("n") + 1) / (F.sum("n").over(everything) + F.count("tok").over(everything))
    ).alias("logprob"))
    targets = table.filter(F.col("n_target") > 0).select("tok", "logprob")
    scored = exploded.join(F.broadcast(targets), "tok", "left")
    agg = scored.groupBy(id_col).agg(F.sum(F.col("_tgt") * F.col("logprob")).alias("_s"),
                                     F.sum("_tgt").alias("_c"), F.count("tok").alias("_n"))
    # an example without tokens or without targets has no loss
    losses = agg.select(id_col, F.when((F.col("_n") == 0) | (F.col("_c") == 0), F.lit(float("nan")))
                        .otherwise(-F.col("_s") / F.col("_c")).alias("loss"))
    return table.filter(F.col("tok").isNotNull()), losses


# --- G3 per label: the label whose words fit best ---------------------------------------

def choose_label(train: DataFrame, rows: DataFrame, text: Column, label: Column,
                 labels: list[int], id_col: str = "id") -> DataFrame:
    """The count model (G3) conditioned on the label, as a classifier: ``id, label``.

    Add-one log-probabilities of the space-separated words of ``text`` are counted per
    label over all of ``train`` (null labels aside); every row of ``rows`` gets the label
    under which its words' mean negative log-probability, to 6 digits, is lowest (ties:
    the first in order). The token table has a row per distinct word; the join to it is
    left to the optimizer, which broadcasts it by measured size only.
    """
    def words(df, *keep):
        return df.select(*keep, F.explode(F.split(F.coalesce(text, F.lit("")), " ")).alias("tok"))

    counts = words(train.filter(label.isNotNull()), label.alias("_l")).groupBy("tok").agg(
        *[F.count(F.when(F.col("_l") == k, F.lit(1))).alias(f"_n{k}") for k in labels])
    totals = counts.agg(F.struct(F.count(F.lit(1)).alias("v"), *[
        F.coalesce(F.sum(f"_n{k}"), F.lit(0)).alias(f"t{k}") for k in labels])).scalar()
    scored = words(rows, id_col).join(counts, "tok", "left").groupBy(id_col).agg(*[
        F.round(-F.avg(F.log((F.coalesce(F.col(f"_n{k}"), F.lit(0)) + 1)
                             / F.greatest(totals[f"t{k}"] + totals["v"], F.lit(1)))), 6).alias(f"_s{k}")
        for k in labels])
    return scored.select(id_col, F.array_min(F.array(*[
        F.struct(F.col(f"_s{k}").alias("s"), F.lit(k).alias("l")) for k in labels]))["l"].alias("label"))


# --- G2: loss of one example ---------------------------------------------------------

def example_loss(labels: Column, logprobs: Column) -> Column:
    """Mean of ``-logprob`` over positions 2..n whose label is not -100
    (the shifted causal-LM loss); no target at all gives NaN."""
    n = F.greatest(F.size(labels) - 1, F.lit(0))
    m = F.greatest(F.size(logprobs) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(labels, 2, n), F.slice(logprobs, 2, m),
                       lambda l, p: F.struct(l.alias("l"), p.alias("p")))
    kept = F.filter(pairs, lambda x: x["l"] != F.lit(IGNORE_INDEX))
    total = F.aggregate(kept, F.lit(0.0).cast("double"), lambda acc, x: acc + x["p"])
    return F.when(F.size(kept) == 0, F.lit(float("nan"))).otherwise(-total / F.size(kept))


# --- X1-X3: answers ----------------------------------------------------------------------

def py_strip(s: Column) -> Column:
    """Python's ``str.strip()`` (every Unicode white space, incl. U+3000)."""
    return F.btrim(s, F.lit(PY_WHITESPACE))


def answer_after_first(s: Column, marker: str, strict: bool = False) -> Column:
    """Text between the first and the second marker, stripped; absent
    marker -> null (or a job failure when strict)."""
    found = py_strip(F.split_part(s, F.lit(marker), F.lit(2)))
    other = (F.raise_error(F.lit(f"marker {marker!r} not in the reply")).cast("string")
             if strict else F.lit(None).cast("string"))
    return F.when(F.contains(s, F.lit(marker)), found).otherwise(other)


def answer_after_last(s: Column | str, marker: str) -> Column:
    """Text after the last marker, stripped; absent marker keeps the text."""
    s = F.col(s) if isinstance(s, str) else s
    return py_strip(F.split_part(s, F.lit(marker), F.lit(-1)))


# --- M1-M5: metrics --------------------------------------------------------------------

def is_correct(expected: Column, generated: Column) -> Column:
    """Expected text occurs in the generated text (case-sensitive); null is wrong."""
    return F.coalesce(F.contains(generated, expected), F.lit(False))


def pair(expected: DataFrame, generated: DataFrame, id_col: str = "id") -> DataFrame:
    """M3: expected and generated side by side, matched on the row id."""
    return expected.join(generated, id_col, "inner")


def accuracy(expected: Column, generated: Column) -> Column:
    """M1 as an aggregate expression: share of correct rows (null on no rows)."""
    return F.avg(is_correct(expected, generated).cast("double"))


def perplexity(loss: Column, skip_nan: bool = False) -> Column:
    """M2: exp of the mean per-example loss (each example weighs the same).
    An example without any target has a NaN loss, which makes the result NaN
    unless ``skip_nan`` leaves such examples out of the mean."""
    if skip_nan:
        loss = F.when(~F.isnan(loss), loss)
    return F.exp(F.avg(loss))


def choice_share(generated: Column, choices) -> Column:
    """M5: share of replies that are exactly one of the allowed choices."""
    return F.avg(F.coalesce(generated.isin(list(choices)), F.lit(False)).cast("double"))


def report(df: DataFrame, task: str, value: Column, digits: int) -> DataFrame:
    """M4: one row: task, row count, metric rounded."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                  F.round(value, digits).alias("value")).select(
        F.lit(task).alias("task"), "n", "value")

