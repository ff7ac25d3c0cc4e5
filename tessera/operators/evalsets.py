"""Evaluation sets: renames (R4-R6), label words (R7), inference prompts
(R8-R10), few-shot choice and text (W1, W2), split and label filters (S2, F1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.templates import fill, parse_format

# ---------------------------------------------------------------------------
# The inference task's prompt, its few-shot example block, the
# label words and the response markers. The text must equal the reference's
# to the character. Few-shot examples always use the Japanese marker and
# Japanese label words, whatever the final marker's language.
# ---------------------------------------------------------------------------
NLI_LABEL_WORDS = {0: "含意", 1: "矛盾", 2: "中立"}
NLI_PROMPT = "以下の前提文と仮説文のペアに対して，前提文が仮説文に対してもつ推論関係を、「含意」「矛盾」「中立」のいずれかから答えてください。\n\n{example}### 前提文:\n{input1}\n### 仮説文:\n{input2}\n{response}"
NLI_SHOT = "### 前提文:\n{sentence1}\n### 仮説文:\n{sentence2}\n### 返答:\n{label}\n\n"
RESPONSE_MARKERS = {"en": "### Response:\n", "ja": "### 返答:\n"}


def response_marker(language: str) -> str:
    """Response marker of the inference prompt (newline included)."""
    if language not in RESPONSE_MARKERS:
        raise ValueError(f"no response marker for language {language!r}")
    return RESPONSE_MARKERS[language]


def label_word(label: Column, strict: bool = True) -> Column:
    """Integer label -> word; an unknown label fails the job when strict,
    else gives null."""
    expr = None
    for k, word in NLI_LABEL_WORDS.items():
        expr = (F.when(label == F.lit(k), F.lit(word)) if expr is None
                else expr.when(label == F.lit(k), F.lit(word)))
    other = (F.raise_error(F.concat(F.lit("unknown label "), label.cast("string")))
             if strict else F.lit(None))
    return expr.otherwise(other.cast("string"))


def select_split(df: DataFrame, split: str, col: str = "split") -> DataFrame:
    """One named split (a pushed-down filter; a partition prune when the
    table is stored with ``split=`` directories)."""
    return df.filter(F.col(col) == F.lit(split))


def filter_label(df: DataFrame, label: int, col: str = "label") -> DataFrame:
    """rows of one label."""
    return df.filter(F.col(col) == F.lit(label))


def rename_qa_to_eval(df: DataFrame) -> DataFrame:
    """question/answer -> prompts/expected."""
    return df.withColumnsRenamed({"question": "prompts", "answer": "expected"})


def rename_eval_to_instruction(df: DataFrame) -> DataFrame:
    """prompts/expected -> instruction/output."""
    return df.withColumnsRenamed({"prompts": "instruction", "expected": "output"})


def empty_input(df: DataFrame, col: str = "input") -> DataFrame:
    """The input column set to the empty string."""
    return df.withColumn(col, F.lit(""))


def require_columns(df: DataFrame, cols=("prompts", "expected")) -> DataFrame:
    """Contract of the scoring job: the table must carry these columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"table must have {list(cols)}; missing {missing}")
    return df


def few_shot_text(train: DataFrame, shot: int, order_col: str = "sentence_pair_id") -> Column:
    """W1 + W2: the few-shot block as a scalar subquery (one value).

    Example ``i`` (0-based) is the ``i // 3``-th row of label ``i % 3`` in
    ``order_col`` order. Per label only the first ``ceil(shot / 3)`` rows
    survive the window (Spark plans a partial ``WindowGroupLimit`` before the
    shuffle, so a label holding most rows still moves a handful of rows).
    Fewer examples than asked fails the job.
    """
    if shot <= 0:
        return F.lit("")
    per = (shot + 2) // 3
    w = Window.partitionBy("label").orderBy(F.col(order_col))
    picked = (train.select(order_col, "label", "sentence1", "sentence2")
              .filter(F.col("label").isin(*NLI_LABEL_WORDS))   # other labels are no examples
              .withColumn("_rn", F.row_number().over(w))
              .filter(F.col("_rn") <= per)
              .withColumn("_i", (F.col("_rn") - 1) * 3 + F.col("label"))
              .filter(F.col("_i") < shot))
    parts = parse_format(NLI_SHOT)
    block = fill(parts, {"sentence1": F.col("sentence1"), "sentence2": F.col("sentence2"),
                         "label": label_word(F.col("label"))})
    agg = picked.agg(
        F.count_distinct("_i").alias("_n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_i"), block.alias("t")))),
                                 lambda x: x["t"]), "").alias("_text"))
    checked = agg.select(F.when(F.col("_n") < F.lit(shot), F.raise_error(F.concat(
        F.lit(f"{shot} shots asked, the train split has only "), F.col("_n").cast("string"),
        F.lit(" usable examples")))).otherwise(F.col("_text")).alias("shots"))
    return checked.scalar()


def nli_prompt(sentence1: Column, sentence2: Column, response: str,
               example: Column | None = None) -> Column:
    """The inference prompt of one pair."""
    return fill(parse_format(NLI_PROMPT), {
        "example": example if example is not None else F.lit(""),
        "input1": sentence1, "input2": sentence2, "response": F.lit(response)})


def nli_eval_set(pairs: DataFrame, shot: int = 0, language: str = "ja",
                 id_col: str = "sentence_pair_id") -> DataFrame:
    """R7-R10 + W1/W2: validation pairs -> (id, prompts, expected)."""
    response = response_marker(language)
    train = select_split(pairs, "train")
    val = select_split(pairs, "validation")
    example = few_shot_text(train, shot, id_col) if shot > 0 else None
    return val.select(id_col,
                      nli_prompt(F.col("sentence1"), F.col("sentence2"), response, example)
                      .alias("prompts"),
                      label_word(F.col("label")).alias("expected"))
