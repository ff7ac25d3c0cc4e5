"""Evaluation jobs: inference accuracy and perplexity.

Inference task (accuracy):

    pairs -> prompts (R7-R10, few-shot W1/W2) -> encode + guard (T7, F3) ->
    scoring job (G1) -> answer after the last marker (X2/X3) -> pair by id (M3)
    -> accuracy report (M1/M4) and the ``ground, generated`` result file (K2)

Perplexity task:

    question/answer rows -> renames (R4, R5), empty input (R6) -> question
    template (R1, R3) -> records without truncation, prompt masked (T5/T6) ->
    guard (F2) -> loss per example (G1 scorer with a ``loss`` column, or the
    count model G3/G2) -> exp of the mean (M2/M4)
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.templates import evaluation_template
from ..functions.tokens import CodePoints, Encoder, get_encoder
from ..operators import evalsets as E
from ..operators import guards as G
from ..operators import scoring as S
from ..operators.tokenize import tokenize_records
from ..sources.sinks import write_results

MAX_LENGTH = 256
NEW_TOKENS = 5


def _job_guard(mode: str) -> str:
    """Jobs score what the guard lets through; a mere flag would be lost on the way."""
    if mode not in ("fail", "drop"):
        raise ValueError(f"guard must be 'fail' or 'drop' in a job, not {mode!r}")
    return mode


def nli_accuracy_job(pairs: DataFrame, scorer: S.Scorer, shot: int = 0, language: str = "ja",
                     encoder: Encoder | None = None, max_length: int = MAX_LENGTH,
                     new_tokens: int = NEW_TOKENS, guard: str = "fail",
                     save_dir: str | None = None, model_path: str = "model",
                     lora: bool = False, id_col: str = "sentence_pair_id"):
    """Returns (report, results); writes the results file when ``save_dir`` is given."""
    enc = encoder or CodePoints()
    marker = E.response_marker(language)
    ev = E.require_columns(E.nli_eval_set(pairs, shot, language, id_col))
    checked = G.length_guard(ev.withColumn("input_ids", enc.encode(F.col("prompts"))),
                             max_length, reserve=new_tokens, mode=_job_guard(guard))
    gen = S.score(checked.drop("input_ids"), scorer, id_col=id_col, passthrough=["expected"])
    paired = gen.withColumn("answer", S.answer_after_last(F.col("generated"), marker))
    if save_dir:      # the model runs once: the report and the CSV read the stored replies
        stored = f"{save_dir.rstrip('/')}/replies-{uuid.uuid4().hex}.parquet"
        paired.write.parquet(stored)
        paired = paired.sparkSession.read.parquet(stored)
    report = S.report(paired, "jnli", S.accuracy(F.col("expected"), F.col("answer")), 4)
    results = paired.select(F.col("expected").alias("ground"), F.col("answer").alias("generated"))
    if save_dir:
        write_results(results, save_dir, "jnli", model_path, lora)
    return report, results


def perplexity_records(qa: DataFrame, language: str = "en", encoder: Encoder | None = None,
                       max_length: int = MAX_LENGTH, guard: str = "fail",
                       id_col: str = "id") -> DataFrame:
    """Question/answer rows -> masked token records of the perplexity task."""
    ev = E.require_columns(E.rename_qa_to_eval(qa))
    recs = E.empty_input(E.rename_eval_to_instruction(ev))
    tok = tokenize_records(recs, evaluation_template(language), encoder or CodePoints(),
                           cutoff_len=None, train_on_inputs=False, truncation=False,
                           keep=[id_col])
    return G.length_guard(tok, max_length, mode=_job_guard(guard))


def perplexity_job(qa: DataFrame, scorer: S.Scorer | None = None, language: str = "en",
                   encoder: Encoder | None = None, max_length: int = MAX_LENGTH,
                   guard: str = "fail", id_col: str = "id") -> DataFrame:
    """Perplexity report. ``scorer`` must add a ``loss double`` column from
    ``input_ids`` and ``labels``; without one the count model scores."""
    tok = perplexity_records(qa, language, encoder, max_length, guard, id_col)
    if scorer is None:
        _, losses = S.count_model(tok, id_col)
    else:
        losses = S.score(tok, scorer, id_col=id_col)
    return S.report(losses, "ppl-vqa", S.perplexity(F.col("loss")), 6)


def load_scorer(spec: str, **options) -> S.Scorer:
    """``package.module:ClassName`` -> an instance of that Scorer subclass."""
    import importlib

    mod, _, cls = spec.partition(":")
    scorer = getattr(importlib.import_module(mod), cls)(**options)
    if not isinstance(scorer, S.Scorer):
        raise TypeError(f"{spec} is not a Scorer")
    return scorer


def main(argv=None) -> None:
    """Command line: accuracy of the inference task or perplexity of QA pairs.

    python -m tessera.plans.evaluation --task jnli --data pairs.parquet \\
        --scorer mypkg.models:MyScorer --shot 3 --format-lang ja --save-dir out/
    python -m tessera.plans.evaluation --task ppl-vqa --data question_answers.json
    """
    import argparse

    from pyspark.sql import SparkSession

    from ..sources.readers import PAIR_SCHEMA, QA_SCHEMA, read_instructions, read_json_records, read_nested_qa

    ap = argparse.ArgumentParser(description="evaluation jobs")
    ap.add_argument("--task", choices=["jnli", "ppl-vqa"], required=True)
    ap.add_argument("--data", required=True,
                    help="jnli: pairs (parquet/json) with a split column; ppl-vqa: nested QA JSON "
                         "or a flat question/answer table")
    ap.add_argument("--scorer", help="package.module:ScorerClass (jnli: required; "
                                     "ppl-vqa: default is the count model)")
    ap.add_argument("--shot", type=int, default=0)
    ap.add_argument("--format-lang", choices=["ja", "en"], default="ja")
    ap.add_argument("--encoder", default="codepoint", help="the guards count its tokens")
    ap.add_argument("--max-length", type=int, default=MAX_LENGTH)
    ap.add_argument("--new-tokens", type=int, default=NEW_TOKENS,
                    help="tokens that the jnli guard keeps free for the answer")
    ap.add_argument("--guard", choices=["fail", "drop"], default="fail")
    ap.add_argument("--save-dir", default=None)
    ap.add_argument("--model-path", default="model")
    ap.add_argument("--lora", action="store_true")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"tessera-eval-{args.task}").getOrCreate()
    if args.task == "jnli":
        if not args.scorer:
            ap.error("--scorer is required for jnli")
        pairs = (spark.read.parquet(args.data) if not args.data.endswith((".json", ".jsonl"))
                 else read_json_records(spark, args.data, PAIR_SCHEMA))
        report, _ = nli_accuracy_job(pairs, load_scorer(args.scorer), args.shot, args.format_lang,
                                     get_encoder(args.encoder), max_length=args.max_length,
                                     new_tokens=args.new_tokens, guard=args.guard,
                                     save_dir=args.save_dir, model_path=args.model_path,
                                     lora=args.lora)
    else:
        if args.data.endswith(".json"):
            qa = read_nested_qa(spark, args.data)
        else:
            qa = read_instructions(spark, args.data, QA_SCHEMA)
        from .training import with_record_id
        qa = with_record_id(qa)
        scorer = load_scorer(args.scorer) if args.scorer else None
        report = perplexity_job(qa, scorer, args.format_lang, get_encoder(args.encoder),
                                max_length=args.max_length, guard=args.guard)
    for r in report.collect():
        print(f"{r.task}: n={r.n} value={r.value}")


if __name__ == "__main__":
    main()
