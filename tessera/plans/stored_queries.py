"""Registered queries of sources, sinks and jobs that write and read back: JSON array files
(S1), stored results (S5, K1, K2), the scoring job (G1) and the order of a growing table (W3,
W6). What they write lies below ``spark.checkpoint.dir``, in a new folder per run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls as K
from ..operators import scoring as S
from ..operators.growing import GrowingOrder
from ..session import checkpoint_dir
from ..sources import readers, sinks, tables
from . import queries as Q
from .registry import register

APPENDS = 3        # parts in which the documents arrive
VAL_GROWING = 20   # validation rows of the growing table (fewer than its first part at the smallest scale)
CALL_TOKENS = 16_384


def _folder(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"


# --- S1: array files ---------------------------------------------------------------------


@register("inst_array_files", sql=Q._with(tables.INST_SQL) + "select id, instruction, input, output from inst")
def inst_array_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instruction records written as JSON array files and read back, with their own ids."""
    path = f"{_folder(spark, 'arrays')}/records.json"
    sinks.write_json_arrays(tables.inst(spark, sf_dir).select("id", "instruction", "input", "output"), path)
    return readers.read_instructions(spark, path)


# --- S5, K1, K2: stored results --------------------------------------------------------------


@register("qa_stored", sql="""
select u.text as question, a.text as answer from conversations u left join conversations a
  on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
where u.role = 'user'""")
def qa_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + K1: question-answer records built once as JSON lines; the second call reads the stored result."""
    path, qa = _folder(spark, "qa"), Q.qa_flatten(spark, sf_dir)
    readers.materialize_once(qa, path)
    return readers.materialize_once(qa.limit(0), path, schema=qa.schema)


@register("nli_result_file", sql=Q._with(tables.NLI_SQL, Q.NLI_ZERO_SQL, Q.GEN_SQL) +
          "select expected as ground, answer as generated from ans")
def nli_result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the ``ground, generated`` result file of the inference task, read back."""
    ans = Q._nli_answers(spark, sf_dir)
    path = sinks.write_results(ans.select(F.col("expected").alias("ground"), F.col("answer").alias("generated")),
                               _folder(spark, "results"), "jnli", "model")
    stored = spark.read.schema("ground string, generated string").option("header", True).option(
        "escape", '"').option("multiLine", True).csv(path)
    return stored.select(*[F.coalesce(c, F.lit("")).alias(c) for c in stored.columns])


# --- G1: the scoring job -----------------------------------------------------------------------

# width classes, widest first, and the greedy walk over them: a class fills the open call, then
# opens calls of its own
CALLS_SQL = f"""len as (select id, len(ids) as n, greatest(8, (len(ids) + 7) // 8 * 8) as w from masked),
class as (select w, count(*) as c, greatest(1, {CALL_TOKENS} // w) as per, row_number() over (order by w desc) as k
          from len group by w),
walk as (
  with recursive walk as (
    select 0::bigint as k, 0::bigint as w, 0::bigint as joined, -1::bigint as open, 0::bigint as open_w, 0::bigint as per,
           -1::bigint as call, 0::bigint as room, 0::bigint as call_w
    union all
    select class.k, class.w, least(c, room), call, call_w, class.per,
           call + (c - least(c, room) + class.per - 1) // class.per,
           case when c > room then (c - room + class.per - 1) // class.per * class.per - (c - room) else room - c end,
           case when c > room then class.w else call_w end
    from walk join class on class.k = walk.k + 1)
  select * from walk where k > 0),
placed as (select id, n, w, row_number() over (partition by w order by md5(id || ':42'), id) as place from len),
called as (
  select id, n, case when place <= joined then open else open + 1 + (place - joined - 1) // per end as call,
         case when place <= joined then open_w else placed.w end as call_w
  from placed join walk on walk.w = placed.w)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.token_budget_calls(Q._vqa_tokens(spark, sf_dir), "id", F.size("input_ids"), CALL_TOKENS)


@register("scoring_calls", sql=Q._with(tables.INST_SQL, Q.VQA_TOK_SQL, CALLS_SQL) + """
select cast(call as bigint) as call, cast(count(*) as bigint) as n, cast(sum(call_w) as bigint) as padded_tokens,
       cast(sum(n) as bigint) as real_tokens from called group by call""")
def scoring_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: the calls of the scoring job under a budget of padded tokens."""
    return _calls(spark, sf_dir).groupBy("call").agg(
        F.count(F.lit(1)).alias("n"), F.sum("call_width").alias("padded_tokens"),
        F.sum(F.size("input_ids")).cast("bigint").alias("real_tokens"))


@register("scored_losses", sql=Q._with(tables.INST_SQL, Q.VQA_TOK_SQL, CALLS_SQL) + """
select losses.id, cast(call as bigint) as call, round(loss, 6) as loss from losses join called on called.id = losses.id""")
def scored_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 + G2: the scoring job with the count model as its scorer, one model call per budget call."""
    table, _ = S.count_model(Q._vqa_tokens(spark, sf_dir))
    # a row per token of the encoder's vocabulary at most
    scorer = S.CountScorer({r["tok"]: r["logprob"] for r in table.select("tok", "logprob").collect()})
    return K.score_calls(_calls(spark, sf_dir), scorer).select("id", "call", F.round("loss", 6).alias("loss"))


# --- W3, W6: a table that grows --------------------------------------------------------------


def _grown(spark: SparkSession, sf_dir: str) -> tuple[GrowingOrder, list[int]]:
    docs = tables.documents(spark, sf_dir).select("doc_id")
    order = GrowingOrder(spark, _folder(spark, "order"), "doc_id", Q.SEED)
    return order, [order.append(docs.filter(F.pmod("doc_id", F.lit(APPENDS)) == i)) for i in range(APPENDS)]


@register("rank_appended", sql=f"""
with p as (select doc_id, (doc_id % {APPENDS} + {APPENDS}) % {APPENDS} as part from documents),
a as (""" + " union all ".join(
    f"select doc_id, arrived from (select doc_id, part, {Q._rank_sql('doc_id')} as arrived from p where part <= {i}) where part = {i}"
    for i in range(APPENDS)) + f""")
select r.doc_id, cast(a.arrived as bigint) as arrived, cast(r.rank as bigint) as rank
from (select doc_id, {Q._rank_sql('doc_id')} as rank from documents) r join a on a.doc_id = r.doc_id""")
def rank_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6 over a growing table: every document's exact rank when it was appended, and at the end."""
    order, parts = _grown(spark, sf_dir)
    arrived = None
    for part in parts:
        here = order.ranks(part).withColumnRenamed("rank", "arrived")
        arrived = here if arrived is None else arrived.unionByName(here)
    return arrived.join(order.ranks(), "doc_id").select("doc_id", "arrived", "rank")


@register("split_appended", sql=f"""
select doc_id, case when {Q._rank_sql('doc_id')} <= {VAL_GROWING} then 'validation' else 'train' end as split
from documents""")
def split_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 over a growing table: the split that follows from the changes of every append."""
    order, parts = _grown(spark, sf_dir)
    changes = None
    for part in parts:
        here = order.split_changes(VAL_GROWING, part).withColumn("part", F.lit(part))
        changes = here if changes is None else changes.unionByName(here)
    return changes.groupBy("doc_id").agg(F.max_by("split", "part").alias("split"))
