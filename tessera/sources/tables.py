"""Reading the driver tables and deriving the record shapes the operators take.

Each derived view exists twice: as a DataFrame (what the library runs) and as
an ANSI SQL common table expression (what the DuckDB oracle runs). Both read
whole tables; nothing is sampled, capped or cut.

* ``inst``: instruction records. A user turn followed by an assistant turn is
  one record; the conversation's system text is its input.
* ``nli``: sentence pairs with three labels. Every pair of consecutive lines of
  a labelled document is one pair (premise, hypothesis); the label is
  ``quality + toxic``; documents with an even id form the train split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path

# record id: "conv_id:turn"; pair id: "doc_id:line position"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def inst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction records (id, instruction, input, output, conv_id, turn).

    The next turn is found by an equi-join on (conv_id, turn + 1), a unique
    key, so a very long conversation spreads over many tasks (a window
    partitioned by conversation would put it in one). The system text joins
    on conv_id after a partial+final aggregate; AQE splits a hot conversation.
    """
    conv = read_table(spark, sf_dir, "conversations")
    user = conv.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    nxt = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    system = (conv.filter(F.col("role") == "system").groupBy("conv_id")
              .agg(F.min_by("text", "turn").alias("sys")))
    pairs = user.join(nxt, ["conv_id", "turn"], "inner")
    return pairs.join(system, "conv_id", "left").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"),
        F.col("text").alias("instruction"),
        F.coalesce(F.col("sys"), F.lit("")).alias("input"),
        F.col("reply").alias("output"),
        "conv_id", "turn")


INST_SQL = """inst as (
  select u.conv_id::varchar || ':' || u.turn::varchar as id, u.text as instruction,
         coalesce(s.sys, '') as input, a.text as output, u.conv_id, u.turn
  from conversations u
  join conversations a
    on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
  left join (select conv_id, arg_min(text, turn) as sys from conversations
             where role = 'system' group by conv_id) s on s.conv_id = u.conv_id
  where u.role = 'user')"""


def nli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence pairs (sentence_pair_id, doc_id, sentence1, sentence2, label, split).

    Documents join their labels first (one row per document), then the line
    pairs are produced by one projection and an explode: no self-join.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") + F.col("toxic")).cast("int").alias("label"))
    lines = F.split(F.col("text"), "\n")
    n = F.size(lines) - 1
    pairs = F.zip_with(F.slice(lines, 1, n), F.slice(lines, 2, n),
                       lambda a, b: F.struct(a.alias("s1"), b.alias("s2")))
    return (docs.join(labels, "doc_id", "inner")
            .select("doc_id", "label", F.posexplode(
                F.when(n > 0, pairs).otherwise(F.array().cast(
                    "array<struct<s1:string,s2:string>>"))).alias("pos", "p"))
            .select(F.concat_ws(":", "doc_id", "pos").alias("sentence_pair_id"),
                    "doc_id",
                    F.col("p.s1").alias("sentence1"), F.col("p.s2").alias("sentence2"),
                    "label",
                    F.when(F.col("doc_id") % 2 == 0, F.lit("train"))
                    .otherwise(F.lit("validation")).alias("split")))


NLI_SQL = """nli_docs as (
  select d.doc_id, string_split(d.text, chr(10)) as ls,
         cast(l.quality + l.toxic as integer) as label
  from documents d join labels l on l.doc_id = d.doc_id),
nli as (
  select doc_id::varchar || ':' || (i - 1)::varchar as sentence_pair_id, doc_id,
         ls[i] as sentence1, ls[i + 1] as sentence2, label,
         case when doc_id % 2 = 0 then 'train' else 'validation' end as split
  from (select doc_id, ls, label, unnest(range(1, len(ls))) as i from nli_docs))"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")
