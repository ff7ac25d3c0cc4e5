"""The queries of this subpackage: each applies one operator, with production
parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table_path
from . import (bpe, crf, exact_dedup, html_text, importance, itq, maxent, minhash, nra, packing, repair,
               suffix_dedup, token_files)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def vocabulary(name: str) -> str:
    """The text of a public tokenizer file (a bounded definition, sent to the tasks)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@_query("op1_maxent")
def op1_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_table(spark, sf_dir, "documents"))


@_query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(_table(spark, sf_dir, "documents"),
                                      vocabulary("word_bpe_49k.json"), end_id=1)


@_query("op3_superminhash")
def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


@_query("op4_itq", itq.ORACLE_SQL)
def op4_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.link_vectors(_table(spark, sf_dir, "embeddings"))


@_query("op5_best_fit")
def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"),
                                  vocabulary("byte_bpe_50k.json"), end_id=0, max_tokens=2048)


@_query("op6_importance")
def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.select(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op7_bpe_round_trip")
def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@_query("op8_bloom_dedup", exact_dedup.ORACLE_SQL)
def op8_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


@_query("op9_text_density")
def op9_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


@_query("op10_suffix_repeats")
def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


@_query("op11_crf")
def op11_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.identify(_table(spark, sf_dir, "documents"))


@_query("op12_nra", nra.ORACLE_SQL)
def op12_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


@_query("op13_survivor_viterbi")
def op13_survivor_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(_table(spark, sf_dir, "conversations"))
