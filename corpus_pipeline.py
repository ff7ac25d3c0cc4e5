"""Corpus pipeline: documents -> selected, deduplicated, packed training sequences.

Each stage is a function of ``(spark, docs, sf_dir)``; all but the last return the columns
of ``documents``, the last one row per packed piece. Every row is a document of its own: the
first three stages decide and drop by row, so of rows that share an id each stands for
itself, rows with null ids are dropped like any other, and one row of each text or group
stays. Stages take null text as empty and give empty results on empty tables. What a stage writes on
its way is deleted when the next one begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, importance, minhash, packing, suffix_dedup
from tessera.llm.common import begin_stage, delete_path, end_stages, scratch_path
from tessera.llm.queries import vocabulary
from tessera.session import table_path


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the labelled good documents; rejected rows go."""
    begin_stage(docs, "selection")
    return importance.keep_selected(docs, spark.read.parquet(table_path(sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space normalised) the smallest id stays."""
    begin_stage(docs, "exact")
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at similarity 0.8 stays."""
    begin_stage(docs, "near")
    return minhash.drop_near_duplicates(docs, words=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere too are cut out of the texts."""
    begin_stage(docs, "passages")
    return suffix_dedup.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed into sequences."""
    begin_stage(docs, "packing")
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0, max_tokens=2048)


STAGES = [
    ("quality selection", select_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("repeated passages", drop_repeated_passages),
    ("best-fit packing", pack),
]

ORACLE_SQL = None   # SQL cannot express the models and the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; each stage's result is written to the
    shared folder and read again by the next, and deleted once that one's is written."""
    docs, stored = spark.read.parquet(table_path(sf_dir, "documents")), None
    end_stages(spark)
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        end = scratch_path(spark, "result")
        path = f"{end.rsplit('/', 2)[0]}/result-{name.replace(' ', '-')}-{end.rsplit('-', 1)[1]}"
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if stored:
            delete_path(spark, stored)
        stored = path
    packed = STAGES[-1][1](spark, docs, sf_dir)
    end_stages(spark)
    return packed
