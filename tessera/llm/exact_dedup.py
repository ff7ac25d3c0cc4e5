"""Exact deduplication by two-pass Bloom filtering.

Pass 1 digests every whole normalised text (SHA-256) and counts, per filter
position, how often it was hit; positions hit at least twice form a bounded bitmap
of possibly repeated texts. Pass 2 probes it: rows that cannot repeat pass straight
through, and only the others are shuffled and grouped by their digest.

Texts are equal when identical after each run of white space (space, tab to carriage
return) is replaced by one space. Null text counts as empty. Of equal texts the row
with the smallest id stays; in ``exact_groups``, which tells of documents, rows that
repeat an id and a text all carry the same decision. Rows with a null id never stay before
a row with an id (nulls only: all stay). ``drop_copies`` leaves exactly one row of each
text. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ROW, first_rows, inner, materialize, unpacked, whole_rows

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    digests = materialize(docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalized(F.col(text_col)), 256).alias("text_sha256")), "digests")
    log2 = bloom.log2_bits(digests.count())
    key = F.xxhash64("text_sha256")
    repeated = bloom.build_repeated(digests.select(key.alias("_k")), "_k", log2)
    probed = bloom.probe(digests, key, repeated, log2, "maybe")
    maybe = probed.filter("maybe")
    # sizes per text are summed in each task first; the written table lets a text
    # with very many copies be split over tasks in the join
    groups = materialize(maybe.groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    shuffled = maybe.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256")
    straight = probed.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    return straight.unionByName(shuffled)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, per text: the row of the smallest id. Only rows whose
    text may repeat are written and numbered; all others pass straight through."""
    digested = whole_rows(docs).withColumn("digest", F.sha2(normalized(F.col(inner(text_col))), 256))
    key = F.xxhash64("digest")
    keys = materialize(digested.select(key.alias("_k")), "digest-keys")
    log2 = bloom.log2_bits(keys.count())
    probed = bloom.probe(digested, key, bloom.build_repeated(keys, "_k", log2), log2, "maybe")
    maybe = materialize(probed.filter("maybe").withColumn(ROW, F.monotonically_increasing_id()), "maybe-copies")
    first = materialize(first_rows(maybe, "digest", inner(id_col)), "first-copies")
    return unpacked(probed.filter("not maybe").select("row").unionByName(
        bloom.drop_ids(maybe, ROW, first, drop=False).select("row")))


ORACLE_SQL = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t
  from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id,
       count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept,
       sha256(t) as text_sha256
from n
"""
