"""Training data job: instruction records -> tokenized, split, shuffled,
padded batches written as parquet.

    read (S1) -> exact split + shuffle (W3/W5, one ranking pass) ->
    render + encode + end-of-text + mask (T5, after the shuffle so the shuffle
    moves text) -> batches + left padding (B1/B2) -> parquet, one folder per
    split, each file sorted by position (whole runs of positions per file).

Usable as a library call or from the command line:

    python -m tessera.plans.training --data records.jsonl --out /shared/batches \
        --micro-batch-size 16 --devices 2 --cutoff-len 256
"""

from __future__ import annotations

import argparse
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions.templates import Template, training_template
from ..functions.tokens import Encoder, get_encoder
from ..operators import batches as B
from ..operators import order as O
from ..operators.evalsets import select_split
from ..operators.tokenize import cut_fields, tokenize_records
from ..sources.readers import read_instructions

VAL_SET_SIZE = 2000   # validation rows of the training job
SPLIT_SEED = 42       # seed of its split


COPIES = 100_000      # copies of one record that one task writes out


def _path_below_root(df: DataFrame) -> Column:
    """The source file's path below the deepest folder that holds all files of ``df``."""
    paths = [re.sub("^[^:/]+:/+", "/", f) for f in df.inputFiles()]
    root = os.path.commonpath([os.path.dirname(p) for p in paths]) if paths else "/"
    here = F.regexp_replace(F.col("_metadata.file_path"), "^[^:/]+:/+", "/")
    return F.substr(here, F.lit(len(root.rstrip("/")) + 2))


def with_record_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Give records read from files a deterministic id that depends on neither the folder
    nor the partition layout, and that is unique, so that a record a corpus repeats very
    often still spreads over all buckets. Parquet: the file's path below the folder that all
    files share, row index and content hash (call it on the DataFrame as read, before any
    shuffle). Formats without a row index:
    content hash and number of the copy; copies are counted (summed in the tasks first)
    and written out again in runs of ``COPIES``, so a hot record is no hot group."""
    if id_col in df.columns:
        return df
    content = F.md5(F.to_json(F.struct(*df.columns)))
    try:
        return df.withColumn(id_col, F.concat_ws(":", _path_below_root(df), F.col(
            "_metadata.row_index").cast("string"), content))
    except AnalysisException:      # no row index in this format
        pass
    groups = df.groupBy(content.alias("_content")).agg(
        F.first(F.struct(*df.columns)).alias("_row"), F.count(F.lit(1)).alias("_n"))
    runs = groups.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                        F.floor((F.col("_n") - 1) / COPIES))))
    dealt = runs.filter(F.col("_n") <= COPIES).union(
        runs.filter(F.col("_n") > COPIES).repartition("_content", "_k"))
    return dealt.withColumn("_copy", F.explode(F.sequence(
        F.col("_k") * COPIES + 1, F.least((F.col("_k") + 1) * COPIES, F.col("_n"))))).select(
        "_row.*", F.concat_ws(":", "_content", "_copy").alias(id_col))


def training_batches(records: DataFrame, template: Template, encoder: Encoder,
                     cutoff_len: int | None, micro_batch_size: int, devices: int = 1,
                     val_set_size: int = VAL_SET_SIZE, seed: int | str = SPLIT_SEED,
                     shuffle_seed: int | str | None = None, train_on_inputs: bool = True,
                     pad_id: int | None = None, id_col: str = "id",
                     group_by_length: bool = False, split: str | None = None) -> DataFrame:
    """The whole training data plan as one lazy DataFrame with columns
    ``id, split, position, batch, width, input_ids, attention_mask, labels``.

    ``group_by_length`` (off by default, as in the training job) orders the
    train split by the length-grouped rule (B3) before batching, as a
    length-grouped training sampler does; validation keeps the shuffled order.
    ``split`` keeps one split of a dataset that has a split column (S2).
    """
    recs = with_record_id(records, id_col)
    if split is not None:
        recs = select_split(recs, split)
    recs = recs.select(id_col, "instruction", "input", "output")
    recs = cut_fields(recs, encoder, cutoff_len)     # the shuffle moves no more than is used
    order = O.exact_split(recs, id_col, val_set_size, seed, shuffle_seed=shuffle_seed)
    order = order.derive(lambda d: tokenize_records(
        d, template, encoder, cutoff_len=cutoff_len, train_on_inputs=train_on_inputs,
        keep=[id_col, "split", "position", "_bucket"]))
    pad = pad_id if pad_id is not None else encoder.pad_id
    if pad is None:
        raise ValueError(f"encoder {encoder.name} has no pad id; pass pad_id")
    size = B.device_batch_size(micro_batch_size, devices)
    cols = [id_col, "split", "position", "batch", "width", "input_ids", "attention_mask", "labels"]
    out = B.pad_batches(order, size, pad_id=pad)
    if not group_by_length:
        return out.select(*cols)
    return out.filter(F.col("split") == "validation").select(*cols).unionByName(
        _grouped_train(order, size, pad, id_col).select(*cols))


def _grouped_train(order: O.ExactOrder, size: int, pad: int, id_col: str) -> DataFrame:
    """Train rows in length-grouped order, batched and left-padded. Only ranks and lengths are
    regrouped; the new places go back to the rank buckets as one row per bucket, which the
    records, still partitioned by bucket, join without moving. Mega-batches hold
    at most 50 batches, so the windows over them and over a batch are bounded."""
    from pyspark.sql import Window

    train_off = order.offsets.filter(F.col("split") == "train")
    train_off = train_off.withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    records = order.ranked.filter(F.col("split") == "train")
    lengths = records.select("_bucket", order.rank_col, F.size("input_ids").alias("_li"), F.size("labels").alias("_ll"))
    grouped = B.length_grouped_order(O.ExactOrder(lengths, train_off, order.rank_col, (), order.digits),
                                     size, F.col("_li"), out_col="_g")
    w = Window.partitionBy("batch")
    placed = grouped.withColumn("batch", B.batch_of(F.col("_g"), size)).select(
        "_bucket", F.struct(F.col(order.rank_col).alias("r"), F.col("_g").alias("position"), "batch",
                            B.round_up(F.max("_li").over(w), 8).alias("width"),
                            B.round_up(F.max("_ll").over(w), 8).alias("lwidth")).alias("_p"))
    # a bucket's ranks follow each other, so a place is found by its index
    per_bucket = placed.groupBy("_bucket").agg(F.array_sort(F.collect_list("_p")).alias("_places"))
    place = F.get("_places", (F.col(order.rank_col) - F.col("_places")[0]["r"]).cast("int"))
    batched = records.join(per_bucket, "_bucket").select(
        id_col, "split", place.alias("_p"), "input_ids", "attention_mask", "labels")
    width = F.col("_p.width")
    return batched.select(
        id_col, "split", F.col("_p.position").alias("position"), F.col("_p.batch").alias("batch"), width.alias("width"),
        B.pad_left(F.col("input_ids"), width, pad).alias("input_ids"),
        B.pad_left(F.col("attention_mask"), width, 0).alias("attention_mask"),
        B.pad_left(F.col("labels"), F.col("_p.lwidth"), -100).alias("labels"))


def write_batches(batches: DataFrame, out: str, mode: str = "errorifexists",
                  ordered: bool = False) -> None:
    """Parquet, one folder per split, rows sorted by position inside each file
    (every file holds whole buckets, i.e. whole runs of positions).
    ``ordered=True`` range-partitions by position first, so files also follow
    each other in position order (one more exchange)."""
    if ordered:
        batches = batches.repartitionByRange("split", "position")
    (batches.sortWithinPartitions("split", "position")
     .write.mode(mode).partitionBy("split").parquet(out))


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--data", required=True, nargs="+", help=".json/.jsonl files or globs, or a dataset path/table")
    ap.add_argument("--out", required=True)
    ap.add_argument("--japanese", action="store_true")
    ap.add_argument("--encoder", default="codepoint")
    ap.add_argument("--cutoff-len", type=int, default=256)
    ap.add_argument("--micro-batch-size", type=int, required=True)
    ap.add_argument("--devices", type=int, default=1)
    ap.add_argument("--val-set-size", type=int, default=VAL_SET_SIZE)
    ap.add_argument("--pad-id", type=int)
    ap.add_argument("--split", help="split of the dataset to train on (default: all rows)")
    ap.add_argument("--group-by-length", action="store_true")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("tessera-training-data").getOrCreate()
    records = read_instructions(spark, args.data)
    df = training_batches(records, training_template(args.japanese), get_encoder(args.encoder),
                          args.cutoff_len, args.micro_batch_size, args.devices,
                          args.val_set_size, pad_id=args.pad_id,
                          group_by_length=args.group_by_length, split=args.split)
    write_batches(df, args.out)
    n = spark.read.parquet(args.out).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    for r in n.collect():
        print(f"{r.split}: {r.rows} rows")


if __name__ == "__main__":
    main()
