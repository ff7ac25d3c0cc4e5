"""Batches: assignment (B1), left padding to a multiple of 8 (B2),
length-grouped batches (B3) and the batch footprint report (B4).

Batches are runs of consecutive ranks, so after ``exact_rank`` (rows
partitioned by hash bucket, each bucket a contiguous rank run) a batch lies
inside one bucket except where a bucket boundary cuts it. Padding widths
are therefore computed bucket-locally (a window over (bucket, batch) that
reuses the existing partitioning: no shuffle of the token arrays), plus a
correction for the batches cut by a bucket boundary. Those are found from the
offsets table alone, number at most one per bucket, and are broadcast: their
size is bounded by the bucket count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import IGNORE_INDEX
from .order import ExactOrder, exact_rank


def device_batch_size(micro_batch_size: int, devices: int) -> int:
    """Per-device batch size as the training job computes it."""
    if devices < 1:
        raise ValueError("devices must be >= 1")
    size = int(micro_batch_size / devices)
    if size < 1:
        raise ValueError("per-device batch size is 0")
    return size


def batch_of(rank: Column, size: int) -> Column:
    """B1: 0-based batch of a 1-based rank; the last short batch is kept."""
    return F.floor((rank - F.lit(1)) / F.lit(size)).cast("bigint")


def round_up(n: Column, multiple: int) -> Column:
    return (F.floor((n + F.lit(multiple - 1)) / F.lit(multiple)) * F.lit(multiple)).cast("int")


def assign_batches(order: ExactOrder, size: int, batch_col: str = "batch") -> DataFrame:
    return order.ranked.withColumn(batch_col, batch_of(F.col(order.rank_col), size))


def pad_left(arr: Column, width: Column, value: int) -> Column:
    return F.concat(F.array_repeat(F.lit(value), F.greatest(width - F.size(arr), F.lit(0))), arr)


def pad_right(arr: Column, width: Column, value: int) -> Column:
    return F.concat(arr, F.array_repeat(F.lit(value), F.greatest(width - F.size(arr), F.lit(0))))


def cut_batches(order: ExactOrder, size: int) -> DataFrame:
    """Batches cut by a bucket boundary: (by..., batch). At most one per bucket."""
    by = list(order.by)
    off = order.offsets.filter(F.col("_n") > 0)
    first = F.floor(F.col("_start") / F.lit(size)).cast("bigint")
    last = F.floor((F.col("_start") + F.col("_n") - F.lit(1)) / F.lit(size)).cast("bigint")
    edges = off.select(*by, "_bucket",
                       F.explode(F.array_distinct(F.array(first, last))).alias("batch"))
    return (edges.groupBy(*by, "batch").agg(F.count(F.lit(1)).alias("_k"))
            .filter(F.col("_k") > 1).select(*by, "batch"))


def pad_batches(order: ExactOrder, size: int, pad_id: int, multiple: int = 8,
                ids: str = "input_ids", mask: str | None = "attention_mask",
                labels: str | None = "labels", side: str = "left",
                label_pad: int = IGNORE_INDEX) -> DataFrame:
    """B1 + B2: assign batches of ``size`` consecutive ranks and pad every row
    to its batch's longest row rounded up to ``multiple``: ids with
    ``pad_id``, mask with 0, labels with -100 (labels get their own width, as
    a sequence-to-sequence collator computes it). Adds ``batch`` and
    ``width`` (the padded id length)."""
    if side not in ("left", "right"):
        raise ValueError("side must be left or right")
    by = list(order.by)
    g = [*by, "batch"]
    df = assign_batches(order, size)
    local = Window.partitionBy(*by, "_bucket", "batch")
    df = df.withColumn("_mi", F.max(F.size(ids)).over(local))
    if labels:
        df = df.withColumn("_ml", F.max(F.size(labels)).over(local))
    cut = cut_batches(order, size)
    fix_aggs = [F.max(F.size(ids)).alias("_fi")]
    if labels:
        fix_aggs.append(F.max(F.size(labels)).alias("_fl"))
    fix = (assign_batches(order, size).join(F.broadcast(cut), g, "left_semi")
           .groupBy(*g).agg(*fix_aggs))
    df = df.join(F.broadcast(fix), g, "left")
    pad = pad_left if side == "left" else pad_right
    width = round_up(F.greatest(F.col("_mi"), F.coalesce(F.col("_fi"), F.lit(0))), multiple)
    df = df.withColumn("width", width)
    out = df.withColumn(ids, pad(F.col(ids), F.col("width"), pad_id))
    if mask:
        out = out.withColumn(mask, pad(F.col(mask), F.col("width"), 0))
    if labels:
        lw = round_up(F.greatest(F.col("_ml"), F.coalesce(F.col("_fl"), F.lit(0))), multiple)
        out = out.withColumn(labels, pad(F.col(labels), lw, label_pad))
    return out.drop("_mi", "_ml", "_fi", "_fl")


def little_endian_hex(values: Column) -> Column:
    """An array of 32-bit integers as the hex digits of its little-endian bytes."""
    def one(x):
        h = F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
        return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.array_join(F.transform(values, one), "")


def batch_tensors(order: ExactOrder, padded: DataFrame, size: int, ids: str = "input_ids",
                  mask: str = "attention_mask", labels: str = "labels") -> DataFrame:
    """B2 as a trainer reads it: one row per batch of ``pad_batches`` (``padded``, its columns
    kept) with the shape ``n_rows, width, label_width``, the rows in order of their ranks as
    little-endian 32-bit bytes ``ids, mask, labels`` (row after row), and ``checksum``, the crc32 of
    the three. A batch has ``size`` rows at most. It lies in one bucket unless a
    bucket's edge cuts it, so batches are put together where their rows are and only the parts
    of cut batches (at most one per bucket) move."""
    g = [*order.by, "batch"]
    row = F.struct(F.col(order.rank_col).alias("r"), F.size(ids).alias("w"), F.size(labels).alias("lw"),
                   *[little_endian_hex(F.col(c)).alias(k) for c, k in ((ids, "i"), (mask, "m"), (labels, "l"))])
    rows = padded.select(*g, "_bucket", row.alias("_row"))
    cut = F.broadcast(cut_batches(order, size))           # at most one per bucket
    whole = rows.join(cut, g, "left_anti").groupBy(*g, "_bucket").agg(F.collect_list("_row").alias("_rows")).drop("_bucket")
    parts = rows.join(cut, g, "left_semi").groupBy(*g).agg(F.collect_list("_row").alias("_rows"))
    put = whole.unionByName(parts).withColumn("_rows", F.array_sort("_rows"))
    data = [F.unhex(F.array_join(F.col(f"_rows.{k}"), "")).alias(name)
            for k, name in (("i", "ids"), ("m", "mask"), ("l", "labels"))]
    return put.select(*g, F.size("_rows").alias("n_rows"), F.col("_rows")[0]["w"].alias("width"),
                      F.col("_rows")[0]["lw"].alias("label_width"), *data).withColumn(
        "checksum", F.crc32(F.concat("ids", "mask", "labels")))


def length_grouped_order(order: ExactOrder, size: int, length: Column,
                         out_col: str = "grouped_rank") -> DataFrame:
    """The length-grouped order of a shuffled table.

    Mega-batches of ``size * m`` consecutive ranks, ``m = min(N // (4 size), 50)``
    (at least 1); inside each, rows sorted by length, longest first (ties keep
    the shuffled order); then the first row of mega-batch 0 and the first row
    of the mega-batch with the longest row trade places. Mega-batches are
    bounded (at most 50 batches), so the window over them cannot be hot.
    Rank a narrow table (id and length) so the two shuffles move no text.
    """
    by = list(order.by)
    if by:
        raise ValueError("length_grouped_order takes an unpartitioned order")
    df = order.ranked.withColumn("_len", length)
    mult = F.greatest(F.least(F.floor(F.col("_total") / F.lit(size * 4)), F.lit(50)), F.lit(1))
    # the row count rides on the (bounded) per-bucket offsets table
    msize = order.offsets.select("_bucket", (mult * F.lit(size)).cast("bigint").alias("_msize"))
    df = df.join(F.broadcast(msize), "_bucket")
    df = df.withColumn("_mega", F.floor((F.col(order.rank_col) - 1) / F.col("_msize")).cast("bigint"))
    inside = Window.partitionBy("_mega").orderBy(F.col("_len").desc(), F.col(order.rank_col))
    df = df.withColumn("_pos", F.row_number().over(inside))
    # the mega-batch holding the longest row (first one on ties)
    top = (df.filter(F.col("_pos") == 1)
           .agg(F.max(F.struct(F.col("_len"), (-F.col("_mega")).alias("_neg"))).alias("_t"))
           .select((-F.col("_t._neg")).alias("_top")))
    swap = top.select(F.explode(F.array_distinct(F.array(
        F.struct(F.lit(0).cast("bigint").alias("_mega"), F.col("_top").alias("_to")),
        F.struct(F.col("_top").alias("_mega"), F.lit(0).cast("bigint").alias("_to"))))).alias("s")) \
        .select("s._mega", "s._to").withColumn("_pos", F.lit(1))
    df = df.join(F.broadcast(swap), ["_mega", "_pos"], "left")
    new_mega = F.coalesce(F.col("_to"), F.col("_mega"))
    return df.withColumn(out_col, (new_mega * F.col("_msize") + F.col("_pos")).cast("bigint")) \
        .drop("_len", "_msize", "_mega", "_pos", "_to")


def footprint(df: DataFrame, id_col: str, length: Column, sizes: list[int],
              multiple: int = 8, seed: int = 42) -> DataFrame:
    """For each candidate batch size, what padding costs on this table:
    rows, batches, real tokens, padded tokens, waste share, widest batch."""
    order = exact_rank(df.select(id_col, length.alias("_len")), id_col, seed)
    cand = (order.ranked.select("_bucket", order.rank_col, "_len")
            .withColumn("batch_size", F.explode(F.array(*[F.lit(int(s)) for s in sizes])))
            .withColumn("batch", F.floor((F.col(order.rank_col) - 1) / F.col("batch_size"))))
    # a batch lies inside one bucket, whose partitioning is reused, unless a bucket's edge
    # cuts it: only cut batches (two per bucket and size at most) move once more
    local = cand.groupBy("_bucket", "batch_size", "batch").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_len").alias("_real"), F.max("_len").alias("_max"))
    cols = ["batch_size", "_rows", "_real", "_max"]
    merged = local.filter("_rows < batch_size").groupBy("batch_size", "batch").agg(
        F.sum("_rows").alias("_rows"), F.sum("_real").alias("_real"), F.max("_max").alias("_max"))
    per_batch = local.filter("_rows = batch_size").select(*cols).union(merged.select(*cols))
    width = F.floor((F.col("_max") + multiple - 1) / multiple) * multiple
    rep = (per_batch.groupBy("batch_size")
           .agg(F.sum("_rows").cast("bigint").alias("rows"),
                F.count(F.lit(1)).cast("bigint").alias("batches"),
                F.sum("_real").cast("bigint").alias("real_tokens"),
                F.sum(F.col("_rows") * width).cast("bigint").alias("padded_tokens"),
                F.max(width).cast("bigint").alias("widest")))
    return rep.withColumn("waste", F.round(1 - F.col("real_tokens") / F.col("padded_tokens"), 6)) \
        .withColumn("batch_size", F.col("batch_size").cast("bigint"))
