"""Exact, reproducible global order without a one-partition window.

A row's place in the shuffled order is its key ``md5(id || ':' || seed)``
(ties broken by id). The exact global rank is computed in two passes:

1. the first ``digits`` hex digits of the key form a bucket (16**digits of
   them, uniform because the key is a hash); a partial+final aggregate counts
   rows per bucket (this pass reads only the id column), and a running sum over
   that small table gives each bucket's start offset (the only single-partition
   step, on at most 16**digits rows, so its size is bounded independently of
   the data);
2. the rows are hash-partitioned by bucket, sorted by key inside each bucket,
   numbered with ``row_number`` per bucket, and the offsets are
   broadcast-joined back.

Rank = offset + number inside the bucket, equal to
``row_number() over (order by key, id)``. Hash buckets are even, so no bucket
is hot unless ids repeat: ids must be unique. Hash (not range) partitioning is
deliberate: a range exchange first samples its input, which re-runs the whole
upstream plan once more; the bucket counts already make the hash layout even.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_DIGITS = 4      # 65,536 buckets: offsets table <= 65,536 rows (~1 MB broadcast);
                        # 5 digits keep buckets near 128 MB beyond ~8 TB (~16 MB broadcast)
DEFAULT_SEED = 42
MAX_OFFSETS = 4_000_000   # rows of the broadcast offsets table (about 100 MB): buckets x ``by`` groups


def order_key(id_col: str | Column, seed: int | str = DEFAULT_SEED) -> Column:
    """``md5(id || ':' || seed)``; a null id fails the job (it would have no
    place in the order, and the row must not vanish)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    checked = F.coalesce(c.cast("string"), F.raise_error(F.lit(
        "null id: every row needs an id for the exact order")).cast("string"))
    return F.md5(F.concat(checked, F.lit(f":{seed}")))


def content_key(df: DataFrame, seed: int | str = DEFAULT_SEED) -> Column:
    """Order key for tables without an id: hash of the whole row. Identical
    rows tie (and are interchangeable)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.to_json(F.struct(*[F.col(c) for c in df.columns]))))


@dataclass(frozen=True)
class ExactOrder:
    """A ranked table and the per-bucket offsets it was ranked with."""

    ranked: DataFrame      # input columns + _key, _bucket, <rank_col>
    offsets: DataFrame     # by..., _bucket, _n, _start, _total
    rank_col: str
    by: tuple[str, ...]
    digits: int

    def derive(self, fn) -> "ExactOrder":
        """Apply a row-wise ``DataFrame -> DataFrame`` step (e.g. tokenization)
        after the ranking shuffle; it must keep the rank, ``by`` and ``_bucket``
        columns. Ranking before such a step moves the compact input through
        the shuffle rather than the step's (larger) output."""
        return replace(self, ranked=fn(self.ranked))


def exact_rank(df: DataFrame, id_col: str, seed: int | str = DEFAULT_SEED,
               digits: int = DEFAULT_DIGITS, by: tuple[str, ...] | list[str] = (),
               rank_col: str = "rank", key: Column | None = None,
               more_than: int | None = None) -> ExactOrder:
    """Exact 1-based rank of every row in key order (per ``by`` group).

    ``more_than``: fail (when the job runs) unless the table has more rows
    than this; the check rides on the broadcast offsets, no extra pass.
    """
    if not 1 <= digits <= 6:
        raise ValueError("digits must be between 1 and 6")
    by = tuple(by)
    keyed = (df.withColumn("_key", key if key is not None else order_key(id_col, seed))
               .withColumn("_bucket", F.conv(F.substring("_key", 1, digits), 16, 10).cast("int")))
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = counts.select(*by, "_bucket", "_n",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                            F.sum("_n").over(whole).alias("_total"))
    start = F.col("_start")
    if by:          # without groups there are 16**digits rows at most
        rows = Window.partitionBy()
        offsets = offsets.withColumn("_rows", F.count(F.lit(1)).over(rows))
        start = F.when(F.col("_rows") > F.lit(MAX_OFFSETS), F.raise_error(F.concat(
            F.lit(f"too many groups of {by}: the offsets table has more than {MAX_OFFSETS} rows ("),
            F.col("_rows").cast("string"), F.lit("); use fewer digits")))).otherwise(start)
    if more_than is not None:
        start = F.when(F.col("_total") <= F.lit(more_than), F.raise_error(F.concat(
            F.lit(f"the table must have more than {more_than} rows, it has "),
            F.col("_total").cast("string")))).otherwise(start)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key", id_col)
    numbered = (keyed.repartition(*[F.col(c) for c in by], F.col("_bucket"))
                .withColumn("_in", F.row_number().over(inside)))
    side = offsets.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_b"),
                          start.alias("_start"))
    offsets = offsets.drop("_rows")
    on = F.col("_bucket") == F.col("_b")
    for c in by:            # a null group is a group
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    ranked = (numbered.join(F.broadcast(side), on, "inner").drop("_b", *[f"_by_{c}" for c in by])
              .withColumn(rank_col, (F.col("_start") + F.col("_in")).cast("bigint"))
              .drop("_start", "_in"))
    return ExactOrder(ranked, offsets, rank_col, by, digits)


def shuffle_rows(df: DataFrame, id_col: str, seed: int | str = DEFAULT_SEED,
                 digits: int = DEFAULT_DIGITS, rank_col: str = "rank") -> DataFrame:
    """The rows in a seeded random order: ``rank`` 1..N (each partition
    holds whole buckets, sorted by rank inside)."""
    return exact_rank(df, id_col, seed, digits, rank_col=rank_col).ranked.drop("_key", "_bucket")


def exact_split(df: DataFrame, id_col: str, n_val: int, seed: int | str = DEFAULT_SEED,
                digits: int = DEFAULT_DIGITS, shuffle_seed: int | str | None = None,
                train: str = "train", val: str = "validation") -> ExactOrder:
    """Exactly ``n_val`` rows to validation, the rest to train.

    The validation rows are the first ``n_val`` of the seeded order; the
    ``position`` of a row inside its split continues that same permutation
    (a uniform random order of each part), so one ranking pass does split and
    shuffle. Pass ``shuffle_seed`` to shuffle each part again by another seed
    (one more ranking pass, partitioned by split). ``n_val`` >= row count is
    an error; ``n_val == 0`` puts every row in train.
    """
    if n_val < 0:
        raise ValueError("n_val must be >= 0")
    order = exact_rank(df, id_col, seed, digits, rank_col="_grank",
                       more_than=n_val if n_val > 0 else None)
    digits = order.digits
    checked = order.ranked
    is_val = F.col("_grank") <= F.lit(n_val)
    parted = (checked
              .withColumn("split", F.when(is_val, F.lit(val)).otherwise(F.lit(train)))
              .withColumn("position", F.when(is_val, F.col("_grank"))
                          .otherwise(F.col("_grank") - F.lit(n_val)).cast("bigint")))
    if shuffle_seed is None:
        # offsets per split follow from the global offsets by the cut at n_val
        offsets = order.offsets.select(
            "_bucket", "_n", "_start", "_total").withColumn("_lo", F.col("_start") + 1) \
            .withColumn("_hi", F.col("_start") + F.col("_n"))
        split_offsets = offsets.select(
            F.explode(F.array(
                F.struct(F.lit(val).alias("split"),
                         F.greatest(F.least(F.col("_hi"), F.lit(n_val)) - F.col("_lo") + 1,
                                    F.lit(0)).alias("_n"),
                         F.least(F.col("_start"), F.lit(n_val)).alias("_start")),
                F.struct(F.lit(train).alias("split"),
                         F.greatest(F.col("_hi") - F.greatest(F.col("_lo"), F.lit(n_val + 1)) + 1,
                                    F.lit(0)).alias("_n"),
                         F.greatest(F.col("_start") - F.lit(n_val), F.lit(0)).alias("_start")),
            )).alias("s"), "_bucket").select("s.split", "_bucket", "s._n", "s._start")
        return ExactOrder(parted.drop("_grank"), split_offsets.filter(F.col("_n") > 0),
                          "position", ("split",), digits)
    again = exact_rank(parted.drop("_key", "_bucket", "position"), id_col, shuffle_seed, digits,
                       by=("split",), rank_col="position")
    return ExactOrder(again.ranked.drop("_grank"), again.offsets, "position", ("split",), digits)
