"""Exact order and split of a table that grows by appends.

``operators.order`` ranks a whole table. Here the order is stored as an updatable order
statistic, so that an append ranks its own rows and moves only the rows that must move:

    <path>/part-000000/keys-256/_group=.../    (_bucket, _key, id), sorted
    <path>/part-000000/counts/                 (_bucket, _n): written last, commits the part

A rank is the number of rows in earlier buckets (a sum over the counts of all parts, at most
16**digits rows) plus the place inside the bucket, for which only the keys of the buckets that
an append touches are read: a part's buckets lie in up to 256 folders of neighbouring
buckets (one per ``rows_per_group`` rows), so folders are pruned, and row groups by the sorted
``_bucket`` column. The split's cut, the key of the n-th row, comes from
the counts and one bucket; as rows arrive it only moves down, and the rows between the new
and the old cut are all that change sides.

Ids must be unique and not null over all parts, as everywhere in W6: a repeated id fails the
rank. A part whose append was killed has no finished counts and does not exist for readers; the
next append takes a new number. Appends come one at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import path_exists
from .order import DEFAULT_DIGITS, DEFAULT_SEED, order_key

GROUPS = 256                  # folders of a part at most
ROWS_PER_GROUP = 1_000_000


class GrowingOrder:
    """The stored order of a growing table; see the module."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "id", seed: int | str = DEFAULT_SEED,
                 digits: int = DEFAULT_DIGITS, rows_per_group: int = ROWS_PER_GROUP):
        if not 2 <= digits <= 6:
            raise ValueError("digits must be between 2 and 6")
        self.spark, self.path, self.id_col, self.seed, self.digits = spark, path.rstrip("/"), id_col, seed, digits
        self.rows_per_group = rows_per_group

    # --- storage -------------------------------------------------------------------

    def _part(self, part: int) -> str:
        return f"{self.path}/part-{part:06d}"

    def _names(self, path: str) -> list[str]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [st.getPath().getName() for st in fs.listStatus(root)] if fs.exists(root) else []

    def _started(self) -> list[int]:
        return sorted(int(n[5:]) for n in self._names(self.path) if n.startswith("part-"))

    def parts(self) -> list[int]:
        """Numbers of the finished parts."""
        return [p for p in self._started() if path_exists(self.spark, f"{self._part(p)}/counts/_SUCCESS")]

    def append(self, df: DataFrame) -> int:
        """Store the keys of the rows of ``df`` (only its id column is read); returns the part's number."""
        part = max(self._started(), default=-1) + 1
        ids = df.select(F.col(self.id_col).alias("id"))
        groups = 1
        while groups < GROUPS and groups * self.rows_per_group < ids.count():
            groups *= 2
        keyed = ids.withColumn("_key", order_key("id", self.seed)).withColumn(
            "_bucket", F.conv(F.substring("_key", 1, self.digits), 16, 10).cast("int")).withColumn(
            "_group", F.floor(F.col("_bucket") / self._per_group(groups)).cast("int"))
        (keyed.repartitionByRange("_bucket", "_key").sortWithinPartitions("_bucket", "_key", "id")
         .write.partitionBy("_group").parquet(f"{self._part(part)}/keys-{groups}"))
        counts = self._stored(part, groups, ids.schema).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
        counts.coalesce(1).write.parquet(f"{self._part(part)}/counts")      # at most 16**digits rows
        return part

    def _per_group(self, groups: int) -> int:
        return 16 ** self.digits // groups

    def _stored(self, part: int, groups: int, ids: T.StructType) -> DataFrame:
        schema = T.StructType([*ids.fields, T.StructField("_key", T.StringType()), T.StructField("_bucket", T.IntegerType()),
                               T.StructField("_group", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self._part(part)}/keys-{groups}")

    def _keys(self, parts: list[int], between: list[tuple[int, int]] | None = None) -> DataFrame:
        """``id, _key, _bucket, _part`` of some parts; ``between``: only folders with buckets in
        one of these ranges (ends included)."""
        def one(p):
            names = self._names(self._part(p))
            groups = next(int(n[5:]) for n in names if n.startswith("keys-"))
            if not any(n.startswith("_group=") for n in self._names(f"{self._part(p)}/keys-{groups}")):
                return None                                                  # a part without rows
            stored, per = self.spark.read.parquet(f"{self._part(p)}/keys-{groups}"), self._per_group(groups)
            if between is not None:
                wanted = {g for lo, hi in between for g in range(lo // per, hi // per + 1)}
                stored = stored.filter(F.col("_group").isin(sorted(wanted)))
            return stored.select("id", "_key", "_bucket", F.lit(p).alias("_part"))

        found = [k for k in map(one, parts) if k is not None]
        if not found:
            raise ValueError(f"{self.path}: no row in parts {parts}")
        return reduce(DataFrame.unionByName, found)

    def _counts(self, parts: list[int]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.schema("_bucket int, _n long").parquet(
            f"{self._part(p)}/counts") for p in parts])

    # --- ranks -----------------------------------------------------------------------

    def _upto(self, part: int | None) -> list[int]:
        parts = self.parts()
        return parts if part is None else [p for p in parts if p <= part]

    def _starts(self, parts: list[int]) -> DataFrame:
        """``_b, _n, _start, _total`` per bucket of the table that the parts make up."""
        per = self._counts(parts).groupBy("_bucket").agg(F.sum("_n").alias("_n"))
        before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        return per.select(F.col("_bucket").alias("_b"), "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                          F.sum("_n").over(Window.partitionBy()).alias("_total"))

    def ranks(self, part: int | None = None) -> DataFrame:
        """``id, rank``: of the rows of one part among all rows up to that part, reading only
        the buckets it touches; without a part of all rows."""
        parts = self._upto(part)
        if not parts:
            raise ValueError(f"{self.path} holds no finished part")
        if part is None:
            keys = self._keys(parts)
        else:
            touched = self._counts([part]).select(F.col("_bucket").alias("_t"))      # at most 16**digits rows
            per = self._per_group(GROUPS)
            runs = touched.select(F.floor(F.col("_t") / per).cast("int")).distinct().collect()
            keys = self._keys(parts, [(r[0] * per, r[0] * per + per - 1) for r in runs]).join(
                F.broadcast(touched), F.col("_bucket") == F.col("_t"), "left_semi")
        inside = Window.partitionBy("_bucket").orderBy("_key", "id")
        repeated = F.lag("id").over(inside) == F.col("id")
        placed = keys.withColumn("_in", F.when(repeated, F.raise_error(F.concat(
            F.lit("repeated id "), F.col("id").cast("string"))).cast("int")).otherwise(F.row_number().over(inside)))
        if part is not None:
            placed = placed.filter(F.col("_part") == part)
        return placed.join(F.broadcast(self._starts(parts)), F.col("_bucket") == F.col("_b")).select(
            F.col("id").alias(self.id_col), (F.col("_start") + F.col("_in")).cast("bigint").alias("rank"))

    # --- split -----------------------------------------------------------------------

    def cut(self, n_val: int, part: int | None = None):
        """``(bucket, key, id)`` of the ``n_val``-th row: it and all before it are validation rows. Reads
        the counts and one bucket."""
        parts = self._upto(part)
        total = self._counts(parts).agg(F.sum("_n")).first()[0] or 0
        if not 0 < n_val < total:
            raise ValueError(f"the table must have more than {n_val} rows (and n_val be above 0), it has {total}")
        at = self._starts(parts).filter((F.col("_start") < n_val) & (F.col("_start") + F.col("_n") >= n_val)).first()
        inside = self._keys(parts, [(at["_b"], at["_b"])]).filter(F.col("_bucket") == at["_b"])
        row = inside.withColumn("_in", F.row_number().over(Window.orderBy("_key", "id"))).filter(
            F.col("_in") == n_val - at["_start"]).first()
        return at["_b"], row["_key"], row["id"]

    def split_changes(self, n_val: int, part: int) -> DataFrame:
        """``id, split`` of the rows whose split the append of ``part`` decides: its own rows, and
        the stored rows that leave validation for train."""
        here = self.cut(n_val, part)
        own = self._own(part).select("id", F.when(self._after(here), "train").otherwise("validation").alias("split"))
        former = [p for p in self.parts() if p < part]
        if not former:
            return own.withColumnRenamed("id", self.id_col)
        there = self.cut(n_val, former[-1])
        between = self._keys(former, [(here[0], there[0])]).filter(
            F.col("_bucket").between(here[0], there[0]) & self._after(here) & ~self._after(there))
        moved = between.select("id", F.lit("train").alias("split"))
        return own.unionByName(moved).withColumnRenamed("id", self.id_col)

    def _own(self, part: int) -> DataFrame:
        """The keys of one part, which may have no rows."""
        return self._keys(self._upto(part)).filter(F.col("_part") == part)

    @staticmethod
    def _after(cut) -> Column:
        _, key, row_id = cut
        return (F.col("_key") > key) | ((F.col("_key") == key) & (F.col("id") > F.lit(row_id)))

    def split(self, n_val: int) -> DataFrame:
        """``id, split`` of all rows."""
        return self._keys(self.parts()).select(
            F.col("id").alias(self.id_col), F.when(self._after(self.cut(n_val)), "train").otherwise("validation").alias("split"))
