"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package

SLICE_BYTES = 2 << 20   # text handled at once inside a Python worker


_STAGES: dict[str, list[str]] = {}   # application -> folders of the pipeline stages, the last one is in use


def _base(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``, inside the folder of the
    pipeline stage that runs (if any)."""
    inside = _STAGES.get(spark.sparkContext.applicationId)
    return f"{inside[-1] if inside else _base(spark)}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def clean_scratch(spark: SparkSession) -> None:
    """Delete what this application's operators wrote below ``spark.checkpoint.dir``
    (call it once their results are stored)."""
    delete_path(spark, _base(spark))


def begin_stage(docs: DataFrame, label: str) -> None:
    """What operators write from now on lies in a folder of its own. The folders of earlier
    stages go, but for those that ``docs`` still reads: a stage's result is stored before
    the next stage begins, or else is part of that stage's input."""
    spark = docs.sparkSession
    folders = _STAGES.setdefault(spark.sparkContext.applicationId, [])
    if folders:
        files = docs.inputFiles()
        for folder in [f for f in folders if not any(f"{f}/" in x for x in files)]:
            delete_path(spark, folder)
            folders.remove(folder)
    folders.append(f"{_base(spark)}/{label}-{uuid.uuid4().hex}")


def end_stages(spark: SparkSession) -> None:
    """Operators that are called from now on belong to no stage."""
    _STAGES.pop(spark.sparkContext.applicationId, None)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors, and is computed once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROW, WHOLE = "__t_row", "row"


def whole_rows(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one struct column (``WHOLE``), out of the way of the names
    that an operator adds; ``unpacked`` is the way back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(WHOLE))


def inner(col: str) -> str:
    """A column of ``whole_rows``."""
    return f"{WHOLE}.`{col}`"


def unpacked(df: DataFrame) -> DataFrame:
    return df.select(f"{WHOLE}.*")


def with_rows(df: DataFrame) -> DataFrame:
    """``whole_rows`` with a unique number per row (``ROW``), written so that it stays the same
    however often the rows are read."""
    return materialize(whole_rows(df).withColumn(ROW, F.monotonically_increasing_id()), "rows")


def first_rows(df: DataFrame, group_col: str, id_col: str) -> DataFrame:
    """The ``ROW`` of one row per group: of the smallest id (null last), and there of the
    smallest row number."""
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col(ROW).alias("r"))
    return df.groupBy(group_col).agg(F.min(order).alias("s")).select(F.col("s.r").alias(ROW))


_CACHES: list[dict] = []   # of this Python worker


def worker_cache() -> dict:
    """A dict for what encoding tasks leave to later ones of the same Python worker. Workers
    outlive tasks and stages: ``map_arrow`` empties it when other work begins."""
    _CACHES.append({})
    return _CACHES[-1]


def drop_caches() -> None:
    for cache in _CACHES:
        cache.clear()


def give_back() -> None:
    """Return to the system what Arrow and the C library hold of freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # glibc only
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema, encodes: bool = False) -> DataFrame:
    """``mapInArrow`` with this package shipped to the workers. Only tasks that use a
    ``worker_cache`` (``encodes``) find it as the last task left it; a worker that waits for
    its next task holds no memory that the last one has freed."""
    def run(batches):
        if not encodes:
            drop_caches()
        try:
            yield from fn(batches)
        finally:
            give_back()

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_slices(batch: pa.RecordBatch, column: str,
                max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch that hold about ``max_bytes`` of a string
    column each (a longer single value makes a slice of its own)."""
    if batch.num_rows == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pa.compute.binary_length(col).fill_null(0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(arr: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return arr.cast(pa.binary()).fill_null(b"").to_pylist()


def narrow(counts: np.ndarray) -> bytes:
    """Counts of at least 0 in as few bytes each as the largest needs (``sum_blocks`` with ``width``)."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(counts) or counts.max() <= np.iinfo(k).max)
    return counts.astype(kind).tobytes()


def sum_blocks(partials: DataFrame, dtype: str, blocks: int, width: int = 0) -> DataFrame:
    """Sum arrays that many tasks hold: rows ``(block int, data binary)`` with
    equal-length arrays per block -> one row per block. Blocks are dealt over
    tasks and each task adds its rows one by one (one array per block in memory). With
    ``width`` (entries per block) the rows are ``narrow`` counts."""
    def add(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1)):
                data = raw.as_buffer()
                x = np.frombuffer(data, dtype=f"<u{data.size // width}" if width else dtype).astype(dtype)
                if k in acc:
                    acc[k] += x
                else:
                    acc[k] = x
        if acc:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(acc), pa.int32()),
                 pa.array([v.tobytes() for v in acc.values()], pa.binary())], ["block", "data"])

    n = min(blocks, max(1, int(partials.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return map_arrow(partials.repartition(n, "block"), add, "block int, data binary")


def collect_blocks(summed: DataFrame, dtype: str, size: int, blocks: int) -> np.ndarray:
    """The whole summed array (``size`` entries, a documented parameter of the
    caller) on the driver."""
    out = np.zeros(size, dtype=dtype)
    width = size // blocks
    for k, raw in ((r["block"], r["data"]) for r in summed.collect()):
        out[k * width:(k + 1) * width] = np.frombuffer(raw, dtype=dtype)
    return out
