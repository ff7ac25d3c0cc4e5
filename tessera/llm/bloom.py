"""Bloom filters of a bounded size, built and probed with DataFrame functions.

A filter is a table of bitmap blocks ``(_block long, _bits binary)`` of 32,768 bits
each, at most ``2 ** MAX_LOG2`` bits in all (32 MiB), so broadcasting it is safe at
any input size. An overfull filter only passes more rows on to the exact step
behind it: results never depend on the filter.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LOG2, MAX_LOG2 = 20, 28
BITS_PER_KEY = 16
BLOCK = 32768


def log2_bits(keys: int) -> int:
    """Filter size for a number of keys: about 16 bits a key, 2^20 to 2^28 bits."""
    return min(MAX_LOG2, max(MIN_LOG2, math.ceil(math.log2(max(1, keys) * BITS_PER_KEY))))


def positions(key: Column, log2: int) -> list[Column]:
    """The two bit positions of a 64-bit key."""
    mask = F.lit((1 << log2) - 1).cast("long")
    return [key.bitwiseAND(mask), F.shiftrightunsigned(F.xxhash64(key), 64 - log2)]


def _blocks(pos: DataFrame) -> DataFrame:
    return (pos.groupBy(F.shiftright("_pos", 15).alias("_block"))
            .agg(F.bitmap_construct_agg(F.col("_pos").bitwiseAND(F.lit(BLOCK - 1)).cast("long"))
                 .alias("_bits")))


def build(keys: DataFrame, key: str, log2: int) -> DataFrame:
    """A filter that holds every key of a column of 64-bit values."""
    return _blocks(keys.select(F.explode(F.array(*positions(F.col(key), log2))).alias("_pos")))


def build_repeated(keys: DataFrame, key: str, log2: int) -> DataFrame:
    """The first pass of two-pass filtering: saturating counters per position;
    a bit is set where a position was hit at least twice. Counts are combined
    in each task before they are shuffled."""
    pos = (keys.select(F.explode(F.array_distinct(F.array(*positions(F.col(key), log2)))).alias("_pos"))
           .groupBy("_pos").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1))
    return _blocks(pos)


def _bit(bits: str, pos: str) -> Column:
    at = F.col(pos).bitwiseAND(F.lit(BLOCK - 1))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))),
                  16, 10).cast("int")
    return F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))


def probe(df: DataFrame, key: Column, blocks: DataFrame, log2: int, out: str) -> DataFrame:
    """Add a boolean column: may the filter hold the row's 64-bit key? (No false
    negatives; a null key is never held.) The blocks are broadcast: bounded, see above."""
    p = positions(key, log2)
    keep = df.columns
    df = df.withColumns({"__t_p0": p[0], "__t_p1": p[1]})
    for i in (0, 1):
        side = F.broadcast(blocks.select(F.col("_block").alias(f"__t_b{i}"),
                                         F.col("_bits").alias(f"__t_bits{i}")))
        df = df.join(side, F.shiftright(f"__t_p{i}", 15) == F.col(f"__t_b{i}"), "left")
    return df.select(*[F.col(f"`{c}`") for c in keep],
                     (_bit("__t_bits0", "__t_p0") & _bit("__t_bits1", "__t_p1")).alias(out))


def to_numpy(blocks: DataFrame, log2: int) -> np.ndarray:
    """The filter as bytes, for probing in Python workers (at most 32 MiB)."""
    out = np.zeros((1 << log2) // 8, dtype=np.uint8)
    for r in blocks.collect():
        at = r["_block"] * (BLOCK // 8)
        out[at:at + BLOCK // 8] = np.frombuffer(r["_bits"], dtype=np.uint8)
    return out


def _xxhash64(key: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of 64-bit integers (XXH64 of eight bytes, seed 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (   # fixed values of XXH64
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    h = turn(key.view(np.uint64) * p2, 31) * p1 ^ np.uint64(42 + int(p5) + 8)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def probe_numpy(bits: np.ndarray, key: np.ndarray, log2: int) -> np.ndarray:
    """``probe`` for an array of int64 keys and a filter from ``to_numpy``."""
    held = np.ones(len(key), dtype=bool)
    for pos in (key.view(np.uint64) & np.uint64((1 << log2) - 1), _xxhash64(key) >> np.uint64(64 - log2)):
        pos = pos.astype(np.int64)
        held &= (bits[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1
    return held


def drop_ids(df: DataFrame, id_col: str, ids: DataFrame, drop: bool = True) -> DataFrame:
    """Rows of ``df`` whose id is not (``drop``) or is (``drop=False``) in the one-column
    table ``ids``. Only rows that a filter of the ids may hold are shuffled; all others
    are decided where they are. A null id is in no table."""
    ids = ids.select(F.col(ids.columns[0]).alias("__t_id")).distinct()
    log2 = log2_bits(ids.count())
    keyed = ids.select(F.xxhash64("__t_id").alias("_k"))
    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col)))
    probed = probe(df, key, build(keyed, "_k", log2), log2, "__t_maybe")
    maybe = probed.filter("__t_maybe").drop("__t_maybe")
    if not drop:
        return maybe.join(ids, F.col(id_col) == F.col("__t_id"), "left_semi")
    return (probed.filter("not __t_maybe").drop("__t_maybe")
            .unionByName(maybe.join(ids, F.col(id_col) == F.col("__t_id"), "left_anti")))
