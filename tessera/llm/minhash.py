"""Near-duplicate documents by SuperMinHash.

A document's set holds its distinct word shingles. Every element of a set walks a
pseudo-random permutation of the signature's slots and offers its j-th slot the value j
plus a fraction, so the values of one element differ in rank from slot to slot (lower
variance than independent hashes). The walk of a set stops at the first step after which
all slots are filled: no later value can be smaller. Slots are cut into bands; documents
that share a band are candidates, and every candidate pair is verified on the full sets.

1. Equal sets are collapsed to their smallest id, so copies are never paired.
2. Each member of a band bucket is verified against the bucket's smallest id; the links
   found are grouped (union-find).
3. Only where a bucket still holds several groups, its members are compared across
   groups: documents connected by such buckets form a cluster, a cluster is dealt in
   blocks of ``BLOCK`` documents with their full sets, and a task verifies every pair of
   different groups that a bound on the overlap does not rule out (set sizes, and the
   number of shingles by hash bucket: never below the true overlap, so no link is lost).
   It gives out links only, and none between groups it has linked already. Links inside a group cannot change the
   result, so no link between groups is lost and no list of pairs is ever written.

Words are runs of bytes other than space and tab to carriage return, A-Z lower-cased. A
document with fewer words than a shingle has the whole sequence as one shingle; one
without words or text has an empty set and links with nothing, and so does a null id.
Where rows repeat an id with different texts, links of any of them count. Empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import (ROW, column, first_rows, inner, map_arrow, materialize, text_bytes, text_slices, unpacked,
                     with_rows)
from .components import connected_components
from .words import mix, pair_hashes, word_hashes, words_of

SLOTS, BAND = 96, 4        # 24 bands: a pair at similarity 0.8 is missed with 3e-6
BLOCK = 512
_STEP = np.uint64(52)      # slot value: step in the high bits, fraction in the low 52
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    h = word_hashes(words_of(text))
    if len(h) < words:
        if not len(h):
            return h
        s = np.array([len(h)], dtype=np.uint64)
        for x in h:
            s = pair_hashes(s, np.array([x]))
        return s
    n = len(h) - words + 1
    s = h[:n]
    for i in range(1, words):
        s = pair_hashes(s, h[i:n + i])
    return np.unique(s)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures (sets x SLOTS) of non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    e = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    sig = np.full(len(sets) * SLOTS, _EMPTY, dtype=np.uint64)
    perm = None
    for j in range(SLOTS):
        x = mix(e + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        # a slot from the part of the permutation not walked yet (Fisher-Yates)
        k = j + (((mix(x) >> np.uint64(32)) * np.uint64(SLOTS - j)) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            at = np.arange(len(e))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
        np.minimum.at(sig, doc * SLOTS + slot, (np.uint64(j) << _STEP) | (x >> np.uint64(12)))
        open_docs = (sig.reshape(-1, SLOTS) == _EMPTY).any(axis=1)
        more = open_docs[doc]
        if not more.any():
            break
        if perm is None:
            e, doc, k = e[more], doc[more], k[more]
            perm = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(e), 1))
            perm[np.arange(len(e)), k] = 0
        elif more.mean() < 0.7:
            e, doc, perm = e[more], doc[more], perm[more]
    return sig.reshape(-1, SLOTS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    bands = sig.reshape(len(sig), SLOTS // BAND, BAND)
    key = np.broadcast_to(np.arange(SLOTS // BAND, dtype=np.uint64), bands.shape[:2])
    for i in range(BAND):
        key = pair_hashes(key, bands[:, :, i])
    return key.astype(np.int64)


_SIGNED = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>"


def sign(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, set size, a 128-bit key of the set and band keys."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = [shingles(t, words) for t in text_bytes(column(part, "text"))]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                bands: list = [None] * len(sets)
                key = np.zeros((len(sets), 2), dtype=np.uint64)
                if len(full):
                    sig = signatures([sets[i] for i in full])
                    for i, b in zip(full.tolist(), band_keys(sig)):
                        bands[i] = b
                        key[i] = mix(sets[i]).sum(), np.bitwise_xor.reduce(mix(sets[i] + np.uint64(7)))
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(n), pa.array(key[:, 0].astype(np.int64)),
                     pa.array(key[:, 1].astype(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "key_a", "key_b", "bands"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(src, run, _SIGNED)


def _sets(docs: DataFrame, ids: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``id, items`` (sorted shingle hashes) of the documents in a table of ids; only their
    texts move."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def to_sets(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"),
                     pa.array([shingles(t, words).tobytes() for t in text_bytes(column(part, "text"))],
                              pa.binary())], ["id", "items"])

    return materialize(map_arrow(bloom.drop_ids(src, "doc_id", ids, drop=False), to_sets,
                                 "id long, items binary"), "sets")


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _bucket_counts(items: list[np.ndarray]) -> np.ndarray:
    """Elements of each set by hash bucket (sets x buckets, a power of two near a quarter
    of a middling set). The sum of the smaller counts bounds the overlap of two sets."""
    sizes = np.array([len(s) for s in items])
    width = 1 << min(11, max(7, int(np.median(sizes)).bit_length() - 2))
    kind = np.uint16 if sizes.max() < 1 << 16 else np.int64
    return np.stack([np.bincount((s >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width).astype(kind)
                     for s in items])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the similarity."""
    def check(batches):
        for batch in batches:
            mask = pa.array([_similar(np.frombuffer(x.as_buffer(), dtype=np.uint64),
                                      np.frombuffer(y.as_buffer(), dtype=np.uint64), percent)
                             for x, y in zip(column(batch, "x"), column(batch, "y"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(mask), column(batch, "b").filter(mask)],
                                             ["a", "b"])

    joined = (pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
              .join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b"))
    return materialize(map_arrow(joined.select("a", "b", "x", "y"), check, "a long, b long"), "links")


def _cross_links(members: DataFrame, percent: int) -> DataFrame:
    """Links between different groups of one cluster of documents that share buckets, each
    verified on the full sets where the overlap bound does not rule it out; a task gives no
    link between groups that it has linked already. ``members``: ``cluster, size, id,
    n_shingles, items, component``."""
    def solve(t: pa.Table, out: list) -> None:
        ids, n, comp, blk = (t.column(c).to_numpy() for c in ("id", "n_shingles", "component", "blk"))
        comp = comp.copy()
        items = [np.frombuffer(x, dtype=np.uint64) for x in t.column("items").to_pylist()]
        counts = _bucket_counts(items)
        across = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
        for i in range(len(ids) - 1):
            j = np.arange(i + 1, len(ids))
            j = j[(comp[j] != comp[i]) & (np.minimum(n[j], n[i]) * 100 >= percent * np.maximum(n[j], n[i]))]
            if across:
                j = j[blk[j] != blk[i]]
            most = np.minimum(counts[j], counts[i]).sum(axis=1, dtype=np.int64)
            for k in j[100 * most >= percent * (n[j] + n[i] - most)].tolist():
                if comp[k] != comp[i] and _similar(items[i], items[k], percent):
                    out.append((int(ids[i]), int(ids[k])))
                    comp[comp == comp[k]] = comp[i]

    def run(batches):
        held = None       # rows of the last group, which may go on in the next batch
        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            keys = [t.column(c).to_numpy() for c in ("cluster", "lo", "hi")]
            cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist()]
            out: list = []
            for p, q in zip(cuts, cuts[1:]):
                solve(t.slice(p, q - p), out)
            held = t.slice(cuts[-1])
            yield links_batch(out)
        out = []
        if held is not None and len(held):
            solve(held, out)
        yield links_batch(out)

    def links_batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()),
                                           pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = (members.withColumn("blk", F.pmod(F.xxhash64("id"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("cluster", "id", "n_shingles", "items", "component", "blk",
                     F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi")))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.repartition(parts, "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "id")
    return materialize(map_arrow(grouped, run, "a long, b long"), "cross-links")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``."""
    signed = materialize(sign(docs, words, id_col, text_col), "signatures")
    able = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(able.groupBy("key_a", "key_b", "n_shingles").agg(
        F.min_by(F.struct("doc_id", "bands"), "doc_id").alias("r")).select(
        "key_a", "key_b", "n_shingles", F.col("r.doc_id").alias("id"), "r.bands"), "classes")
    banded = classes.select("id", "n_shingles", F.explode("bands").alias("key"))
    hubs = materialize(banded.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size"))
                       .filter("size > 1"), "hubs")
    members = materialize(banded.join(hubs, "key"), "members")
    sizes = classes.select(F.col("id").alias("hub"), F.col("n_shingles").alias("hub_n"))
    stars = materialize(
        members.filter("id <> hub").select("hub", "id", "n_shingles").distinct().join(sizes, "hub")
        .filter(F.least("n_shingles", "hub_n") * 100 >= F.greatest("n_shingles", "hub_n") * percent)
        .select(F.col("hub").alias("a"), F.col("id").alias("b")), "stars")
    ids = materialize(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "star-ids")
    links = verify(stars, _sets(docs, ids, words, id_col, text_col), percent)
    grouped = materialize(connected_components(links), "groups")
    in_group = materialize(members.select("key", "hub", "id").join(
        grouped, F.col("id") == F.col("node"), "left").select(
        "key", "hub", "id", F.coalesce("component", "id").alias("component")), "in-group")
    split = materialize(in_group.groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key"),
        "split-buckets")
    if split.head(1):
        open_members = materialize(in_group.join(split, "key").select("hub", "id", "component").distinct(), "open")
        clusters = materialize(connected_components(open_members.select(
            F.col("hub").alias("a"), F.col("id").alias("b"))), "clusters")
        sizes = materialize(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "cluster-sizes")
        ids = materialize(clusters.select(F.col("node").alias("id")), "cluster-ids")
        whole = (clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster"))
                 .join(sizes.withColumnRenamed("component", "cluster"), "cluster")
                 .join(_sets(docs, ids, words, id_col, text_col), "id")
                 .join(classes.select("id", "n_shingles"), "id")
                 .join(grouped, F.col("id") == F.col("node"), "left")
                 .withColumn("component", F.coalesce("component", "id")))
        known = grouped.select(F.col("node").alias("a"), F.col("component").alias("b"))
        grouped = materialize(connected_components(known.union(_cross_links(whole, percent))), "groups")
    per_class = materialize(classes.select("key_a", "key_b", "n_shingles", "id").join(
        grouped, F.col("id") == F.col("node"), "left").select(
        "key_a", "key_b", "n_shingles", F.coalesce("component", "id").alias("component_id")), "per-class")
    keys = ["key_a", "key_b", "n_shingles"]
    linked = able.select("doc_id", *keys).join(per_class, keys)
    rest = signed.filter("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (linked.select("doc_id", "n_shingles", "component_id").unionByName(rest)
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group left: that of the
    smallest id. Every row is a document of its own here, whatever its id."""
    rows = with_rows(docs)
    copies = materialize(near_duplicates(rows, words, percent, ROW, inner(text_col)).filter("not kept").select(
        F.col("doc_id").alias(ROW), "component_id"), "near-copies")
    heads = copies.select(F.col("component_id").alias(ROW), "component_id").distinct()
    group = materialize(copies.union(heads).join(
        rows.select(ROW, F.col(inner(id_col)).alias("id")), ROW).select(ROW, "component_id", "id"), "near-groups")
    gone = materialize(group.join(first_rows(group, "component_id", "id"), ROW, "left_anti").select(ROW), "near-gone")
    return unpacked(bloom.drop_ids(rows, ROW, gone))
