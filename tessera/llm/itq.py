"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample (``SAMPLE`` vectors of smallest id hash): the
centred vectors are turned to their principal axes and the rotation alternates between
signs and the best orthogonal map onto them, so that the sign bits are balanced and lose
little. Every vector gets one or more 64-bit codes (one per rotation), each cut into four
tables of 16 bits. A pair is a candidate if in some table its codes differ in at most one
bit and in at most ``RADIUS`` bits of that code; candidates are ranked again with their
original vectors, and pairs with cosine >= the threshold are links.

How many codes are needed depends on the vectors (a common offset or clusters bring the
centred vectors of a pair apart), so it is measured: rotations are added until pairs just
at the threshold, made from sample vectors (``PROBES``), are found with recall
``RECALL``. After ``CENTRED`` rotations the next ones are random and not centred: their
recall depends on the angle of a pair only. The job fails if ``MAX_CODES`` codes do not
reach it.

Equal vectors are collapsed first, so copies are never paired with one another. A pair
is only formed in the first table that finds it. Vectors that are null, zero, or hold
null or non-finite components, and rows with a null id, link with nothing. Shorter
vectors count as padded with zeros. Rows that repeat an id and vector count as copies; rows
that repeat an id with other vectors are vectors of their own.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, materialize
from .components import connected_components

BITS, TABLES = 64, 4
CHUNK = BITS // TABLES
SAMPLE = 20_000
RADIUS = 20
ROUNDS = 50
PROBES, RECALL, CENTRED, MAX_CODES = 4_000, 0.97, 4, 12


def unit_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, unit array<double>`` (null unless the vector can link)."""
    v = F.col("v")
    sane = (F.col("vec_id").isNotNull() & v.isNotNull()
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    top = F.array_max(F.transform(v, F.abs))
    scaled = F.transform(v, lambda x: x / F.col("top"))
    norm = F.sqrt(F.aggregate(F.col("s"), F.lit(0.0), lambda a, x: a + x * x))
    raw = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return (raw.withColumn("v", F.when(sane, v)).withColumn("top", top)
            .withColumn("s", scaled).withColumn("norm", norm)
            .select("vec_id", F.transform("s", lambda x: x / F.col("norm")).alias("unit")))


def learn(sample: np.ndarray, bits: int = BITS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension x bits) of iterative quantisation. With fewer
    dimensions than bits, several rotations stand side by side."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x.T @ x)
    parts, left = [], bits
    while left:
        k = min(left, x.shape[1])
        pc = axes[:k].T
        z = x @ pc
        rot, _ = np.linalg.qr(rng.normal(size=(k, k)))
        for _ in range(ROUNDS):
            sign = np.where(z @ rot >= 0, 1.0, -1.0)
            a, _, b = np.linalg.svd(sign.T @ z)
            rot = (a @ b).T
        parts.append(pc @ rot)
        left -= k
    return mean, np.concatenate(parts, axis=1)


def threshold_pairs(sample: np.ndarray, threshold: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at the threshold: sample vectors, each turned towards another one
    (odd rows) or to a random side (even rows)."""
    rng = np.random.default_rng(seed)
    p = sample[rng.integers(0, len(sample), PROBES)]
    other = sample[rng.integers(0, len(sample), PROBES)] - sample[rng.integers(0, len(sample), PROBES)]
    side = rng.normal(size=p.shape)
    moved = np.linalg.norm(other, axis=1) > 1e-9
    odd = (np.arange(PROBES) % 2 == 1) & moved
    side[odd] = other[odd]
    side -= (side * p).sum(axis=1, keepdims=True) * p
    size = np.linalg.norm(side, axis=1, keepdims=True)
    turned = size[:, 0] > 1e-9
    p, side = p[turned], side[turned] / size[turned]
    return p, threshold * p + np.sqrt(1 - threshold * threshold) * side


def _found(p: np.ndarray, q: np.ndarray, shift: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Whether the tables of one code find each pair."""
    differ = ((p @ projection >= shift) != (q @ projection >= shift)).reshape(len(p), TABLES, CHUNK).sum(axis=2)
    return (differ.min(axis=1) <= 1) & (differ.sum(axis=1) <= RADIUS)


def learn_codes(sample: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Shift and projection (dimension x BITS per code) with as many codes as the recall needs."""
    p, q = threshold_pairs(sample, threshold)
    found, shifts, parts = np.zeros(len(p), dtype=bool), [], []
    rng = np.random.default_rng(29)
    for i in range(MAX_CODES):
        if i < CENTRED:
            mean, projection = learn(sample, seed=11 + i)
        else:
            mean, projection = np.zeros(sample.shape[1]), rng.normal(size=(sample.shape[1], BITS))
        parts.append(projection)
        shifts.append(mean @ projection)
        found |= _found(p, q, shifts[-1], projection)
        if not len(p) or found.mean() >= RECALL:
            return np.concatenate(shifts), np.concatenate(parts, axis=1)
    raise ValueError(f"{MAX_CODES} codes find {found.mean():.3f} of the pairs at the threshold, not {RECALL}")


def _codes(reps: DataFrame, shift: np.ndarray, projection: np.ndarray) -> DataFrame:
    """``id, code_0, code_1, ...``"""
    shared = reps.sparkSession.sparkContext.broadcast((shift, projection))
    n = projection.shape[1] // BITS

    def run(batches):
        shift, projection = shared.value
        for batch in batches:
            x = _matrix(column(batch, "unit"), len(projection))
            code = np.packbits(x @ projection >= shift, axis=1).view(">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), *(pa.array(np.ascontiguousarray(code[:, i])) for i in range(n))],
                ["id", *(f"code_{i}" for i in range(n))])

    return map_arrow(reps.select("id", "unit"), run, ", ".join(["id long", *(f"code_{i} long" for i in range(n))]))


def _matrix(units: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(units), width))
    lens = np.diff(units.offsets.to_numpy())
    flat = units.flatten().to_numpy()
    row = np.repeat(np.arange(len(units)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def candidates(codes: DataFrame) -> DataFrame:
    """Pairs ``a < b`` that the tables of some code find (each pair once)."""
    names = [c for c in codes.columns if c != "id"]

    def chunk(code: str, t) -> F.Column:
        return F.shiftrightunsigned(F.col(code), CHUNK * t).bitwiseAND(F.lit((1 << CHUNK) - 1).cast("long"))

    def rows(side: str, probe: bool) -> DataFrame:
        flips = [0, *(1 << i for i in range(CHUNK))] if probe else [0]
        entries = [F.struct(F.lit(i * TABLES + t).alias("t"),
                            chunk(c, t).bitwiseXOR(F.lit(f).cast("long")).alias("k"))
                   for i, c in enumerate(names) for t in range(TABLES) for f in flips]
        own = [f"{c}_{side}" for c in names]
        return codes.select(F.col("id").alias(side), *[F.col(c).alias(o) for c, o in zip(names, own)],
                            F.explode(F.array(*entries)).alias("e")).select(
            side, *own, F.col("e.t").alias(f"t_{side}"), F.col("e.k").alias(f"k_{side}"))

    p, q = rows("a", True), rows("b", False)
    diff = [F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")) for c in names]
    close = [F.bit_count(d) <= RADIUS for d in diff]
    near = [F.bit_count(F.shiftrightunsigned(d, CHUNK * t).bitwiseAND(
        F.lit((1 << CHUNK) - 1).cast("long"))) <= 1 for d in diff for t in range(TABLES)]
    first = F.lit(True)     # no earlier table finds the pair
    for t in range(len(near) - 1):
        first = first & ((F.col("t_a") <= t) | ~(near[t] & close[t // TABLES]))
    here = F.lit(False)
    for i, c in enumerate(close):
        here = here | ((F.col("t_a") >= i * TABLES) & (F.col("t_a") < (i + 1) * TABLES) & c)
    on = ((F.col("t_a") == F.col("t_b")) & (F.col("k_a") == F.col("k_b")) & (F.col("a") < F.col("b"))
          & here & first)
    return p.join(q, on).select("a", "b")


def link_vectors(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``."""
    key = F.sha2(F.concat_ws(",", F.transform("unit", lambda x: (x + 0.0).cast("string"))), 256)
    units = materialize(unit_vectors(df, id_col, vec_col).withColumn(
        "key", F.when(F.col("unit").isNotNull(), key)), "units")
    width = units.agg(F.max(F.size("unit"))).first()[0]
    if width is None or width < 1:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                            F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = materialize(units.filter("unit is not null").groupBy("key").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"),
        F.min_by("unit", "vec_id").alias("unit")).withColumn("num", F.monotonically_increasing_id()), "classes")
    sample = classes.orderBy(F.xxhash64("id"), "key").limit(SAMPLE).select("unit").toArrow()
    shift, projection = learn_codes(_matrix(sample.column(0).combine_chunks(), width), threshold)
    # classes have numbers of their own: two of them may share a repeated id
    pairs = candidates(materialize(_codes(classes.select(F.col("num").alias("id"), "unit"), shift, projection), "codes"))
    va = classes.select(F.col("num").alias("a"), F.col("unit").alias("ua"))
    vb = classes.select(F.col("num").alias("b"), F.col("unit").alias("ub"))
    # a shorter vector has zeros at its end: they add nothing to the product
    n = F.least(F.size("ua"), F.size("ub"))
    dot = F.aggregate(F.zip_with(F.slice("ua", F.lit(1), n), F.slice("ub", F.lit(1), n),
                                 lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    links = materialize(pairs.join(va, "a").join(vb, "b").filter(dot >= threshold).select("a", "b"), "links")
    both = links.union(links.select("b", "a"))
    size = classes.select(F.col("num").alias("b"), "copies")
    degree = both.join(size, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    comp = materialize(connected_components(links), "components")
    smallest = materialize(comp.join(classes.select(F.col("num").alias("node"), "id"), "node").groupBy("component").agg(
        F.min("id").alias("component_id")), "smallest-ids")
    per_class = materialize(
        classes.select("key", "num", "id", "copies").join(degree, F.col("num") == F.col("a"), "left")
        .join(comp.join(smallest, "component"), F.col("num") == F.col("node"), "left")
        .select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                F.coalesce("component_id", "id").alias("component_id")), "per-class")
    linked = units.filter("key is not null").select("vec_id", "key").join(per_class, "key")
    rest = units.filter("key is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (linked.select("vec_id", "n_links", "component_id").unionByName(rest)
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


ORACLE_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) as (
  select vec_id, vec_id from v
  union
  select r.a, l.b from reach r join links l on r.b = l.a)
select v.vec_id, (select count(*) from links l where l.a = v.vec_id) as n_links,
       min(r.b) as component_id, v.vec_id = min(r.b) as kept
from v join reach r on r.a = v.vec_id group by v.vec_id
"""
