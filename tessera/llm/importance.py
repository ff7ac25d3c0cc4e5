"""Quality selection by importance resampling.

Two generative models over hashed n-grams are fitted (words, word pairs, the first four and
last two bytes of words, and a word repeated 3 to 10 times in a row): the target model on labelled good documents (``quality = 1``, ``toxic = 0``) of a bounded
sample, the raw model on every document. A document's log weight is the sum over its
distinct n-grams of log(target rate / raw rate); rates count documents, so a word that one
document repeats, or an n-gram that occurs in a few copies only, says little. Where a
bucket's target count does not differ from the raw model's expectation by ``Z`` standard
deviations and a factor of ``FACTOR`` the target model takes the raw rate. The table is
centred so that target text scores 0 on average (a long document is not favoured for
its length).

Documents are then resampled without replacement by Gumbel top-k: the key is log weight
plus Gumbel noise (a hash of the id, so it can be recomputed), and the k largest keys
stay. k is the number of documents whose log weight reaches the threshold that best
tells labelled good from bad documents, where losing a share of the good ones counts
``GOOD_COST`` times as much as keeping that share of the bad ones; the k-th key comes
from counting passes, not from a sort. Rows tied at the k-th key all stay.

Null or empty text has no n-grams and log weight 0. Null labels are no labels; of
repeated labels the worst counts. Without labels of both kinds every document stays.
Rows that repeat an id share their noise. Null ids take part like any other. Empty
tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import (collect_blocks, column, inner, map_arrow, materialize, narrow, sum_blocks, text_bytes,
                     text_slices, unpacked, whole_rows)
from .words import mix, pair_hashes, word_hashes, words_of

BUCKETS = 1 << 18          # per n-gram order
TABLE = 2 * BUCKETS        # one-word buckets, then two-word buckets
BLOCKS = 128
SAMPLE = 20_000            # labelled documents used at most
SMOOTH = 0.5               # pseudo-count per bucket
Z, FACTOR = 3.0, 4.0
GOOD_COST = 10.0
RUNS = range(3, 11)        # repeats of one word that count as n-grams


def _runs(h: np.ndarray) -> np.ndarray:
    """A hash for every length in RUNS that a run of one word reaches."""
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    longest = int(np.diff(edge).max())
    return mix(np.arange(RUNS.start, min(longest, RUNS.stop - 1) + 1, dtype=np.uint64))


def _grams(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the distinct n-grams of each row of a slice, the row they belong to,
    and the number of words of each row."""
    idx, row, n_words = [], [], []
    for i, text in enumerate(text_bytes(column(part, "text"))):
        words = words_of(text)
        h = word_hashes(words)
        n_words.append(len(h))
        if not len(h):
            continue
        kinds = set(words)
        parts = np.concatenate([
            h, mix(word_hashes([w[:4] for w in kinds if len(w) > 4]) + np.uint64(1)),
            mix(word_hashes([w[-2:] for w in kinds]) + np.uint64(2)), _runs(h)])
        two = (pair_hashes(h[:-1], h[1:]) & np.uint64(BUCKETS - 1)) + np.uint64(BUCKETS)
        idx.append(np.unique(np.concatenate([parts & np.uint64(BUCKETS - 1), two]).astype(np.int32)))
        row.append(np.full(len(idx[-1]), i, dtype=np.int64))
    if not idx:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.array(n_words, dtype=np.int64)
    return np.concatenate(idx), np.concatenate(row), np.array(n_words, dtype=np.int64)


def label_sample(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` labelled ids (those of smallest hash): ``__t_id, good``."""
    per_doc = (labels.filter("doc_id is not null and quality is not null and toxic is not null")
               .groupBy("doc_id").agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("good")))
    return (per_doc.select(F.col("doc_id").alias("__t_id"), "good")
            .orderBy(F.xxhash64("__t_id"), "__t_id").limit(size))


KEY = "__t_key"


def _key(id_col: str, text_col: str) -> F.Column:
    """What a decision depends on: 128 bits of id and text."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"),
                          F.coalesce(F.col(text_col), F.lit(""))))


def _labelled(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, good, KEY`` of all documents; the sample has at most SAMPLE rows."""
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                        _key(id_col, text_col).alias(KEY))
            .join(F.broadcast(sample), F.col("doc_id") == F.col("__t_id"), "left")
            .select("doc_id", "text", "good", KEY))


def fit(labelled: DataFrame) -> np.ndarray:
    """Centred log ratio of target and raw rate per bucket (a table of TABLE floats)."""
    width = TABLE // BLOCKS

    def count(batches):
        acc = np.zeros((2, TABLE), dtype=np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                idx, row, _ = _grams(part)
                good = np.array([g is True for g in column(part, "good").to_pylist()], dtype=bool)
                acc[0] += np.bincount(idx, minlength=TABLE)
                if good.any():
                    acc[1] += np.bincount(idx[good[row]], minlength=TABLE)
        parts = acc.reshape(2 * BLOCKS, width)
        used = np.flatnonzero(parts.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([narrow(parts[k]) for k in used], pa.binary())],
                ["block", "data"])

    summed = sum_blocks(map_arrow(labelled, count, "block int, data binary"), "<i8", 2 * BLOCKS, width)
    raw, target = collect_blocks(summed, "<i8", 2 * TABLE, 2 * BLOCKS).reshape(2, TABLE).astype(float)
    out = np.zeros(TABLE, dtype=np.float32)
    for part in (slice(0, BUCKETS), slice(BUCKETS, TABLE)):
        n, n_raw = target[part].sum(), raw[part].sum()
        if not n:
            continue
        expected = raw[part] * (n / n_raw)
        ratio = np.log((target[part] + SMOOTH) / (expected + SMOOTH))
        differs = np.abs(target[part] - expected) > Z * np.sqrt(expected + 1)
        ratio[~differs | (np.abs(ratio) < np.log(FACTOR))] = 0.0
        out[part] = ratio - (ratio * target[part]).sum() / n
    return out


def weigh(labelled: DataFrame, table: np.ndarray) -> DataFrame:
    """``doc_id, n_words, log_weight, good, KEY`` per document."""
    shared = labelled.sparkSession.sparkContext.broadcast(table)

    def score(batches):
        ratio = shared.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                idx, row, words = _grams(part)
                n = part.num_rows
                weight = np.bincount(row, weights=ratio[idx].astype(np.float64), minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(words, pa.int64()), pa.array(weight, pa.float64()),
                     column(part, "good"), column(part, KEY)], ["doc_id", "n_words", "log_weight", "good", KEY])

    return map_arrow(labelled, score, f"doc_id long, n_words long, log_weight double, good boolean, {KEY} string")


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut of least cost (the middle of the best gap): the dropped share of good times
    GOOD_COST plus the kept share of bad; minus infinity unless there are both kinds."""
    if not len(good) or not len(bad):
        return float("-inf")
    x = np.concatenate([good, bad])
    is_bad = np.concatenate([np.zeros(len(good)), np.full(len(bad), 1.0)])
    order = np.argsort(x, kind="stable")
    x, is_bad = x[order], is_bad[order]
    gain = np.cumsum(is_bad) / len(bad) - GOOD_COST * np.cumsum(1 - is_bad) / len(good)
    gain[:-1][x[:-1] == x[1:]] = -np.inf      # no cut inside a tie
    i = int(np.argmax(gain))
    if gain[i] <= 0:
        return float("-inf")
    return float((x[i] + x[i + 1]) / 2) if i + 1 < len(x) else float(np.nextafter(x[i], np.inf))


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096, few: int = 4096) -> float:
    """The k-th largest value of a finite double column by counting passes over narrower
    and narrower ranges; ends on at most ``few`` values or on one value."""
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return lo
    c, above = F.col(col), 0
    while True:
        here = df.filter((c >= lo) & (c <= hi))
        width = (hi - lo) / bins
        if lo == hi:
            return lo
        if n <= few or lo + width <= lo:
            return _kth_of_few(here, col, k - above)
        # counts and value range per bin: at most ``bins`` + 1 rows
        rows = here.groupBy(F.floor((c - lo) / width).alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]


def _kth_of_few(df: DataFrame, col: str, k: int) -> float:
    seen = 0
    for r in sorted(df.groupBy(col).count().collect(), key=lambda r: -r[0]):
        seen += r["count"]
        if seen >= k:
            return r[0]
    raise ValueError("fewer rows than k")


def gumbel(id_col: str, seed: int) -> F.Column:
    """Standard Gumbel noise from a hash of the id."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col), F.lit(-1))), 11)
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def select(docs: DataFrame, labels: DataFrame, seed: int = 7, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, log_weight, gumbel_key, kept`` per document."""
    return _decide(docs, labels, seed, id_col, text_col).drop(KEY)


def _decide(docs: DataFrame, labels: DataFrame, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``select``, with the key of each document."""
    labelled = _labelled(docs, materialize(label_sample(labels), "label-sample"), id_col, text_col)
    scores = materialize(weigh(labelled, fit(labelled)).withColumn(
        "gumbel_key", F.col("log_weight") + gumbel("doc_id", seed)), "weights")
    # at most SAMPLE labelled ids; of rows that repeat one the lowest weight counts
    seen = scores.filter("good is not null").groupBy("doc_id").agg(
        F.first("good"), F.min("log_weight")).select(F.col("first(good)"), F.col("min(log_weight)")).collect()
    cut = best_threshold(np.array([r[1] for r in seen if r[0]]), np.array([r[1] for r in seen if not r[0]]))
    k = scores.filter(F.col("log_weight") >= cut).count()
    least = kth_largest(scores, "gumbel_key", k)
    return scores.select("doc_id", "n_words", "log_weight", "gumbel_key",
                         (F.col("gumbel_key") >= least).alias("kept"), KEY)


def keep_selected(docs: DataFrame, labels: DataFrame, seed: int = 7, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without the rows that selection rejects. A decision
    depends on id and text only, so rows are dropped by a key of both and none is copied."""
    gone = materialize(_decide(docs, labels, seed, id_col, text_col).filter("not kept").select(KEY).distinct(), "rejected")
    rows = whole_rows(docs).withColumn(KEY, _key(inner(id_col), inner(text_col)))
    return unpacked(bloom.drop_ids(rows, KEY, gone))
