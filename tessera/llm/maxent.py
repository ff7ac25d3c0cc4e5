"""Language-model scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(word | class). The class softmax sums weight
rows of hashed features: the last word, the last two words, and two skip features (the
second and third last word alone). Words are in classes:

* the ``HEAD`` most frequent training words form ``HEAD_CLASSES`` classes by the company
  they keep (k-means on how often they stand near each of the most frequent words);
* all others, unknown words too, are in one of ``TAIL_CLASSES`` classes by their last byte.

Inside a class a word has its smoothed training share (count + 0.1; each tail class
holds one unknown type), so the probabilities of all known words and one unknown word
per tail class sum to one.

Training is one pass over all training documents in ``ROUNDS`` rounds, each on its own
share: every task starts from the current weights, makes AdaGrad gradient updates in
sparse numpy batches over its documents, and the changes of all tasks are averaged per
weight row by the number of updates it got. Corpus counts cover all training documents.
The head words are a bounded table in every task; the counts of tail words, which grow
with the corpus, reach the documents by a join on (document, tail word) pairs.

Null or empty text scores its end token only. Rows that repeat an id are scored one by
one. A null id counts as held out. Without training documents every word is unknown.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (collect_blocks, column, map_arrow, materialize, sum_blocks, text_bytes,
                     text_slices)
from .words import mix, words_of

HEAD = 200_000
HEAD_CLASSES, TAIL_CLASSES = 24, 8
CLASSES = HEAD_CLASSES + TAIL_CLASSES
ROWS = 1 << 16             # weight rows (hashed features)
ROUNDS = 2
BLOCKS = 64
NEAR = 16                  # columns of the neighbour counts: 15 words and all others
COUNT_ENTRIES = 300_000    # counts held in a task before they are passed on
BATCH = 4096               # positions per gradient update
RATE = 0.25
SMOOTH = 0.1
END = b" "                 # stands for the end of a text; no word holds a blank
PAD = 3                    # positions before the first word


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, bucket`` with bucket = crc32(id as text) mod 10 (0: held out)."""
    doc_id = F.col(id_col).cast("long")
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    return docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"),
                       (crc % 10).cast("int").alias("bucket"), crc.alias("crc"))


def count_words(training: DataFrame) -> DataFrame:
    """``word binary, n long`` over all training texts, ends included."""
    def out(acc: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(acc), pa.binary()),
                                           pa.array(list(acc.values()), pa.int64())], ["word", "n"])

    def run(batches):
        acc: Counter = Counter()
        for batch in batches:
            for part in text_slices(batch, "text"):
                for text in text_bytes(column(part, "text")):
                    acc.update(words_of(text))
                acc[END] += part.num_rows
                if len(acc) > COUNT_ENTRIES:
                    yield out(acc)
                    acc = Counter()
        if acc:
            yield out(acc)

    parts = map_arrow(training.select("text"), run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class HeadIds(dict):
    """word -> head number, or HEAD_SIZE + tail class for all other words."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.head = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.head + tail_class(word)


def tail_class(word: bytes) -> int:
    return word[-1] & (TAIL_CLASSES - 1)


def _stream(texts: list[bytes], ids: HeadIds) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Symbols of all texts in a row, PAD pad symbols before and an end after each; the
    position of every end; the words."""
    pad = [ids.head + TAIL_CLASSES] * PAD
    get, end = ids.__getitem__, ids[END]
    parts, words_out, ends, at = [], [], [], 0
    for t in texts:
        words = words_of(t)
        x = np.empty(PAD + len(words) + 1, dtype=np.int64)
        x[:PAD] = pad
        x[PAD:-1] = np.fromiter(map(get, words), np.int64, len(words))
        x[-1] = end
        parts.append(x)
        words_out.append(words)
        at += len(x)
        ends.append(at - 1)
    return np.concatenate(parts), np.array(ends), words_out


def _features(sym: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Weight rows of the four features at each position (4 x positions)."""
    a, b, c = (sym[pos - k].astype(np.uint64) for k in (1, 2, 3))
    k = np.uint64(1 << 20)
    h = np.stack([a, (b + np.uint64(1)) * k + a, b + (k << np.uint64(24)), c + (k << np.uint64(25))])
    return (mix(h + np.uint64(0x51ED27)) & np.uint64(ROWS - 1)).astype(np.int64)


class Work:
    """Arrays of a task that every update uses again."""

    def __init__(self):
        self.logits, self.one = (np.empty((BATCH, CLASSES), dtype=np.float32) for _ in range(2))
        self.g, self.sum, self.square = (np.empty((4 * BATCH, CLASSES), dtype=np.float32) for _ in range(3))


def _class_logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, work: Work) -> np.ndarray:
    n = rows.shape[1]
    z = np.take(weights, rows[0], axis=0, out=work.logits[:n], mode="clip")
    for r in rows[1:]:
        z += np.take(weights, r, axis=0, out=work.one[:n], mode="clip")
    z += bias
    return z


def _sum_runs(z: np.ndarray, at: np.ndarray, edge: np.ndarray, out: np.ndarray, deep: int = 6) -> np.ndarray:
    """Sums of the rows ``z[at]`` over the runs that start at ``edge``: most runs are short and
    added member by member over all runs at once."""
    size = np.diff(np.append(edge, len(at)))
    g = np.take(z, at[edge], axis=0, out=out[:len(edge)], mode="clip")
    some = np.flatnonzero(size > 1)
    few, many = some[size[some] <= deep], some[size[some] > deep]
    member = 1
    while len(few):
        g[few] += z[at[edge[few] + member]]
        member += 1
        few = few[size[few] > member]
    if len(many):
        n = size[many]
        first = np.cumsum(n) - n
        g[many] = np.add.reduceat(z[at[np.repeat(edge[many] - first, n) + np.arange(n.sum())]], first, axis=0)
    return g


def _positions(sym: np.ndarray, ids: HeadIds) -> np.ndarray:
    return np.flatnonzero(sym < ids.head + TAIL_CLASSES)


def neighbour_counts(training: DataFrame, head, near: list[int]) -> np.ndarray:
    """How often each head word stands within two words of each of the ``near`` words."""
    shared = head
    size = shared.value.head
    width = -(-size // BLOCKS)

    def run(batches):
        ids = shared.value
        col = np.full(ids.head + TAIL_CLASSES + 1, len(near), dtype=np.int64)
        col[near] = np.arange(len(near))
        acc, added = np.zeros(BLOCKS * width * NEAR, dtype=np.int32), 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                sym, _, _ = _stream(text_bytes(column(part, "text")), ids)
                added += 4 * len(sym)      # at most this much in one count
                if added >= 1 << 31:
                    yield blocks_of(acc)
                    acc[:], added = 0, 4 * len(sym)
                real = sym < ids.head
                for d in (1, 2):
                    both = np.flatnonzero(real[d:] & real[:-d])
                    x, y = sym[both + d], sym[both]
                    acc += np.bincount(np.concatenate([x * NEAR + col[y], y * NEAR + col[x]]),
                                       minlength=len(acc)).astype(np.int32)
        yield blocks_of(acc)

    def blocks_of(acc: np.ndarray) -> pa.RecordBatch:
        parts = acc.reshape(BLOCKS, -1)
        used = np.flatnonzero(parts.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([parts[k].astype("<i8").tobytes() for k in used], pa.binary())],
            ["block", "data"])

    summed = sum_blocks(map_arrow(training.select("text"), run, "block int, data binary"), "<i8", BLOCKS)
    return collect_blocks(summed, "<i8", BLOCKS * width * NEAR, BLOCKS).reshape(-1, NEAR)[:size]


def word_classes(near_counts: np.ndarray, counts: np.ndarray, passes: int = 12) -> np.ndarray:
    """k-means (weighted by count) of the head words on their neighbours' square-root shares."""
    if (near_counts < 0).any():
        raise ValueError("word classes: a neighbour count is below 0")
    n = near_counts.sum(axis=1, keepdims=True)
    usual = (near_counts.sum(axis=0) + 1.0) / (near_counts.sum() + NEAR)
    x = np.sqrt((near_counts + 20.0 * usual) / (n + 20.0)).astype(np.float32)
    first = [0]
    gap = np.full(len(x), np.inf)
    for _ in range(min(HEAD_CLASSES, len(x)) - 1):       # far apart, frequent words first
        c = x[first[-1]]
        gap = np.minimum(gap, (x * x).sum(axis=1) - 2 * (x @ c) + c @ c)
        first.append(int(np.argmax(np.maximum(gap, 0) * np.sqrt(counts))))
    centre = x[first]
    weight = np.sqrt(counts.astype(float))
    for _ in range(passes):
        near = np.argmax(x @ centre.T - 0.5 * (centre ** 2).sum(axis=1), axis=1)
        total = np.bincount(near, weights=weight, minlength=len(centre))
        sums = np.stack([np.bincount(near, weights=weight * x[:, j], minlength=len(centre))
                         for j in range(NEAR)], axis=1)
        centre = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-9)[:, None], centre)
        if not np.isfinite(centre).all():
            raise ValueError("word classes: a centre is not finite; the neighbour counts are wrong")
    return near


def train_round(training: DataFrame, head, cls: np.ndarray, bias: np.ndarray,
                weights: np.ndarray) -> np.ndarray:
    """One round of distributed gradient updates; returns the new weights."""
    sc = training.sparkSession.sparkContext
    shared = sc.broadcast((cls, bias, weights))
    width = CLASSES + 1     # a row's summed change, and its number of updates

    def run(batches):
        ids = head.value
        cls, bias, start = shared.value
        w, grad2 = start.copy(), np.full(start.shape, 1e-2, dtype=np.float32)
        updates, work = np.zeros(ROWS, dtype=np.float32), Work()
        for batch in batches:
            for part in text_slices(batch, "text"):
                sym, _, _ = _stream(text_bytes(column(part, "text")), ids)
                pos = _positions(sym, ids)
                for at in range(0, len(pos), BATCH):
                    _update(w, grad2, updates, sym, pos[at:at + BATCH], cls, bias, work)
        out = np.empty((ROWS, width), dtype=np.float32)
        out[:, :-1] = (w - start) * updates[:, None]
        out[:, -1] = updates
        parts = out.reshape(BLOCKS, -1)
        if updates.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                ["block", "data"])

    summed = sum_blocks(map_arrow(training.select("text"), run, "block int, data binary"), "<f4", BLOCKS)
    total = collect_blocks(summed, "<f4", ROWS * width, BLOCKS).reshape(ROWS, width)
    shared.unpersist()
    return weights + total[:, :-1] / np.maximum(total[:, -1:], 1)


def _update(w, grad2, updates, sym, pos, cls, bias, work: Work) -> None:
    rows = _features(sym, pos)
    z = _class_logits(w, bias, rows, work)
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    n = len(pos)
    z[np.arange(n), cls[sym[pos]]] -= 1.0
    # add up the gradients of equal rows: sort (row, position) and sum runs
    key = np.sort(((rows << 13) | np.arange(n)).ravel())
    row = key >> 13
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    at = row[edge]
    g = _sum_runs(z, key & 8191, edge, work.g)
    total = np.take(grad2, at, axis=0, out=work.sum[:len(at)], mode="clip")
    total += np.multiply(g, g, out=work.square[:len(at)])
    grad2[at] = total
    g *= np.float32(RATE)
    g /= np.sqrt(total, out=total)
    new = np.take(w, at, axis=0, out=work.sum[:len(at)], mode="clip")
    new -= g
    w[at] = new
    updates[at] += 1


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    every = _documents(docs, id_col, text_col)
    training = every.filter("bucket <> 0")
    counts = materialize(count_words(training), "word-counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()     # bounded by HEAD
    words = top.column("word").to_pylist()
    head_n = top.column("n").to_numpy().astype(np.int64)
    counted = len(words)
    if END not in words:
        words.append(END)     # no training document, or a corpus of one-off words
        head_n = np.append(head_n, 0)
    del top
    ids = HeadIds(words)
    head = sc.broadcast(ids)
    # tail totals per class: counted tail words, tail tokens
    last = F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(TAIL_CLASSES - 1))
    per_tail = {r["t"]: (r["n"], r["v"]) for r in counts.groupBy(last.alias("t")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    tail_n, tail_v = (np.array([per_tail.get(t, (0, 0))[i] for t in range(TAIL_CLASSES)], dtype=np.float64)
                      for i in (0, 1))
    of_head = np.array([tail_class(w) for w in words[:counted]], dtype=np.int64)
    tail_n -= np.bincount(of_head, weights=head_n[:counted], minlength=TAIL_CLASSES)
    tail_v -= np.bincount(of_head, minlength=TAIL_CLASSES)
    near = [i for i, w in enumerate(words) if w != END][:NEAR - 1]
    cls = np.concatenate([word_classes(neighbour_counts(training, head, near), head_n),
                          HEAD_CLASSES + np.arange(TAIL_CLASSES)])
    # share of a word in its class, and of a class in all tokens
    mass = np.bincount(cls[:len(words)], weights=head_n + SMOOTH, minlength=CLASSES)
    tail_mass = tail_n + SMOOTH * (tail_v + 1)
    mass[HEAD_CLASSES:] = tail_mass
    bias = np.log(np.maximum(mass, 1e-3) / mass.sum()).astype(np.float32)
    inside = np.concatenate([np.log10((head_n + SMOOTH) / mass[cls[:len(words)]]), -np.log10(tail_mass)])
    base = np.concatenate([np.log10(head_n + SMOOTH), np.zeros(TAIL_CLASSES)])
    known = np.concatenate([head_n > 0, np.zeros(TAIL_CLASSES, dtype=bool)])
    base_all = float(np.log10(n_all + SMOOTH * (v_all + 1)))
    weights = np.zeros((ROWS, CLASSES), dtype=np.float32)
    for i in range(ROUNDS):
        share = training.filter(F.pmod(F.shiftright("crc", 8), F.lit(ROUNDS)) == i)
        weights = train_round(share, head, cls, bias, weights)
    model = sc.broadcast((cls, bias, weights, inside, base, known))

    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 40
        ids, work = head.value, Work()
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield from _score_slice(part, ids, model.value, row, work)
                row += part.num_rows

    scored = materialize(map_arrow(every, run, (
        "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
        "score double, word binary, n int")), "scores")
    tails = (scored.filter("word is not null").select("row", "word", "n")
             .join(counts.withColumnRenamed("n", "c"), "word", "left")
             .groupBy("row").agg(
                 F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("tail"),
                 F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known")))
    tail = F.coalesce("tail", F.lit(0.0))
    return (scored.filter("word is null").drop("word", "n").join(tails, "row", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
                    F.lit(int(n_all)).cast("long").alias("train_tokens"),
                    (F.col("base") + tail - F.col("n_tokens") * base_all).alias("base_score"),
                    (F.col("score") + tail).alias("score")))


def _score_slice(part: pa.RecordBatch, ids: HeadIds, model, row: int, work: Work):
    cls, bias, weights, inside, base, known = model
    sym, ends, words = _stream(text_bytes(column(part, "text")), ids)
    pos = _positions(sym, ids)
    log_class = np.empty(len(pos))
    for at in range(0, len(pos), BATCH):
        p = pos[at:at + BATCH]
        z = _class_logits(weights, bias, _features(sym, p), work)
        target = z[np.arange(len(p)), cls[sym[p]]]
        top = z.max(axis=1)
        log_class[at:at + BATCH] = target - top - np.log(np.exp(z - top[:, None]).sum(axis=1))
    text = np.searchsorted(ends, pos)
    n, s = part.num_rows, sym[pos]
    total = lambda x: np.bincount(text, weights=x, minlength=n)
    held = np.array(column(part, "bucket").to_pylist()) == 0
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "n"]
    rows = np.arange(row, row + n)
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows), column(part, "doc_id"), pa.array(held),
         pa.array(np.bincount(text, minlength=n), pa.int64()),
         pa.array(total(known[s]).round(), pa.float64()).cast(pa.int64()), pa.array(total(base[s])),
         pa.array(total(log_class / np.log(10) + inside[s])), pa.nulls(n, pa.binary()),
         pa.nulls(n, pa.int32())], names)
    # tail words of each text with their number, to be joined with their counts
    t_row, t_word, t_n = [], [], []
    start = 0
    for i, w in enumerate(words):
        mine = sym[start + PAD:start + PAD + len(w)]
        start += PAD + len(w) + 1
        here = Counter([w[k] for k in np.flatnonzero(mine >= ids.head).tolist()])
        t_row += [row + i] * len(here)
        t_word += here.keys()
        t_n += here.values()
    k = len(t_row)
    if k:
        yield pa.RecordBatch.from_arrays(
            [pa.array(t_row, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()),
             pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()),
             pa.nulls(k, pa.float64()), pa.array(t_word, pa.binary()), pa.array(t_n, pa.int32())], names)
