"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

1. The distinct terms of the items (the queries) are collected in blocks of about
   ``BLOCK_TERMS`` terms; a block's vocabulary is the only thing a task holds of it.
2. One pass over the documents writes per document its number of terms and the counts of the
   terms of the block; totals and document frequencies are summed over all documents.
3. A task deals its documents in groups of up to ``GROUP`` and inverts each: per term a list
   of (document, impact), highest impact first. NRA reads the lists of an item in step,
   each round twice as deep. A document's score lies between the sum of the impacts read for
   it and that sum plus, for every list it was not met in, the next unread impact. An item is
   done when no unread document can reach the k-th best lower bound (ties included) and
   every document that can has equal bounds, so membership, ties and scores are final. The
   k best of the groups so far give the bound that the next group starts with.
4. Tasks give their k best per item; the best of all of them are ranked in two steps.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z
lower-cased. Scores are 64-bit integers. Null or term-free texts match nothing. Rows that repeat an id are documents
(items) of their own; of equal scores the smallest doc_id comes first, a null id last. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import collect_blocks, column, map_arrow, materialize, sum_blocks, text_bytes, text_slices

BLOCK_TERMS = 1 << 18    # terms of the items that are searched in one pass, about
GROUP = 8192             # documents inverted at once
CELLS = 1 << 23          # document x term cells of one item's search
FIRST_DEPTH = 32         # entries read from each list in the first round
DF_BLOCKS = 64
FAN_IN = 64              # tasks whose results meet in the first ranking step

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: bytes) -> list[bytes]:
    return _TERM.findall(text.lower())   # on bytes: A-Z only


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_no, item_id, terms`` (sorted, distinct) of the items that have any."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                terms = [sorted(set(terms_of(t))) for t in text_bytes(column(part, "text"))]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "item_no"), column(part, "item_id"), pa.array(terms, pa.list_(pa.binary()))],
                    ["item_no", "item_id", "terms"])

    src = items.select(F.monotonically_increasing_id().alias("item_no"), F.col(id_col).cast("long").alias("item_id"),
                       F.col(text_col).alias("text"))
    return materialize(map_arrow(src, run, "item_no long, item_id long, terms array<binary>")
                       .filter("size(terms) > 0"), "items")


def forward(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Per document with terms: ``doc_id, n, tids, tfs`` (32-bit arrays of the vocabulary's
    terms in it and their counts)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)   # one block's terms

    def run(batches):
        number = shared.value.get
        for batch in batches:
            for part in text_slices(batch, "text"):
                n, tids, tfs = [], [], []
                for text in text_bytes(column(part, "text")):
                    terms = terms_of(text)
                    counts = Counter(map(number, terms))
                    counts.pop(None, None)
                    n.append(len(terms))
                    tids.append(np.fromiter(counts.keys(), "<i4", len(counts)).tobytes())
                    tfs.append(np.fromiter(counts.values(), "<i4", len(counts)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(n, pa.int64()), pa.array(tids, pa.binary()), pa.array(tfs, pa.binary())],
                    ["doc_id", "n", "tids", "tfs"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(map_arrow(src, run, "doc_id long, n long, tids binary, tfs binary").filter("n > 0"), "forward")


def _flat(arr: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(arr.to_pylist()), dtype=dtype)


def document_frequencies(fwd: DataFrame, size: int) -> np.ndarray:
    """Documents per term number."""
    width = -(-size // DF_BLOCKS)

    def count(batches):
        acc = np.zeros(width * DF_BLOCKS, dtype=np.int64)
        for batch in batches:
            acc += np.bincount(_flat(batch.column(0), "<i4"), minlength=len(acc))
        for k, part in enumerate(acc.reshape(DF_BLOCKS, width)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                                                 ["block", "data"])

    summed = sum_blocks(map_arrow(fwd.select("tids"), count, "block int, data binary"), "<i8", DF_BLOCKS)
    return collect_blocks(summed, "<i8", width * DF_BLOCKS, DF_BLOCKS)[:size]


class Best:
    """The k best (score, document) so far, best first."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def bound(self) -> int:
        """The score that a further document must reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        s, i, n = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((i, n, -s))[:self.k]
        self.score, self.id, self.null = s[order], i[order], n[order]


def search(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, bound: int,
           depth: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """NRA over lists ``(documents, impacts)``, impacts falling and above 0: the documents
    that can be among the k best and reach ``bound``, with their scores. It reads the
    lists front to back and stops as soon as these are final."""
    n_lists = len(lists)
    lower = np.zeros(n_docs)                       # sums below 2^53: exact
    met = np.zeros((n_docs, n_lists), dtype=np.float32)
    to = [0] * n_lists
    rest = np.array([float(imp[0]) for _, imp in lists])   # next unread impact per list
    while True:
        for t, (docs, imp) in enumerate(lists):
            at, end = to[t], min(to[t] + depth, len(docs))
            if at < end:
                lower[docs[at:end]] += imp[at:end]
                met[docs[at:end], t] = 1.0
                to[t] = end
                rest[t] = imp[end] if end < len(docs) else 0.0
        depth *= 2
        unread = rest.sum()
        if n_docs > k:
            bound = max(bound, int(np.partition(lower, n_docs - k)[n_docs - k]))
        if unread:
            if unread >= bound:
                continue                           # a document not met yet could get in
            able = np.flatnonzero(lower + unread >= bound)
            open_lists = np.flatnonzero(rest)
            upper = lower[able] + (1.0 - met[np.ix_(able, open_lists)]) @ rest[open_lists]
            able, upper = able[upper >= bound], upper[upper >= bound]
            if (upper > lower[able]).any():
                continue                           # a score is not final yet
        else:
            able = np.flatnonzero(lower >= bound)
        return able, lower[able].astype(np.int64)


def _invert(tids: np.ndarray, docs: np.ndarray, impact: np.ndarray, n_terms: int):
    """Impact-sorted lists: (documents, impacts, start of every term's list)."""
    some = impact > 0
    tids, docs, impact = tids[some], docs[some], impact[some]
    order = np.lexsort((docs, -impact, tids))
    return docs[order], impact[order].astype(np.float64), np.concatenate(
        [[0], np.cumsum(np.bincount(tids, minlength=n_terms))])


def _rank_block(docs: DataFrame, items: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """``item_no, item_id, part, doc_id, score``: every task's best for the items of a block."""
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in items for t in r["terms"]}))}
    fwd = forward(docs, vocabulary, id_col, text_col)
    n_docs, n_terms = fwd.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(fwd, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    queries = [(r["item_no"], r["item_id"], np.array([vocabulary[bytes(t)] for t in r["terms"]])) for r in items]
    widest = max(len(t) for _, _, t in queries)
    group = max(64, min(GROUP, CELLS // widest))
    shared = docs.sparkSession.sparkContext.broadcast((weight, queries))   # one block's terms

    def run(batches):
        from pyspark import TaskContext
        w, asked = shared.value
        best = [Best(k) for _ in asked]
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                part = batch.slice(at, group)
                ids, n = column(part, "doc_id"), column(part, "n").to_numpy()
                tids = _flat(column(part, "tids"), "<i4")
                tf = _flat(column(part, "tfs"), "<i4").astype(np.int64)
                local = np.repeat(np.arange(len(n)), np.asarray(pa.compute.binary_length(column(part, "tids"))) // 4)
                m = 100 - 50 + (50 * n * n_docs) // n_terms
                impact = w[tids] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[local]))
                by_doc, by_impact, start = _invert(tids, local, impact, len(w))
                null, ids = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
                for top, (_, _, terms) in zip(best, asked):
                    lists = [(by_doc[start[t]:start[t + 1]], by_impact[start[t]:start[t + 1]])
                             for t in terms.tolist() if start[t + 1] > start[t]]
                    if lists:
                        able, score = search(lists, len(n), k, top.bound())
                        top.add(score, ids[able], null[able])
        for top, (no, item_id, _) in zip(best, asked):
            size = len(top.score)
            if size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([no] * size, pa.int64()), pa.array([item_id] * size, pa.int64()),
                     pa.array([TaskContext.get().partitionId() // FAN_IN] * size, pa.int32()),
                     pa.array(top.id, pa.int64(), mask=top.null), pa.array(top.score)],
                    ["item_no", "item_id", "part", "doc_id", "score"])

    return map_arrow(fwd, run, "item_no long, item_id long, part int, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item."""
    spark = docs.sparkSession
    asked = item_terms(items, item_col, item_text_col)
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_terms))
    parts = spark.createDataFrame([], "item_no long, item_id long, part int, doc_id long, score long")
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == b).orderBy("item_no").collect()
        if block:
            parts = parts.unionByName(_rank_block(docs, block, k, id_col, text_col))
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item_no", "part"], ["item_no"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
        parts = parts.withColumn("rank", place).filter(F.col("rank") <= k)
    return parts.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE_SQL = r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
q as (
  select row_number() over () as i, item_id,
         unnest(list_distinct(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term
  from benchmark),
s as (select count(*)::bigint as nn, sum(len(terms))::bigint as ll from d where len(terms) > 0),
p as (
  select r, term, count(*)::bigint as tf
  from (select r, unnest(terms) as term from d)
  where term in (select term from q) group by r, term),
w as (
  select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from p, s group by term, nn),
scored as (
  select q.i, q.item_id, d.doc_id, p.r,
         sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + (50 * len(d.terms) * s.nn) // s.ll))))::bigint as score
  from q join p on q.term = p.term join w on w.term = p.term join d on d.r = p.r, s
  group by all),
ranked as (
  select item_id, row_number() over (partition by i order by score desc, doc_id nulls last) as rank, doc_id, score
  from scored where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 50
"""
