"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document's ids (its text by the tokenizers library, then the end id) stay one piece if
they fit; a longer one is cut into pieces of ``max_tokens``, the first of which may be
shorter. Pieces are dealt over tasks by a hash of (document, piece); each task packs its
stream online: a fixed number of open bins is kept in a bitset keyed by free space, a
piece goes to the open bin with the least space that holds it, and when a new bin is
needed while all are open, the fullest one closes. Runs of ``WINDOW`` pieces are taken
longest first.

The number of streams follows from the counted pieces (at least ``STREAM`` each), not from the
session's partitions. Only (document, piece, length) rows are shuffled. Sequence numbers are unique over all
tasks. Null text is empty (a piece that is just the end id); rows with a null or repeated
id are pieces like any other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import worker_encoder
from .common import column, map_arrow, materialize, text_slices

OPEN_BINS = 4096
WINDOW = 4096
STREAM = 8 * WINDOW        # pieces of a stream at least
CACHED = 400_000           # pieces of text whose ids a worker keeps
FREQUENT = CACHED // 2     # of these, at most so many stay when it is full: the most used


class BestFit:
    """Bounded-space online best fit."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0                      # bit f: some open bin has f tokens free
        self.bins: dict[int, list[int]] = defaultdict(list)   # free space -> open bins
        self.n_open = self.n_bins = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece of 1 to ``capacity`` tokens."""
        fit = self.free >> length
        if fit:
            space = length + (fit & -fit).bit_length() - 1
            b = self._take(space)
        else:
            if self.n_open == self.open_bins and self.free:
                self._take((self.free & -self.free).bit_length() - 1)   # the fullest closes
            b, space = self.n_bins, self.capacity
            self.n_bins += 1
        left = space - length
        if left:
            self.bins[left].append(b)
            self.free |= 1 << left
            self.n_open += 1
        return b, self.capacity - space

    def _take(self, space: int) -> int:
        here = self.bins[space]
        b = here.pop()
        if not here:
            self.free &= ~(1 << space)
        self.n_open -= 1
        return b


def pieces(docs: DataFrame, definition: str, end_id: int, max_tokens: int,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                flat, counts = worker_encoder(definition, True, CACHED, FREQUENT).encode(
                    column(part, "text").fill_null("").to_pylist())
                to = np.cumsum(counts).tolist()
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, a, b in zip(column(part, "doc_id").to_pylist(), [0, *to], to):
                    ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                    first = len(ids) % max_tokens or max_tokens
                    cuts = [0, *range(first, len(ids) + 1, max_tokens)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        for out, v in zip(rows, (doc_id, k, s, e - s, zlib.crc32(ids[s:e]))):
                            out.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(),
                                                           pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(src, run, "doc_id long, piece int, start long, length long, ids_crc32 long",
                     encodes=True)


def streams(n_items: int, partitions: int) -> int:
    """Streams to deal so many pieces over: each has ``STREAM`` pieces at least, so that its
    bins left open at the end weigh little, whatever the number of partitions."""
    return max(1, min(partitions, n_items // STREAM))


def pack(items: DataFrame, max_tokens: int, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``max_tokens``."""
    items = materialize(items, "pieces")
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def run(batches):
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 40
        bins = BestFit(max_tokens, open_bins)

        def place(part: pa.Table) -> pa.Table:
            lengths = part.column("length").to_numpy()
            seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for i in np.argsort(-lengths, kind="stable").tolist():
                b, off[i] = bins.place(int(lengths[i]))
                seq[i] = base + b
            return part.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

        held = None        # fewer rows than a window, which may go on in the next batch
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            whole = len(t) - len(t) % WINDOW
            for at in range(0, whole, WINDOW):
                yield from place(t.slice(at, WINDOW).combine_chunks()).to_batches()
            held = t.slice(whole)
        if held is not None and len(held):
            yield from place(held.combine_chunks()).to_batches()

    n = streams(items.count(), int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = (items.repartition(n, "doc_id", "piece", "ids_crc32")
               .sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32"))
    return map_arrow(ordered, run, schema)


def pack_documents(docs: DataFrame, definition: str, end_id: int = 0, max_tokens: int = 2048,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces(docs, definition, end_id, max_tokens, id_col, text_col), max_tokens)
