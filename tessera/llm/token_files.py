"""Token id files: independent zstandard frames and a trailing seek table.

A file holds the documents of one range of ids in ascending order. Its frames follow
the zstandard seekable format: any zstandard reader can unpack the file, and the last
frame (a skippable one) lists compressed size, uncompressed size and checksum (low 32
bits of XXH64 of the uncompressed bytes) of every frame. The frame before it is the
index: first id, number of documents and of tokens of each data frame. A reader of one
document reads the tail, the index and one data frame.

Data frame: ``n``, id width in bytes (uint32 each); per document its id (int64), null
flag (uint8), number of tokens (uint32); then the token ids of all documents.

Files are written by the tasks to the shared folder under a name of their own per
attempt; only files listed in the manifest (a table Spark commits) count, so lost
executors and repeated tasks leave no trace in results. The manifest's rows (one per
file) meet in one task and are stored as one file, and a reading task takes several
small files. Null text is empty (just the end id); null ids sort first; rows that repeat
an id follow each other, ordered by text; an empty table makes no file; other columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import worker_library_encoder
from .common import column, map_arrow, materialize, scratch_path, text_slices

# fixed values of the zstandard seekable format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FRAME_BYTES = 256 << 10   # raw bytes of a data frame; a larger document has a frame of its own
LEVEL = 1
READ_BYTES = 16 << 20     # of files for one reading task, if there are more than a task a core
_INDEX = np.dtype([("first", "<i8"), ("docs", "<u4"), ("tokens", "<u8")])


class FrameWriter:
    """Writes documents, in order, to a binary stream."""

    def __init__(self, out):
        self.out, self.table, self.index = out, [], []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.size = self.n_docs = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.size += 13 + 4 * len(ids)
        self.n_docs += 1
        self.n_tokens += len(ids)
        if self.size >= FRAME_BYTES:
            self._flush()

    def _frame(self, raw: bytes) -> None:
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if not self.docs:
            return
        ids = np.concatenate([x for _, x in self.docs])
        width = 2 if not len(ids) or ids.max() < 65536 else 4
        keys = np.array([d if d is not None else 0 for d, _ in self.docs], dtype="<i8")
        null = np.array([d is None for d, _ in self.docs], dtype=np.uint8)
        lens = np.array([len(x) for _, x in self.docs], dtype="<u4")
        self._frame(struct.pack("<II", len(keys), width) + keys.tobytes() + null.tobytes()
                    + lens.tobytes() + ids.astype(f"<u{width}").tobytes())
        self.index.append((int(keys[0]), len(keys), len(ids)))
        self.docs, self.size = [], 0

    def close(self) -> None:
        self._flush()
        self._frame(np.array(self.index, dtype=_INDEX).tobytes())
        body = b"".join(struct.pack("<III", *t) for t in self.table)
        footer = struct.pack("<IBI", len(self.table), 0x80, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body) + len(footer)) + body + footer)


class FrameReader:
    """Reads a file of this format from a seekable binary stream."""

    def __init__(self, src, size: int):
        self.src = src
        self.zstd = zstandard.ZstdDecompressor()
        src.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", src.read(9))
        if magic != SEEKABLE_MAGIC or flags != 0x80:
            raise ValueError("not a token id file: no seek table")
        src.seek(size - 9 - 12 * frames)
        self.table = np.frombuffer(src.read(12 * frames), dtype="<u4").reshape(frames, 3).astype(np.int64)
        self.at = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        self.index = np.frombuffer(self._raw(frames - 1), dtype=_INDEX)

    def _raw(self, i: int) -> bytes:
        packed, raw_size, check = self.table[i].tolist()
        self.src.seek(int(self.at[i]))
        raw = self.zstd.decompress(self.src.read(packed), max_output_size=raw_size)
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged: its checksum differs")
        return raw

    def frame(self, i: int) -> tuple[list, np.ndarray, np.ndarray]:
        """Document ids, numbers of tokens and all token ids of data frame ``i``."""
        raw = self._raw(i)
        n, width = struct.unpack_from("<II", raw)
        keys = np.frombuffer(raw, "<i8", n, 8)
        null = np.frombuffer(raw, np.uint8, n, 8 + 8 * n)
        lens = np.frombuffer(raw, "<u4", n, 8 + 9 * n).astype(np.int64)
        ids = np.frombuffer(raw, f"<u{width}", int(lens.sum()), 8 + 13 * n)
        return [None if z else k for k, z in zip(keys.tolist(), null)], lens, ids

    def document(self, doc_id: int) -> np.ndarray | None:
        """Token ids of one document (the first of that id), or None; unpacks only
        the frames whose range of ids holds it."""
        i = max(0, int(np.searchsorted(self.index["first"], doc_id, side="left")) - 1)
        while i < len(self.index) and (i == 0 or self.index["first"][i] <= doc_id):
            keys, lens, ids = self.frame(i)
            if doc_id in keys:
                k = keys.index(doc_id)
                end = int(lens[:k + 1].sum())
                return ids[end - int(lens[k]):end]
            i += 1
        return None


def open_file(path: str) -> tuple[FrameReader, object]:
    store, inner = pafs.FileSystem.from_uri(path)
    src = store.open_input_file(inner)
    return FrameReader(src, src.size()), src


MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long"


def write_files(docs: DataFrame, definition: str, end_id: int, path: str,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, add ``end_id``, write files in ascending id order below
    ``path`` and return the manifest (one row per file; ``part`` is the file order)."""
    def run(batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        writer = out = None
        for batch in batches:
            for part in text_slices(batch, "text"):
                flat, counts = worker_library_encoder(definition).encode(
                    column(part, "text").fill_null("").to_pylist())
                if writer is None:
                    store, inner = pafs.FileSystem.from_uri(path)
                    store.create_dir(inner, recursive=True)
                    name = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.tok.zst"
                    out = store.open_output_stream(f"{inner}/{name}", compression=None)
                    writer = FrameWriter(out)
                to = np.cumsum(counts).tolist()
                for doc_id, a, b in zip(column(part, "doc_id").to_pylist(), [0, *to], to):
                    writer.add(doc_id, np.append(flat[a:b], np.uint32(end_id)))
        if writer is not None:
            writer.close()
            n_bytes = out.tell()
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": ctx.partitionId(), "path": f"{path}/{name}", "n_docs": writer.n_docs,
                  "n_tokens": writer.n_tokens, "n_bytes": n_bytes}],
                schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()),
                                  ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    src = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
           .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    # not a table file for each row: Hadoop's local file system starts a process (chmod) for every
    # file and folder that it makes, and until that runs it counts with all memory of the executor
    return materialize(map_arrow(src, run, MANIFEST, encodes=True).repartition(1), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``. Frames are
    unpacked one by one and checked."""
    # one row per file: the running sum over files is a small table
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("part", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    files, n_bytes = manifest.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(files, max(cores, -(-n_bytes // READ_BYTES))))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader, src = open_file(row["path"])
                start = row["base"]
                for i in range(len(reader.index)):
                    keys, lens, ids = reader.frame(i)
                    to = np.cumsum(lens)
                    wide = ids.astype("<u4")
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip([0, *to.tolist()], to.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array(start + to - lens, pa.int64()),
                         pa.array(lens, pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(lens.sum())
                src.close()

    return map_arrow(based.repartition(n), run,
                     "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, definition: str, end_id: int) -> DataFrame:
    """Write all documents to files in the shared folder and read them back."""
    spark: SparkSession = docs.sparkSession
    return read_files(write_files(docs, definition, end_id, scratch_path(spark, "token-files")))
