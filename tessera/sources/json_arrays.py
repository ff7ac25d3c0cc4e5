"""JSON arrays of objects read in parallel, also when one file is the whole table.

Spark's ``multiLine`` JSON reader parses a file in one task. Here a file is read in the
ordinary byte-range splits, cut at every ``}`` by the text source's line separator, so
that a split is an ordered run of fragments. Whether a split begins inside a string, and at
which brace depth, depends on all splits before it, but only through a small summary: the
parity of its unescaped quotes, and the change and the lowest point of the depth for either
beginning.

1. Every split is summed up (one narrow row).
2. Per file the summaries are composed in order (a prefix scan over one row per split),
   which gives each split its beginning, and the split in which the object that it begins
   inside was opened.
3. Every split cuts out its objects. An object that crosses a border gives one piece per
   split; the pieces, at most one per border and split, meet by (file, split it was opened
   in) and are joined.
4. Spark parses the object texts (``from_json``, malformed records fail).

Only objects may be elements. Anything else between them, a file that ends inside an
object or string, or one without its closing bracket fails the read. An empty file has no records.
"""

from __future__ import annotations

import re
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

_ESCAPED = re.compile(r"\\.", re.S)
_FIRST = re.compile(r"\ufeff?\s*\[\s*")              # before the first object
_NEXT = re.compile(r"\s*,\s*")                      # before all others
_LAST = re.compile(r"\s*\]\s*")                      # after the last one
_NOTHING = re.compile(r"\ufeff?\s*(\[\s*\]\s*)?")   # a file without objects

BROADCAST_SPLITS = 500_000    # splits whose beginnings are broadcast (about 100 bytes each)

_FRAGMENTS = ["file", "start", "fragment"]


def _outside(fragment: str, inside: bool) -> tuple[str, bool]:
    """The parts of a fragment outside strings, quotes as marks, and whether it ends inside one.
    Escapes occur inside strings only, so dropping them first keeps the quotes that count."""
    parts = (_ESCAPED.sub("", fragment) if "\\" in fragment else fragment).split('"')
    return '"'.join(parts[1 if inside else 0::2]), inside ^ (len(parts) % 2 == 0)


class _Summary:
    """What the splits after this one must know of it, for either beginning."""

    def __init__(self):
        self.odd, self.depth, self.low = False, [0, 0], [0, 0]

    def add(self, fragment: str, closed: bool) -> None:
        for begin in (0, 1):
            out, inside = _outside(fragment, bool(begin) ^ self.odd)
            self.depth[begin] += out.count("{") - (closed and not inside)
            self.low[begin] = min(self.low[begin], self.depth[begin])
        self.odd = inside ^ True      # the second beginning was inside a string


def _fragments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, start, fragment, closed`` in file order inside a split."""
    raw = spark.read.option("lineSep", "}").text(paths)
    return raw.select(F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("fragment"))


def _summaries(fragments: DataFrame) -> DataFrame:
    def run(batches):
        key, summary = None, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in (*key, summary.odd, *summary.depth, *summary.low)],
                ["file", "start", "odd", "d0", "d1", "l0", "l1"])

        for batch in batches:
            for file, start, fragment in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start) != key:
                    if key is not None:
                        yield row()
                    key, summary = (file, start), _Summary()
                summary.add(fragment, True)
        if key is not None:
            yield row()

    return fragments.mapInArrow(run, "file string, start long, odd boolean, d0 long, d1 long, l0 long, l1 long")


def _compose(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Beginnings of a file's splits in order: (start, inside a string, depth, split in which
    the object open at its beginning was opened, last split)."""
    inside, depth, owner, out = False, 0, None, []
    for start, odd, *changes in rows:
        change, low = changes[inside], changes[2 + inside]
        out.append([start, inside, depth, owner, False])
        closes = depth + low <= 0
        depth += change
        if depth > 0 and (owner is None or closes):
            owner = start
        elif depth <= 0:
            owner = None
        inside ^= odd
    if out:
        out[-1][4] = True
    yield from map(tuple, out)


def _beginnings(summaries: DataFrame) -> DataFrame:
    import pandas as pd

    def scan(key, pdf):
        rows = pdf.sort_values("start")[["start", "odd", "d0", "d1", "l0", "l1"]].itertuples(index=False)
        out = pd.DataFrame(list(_compose(rows)), columns=["start", "inside", "depth", "owner", "last"])
        out.insert(0, "file", key[0])
        out["owner"] = out["owner"].astype("Int64")
        return out

    return summaries.groupBy("file").applyInPandas(
        scan, "file string, start long, inside boolean, depth long, owner long, last boolean")


class _Cutter:
    """Cuts the objects out of one split's fragments."""

    def __init__(self, file, start, inside, depth, owner, last):
        self.file, self.start, self.inside, self.depth, self.last = file, start, inside, depth, last
        self.first = start == 0                        # no object of the file yet
        self.owner = owner if depth > 0 else None      # None: the open object began here
        self.crossed = depth > 0
        self.parts: list[str] = []
        self.held: str | None = None                   # the last fragment may be the end of the file

    def feed(self, fragment: str):
        if self.held is not None:
            yield from self._take(self.held)
        self.held = fragment

    def _fail(self, what: str):
        raise ValueError(f"{self.file}: {what} near byte {self.start} and after is no JSON array of objects")

    def _take(self, fragment: str):
        """A fragment that a brace ends."""
        out, ends_inside = _outside(fragment, self.inside)
        if self.depth <= 0:
            gap = (_FIRST if self.first else _NEXT).match(fragment)
            if not gap or fragment[gap.end():gap.end() + 1] != "{":
                self._fail("text between objects")
            fragment, self.first = fragment[gap.end():], False
        self.depth += out.count("{") - (not ends_inside)
        self.inside = ends_inside
        self.parts.append(fragment + "}")
        if self.depth == 0 and not self.inside:
            yield self._object()
        elif self.depth < 0:
            self._fail("a closing brace")

    def _object(self):
        """A whole object, or the last piece of one that began in another split."""
        text, self.parts = "".join(self.parts), []
        row = (self.file, self.owner, self.start, text) if self.crossed else (self.file, None, None, text)
        self.crossed, self.owner = False, None
        return row

    def close(self):
        if self.last:
            tail = self.held or ""
            if self.depth > 0 or self.inside:
                self._fail("an object that does not end")
            if not (_NOTHING if self.first else _LAST).fullmatch(tail):
                self._fail("the end")
        elif self.held is not None:
            yield from self._take(self.held)
        if self.parts:       # an object goes on in the next split
            yield self.file, (self.owner if self.crossed else self.start), self.start, "".join(self.parts)


def _cut(fragments: DataFrame) -> DataFrame:
    """``file, owner, start, text``: whole objects (owner null) and pieces of crossing ones."""
    fields = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("start", pa.int64()), ("text", pa.string())])

    def run(batches):
        key, cutter = None, None
        for batch in batches:
            rows: list = []
            for file, start, fragment, inside, depth, owner, last in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start) != key:
                    if cutter is not None:
                        rows += cutter.close()
                    key, cutter = (file, start), _Cutter(file, start, inside, depth, owner, last)
                rows += cutter.feed(fragment)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
        if cutter is not None and (rows := list(cutter.close())):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return fragments.mapInArrow(run, "file string, owner long, start long, text string")


def split_bound(spark: SparkSession, sizes: list[int]) -> int:
    """At most so many splits does Spark read files of these sizes in."""
    conf = {k: int(spark._jsparkSession.sessionState().conf().getConfString(f"spark.sql.files.{k}").rstrip("b"))
            for k in ("maxPartitionBytes", "openCostInBytes")}
    cost = conf["openCostInBytes"]
    per_core = sum(size + cost for size in sizes) // spark.sparkContext.defaultParallelism
    split = max(1, min(conf["maxPartitionBytes"], max(cost, per_core)))
    return sum(-(-size // split) for size in sizes)


def object_texts(spark: SparkSession, paths: list[str], few_splits: bool = True) -> DataFrame:
    """``text``: every object of the arrays in ``paths``, as written. With ``few_splits`` (at
    most BROADCAST_SPLITS) the beginnings are broadcast, so that fragments stay in place and in
    order; else the fragments are numbered, joined and sorted by split."""
    ship_package(spark)
    fragments = _fragments(spark, paths)
    begin = _beginnings(_summaries(fragments)).withColumnsRenamed({"file": "_f", "start": "_s"})
    on = (F.col("file") == F.col("_f")) & (F.col("start") == F.col("_s"))
    if few_splits:
        known = fragments.join(F.broadcast(begin), on)
    else:
        known = (fragments.withColumn("_at", F.monotonically_increasing_id()).join(begin, on)
                 .repartition("file", "start").sortWithinPartitions("file", "start", "_at"))
    cut = _cut(known.select(*_FRAGMENTS, "inside", "depth", "owner", "last"))
    whole = cut.filter(F.col("owner").isNull()).select("text")
    crossing = cut.filter(F.col("owner").isNotNull()).groupBy("file", "owner").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "")
        .alias("text")).select("text")
    return whole.unionByName(crossing)


def read_json_arrays(spark: SparkSession, paths: list[str], schema: T.StructType, sizes: list[int]) -> DataFrame:
    """The records of files that hold one JSON array of objects each (``sizes``: their bytes)."""
    texts = object_texts(spark, paths, split_bound(spark, sizes) <= BROADCAST_SPLITS)
    return texts.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
