"""Repeated passages by an enhanced suffix array.

A byte is removed if a string of ``least`` (200) bytes that covers it also starts
anywhere else, in the same document or another. Matches never cross documents.

1. Every 200-byte window has a key: the smallest hash of its 32-byte grams. Equal windows
   have equal keys, and neighbouring windows mostly share theirs, so a text falls into
   runs of windows of one key. Keys that several runs have (or a run whose key gram
   occurs twice in it) are counted over all documents.
2. A bounded filter of the repeated keys goes to a second pass, which keeps the text of
   runs the filter may hold. Equal regions are collapsed.
3. Regions meet by key. Each task sorts the suffixes that start a window (a suffix array
   over its regions), computes the common prefixes of neighbours, and scans them with a
   stack: the common-prefix interval tree. An interval of at least 200 bytes whose
   occurrences differ in the byte before them (left-extension diversity) is a maximal
   repeat; it covers all its occurrences. Non-diverse intervals are covered by the one
   that starts a byte earlier. At most ``SUFFIXES`` suffixes are sorted at once, those with
   the same window together; where one window alone has more (a short line that goes on
   and on), its suffixes are sorted in several lots and every interval counts as diverse.
4. Covered ranges go back to the documents; documents without any pass straight through.

A key shared by more than ``HOT`` distinct regions is not gathered in one task: its
windows are counted one by one (summed in the tasks first), which gives the intervals
of depth 200.

Null text is empty. Rows that repeat an id and a text repeat each other, so all of their
long-enough text goes. Null ids are documents like any other. Empty tables give empty
results; other columns are ignored. ``least`` below ``MIN_LEAST`` (64) is refused.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import bloom
from .common import column, inner, map_arrow, materialize, text_bytes, text_slices, unpacked, whole_rows
from .words import mix

LEAST = 200
GRAM = 32
MIN_LEAST = 2 * GRAM      # shorter passages have too few grams for a key
BUFFER = 1 << 18          # bytes hashed at once
PIECE = 1 << 18           # windows of a piece of a long text
SORT_BYTES = 512 << 10    # region bytes in one suffix array (whole keys; one key may be larger)
DEPTH = 256               # suffixes are compared this far, or ``least`` if that is more; longer prefixes count as this long
SUFFIXES = 80_000         # suffixes sorted at once
HOT = 4_000
SEEN = 200_000            # regions remembered per task so that copies are sent once
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_FACTOR = 0x9E3779B97F4A7C15
_POS = np.uint64((1 << 21) - 1)


def _hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of the ``size`` bytes (a power of two) from each position."""
    h, f, span = _BYTE[buf], _FACTOR, 1
    while span < size:
        h = h[:-span] * np.uint64(f) + h[span:]
        f = f * f & 0xFFFFFFFFFFFFFFFF
        span *= 2
    return mix(h)


def _slide_min(v: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[:len(v) - (width - span)], v[width - span:]) if width > span else v


def runs_of(buf: np.ndarray, ends: np.ndarray, starts: np.ndarray, least: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key inside the pieces ``starts[i]:ends[i]`` of a buffer:
    key, first window, number of windows, piece, and whether the key gram repeats in it."""
    h = _hashes(buf, GRAM)
    v = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    low = _slide_min(v, least - GRAM + 1)            # one value per window
    same = (low[1:] ^ low[:-1]) <= _POS
    edge = np.concatenate([[True], ~same])
    edge[starts] = True
    stop = ends - least + 1
    edge[stop[stop < len(edge)]] = True
    first = np.flatnonzero(edge)
    n = np.diff(np.append(first, len(low)))
    piece = np.searchsorted(starts, first, side="right") - 1
    ok = first < stop[piece]
    first, n, piece = first[ok], n[ok], piece[ok]
    a, b = low[first] & _POS, low[first + n - 1] & _POS
    return h[a.astype(np.int64)].view(np.int64), first, n, piece, a != b


def _buffers(texts: list[bytes], least: int) -> Iterator[tuple]:
    """Long-enough texts laid end to end, at most about BUFFER bytes at once; longer
    texts in pieces that overlap by a window less one byte:
    ``(bytes, piece starts, piece ends, text number, start in the text)``."""
    parts, rows, offs, size = [], [], [], 0

    def out():
        lens = np.array([len(p) for p in parts])
        ends = np.cumsum(lens)
        return b"".join(parts), ends - lens, ends, np.array(rows), np.array(offs)

    for i, t in enumerate(texts):
        for at in range(0, len(t) - least + 1, PIECE):
            p = t[at:at + PIECE + least - 1]
            if size and size + len(p) > BUFFER:
                yield out()
                parts, rows, offs, size = [], [], [], 0
            parts.append(p)
            rows.append(i)
            offs.append(at)
            size += len(p)
    if parts:
        yield out()


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, rid``; rows with the same id and text share their rid (128 bits)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       _rid(id_col, text_col).alias("rid"))


def _rid(id_col: str, text_col: str) -> F.Column:
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"),
                                  F.coalesce(F.col(text_col), F.lit("")))))


def repeated_keys(src: DataFrame, least: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                keys, times = [], []
                for raw, starts, ends, _, _ in _buffers(text_bytes(column(part, "text")), least):
                    key, _, _, _, twice = runs_of(np.frombuffer(raw, np.uint8), ends, starts, least)
                    keys.append(key)
                    times.append(1 + twice)
                if keys:
                    key, back = np.unique(np.concatenate(keys), return_inverse=True)
                    n = np.bincount(back, weights=np.concatenate(times)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return (map_arrow(src.select("text"), run, "key long, n long")
            .groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"))


def candidate_regions(src: DataFrame, least: int) -> DataFrame:
    """``rid, start, key, hash, region``: runs of windows with a possibly repeated key. A
    region's text is left out where the same task sent it before."""
    keys = materialize(repeated_keys(src, least), "repeated-keys")
    log2 = bloom.log2_bits(keys.count())
    bits = src.sparkSession.sparkContext.broadcast(bloom.to_numpy(bloom.build(keys, "key", log2), log2))

    def run(batches):
        held, seen = bits.value, set()
        for batch in batches:
            for part in text_slices(batch, "text"):
                rid = column(part, "rid").to_pylist()
                cols: tuple[list, ...] = ([], [], [], [], [])
                for raw, starts, ends, rows, offs in _buffers(text_bytes(column(part, "text")), least):
                    key, first, n, piece, _ = runs_of(np.frombuffer(raw, np.uint8), ends, starts, least)
                    hit = np.flatnonzero(bloom.probe_numpy(held, key, log2))
                    at = offs[piece] + first - starts[piece]
                    for k, a, m, p, s in zip(key[hit].tolist(), first[hit].tolist(), n[hit].tolist(),
                                             rows[piece[hit]].tolist(), at[hit].tolist()):
                        region = raw[a:a + m + least - 1]
                        digest = xxhash.xxh3_128_digest(region)
                        new = digest not in seen
                        if new:
                            seen.add(digest)
                        for c, x in zip(cols, (rid[p], s, k, digest, region if new else None)):
                            c.append(x)
                    if len(seen) > SEEN:
                        seen.clear()
                if cols[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(),
                                                               pa.binary(), pa.binary()))],
                        ["rid", "start", "key", "hash", "region"])

    return materialize(map_arrow(src, run, "rid binary, start long, key long, hash binary, region binary"),
                       "regions")


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the next one; ``room`` is how far
    each may reach."""
    out = np.minimum(room[:-1], room[1:])
    step, width = 8192, 64
    for at in range(0, len(out), step):
        rows = np.arange(at, min(at + step, len(out)))
        off = 0
        while len(rows):
            col = off + np.arange(width)
            p = np.minimum(suffixes[rows][:, None] + col, len(text) - 1)
            q = np.minimum(suffixes[rows + 1][:, None] + col, len(text) - 1)
            differ = text[p] != text[q]
            stop = differ.any(axis=1)
            out[rows[stop]] = np.minimum(out[rows[stop]], off + differ[stop].argmax(axis=1))
            off += width
            rows = rows[~stop & (out[rows] > off)]
    return out


def maximal_repeats(lcp: np.ndarray, before: np.ndarray, least: int, depth: int = 1 << 62
                    ) -> Iterator[tuple[int, int, int]]:
    """Stack scan of the common prefixes of a sorted suffix list: every interval
    ``(first, last, length)`` of at least ``least`` bytes whose suffixes differ in the byte
    before them (``before``; negative: nothing comes before), inner ones first."""
    stack: list[list[int]] = []       # [length, first suffix, byte before all of them or -1]
    values = lcp.tolist() + [0]
    left = before.tolist()
    for i, length in enumerate(values):
        # suffixes i and i + 1 share ``length`` bytes
        first, common = i, left[i]
        while stack and stack[-1][0] > length:
            size, first, inner = stack.pop()
            common = inner if inner == common else -1
            if common < 0 or size >= depth:
                yield first, i, size
        if length >= least:
            if stack and stack[-1][0] == length:
                if stack[-1][2] != common:
                    stack[-1][2] = -1
            else:
                stack.append([length, first, common])
        elif stack:
            stack.clear()


def _window_hashes(text: np.ndarray, least: int) -> np.ndarray:
    """A hash of the ``least`` bytes from each position, BUFFER of them at once."""
    half = 1 << (least.bit_length() - 1)             # two of these cover a window
    out = np.empty(max(0, len(text) - least + 1), dtype=np.uint64)
    for at in range(0, len(out), BUFFER):
        n = min(BUFFER, len(out) - at)
        h = _hashes(text[at:at + n + least - 1], half)
        out[at:at + n] = h[:n] * np.uint64(_FACTOR) + h[least - half:]
    return out


def _sorted_parts(window: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Slices of at most ``most`` of sorted values that all occur twice or more. Equal values
    stay in one slice, but for values that occur more often than ``most``: of those each
    slice has two at least."""
    at = 0
    while at < len(window):
        to = at + most
        if to < len(window):
            first, last = np.searchsorted(window, window[to], "left"), np.searchsorted(window, window[to], "right")
            to = int(first) if first > at else to - (last - to == 1)
        yield at, min(to, len(window))
        at = to


def covered_ranges(regions: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    """Ranges of each region (distinct byte strings) that maximal repeats cover."""
    raw = b"".join(regions)
    text = np.frombuffer(raw, dtype=np.uint8)
    sizes = np.array([len(r) for r in regions])
    ends = np.cumsum(sizes)
    # only windows that occur twice start a suffix of interest; found by their hash
    inside = np.ones(len(text), dtype=bool)
    for e in ends.tolist():
        inside[e - least + 1:e] = False
    starts = np.flatnonzero(inside)
    window = _window_hashes(text, least)[starts]
    order = np.argsort(window, kind="stable")
    window = window[order]
    same = window[1:] == window[:-1]
    often = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    crowded = bool((window[SUFFIXES:] == window[:-SUFFIXES]).any())
    starts, window = starts[order[often]], window[often]
    del inside, order, same, often
    change = np.zeros(len(text) + 1, dtype=np.int32)
    for a, b in _sorted_parts(window, SUFFIXES):
        mine = starts[a:b]
        reach = _reach(raw, text, mine, sizes, ends, least, crowded)
        np.add.at(change, mine, reach > 0)
        np.subtract.at(change, mine + reach, reach > 0)
    del starts, window
    covered = np.cumsum(change[:-1], dtype=np.int32) > 0
    edge = np.concatenate([[True], covered[1:] != covered[:-1]])
    edge[(ends - sizes)] = True             # ranges do not run on into the next region
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(text))
    out: list[list[tuple[int, int]]] = [[] for _ in regions]
    on = covered[first]
    region = np.searchsorted(ends, first[on], side="right")
    base = (ends - sizes)[region]
    for r, x, y in zip(region.tolist(), (first[on] - base).tolist(), (last[on] - base).tolist()):
        out[r].append((x, y))
    return out


def _reach(raw: bytes, text: np.ndarray, cand: np.ndarray, sizes: np.ndarray, ends: np.ndarray,
           least: int, crowded: bool = False) -> np.ndarray:
    """Length of the longest maximal repeat that starts at each candidate (0: none).
    ``crowded``: occurrences of a window may be in several calls, so that what starts a byte
    earlier need not reach as far here; then every repeat counts, whatever comes before it."""
    found = np.zeros(len(cand), dtype=np.int64)
    if len(cand) < 2:
        return found
    region = np.searchsorted(ends, cand, side="right")
    depth = max(DEPTH, least)
    stop = np.minimum(ends[region], cand + depth)
    order = sorted(range(len(cand)), key=[raw[a:b] for a, b in zip(cand.tolist(), stop.tolist())].__getitem__)
    order = np.array(order)
    sa, room = cand[order], (stop - cand)[order]
    opens = sa == (ends - sizes)[region[order]]
    before = np.where(opens | crowded, -1 - np.arange(len(sa)), text[sa - 1].astype(np.int64))
    lcp = common_prefixes(text, sa, room)
    done = list(range(len(sa) + 1))          # next suffix without a longer repeat

    def following(i: int) -> int:
        while done[i] != i:
            done[i] = done[done[i]]
            i = done[i]
        return i

    for first, last, length in maximal_repeats(lcp, before, least, depth):
        i = following(first)
        while i <= last:
            found[order[i]] = length
            done[i] = i + 1
            i = following(i)
    return found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint ranges; touching ones are joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


_RANGES = "hash binary, ranges array<struct<a:long,b:long>>"


def _ranges_batch(hashes: list[bytes], ranges: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(hashes, pa.binary()),
         pa.array([[{"a": a, "b": b} for a, b in r] for r in ranges], kind)], ["hash", "ranges"])


def _repeats_by_key(regions: DataFrame, least: int) -> DataFrame:
    """Covered ranges of distinct regions that meet by key."""
    def solve(rows):
        one = [(h, [(0, len(r))]) for h, r, n in rows if n > 1]     # a copied region is covered
        found = covered_ranges([r for _, r, _ in rows], least) if len(rows) > 1 or rows[0][2] == 1 else []
        hot = {h for h, _ in one}
        more = [(h, merged(x)) for (h, _, _), x in zip(rows, found) if x and h not in hot]
        both = one + more
        if both:
            yield _ranges_batch([h for h, _ in both], [r for _, r in both])

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for key, h, region, n in zip(*(column(batch, c).to_pylist()
                                           for c in ("key", "hash", "region", "copies"))):
                if key != last and size > SORT_BYTES:
                    yield from solve(rows)
                    rows, size = [], 0
                rows.append((h, region, n))
                size += len(region)
                last = key
        if rows:
            yield from solve(rows)

    n = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(regions.repartition(n, "key").sortWithinPartitions("key", "hash"), run, _RANGES)


def _repeats_by_window(regions: DataFrame, least: int) -> DataFrame:
    """The same for keys with very many distinct regions: windows are counted."""
    def windows(batches):
        h, at, w = [], [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(h, pa.binary()), pa.array(at, pa.int64()), pa.array(w, pa.binary())],
                ["hash", "at", "window"])

        for batch in batches:
            for digest, region in zip(column(batch, "hash"), column(batch, "region")):
                digest, region = digest.as_py(), region.as_py()
                for i in range(len(region) - least + 1):
                    h.append(digest)
                    at.append(i)
                    w.append(xxhash.xxh3_128_digest(region[i:i + least]))
                    if len(h) == SUFFIXES:
                        yield out()
                        h, at, w = [], [], []
        if h:
            yield out()

    every = materialize(map_arrow(regions.select("hash", "region"), windows,
                                  "hash binary, at long, window binary"), "hot-windows")
    often = materialize(every.groupBy("window").agg(F.count(F.lit(1)).alias("n"))
                        .filter("n > 1").select("window"), "hot-repeats")
    copied = regions.filter("copies > 1").select("hash", F.array(F.struct(
        F.lit(0).cast("long").alias("a"), F.length("region").cast("long").alias("b"))).alias("ranges"))
    return (every.join(often, "window").groupBy("hash").agg(F.collect_list(F.struct(
        F.col("at").alias("a"), (F.col("at") + least).alias("b"))).alias("ranges")).unionByName(copied))


def repeated_ranges(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
                    hot: int = HOT) -> DataFrame:
    """``rid, ranges`` (byte ranges, not merged) of the documents that repeat something."""
    if least < MIN_LEAST:
        raise ValueError(f"passages must be at least {MIN_LEAST} bytes long, not {least}")
    occurrences = candidate_regions(_source(docs, id_col, text_col), least)
    distinct = materialize(occurrences.groupBy("key", "hash").agg(
        F.max("region").alias("region"), F.count(F.lit(1)).alias("copies")), "distinct-regions")
    per_key = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > hot).select("key")
    per_key = materialize(per_key, "hot-keys")
    if per_key.head(1):
        cool = distinct.join(per_key, "key", "left_anti")
        covered = _repeats_by_key(cool, least).unionByName(
            _repeats_by_window(distinct.join(per_key, "key", "left_semi"), least))
    else:
        covered = _repeats_by_key(distinct, least)
    covered = materialize(covered, "covered")
    return materialize(
        occurrences.select("rid", "start", "hash").join(covered, "hash")
        .select("rid", F.transform("ranges", lambda r: F.struct(
            (r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b"))).alias("ranges"))
        .groupBy("rid").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "ranges")


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    keep, at = [], 0
    for a, b in spans:
        keep.append(text[at:a])
        at = b
    keep.append(text[at:])
    return b"".join(keep)


def _spans(value) -> list[tuple[int, int]]:
    return merged([(r["a"], r["b"]) for r in value])


def remove_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id",
                   text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row."""
    src = _source(docs, id_col, text_col)
    ranges = repeated_ranges(docs, least, id_col, text_col, hot)
    touched, rest = _split(src, ranges)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = text_bytes(column(part, "text"))
                spans = [_spans(x) for x in column(part, "ranges").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(map(len, texts), pa.int64()),
                     pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                     pa.array(map(len, spans), pa.int64()),
                     pa.array([hashlib.sha256(_without(t, s)).hexdigest() for t, s in zip(texts, spans)],
                              pa.string())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    zero = F.lit(0).cast("long")
    return map_arrow(touched.select("doc_id", "text", "ranges"), run,
                     "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").unionByName(
        rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"),
                    zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")))


def _split(src: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ranges (joined with them) and rows without; only rows that a filter of
    the rids may hold are shuffled."""
    log2 = bloom.log2_bits(ranges.count())
    held = bloom.build(ranges.select(F.xxhash64("rid").alias("_k")), "_k", log2)
    probed = bloom.probe(src, F.xxhash64("rid"), held, log2, "__t_maybe")
    maybe = probed.filter("__t_maybe").drop("__t_maybe")
    return (maybe.join(ranges, "rid"),
            probed.filter("not __t_maybe").drop("__t_maybe").unionByName(maybe.join(ranges, "rid", "left_anti")))


def drop_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
                 size_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with repeated passages cut out of the text; of a
    character that is only partly covered all bytes stay. ``size_col``, if there, is the
    new number of characters."""
    ranges = repeated_ranges(docs, least, id_col, text_col)
    columns = docs.columns
    touched, rest = _split(whole_rows(docs).withColumn("rid", _rid(inner(id_col), inner(text_col))), ranges)

    def cut(series_text, series_ranges):
        import pandas as pd
        return pd.Series([cut_characters(t, _spans(r)) for t, r in zip(series_text, series_ranges)])

    ship_package(docs.sparkSession)
    touched = touched.withColumn("cut", F.pandas_udf(cut, "string")(F.col(inner(text_col)), "ranges"))
    new = {text_col: F.col("cut")}
    if size_col in columns:
        new[size_col] = F.length("cut").cast(docs.schema[size_col].dataType)
    return touched.select(*[new.get(c, F.col(inner(c))).alias(c) for c in columns]).unionByName(unpacked(rest.select("row")))


def cut_characters(text: str, spans: list[tuple[int, int]]) -> str:
    """Cut byte ranges out of a text, shrunk to whole characters."""
    raw = text.encode()
    whole = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            whole.append((a, b))
    return _without(raw, whole).decode()
