"""Repair of damaged conversations by Viterbi search with survivor coalescence.

Damage (``damage``) is decided per row by crc32 of ``conv_id:turn``: a row is dropped, its
text emptied, its sentence ends removed, the row repeated, or its role set to user. Repair
finds for every conversation the cheapest edits (keep 0, change the role 3, delete 4,
insert 3, 3 more for a truncated row that stays) that give role initials ``(s?(ua)+)?``.
Of equally cheap edits the ASCII-least string of edit initials counts.

The trellis has four states: nothing yet, after s, after u, after a. A survivor per state
is carried from row to row, inserts are taken together with the row that follows them.
All survivors have then consumed the same rows, so no survivor's edits are the start of
another's, and the order of their whole unresolved edit strings follows from the order of
the survivors they extend: it is carried along as a rank, and ties are decided on
complete strings without reading them again. A survivor goes when another one is cheaper
whatever follows. The survivors' edits form a tree of back pointers; every node knows its
live children (its references). A node without any is released, and as soon as the root has
one child only, all survivors share that edit: it is given out and forgotten. So memory is
that of the unresolved rows.

On Spark: one range exchange sorts the rows of all conversations by (conversation, turn).
A task solves the conversations that lie inside its range. Those at its edges, and those
longer than a segment (``SEGMENT_ROWS`` rows or ``SEGMENT_CHARS`` characters), go on as segments: per segment the cost and rank from
every entry state to every exit state (4 x 4), then one pass over these small tables per
conversation fixes the states at the borders, and the segments are solved side by side. Only
the digest of a conversation's repaired text is taken in one task, from joined segment
texts, as SHA-256 has to be.

Nulls are one space in ``conv_id:turn``, role and text; rows with a null conversation form
a conversation of their own. Rows of one turn come in the order of role, then of the
text's SHA-256 (copies are alike). A role without characters has no initial, so its row
can't be kept as it is. Conversations whose rows were all dropped give zeros, an empty
audit and the digest of the empty string. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import Iterator, NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

SEGMENT_ROWS, SEGMENT_CHARS = 4096, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}   # an inserted or rerolled turn
INSERTS = {START: 2, AFTER_S: 2, AFTER_U: 1, AFTER_A: 1}   # more give a state that fewer reach
CLOSING = {START: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}   # inserts that end a conversation


def damage(conv: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` (0: the row was dropped, 2: repeated)."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(as_text[0], F.lit(":"), as_text[1])) % 20
    return conv.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when((kind == 0) | (kind == 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


# --- the trellis -----------------------------------------------------------------------


class Front(NamedTuple):
    """Survivors by state: cost above the cheapest (None: no survivor) and rank of the edits."""
    cost: tuple
    rank: tuple


def front_at(state: int) -> Front:
    return Front(tuple(0 if s == state else None for s in range(4)), tuple(0 for _ in range(4)))


def symbol(role: str, text: str, seen: bool) -> str:
    """What the search needs of a row: its role initial (s, u, a or x) and its fault (``b``
    blank, ``d`` duplicate, ``t`` truncated, ``-`` none)."""
    body = text.strip(BLANKS)
    fault = "b" if not body else "d" if seen else "-" if body[-1] in ".!?" else "t"
    return (role[:1] if role[:1] in ("s", "u", "a") else "x") + fault


def _kept(state: int, initial: str) -> int | None:
    if initial == "u" and state != AFTER_U:
        return AFTER_U
    if initial == "a" and state == AFTER_U:
        return AFTER_A
    return AFTER_S if initial == "s" and state == START else None


def _moves(state: int, sym: str) -> Iterator[tuple[int, str, int]]:
    """(new state, edits, cost) of the ways to consume a row, with inserts before it."""
    initial, fault = sym
    extra = TRUNCATED if fault == "t" else 0
    for n in range(INSERTS[state] + 1):
        ins, cost = "I" * n, INSERT * n
        yield state, ins + "D", cost + DELETE
        if fault not in "bd":
            to = _kept(state, initial)
            if to is not None:
                yield to, ins + "K", cost + KEEP + extra
            yield NEXT[state], ins + "R", cost + REROLE + extra
        state = NEXT[state]


def _beaten(cost: list, state: int) -> bool:
    """Does another survivor cost less whatever follows?"""
    c, u, a = cost[state], cost[AFTER_U], cost[AFTER_A]
    others = {START: [(a, DELETE), (u, INSERT + DELETE)], AFTER_S: [(a, 0), (u, INSERT)],
              AFTER_U: [(a, INSERT), (cost[START], INSERT), (cost[AFTER_S], INSERT)],
              AFTER_A: [(u, INSERT), (cost[START], 2 * INSERT), (cost[AFTER_S], 2 * INSERT)]}[state]
    return any(x is not None and x + more < c for x, more in others)


_STEPS: dict = {}   # (front, symbol) -> step; costs are bounded differences, so there are few


def step(front: Front, sym: str) -> tuple[Front, int, tuple]:
    """The next front, the cost of its cheapest survivor, and per state (former state,
    edits) or None."""
    known = _STEPS.get((front, sym))
    if known is None:
        best: list = [None] * 4
        for state, c in enumerate(front.cost):
            if c is not None:
                for to, edits, more in _moves(state, sym):
                    way = (c + more, front.rank[state], edits, state)
                    if best[to] is None or way < best[to]:
                        best[to] = way
        cost = [b and b[0] for b in best]
        best = [None if b is None or _beaten(cost, s) else b for s, b in enumerate(best)]
        order = sorted((b[1], b[2]) for b in best if b)
        least = min(b[0] for b in best if b)
        known = _STEPS[front, sym] = (
            Front(tuple(b and b[0] - least for b in best), tuple(order.index((b[1], b[2])) if b else 0 for b in best)),
            least, tuple(b and (b[3], b[2]) for b in best))
    return known


class Node:
    """One edit step of a survivor; ``kids`` are its live references."""
    __slots__ = ("parent", "kids", "edits", "row")

    def __init__(self, parent, edits, row):
        self.parent, self.edits, self.row, self.kids = parent, edits, row, []


class Search:
    """Viterbi search from one entry state; calls ``emit(edits, row)`` for every step that
    all survivors share."""

    def __init__(self, emit, entry: int = START):
        self.emit, self.front, self.cost = emit, front_at(entry), 0
        self.root = Node(None, "", None)
        self.leaves: list = [self.root if s == entry else None for s in range(4)]

    def feed(self, sym: str, row) -> None:
        self.front, more, back = step(self.front, sym)
        self.cost += more
        old, self.leaves = self.leaves, [None] * 4
        for state, way in enumerate(back):
            if way:
                parent = old[way[0]]
                node = self.leaves[state] = Node(parent, way[1], row)
                parent.kids.append(node)
        for node in old:
            if node is not None:
                self._release(node)
        root = self.root
        while len(root.kids) == 1:
            root = root.kids[0]
            root.parent = None
            self.emit(root.edits, root.row)
        self.root = root

    def _release(self, node: Node) -> None:
        while not node.kids and node.parent is not None:
            node.parent.kids.remove(node)
            node = node.parent

    def close(self, state: int) -> None:
        """Give out the rest of the survivor in ``state``."""
        path, node = [], self.leaves[state]
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node.edits, node.row)


def best_end(front: Front) -> tuple[int, int]:
    """(state, cost) of the cheapest survivor with its closing inserts."""
    c, _, state = min((c + INSERT * len(CLOSING[s]), front.rank[s], s)
                      for s, c in enumerate(front.cost) if c is not None)
    return state, c


class Repaired:
    """Applies edits: counts, audit and the lines ``role:text`` of what stays."""

    def __init__(self, state: int = START):
        self.state, self.audit, self.lines = state, [], []

    def __call__(self, edits: str, row) -> None:
        self.audit.append(edits)
        for e in edits:
            if e == "D":
                continue
            if e == "K":
                role, text = row
                self.state = _kept(self.state, role[:1])
            else:
                self.state = NEXT[self.state]
                role = "user" if self.state == AFTER_U else "assistant"
                text = row[1] if e == "R" else ""
            self.lines.append(f"{role}:{text}")


class Faults:
    """Counts over consecutive rows of one conversation."""

    def __init__(self):
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.lo = self.hi = self.first = self.last = None

    def add(self, turn, role: str, sym: str) -> None:
        self.blank += sym[1] == "b"
        self.duplicate += sym[1] == "d"
        self.truncated += sym[1] == "t"
        if self.n:
            self.illegal += self.last + role[:1] not in ("su", "ua", "au")
        else:
            self.first = role[:1]
        self.n, self.last = self.n + 1, role[:1]
        if turn is not None:
            self.turns += turn != self.hi
            self.lo, self.hi = turn if self.lo is None else self.lo, turn

    def merge(self, b: "Faults") -> None:
        """Take in the rows that follow."""
        if not b.n:
            return
        if self.n:
            self.illegal += self.last + b.first not in ("su", "ua", "au")
        self.turns += b.turns - (b.lo is not None and b.lo == self.hi)
        self.lo = b.lo if self.lo is None else self.lo
        self.hi = self.hi if b.hi is None else b.hi
        self.first = b.first if not self.n else self.first
        self.last, self.n = b.last, self.n + b.n
        for f in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, f, getattr(self, f) + getattr(b, f))

    def counts(self) -> list[int]:
        gaps = 0 if self.lo is None else self.hi - self.lo + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def repair(rows) -> tuple[list[int], int, str, list[str]]:
    """(gaps, blank, duplicate, truncated, illegal), cost, audit and repaired lines of one
    conversation's rows ``(turn, role, text)`` in order."""
    seen, faults, out = set(), Faults(), Repaired()
    search = Search(out)
    for turn, role, text in rows:
        key = _key(None, role, text)
        sym = symbol(role, text, key in seen)
        seen.add(key)
        faults.add(turn, role, sym)
        search.feed(sym, (role, text))
    state, more = best_end(search.front)
    search.close(state)
    out(CLOSING[state], None)
    return faults.counts(), search.cost + more, "".join(out.audit), out.lines


def _key(conv, role: str, text: str) -> bytes:
    """128-bit key of a conversation's (role, text)."""
    return xxhash.xxh3_128_digest(f"{conv}\0{len(role)}\0{role}{text}".encode("utf-8", "surrogatepass"))


# --- on Spark --------------------------------------------------------------------------

_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
_RESULT = ", ".join(f"{c} long" for c in [*_COUNTS, "cost"]) + ", audit string, repaired_sha256 string"
_PIECE = "n long, blank long, duplicate long, truncated long, illegal long, turns long, lo long, hi long, first string, last string"


def _records(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(records: Iterator[tuple], fields: list[tuple], rows: int = 4096, chars: int = 4 << 20):
    """Arrow batches of bounded size."""
    schema = pa.schema(fields)
    held: list = []
    size = 0
    for r in records:
        held.append(r)
        size += sum(len(v) for v in r if isinstance(v, (str, bytes)))
        if len(held) >= rows or size >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow_type(df: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[col].dataType)


def _solve_inside(rows: DataFrame, segment_rows: int, segment_chars: int) -> DataFrame:
    """Solve the conversations that lie inside a task's sorted rows; the rows of all others
    come out with ``segment`` and ``at``."""
    kind = _arrow_type(rows, "conv_id")
    fields = [("conv_id", kind), *[(c, pa.int64()) for c in [*_COUNTS, "cost"]], ("audit", pa.string()),
              ("repaired_sha256", pa.string()), ("segment", pa.int64()), ("at", pa.int32()), ("turn", pa.int64()),
              ("role", pa.string()), ("text", pa.string()), ("copies", pa.int32()), ("key", pa.binary())]

    def solve(conv, held):
        flat = ((t, r, x) for t, r, x, n in held for _ in range(n))
        counts, cost, audit, lines = repair(flat)
        digest = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
        return (conv, *counts, cost, audit, digest, *[None] * 7)

    def run(batches):
        from pyspark import TaskContext
        segment = TaskContext.get().partitionId() << 32
        edge, conv, held, size = True, None, [], 0

        def as_segment():
            for i, (t, r, x, n) in enumerate(held):
                yield (conv, *[None] * 8, segment, i, t, r, x, n, _key(conv, r, x))

        def records():
            nonlocal segment, edge, conv, held, size
            started = False
            for c, turn, role, text, copies in _records(batches):
                if not started:
                    conv, started = c, True
                elif c != conv:
                    if edge:
                        yield from as_segment()
                        segment += 1
                    else:
                        yield solve(conv, held)
                    edge, conv, held, size = False, c, [], 0
                elif len(held) >= segment_rows or size >= segment_chars:
                    yield from as_segment()
                    segment += 1
                    edge, held, size = True, [], 0
                held.append((turn, role, text, copies))
                size += len(text)
            yield from as_segment()

        yield from _batches(records(), fields)

    conv_type = rows.schema["conv_id"].dataType.simpleString()
    return map_arrow(rows, run, f"conv_id {conv_type}, {_RESULT}, segment long, at int, turn long, role string, "
                                "text string, copies int, key binary")


def _by_segment(records: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Runs of records with one first field (a segment has a bounded number of rows)."""
    held: list = []
    for r in records:
        if held and held[0][0] != r[0]:
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def _symbols(held) -> Iterator[tuple]:
    """(symbol, turn, role, text) of a segment's rows, repeated rows twice."""
    for _, _, _, turn, role, text, copies, repeats in held:
        for i in range(copies):
            yield symbol(role, text, repeats or i > 0), turn, role, text


def _sorted(df: DataFrame, by: str, *cols: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, by).sortWithinPartitions(by, *cols)


def _across(segments: DataFrame, conv_type: str, kind: pa.DataType) -> DataFrame:
    """Results of the conversations given as segments."""
    firsts = materialize(segments.filter("copies > 0").groupBy("key").agg(
        F.min(F.struct("segment", "at")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "key", F.col("f.segment").alias("s0"), F.col("f.at").alias("a0")), "first-turns")
    repeats = F.coalesce((F.col("s0") != F.col("segment")) | (F.col("a0") != F.col("at")), F.lit(False))
    marked = materialize(segments.join(firsts, "key", "left").select(
        "segment", "at", "conv_id", "turn", "role", "text", "copies", repeats.alias("repeats")), "segments")

    def tables(batches):
        def records():
            for held in _by_segment(_records(batches)):
                syms = [s for s, *_ in _symbols(held)]
                cost, rank = [], []
                for entry in range(4):
                    front, base = front_at(entry), 0
                    for s in syms:
                        front, more, _ = step(front, s)
                        base += more
                    cost += [None if c is None else c + base for c in front.cost]
                    rank += front.rank
                yield held[0][2], held[0][0], cost, rank
        yield from _batches(records(), [("conv_id", kind), ("segment", pa.int64()), ("cost", pa.list_(pa.int64())),
                                        ("rank", pa.list_(pa.int32()))])

    narrow = marked.select("segment", "at", "conv_id", F.lit(None).cast("long").alias("turn"), "role", "text", "copies", "repeats")
    per_segment = map_arrow(_sorted(narrow, "segment", "at"), tables,
                            f"conv_id {conv_type}, segment long, cost array<long>, rank array<int>")

    def borders(batches):
        def records():
            for held in _by_segment(_records(batches)):
                yield from _borders(held)
        yield from _batches(records(), [("segment", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()),
                                        ("closing", pa.string())])

    ways = materialize(map_arrow(_sorted(per_segment, "conv_id", "segment"), borders,
                                 "segment long, entry int, leave int, closing string"), "borders")

    def pieces(batches):
        def records():
            for held in _by_segment(_records(batches)):
                entry, leave, closing = held[0][8:]
                out, faults = Repaired(entry), Faults()
                search = Search(out, entry)
                for sym, turn, role, text in _symbols([h[:8] for h in held]):
                    faults.add(turn, role, sym)
                    search.feed(sym, (role, text))
                cost = search.cost + search.front.cost[leave]
                search.close(leave)
                out(closing, None)
                f = faults
                yield (held[0][2], held[0][0], "".join(out.audit), cost + INSERT * len(closing),
                       "\n".join(out.lines) if out.lines else None, f.n, f.blank, f.duplicate, f.truncated,
                       f.illegal, f.turns, f.lo, f.hi, f.first, f.last)
        yield from _batches(records(), [
            ("conv_id", kind), ("segment", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("lines", pa.string()),
            *[(c, pa.int64()) for c in ("n", "blank", "duplicate", "truncated", "illegal", "turns", "lo", "hi")],
            ("first", pa.string()), ("last", pa.string())])

    solved = map_arrow(_sorted(marked.join(ways, "segment"), "segment", "at"), pieces,
                       f"conv_id {conv_type}, segment long, audit string, cost long, lines string, {_PIECE}")

    def whole(batches):
        def records():
            conv, faults = None, None
            for r in _records(batches):
                if faults is None or r[0] != conv:
                    if faults is not None:
                        yield conv, *faults.counts(), cost, "".join(audit), digest.hexdigest()
                    conv, faults, cost, audit, digest, empty = r[0], Faults(), 0, [], hashlib.sha256(), True
                audit.append(r[2])
                cost += r[3]
                if r[4] is not None:
                    digest.update(("" if empty else "\n").encode() + r[4].encode("utf-8", "surrogatepass"))
                    empty = False
                b = Faults()
                b.n, b.blank, b.duplicate, b.truncated, b.illegal, b.turns, b.lo, b.hi, b.first, b.last = r[5:]
                faults.merge(b)
            if faults is not None:
                yield conv, *faults.counts(), cost, "".join(audit), digest.hexdigest()
        yield from _batches(records(), [("conv_id", kind), *[(c, pa.int64()) for c in [*_COUNTS, "cost"]],
                                        ("audit", pa.string()), ("repaired_sha256", pa.string())])

    return map_arrow(_sorted(materialize(solved, "pieces"), "conv_id", "segment"), whole,
                     f"conv_id {conv_type}, {_RESULT}")


def _borders(held: list[tuple]) -> Iterator[tuple]:
    """Best entry and exit state of every segment of a conversation, from the segments'
    tables ``(conv, segment, cost, rank)`` in order."""
    front, back = front_at(START), []
    for _, _, cost, rank in held:
        best: list = [None] * 4
        for i, c in enumerate(front.cost):
            if c is not None:
                for j in range(4):
                    if cost[4 * i + j] is not None:
                        way = (c + cost[4 * i + j], front.rank[i], rank[4 * i + j], i)
                        if best[j] is None or way < best[j]:
                            best[j] = way
        order = sorted(b[1:3] for b in best if b)
        least = min(b[0] for b in best if b)
        front = Front(tuple(b and b[0] - least for b in best), tuple(order.index(b[1:3]) if b else 0 for b in best))
        back.append([b and b[3] for b in best])
    state, _ = best_end(front)
    closing, ways = CLOSING[state], []
    for (_, segment, _, _), former in zip(reversed(held), reversed(back)):
        ways.append((segment, former[state], state, closing))
        state, closing = former[state], ""
    yield from ways


def repair_conversations(conv: DataFrame, segment_rows: int = SEGMENT_ROWS,
                         segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Damage and repair every conversation: ``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256``."""
    n = int(conv.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "_sha"]
    rows = damage(conv).withColumn("_sha", F.sha2("text", 256)).withColumn("_copy", F.monotonically_increasing_id())
    dealt = (rows.repartitionByRange(n, *order, "_copy").sortWithinPartitions(*order, "_copy")
             .select("conv_id", "turn", "role", "text", "copies"))
    solved = materialize(_solve_inside(dealt, segment_rows, segment_chars), "conversations")
    kind, conv_type = _arrow_type(conv, "conv_id"), conv.schema["conv_id"].dataType.simpleString()
    result = ["conv_id", *_COUNTS, "cost", "audit", "repaired_sha256"]
    segments = solved.filter("segment is not null").select(
        "segment", "at", "conv_id", "turn", "role", "text", "copies", "key")
    return solved.filter("segment is null").select(*result).unionByName(_across(segments, conv_type, kind).select(*result))
