"""Conversation repair against a search that keeps whole edit strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tessera.llm import repair

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    """conversation -> rows (turn, role, text) after damage, in order."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        here = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, kind = role if role is not None else " ", text if text is not None else " ", zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        here += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for here in out.values():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def brute(rows):
    """All states with whole edit strings, no pruning: state is the roles' regular expression."""
    def grow(best):   # inserts, until nothing gets better
        todo = list(best)
        while todo:
            s = todo.pop()
            cost, audit, lines = best[s]
            to, line = ("a", "assistant:") if s == "u" else ("u", "user:")
            new = (cost + 3, audit + "I", lines + [line])
            if to not in best or new[:2] < best[to][:2]:
                best[to] = new
                todo.append(to)
        return best

    best = grow({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults(rows)):
        new = {}
        for s, (cost, audit, lines) in best.items():
            ways = [(s, 4, "D", lines)]
            if fault in "-t":
                more, i = 3 * (fault == "t"), role[:1]
                if (i == "s" and s == "") or (i == "u" and s != "u") or (i == "a" and s == "u"):
                    ways.append((i, more, "K", lines + [f"{role}:{text}"]))
                other = "a" if s == "u" else "u"
                ways.append((other, 3 + more, "R", lines + [f"{'assistant' if other == 'a' else 'user'}:{text}"]))
            for to, more, e, kept in ways:
                way = (cost + more, audit + e, kept)
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        best = grow(new)
    cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])
    initials = "".join(x[:1] for x in lines)
    assert re.fullmatch("(s?(ua)+)?", initials)
    turns = [t for t, *_ in rows if t is not None]
    f = faults(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return ((max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0), f.count("b"), f.count("d"), f.count("t"),
            illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def random_rows(rng, n, roles="usaxU"):
    names = {"u": "user", "s": "system", "a": "assistant", "x": "tool", "U": "ultra"}
    return [(t, names[rng.choice(roles)], rng.choice(["a.", "b!", "c", "", " \t", "d?", "é. ", "f,"]))
            for t in range(n)]


def test_search_equals_whole_strings():
    rng = random.Random(5)
    for i in range(3000):
        rows = random_rows(rng, rng.randrange(9), "usax"[:1 + i % 4])
        counts, cost, audit, lines = repair.repair(rows)
        assert (*counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()) == brute(rows)


def test_cheapest_of_all_edit_strings():
    """Every string of edits up to a length, with no search at all."""
    rng = random.Random(9)
    for _ in range(25):
        rows = random_rows(rng, 3, "usa")
        f, found = faults(rows), []
        for n in range(8):
            for edits in itertools.product("DIKR", repeat=n):
                if len(edits) - edits.count("I") != len(rows):
                    continue
                cost, roles, at, ok = 0, "", 0, True
                for e in edits:
                    here = "a" if roles[-1:] == "u" else "u"
                    if e == "I":
                        cost, roles = cost + 3, roles + here
                        continue
                    bad, more = f[at] in "bd", 3 * (f[at] == "t")
                    if e == "D":
                        cost += 4
                    else:
                        ok &= not bad
                        cost += more + 3 * (e == "R")
                        roles += here if e == "R" else rows[at][1][:1]
                    at += 1
                if ok and re.fullmatch("(s?(ua)+)?", roles):
                    found.append((cost, "".join(edits)))
        _, cost, audit, _ = repair.repair(rows)
        assert (cost, audit) == min(found)


def test_memory_is_that_of_unresolved_rows():
    out = []
    search = repair.Search(lambda edits, row: out.append(edits))
    rng = random.Random(1)
    for i in range(20_000):
        role = "user" if i % 2 == 0 else "assistant"
        if rng.random() < 0.1:
            role = "user"
        search.feed(repair.symbol(role, "x.", False), None)
        assert i - len(out) < 200
    assert len(repair._STEPS) < 2000


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(3)
    rows = []
    for c in range(120):
        rows += [(c, t, r, x, "e", 1) for t, r, x in random_rows(rng, rng.randrange(12), "uuaas")]
    rows += [(500, t, r, x, "e", 1) for t, r, x in random_rows(rng, 900, "uas")]           # long: several segments
    rows += [(501, 7, "user", "same.", "e", 1)] * 150 + [(502, None, None, None, None, None)] * 3
    rows += [(None, t, r, x, "e", 1) for t, r, x in random_rows(rng, 70, "uaas")]
    rows += [(503, None, "user", "q?", "e", 1), (503, 4, "assistant", "x" * 50_000 + ".", "e", 1), (503, -2, "", "é.", "e", 1)]
    rows += [(600 + i, 0, "user", "only.", "e", 1) for i in range(300)]                    # some lose their only row
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, key string, segment long"


@pytest.mark.parametrize("segment", [4096, 16])
def test_conversations(spark, conversations, segment):
    df = spark.createDataFrame(conversations, SCHEMA).repartition(5)
    got = {r[0]: tuple(r[1:]) for r in repair.repair_conversations(df, segment, 4000 if segment == 16 else 1 << 20).collect()}
    want = {c: brute(rows) for c, rows in damaged(conversations).items()}
    assert got == want
    assert any(w[6] == "" for w in want.values())


def test_tables_without_rows(spark):
    empty = repair.repair_conversations(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["conv_id", *COLUMNS]
