"""Ranked search against full scoring."""

import collections
import math
import re

import numpy as np
import pytest

from tessera.llm import nra

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score long, rank int, part string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, docs, k):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m, score = 50 + (50 * sum(b.values()) * n_docs) // n_terms, 0
            for t in set(terms(text)) & set(b):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((10 ** 9 * b[t]) // (1000 * b[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return collections.Counter(out)


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)] + ["Été", "日本", "x_y", "A1b"]
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, size=rng.integers(1, 60), p=p / p.sum()))) for i in range(700)]
    docs += [(1000 + i, "w1 w2, w250") for i in range(90)] + [(3, "w250 w250"), (None, "w1 w2, w250"), (None, None),
                                                            (2000, ""), (2001, "!?"), (2002, "w0 " * 20_000 + "É")]
    items = [(i, " ".join(rng.choice(words, size=rng.integers(1, 30)))) for i in range(25)]
    items += [(30, None), (31, "??"), (32, "unknown"), (33, "w1 w2 w250"), (33, "W1"), (None, "w3 w200"), (34, "été 日本 a1B y")]
    return docs, items


@pytest.mark.parametrize("k,block", [(50, 1 << 18), (3, 40)])
def test_rank(spark, tables, k, block):
    docs, items = tables
    d = spark.createDataFrame([(i, t, 1, 2, "p") for i, t in docs], SCHEMA).repartition(3)
    q = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id long")
    got = nra.rank(d, q, k, block_terms=block)
    assert collections.Counter(map(tuple, got.collect())) == brute(items, docs, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_empty_tables(spark, tables):
    d = spark.createDataFrame([(1, "a b", 1, 2, "p")], SCHEMA)
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert nra.rank(d.limit(0), q).count() == 0 and nra.rank(d, q.limit(0)).count() == 0
    assert [tuple(r) for r in nra.rank(d, q).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10 ** 9 // 3000))]


def test_search_is_final_and_stops_early():
    rng = np.random.default_rng(1)
    early = 0
    for trial in range(200):
        n, k = 400, 5
        lists, score = [], np.zeros(n)
        for _ in range(int(rng.integers(1, 9))):
            docs = rng.permutation(n)[:int(rng.integers(1, n))]
            imp = np.sort(rng.integers(1, 6, len(docs)) if trial % 2 else rng.integers(1, 9000, len(docs)) ** 2)[::-1].astype(float)
            lists.append((docs, imp))
            score[docs] += imp
        reads = []
        class Counted(np.ndarray):
            def __getitem__(self, at):
                if isinstance(at, slice):
                    reads.append(len(range(*at.indices(len(self)))))
                return np.asarray(self).__getitem__(at)
        able, got = nra.search([(d.view(Counted), i) for d, i in lists], n, k, 1, depth=4)
        assert (got == score[able]).all()
        kth = np.sort(score)[-k]
        assert set(np.flatnonzero((score >= kth) & (score > 0))) <= set(able)
        early += sum(reads) < 2 * sum(len(d) for d, _ in lists)
    assert early > 20
