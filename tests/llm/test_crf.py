"""Language identification: forward-backward against enumeration, gradients, held-out accuracy."""

import itertools
import zlib

import numpy as np
import pytest

from tessera.llm import crf

from ..conftest import SF_CHECK


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    lengths, k = [1, 5, 2, 3], 3
    score, moves = rng.normal(size=(sum(lengths), k)) * 3, rng.normal(size=(k, k))
    starts = np.cumsum(lengths) - lengths
    got, pairs = crf.marginals(score, starts, moves)
    want, want_pairs = np.zeros_like(score), np.zeros((k, k))
    for at, n in zip(starts, lengths):
        paths = list(itertools.product(range(k), repeat=n))
        w = np.array([np.exp(sum(score[at + i, y] for i, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)))
                      for p in paths])
        for p, x in zip(paths, w / w.sum()):
            for i, y in enumerate(p):
                want[at + i, y] += x
            for a, b in itertools.pairwise(p):
                want_pairs[a, b] += x
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_blocks_do_not_matter(monkeypatch):
    rng = np.random.default_rng(3)
    score, moves = rng.normal(size=(1000, 4)), rng.normal(size=(4, 4))
    starts = np.array([0, 1, 63, 64, 65, 700, 999])
    want = crf.marginals(score, starts, moves)
    for chain in (3, 64, 5000):
        monkeypatch.setattr(crf, "CHAIN", chain)
        got = crf.marginals(score, starts, moves)
        assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_gradient_equals_differences():
    """Against finite differences of the enumerated log likelihood of one short chain."""
    rng = np.random.default_rng(4)
    k, word, label = 2, np.array([0, 1, 0, 2]), np.array([0, 1, 1, 0])
    feats, counts = np.array([5, 9, 9, 7, 5], dtype=np.int32), np.array([2, 1, 2], dtype=np.int32)
    shares = rng.normal(size=(3, k))
    m = crf.Model(["x", "y"], rng.normal(size=(crf.BUCKETS, k)), rng.normal(size=(k, k)), rng.normal(size=(k, k)), {})

    def likelihood(m):
        s = crf._scores(feats, counts, shares, m)[word]
        def value(p):
            return sum(s[i, y] for i, y in enumerate(p)) + sum(m.moves[a, b] for a, b in itertools.pairwise(p))
        return value(label) - np.log(sum(np.exp(value(p)) for p in itertools.product(range(k), repeat=len(word))))

    parts = crf.gradient(m, word, label, feats, counts, shares)
    for name, g, cells in (("weights", parts[0], [(5, 0), (9, 1), (7, 0)]), ("lexical", parts[1], [(0, 1), (1, 1)]),
                           ("moves", parts[2], [(0, 0), (0, 1), (1, 0), (1, 1)])):
        for cell in cells:
            x = getattr(m, name).copy()
            x[cell] += 1e-5
            assert abs((likelihood(m._replace(**{name: x})) - likelihood(m)) / 1e-5 - g[cell]) < 1e-3


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    return docs, crf.fit(docs.filter(crf.fold() != 2).select("doc_id", "text", "lang"), 400)


def test_held_out_accuracy(spark, model):
    docs, m = model
    got = {r.doc_id: r for r in crf.identify(docs, 400).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_words_of_switching_texts(spark, model):
    """Spliced held-out texts: every word gets the language of the text it came from."""
    docs, m = model
    by_lang = {}
    for r in docs.filter(crf.fold() == 2).orderBy("doc_id").collect():
        words = crf.words_of(r.text)
        if len(words) > 100:
            by_lang.setdefault(r.lang, []).append(words[50:100])
    langs = sorted(by_lang)
    mixed = [[(w, x) for j in range(4) for x in [langs[(i + j) % len(langs)]] for w in by_lang[x][i % len(by_lang[x])]]
             for i in range(12)]
    df = spark.createDataFrame([(i, " ".join(w for w, _ in t)) for i, t in enumerate(mixed)], "doc_id long, text string")
    right = total = 0
    for r in crf.label_words(df, m).collect():
        labels = [x for x, n in zip(r.langs, r.lengths) for _ in range(n)]
        assert len(labels) == len(mixed[r.doc_id])
        right += sum(a == b for a, (_, b) in zip(labels, mixed[r.doc_id]))
        total += len(labels)
    assert right >= 0.95 * total


SCHEMA = "doc_id long, text string, lang string, score string, h string, words int"


def test_edge_cases(spark, model):
    _, m = model
    long = "the and of this that with for was " * 20_000
    rows = [(1, None, "en"), (2, "", "en"), (3, " 12 _ ²½ !", "en"), (4, "the", None), (None, "der die das und nicht", "de"),
            (5, long, "en"), (5, "que les des une", "fr"), (5, "que les des une", "fr"), (6, "日本語", "en")]
    df = spark.createDataFrame([(*r, "s", "h", 1) for r in rows], SCHEMA)
    got = crf.classify(df, m).collect()
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert [r.score for r in got if r.doc_id in (1, 2, 3)] == [0.0] * 3
    assert {r.lang_pred for r in got if r.doc_id in (4, 5)} == {"en", "fr"}
    assert len(got) == len(rows)
    own = crf.identify(df, 100, 3)
    assert own.columns == ["doc_id", "held_out", "lang_pred", "score"] and own.count() == len(rows)
    assert crf.identify(df.limit(0)).count() == 0
    unlabelled = crf.identify(df.withColumn("lang", df.lang.substr(0, 0)).replace("", None, subset=["lang"]))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_same_bits_for_any_layout(spark, model):
    docs, m = model
    train = docs.filter(crf.fold() != 2).select("doc_id", "text", "lang")
    a, b = (crf.fit(train.repartition(n), 60, 2) for n in (2, 7))
    assert all((x == y).all() for x, y in zip(a[1:4], b[1:4]))
