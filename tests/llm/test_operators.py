"""Edge cases of every operator on small tables, against brute force."""

import collections
import hashlib
import io
import math
import zlib

import numpy as np
import pytest

from tessera.llm import (bloom, bpe, chunks, components, exact_dedup, html_text, importance, itq, maxent,
                         minhash, packing, suffix_dedup, token_files)
from tessera.llm.queries import vocabulary

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
SCHEMA = "doc_id long, text string, kept boolean, rid long, _pos string, n_chars int"
LONG = " ".join(f"wörd{i % 977}" for i in range(30_000))
TEXTS = [None, "", " \n ", "one two", "one  two", "ONE two\tthree four five six", LONG, LONG + " end",
         "日本語 <|endoftext|> 😀 it's", "x" * 5000, "rep " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, True, 1, "a", None) for i, t in enumerate(TEXTS)]
    rows += [(3, "one two", None, None, None, 4), (None, "one two", False, 2, "b", 5), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower_words(t):
    return (t or "").encode().lower().split()


def test_exact_groups(docs, empty):
    df, rows = docs
    norm = [exact_norm(r[1]) for r in rows]
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)
                              for r in exact_dedup.exact_groups(df).collect())
    want = collections.Counter()
    for (i, *_), t in zip(rows, norm):
        ids = [r[0] for r, x in zip(rows, norm) if x == t]
        keep = min((x for x in ids if x is not None), default=None)
        want[(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert got == want
    assert exact_dedup.exact_groups(empty).count() == 0
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns and left.filter("doc_id = 4").count() == 0


def exact_norm(t):
    import re
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_filter_is_only_a_filter(spark):
    # an overfull filter passes rows on, results stay exact
    df = spark.range(5000).selectExpr("id as doc_id", "concat('t', id % 4000) as text")
    blocks = bloom.build_repeated(df.selectExpr("xxhash64(text) as k"), "k", 20)
    assert blocks.count() <= 32
    r = exact_dedup.exact_groups(df)
    assert r.filter("kept").count() == 4000 and r.filter("group_size = 2").count() == 2000
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "x")
    assert bloom.drop_ids(df, "doc_id", ids).count() == 5000 - 715
    assert bloom.drop_ids(df, "doc_id", ids, drop=False).count() == 715
    k = np.array([1, -7, 2 ** 62], dtype=np.int64)
    got = [r[0] for r in spark.createDataFrame([(int(x),) for x in k], "k long").selectExpr("xxhash64(k)").collect()]
    assert got == bloom._xxhash64(k).view(np.int64).tolist()


def exact_components(sets, percent):
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: find(i) for i in ids}


def shingle_set(t, k):
    w = lower_words(t)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, docs, empty, words):
    rng = np.random.default_rng(words)
    base = [f"w{i}" for i in range(120)]
    texts = dict(enumerate(TEXTS))
    for i in range(40):          # a chain of versions around the threshold
        w = list(base)
        for at in rng.integers(0, 120, size=i % 6):
            w[at] = f"z{rng.integers(9)}"
        texts[100 + i] = " ".join(w)
    df = spark.createDataFrame([(i, t, "e") for i, t in texts.items()], "doc_id long, text string, key string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, words, 80).collect()}
    sets = {i: shingle_set(t, words) for i, t in texts.items()}
    want = exact_components(sets, 80)
    for i in texts:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i)
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.near_duplicates(docs[0]).count() == docs[0].count()
    left = minhash.drop_near_duplicates(df, words)
    assert left.columns == df.columns and left.count() == sum(want[i] == i for i in want)


def test_signature_estimates_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 2 ** 63, 1000).astype(np.uint64))
    x, y = minhash.signatures([a[:900], a[100:]])
    assert abs((x == y).mean() - 0.8) < 0.2
    assert (minhash.signatures([a[:1]]) != minhash._EMPTY).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (100, 150), (7, 7)] + [(300, 300 + i) for i in range(1, 50)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100, **{300 + i: 300 for i in range(50)}}
    assert components.connected_components(df.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    near = base[:20] + rng.normal(size=(20, 24)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near, base[:3]]))]
    odd = [None, [0.0] * 24, [float("nan")] * 24, [None] * 24, [float("inf")] + [0.0] * 23, []]
    rows += [(200 + i, v) for i, v in enumerate(odd)] + [(None, base[0].tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int")
    got = {r.vec_id: r for r in itq.link_vectors(df).collect()}
    x = np.concatenate([base, near, base[:3]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.95
    want = exact_components({i: {j for j in range(83) if linked[i, j]} for i in range(83)}, 1)
    assert sum(got[i].n_links for i in range(83)) >= 0.9 * (linked.sum() - 83)
    assert all(got[i].n_links <= linked[i].sum() - 1 and got[i].component_id == want[i] for i in range(83))
    assert all(got[200 + i].n_links == 0 and got[200 + i].kept for i in range(len(odd))) and got[None].n_links == 0
    assert itq.link_vectors(df.limit(0)).count() == 0
    assert itq.link_vectors(df.filter("vec_id >= 200")).count() == len(odd)


def test_encoders_match_the_library(docs):
    for name, keeps in ((WORD, False), (BYTE, True)):
        lib = chunks.library_tokenizer(vocabulary(name))
        enc = [chunks.library_encoder(vocabulary(name), keeps)]
        if not keeps:
            enc += [bpe.worker_bpe(vocabulary(name))[1], bpe.worker_library_encoder(vocabulary(name))]
        rng = np.random.default_rng(5)
        parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "th", "İ", "Σ", "é", "é", "'s", "'LL", "12",
                 "<|endoftext|>", "<|startoftext|>", "!?", "日本", "​", "\x00", "K"]
        texts = ["".join(rng.choice(parts, size=rng.integers(0, 12))) for _ in range(1500)] + [t or "" for t in TEXTS]
        for e in enc:
            ids, counts = e.encode(texts)
            for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
                assert got.tolist() == lib.encode(t, add_special_tokens=False).ids


def test_small_cache_gives_the_same_ids():
    small = chunks.ChunkEncoder(lambda ps: [[len(p), ord(p[0])] for p in ps], str.split, limit=3)
    for t in ("a bb ccc", "dddd a", "bb bb e"):
        assert small.encode([t])[0].tolist() == [x for p in t.split() for x in (len(p), ord(p[0]))]


def test_bpe_round_trip(docs, empty):
    df, rows = docs
    lib = chunks.library_tokenizer(vocabulary(WORD))
    got = collections.Counter(tuple(r) for r in bpe.round_trip_digests(df, vocabulary(WORD)).collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
              hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == want
    assert bpe.round_trip_digests(empty, vocabulary(WORD)).count() == 0
    ids = bpe.encode_column(df.filter("doc_id = 8"), vocabulary(WORD))
    assert bpe.decode_column(ids, vocabulary(WORD)).first().text == lib.decode(
        lib.encode(TEXTS[8], add_special_tokens=False).ids, skip_special_tokens=False)


def test_token_files(docs, empty, tmp_path):
    df, rows = docs
    lib = chunks.library_tokenizer(vocabulary(WORD))
    got = sorted((tuple(r) for r in token_files.write_and_read(df, vocabulary(WORD), 1).collect()), key=lambda r: r[1])
    start = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for (i, t, *_), r in zip(order, got):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert r == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.write_and_read(empty, vocabulary(WORD), 1).count() == 0


def test_token_files_of_many_tasks_make_few_table_files(spark, tmp_path, monkeypatch):
    """Each table file that a task makes starts a process on its executor."""
    texts = {i: " ".join(f"word{j}" for j in range(i % 7)) for i in range(256)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    parts = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in parts}
    lib = chunks.library_tokenizer(vocabulary(WORD))
    try:
        for k, v in parts.items():
            spark.conf.set(k, v)
        manifest = token_files.write_files(docs, vocabulary(WORD), 1, f"file://{tmp_path}/files")
        files = manifest.count()
        assert files > 2 * spark.sparkContext.defaultParallelism and len(manifest.inputFiles()) == 1
        assert sorted(r.part for r in manifest.collect()) == list(range(files))
        few = token_files.read_files(manifest)
        assert few.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        monkeypatch.setattr(token_files, "READ_BYTES", 1)   # large files: a task each, and no more
        many = token_files.read_files(manifest)
        assert many.rdd.getNumPartitions() == files
        for df in few, many:
            start, got = 0, sorted(df.collect(), key=lambda r: r.doc_id)
            assert [r.doc_id for r in got] == list(texts)
            for r in got:
                ids = np.array(lib.encode(texts[r.doc_id], add_special_tokens=False).ids + [1], "<u4")
                assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
                start += len(ids)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_frames_can_be_read_one_by_one():
    out = io.BytesIO()
    w = token_files.FrameWriter(out)
    ids = {i: np.arange(i * 300, dtype=np.uint32) for i in range(0, 400, 2)}
    for i, x in ids.items():
        w.add(i, x)
    w.close()
    raw = out.getvalue()
    r = token_files.FrameReader(io.BytesIO(raw), len(raw))
    assert len(r.index) > 3
    assert r.document(200).tolist() == ids[200].tolist() and r.document(0).tolist() == [] and r.document(3) is None
    bad = bytearray(raw)
    bad[int(r.at[1]) + 30] ^= 1
    with pytest.raises(Exception):
        token_files.FrameReader(io.BytesIO(bytes(bad)), len(bad)).frame(1)


def test_packing(docs, empty):
    df, rows = docs
    lib = chunks.library_tokenizer(vocabulary(BYTE))
    got = packing.pack_documents(df, vocabulary(BYTE), 0, 256).collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 256
    assert packing.pack_documents(empty, vocabulary(BYTE)).count() == 0


def test_best_fit_is_tight_with_few_bins():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 2049, 20_000)
    bins = packing.BestFit(2048, 64)
    used = collections.Counter()
    for n in sizes.tolist():
        b, off = bins.place(n)
        assert off == used[b]
        used[b] += n
    assert max(used.values()) <= 2048 and bins.n_open <= 64
    assert len(used) < 1.1 * sizes.sum() / 2048


def test_selection(spark, docs, empty):
    rng = np.random.default_rng(2)
    rows, lab = [], []
    for i in range(900):
        w = [f"word{int(x)}" for x in rng.zipf(1.4, 80) % 500]
        kind = i % 10
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        if kind == 1:
            w[::9] = ["insult"] * len(w[::9])
        rows.append((i, " ".join(w), "x"))
        if i % 3 == 0:
            lab.append((i, int(kind != 0), int(kind == 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string, good string")
    labels = spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in importance.select(df, labels).collect()}
    assert np.mean([got[i] for i in got if i % 10 > 1]) > 0.97
    assert np.mean([got[i] for i in got if i % 10 < 2]) < 0.1
    none = labels.limit(0)
    assert importance.select(df, none).filter("not kept").count() == 0
    assert importance.select(empty, labels).count() == 0
    nulls = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert importance.select(docs[0], nulls).count() == docs[0].count()
    left = importance.keep_selected(df, labels)
    assert left.columns == df.columns and left.count() == sum(got.values())


def test_kth_largest(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 5, 5, 1, 9, -2, 7.5] * 30], "x double")
    values = sorted((r.x for r in df.collect()), reverse=True)
    for k in (1, 30, 31, 100, 210):
        assert importance.kth_largest(df, "x", k, bins=4, few=8) == values[k - 1]


def test_language_model(docs, empty):
    df, rows = docs
    got = sorted(map(tuple, maxent.score(df).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()), key=repr)
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    c = collections.Counter()
    for i, t, *_ in rows:
        if crc(i):
            c.update(lower_words(t) + [b" "])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, *_ in rows:
        w = lower_words(t) + [b" "]
        want.append((i, crc(i) == 0, len(w), sum(c[x] > 0 for x in w), n,
                     sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    want.sort(key=repr)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5]))
    assert maxent.score(empty).count() == 0
    assert all(r.score <= 0 and math.isfinite(r.score) for r in maxent.score(df).collect())


def brute_repeats(texts, least):
    c = collections.Counter(t[k:k + least] for t in texts for k in range(len(t) - least + 1))
    out = []
    for t in texts:
        cov = np.zeros(len(t) + 1, dtype=int)
        for k in range(len(t) - least + 1):
            if c[t[k:k + least]] > 1:
                cov[k] += 1
                cov[k + least] -= 1
        on = np.cumsum(cov)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum())
        out.append((len(t), int(on.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~on].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4000, 1])
def test_repeats(spark, docs, empty, hot):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"é{int(x)}" for x in rng.integers(0, 10 ** 6, n))
    shared = [word(40) for _ in range(4)]
    texts = [None, "", "short", "a" * 199, "a" * 201, "ab" * 300, shared[0] + shared[0]]
    for _ in range(25):
        texts.append(word(5) + shared[rng.integers(4)] + word(int(rng.integers(0, 30))) + shared[rng.integers(4)][:260] + "!")
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, rid int")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([(t or "").encode() for t in texts], 200)
    if hot > 1:
        assert suffix_dedup.remove_repeats(empty).count() == 0
        assert suffix_dedup.remove_repeats(docs[0]).count() == docs[0].count()
        left = suffix_dedup.drop_repeats(df)
        assert left.columns == df.columns and left.count() == len(texts)
        assert suffix_dedup.drop_repeats(docs[0]).columns == docs[0].columns


def test_line_that_goes_on_is_sorted_in_bounded_lots(monkeypatch):
    """A short line repeated to the end of many regions: few distinct windows, each very often."""
    rng = np.random.default_rng(5)
    regions = [b"%d head " % i + b"Is onhe. " * int(rng.integers(20, 60)) + b"tail %d" % (i % 7) * 40 for i in range(40)]
    regions += [b"z" * 64, b"y" * 300, bytes(rng.integers(97, 99, 500).astype(np.uint8))]
    whole = suffix_dedup.covered_ranges(regions, 64)
    assert [(len(r), sum(b - a for a, b in x), len(x)) for r, x in zip(regions, whole)] == [
        x[:3] for x in brute_repeats(regions, 64)]
    sizes, plain = [], suffix_dedup._reach
    monkeypatch.setattr(suffix_dedup, "_reach", lambda raw, text, cand, *a: sizes.append(len(cand)) or plain(raw, text, cand, *a))
    for most in (3, 50, 500):
        sizes.clear()
        monkeypatch.setattr(suffix_dedup, "SUFFIXES", most)
        assert suffix_dedup.covered_ranges(regions, 64) == whole
        assert 2 <= min(sizes) and max(sizes) <= most


def test_packing_bounds_the_pieces_a_worker_keeps():
    encoder = chunks.library_encoder(vocabulary(BYTE), True, 1000)
    texts = [" ".join(f"w{i}x{j}" for j in range(300)) for i in range(40)]
    plain = chunks.library_encoder(vocabulary(BYTE), True)
    for t in texts:
        assert encoder.encode([t])[0].tolist() == plain.encode([t])[0].tolist()
        assert len(encoder.index) <= 1300
    assert len(plain.index) > 10_000 and packing.CACHED < chunks.CACHE_PIECES


def test_frequent_pieces_survive_a_full_cache():
    """Pieces that come again and again are encoded once, however many others pass through."""
    encoded = collections.Counter()

    def encode(pieces):
        encoded.update(pieces)
        return [[len(p), *map(ord, p)] for p in pieces]

    cache = chunks.ChunkEncoder(encode, str.split, limit=100, keep=50)
    often = [f"often{i}" for i in range(20)]
    for i in range(200):
        t = " ".join([*often, *(f"once{i}x{j}" for j in range(30)), *often])
        assert cache.encode([t])[0].tolist() == [x for p in t.split() for x in (len(p), *map(ord, p))]
        assert len(cache.index) <= 130 and len(cache.uses) >= len(cache.index)
    assert set(encoded.values()) == {1}
    assert 0 < packing.FREQUENT < packing.CACHED


def test_each_distinct_word_meets_the_model_once(monkeypatch):
    """Pieces that share their words ("word", "word,", "word.") do not go through the library's
    whole chain; others do."""
    lib, definition = chunks.library_tokenizer(vocabulary(BYTE)), vocabulary(BYTE)
    calls = collections.Counter()

    class Model:
        def tokenize(self, word):
            calls[word] += 1
            return lib.model.tokenize(word)

    class Library:
        model = Model()

        def encode_batch_fast(self, batch, **kw):
            calls["whole"] += len(batch)
            return lib.encode_batch_fast(batch, **kw)

    def check(texts):
        ids, counts = enc.encode(texts)
        for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
            assert got.tolist() == lib.encode(t, add_special_tokens=False).ids

    with monkeypatch.context() as m:
        m.setitem(chunks._LIBRARY, definition, Library())
        enc = chunks.library_encoder(definition, True)
        check([" ".join(f"wörd{'abcdef'[i % 6]}{end}" for i in range(60) for end in ("", ",", ".", "!!", "'s"))])
        assert calls["whole"] == 0 and max(calls.values()) == 1 and len(calls) == 1 + 6 + 4
        check(["a <|endoftext|> b", "z" * 5000 + " ok", "ok \u0671\u1680x y", "\U0001f600 ok"])
        assert calls["whole"] == 4 and max(calls.values()) <= 4


def test_settled_characters_are_told_apart_as_the_library_does():
    lib, encoder = chunks.library_tokenizer(vocabulary(BYTE)), chunks.library_encoder(vocabulary(BYTE), True)
    settled = [chr(c) for c in range(0xd800) if not chunks._OTHER.match(chr(c))]
    settled += [chr(c) for c in range(0xe000, 0x10000) if not chunks._OTHER.match(chr(c))]
    assert len(settled) > 30_000
    texts = [f"a{c}1{c}! {c}{c} {c}a {c}1 {c}" for c in settled]
    ids, counts = encoder.encode(texts)
    for t, got, want in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), lib.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids, ascii(t)
    odd, _ = chunks.byte_level_words(vocabulary(BYTE))
    assert odd("\u1680") and odd("\U0001f600") and odd("x<|endoftext|>") and not odd("é日本—€")


def test_maximal_repeat_intervals():
    # banana: repeats "ana" (twice), "a" (three times); "na" is always preceded by a
    s = b"banana"
    sa = sorted(range(6), key=lambda i: s[i:])
    room = np.array([6 - i for i in sa])
    lcp = suffix_dedup.common_prefixes(np.frombuffer(s, np.uint8), np.array(sa), room)
    assert lcp.tolist() == [1, 3, 0, 0, 2]
    before = np.array([s[i - 1] if i else -1 for i in sa])
    got = {(s[sa[a]:sa[a] + n], b - a + 1) for a, b, n in suffix_dedup.maximal_repeats(lcp, before, 1)}
    assert got == {(b"ana", 2), (b"a", 3)}
    assert suffix_dedup.cut_characters("aéb", [(0, 2)]) == "éb"


PAGE = """<html><head><title>t</title><script>x='</p>'</script></head><body class="has-sidebar"><header>Site</header>
<nav><a href=/a>Home</a></nav><div id=wrap><div class="post"><h2>Title &amp; more</h2><p>First   paragraph, long
enough to count as text.<p>Second <b>bold</b>&nbsp;one<br>goes on.<form><input> Sign up</form></div>
<div class="comments"><p>I do not agree with this at all, what a long comment this is, really.</p></div>
<div class="ad-box">Buy now!</div></div><aside>Other</aside><footer>&copy; me</footer></body></html>"""


def test_pages(spark):
    pages = [PAGE, None, "", "just text", "<p>open <b>tags", "<nav><a href=x>only menu</a></nav>",
             "<article><h1>Head</h1><p>One</p></article><p cut"]
    df = spark.createDataFrame([(i, f"u{i}", h, "z") for i, h in enumerate(pages)],
                               "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got == {0: "Title & more\nFirst paragraph, long enough to count as text.\nSecond bold one goes on.",
                   1: "", 2: "", 3: "just text", 4: "open tags", 5: "", 6: "Head\nOne"}
    assert html_text.extract(df.limit(0)).count() == 0
    assert html_text.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_pipeline_decides_by_row(spark):
    rng = np.random.default_rng(12)
    word = lambda n: " ".join(f"q{int(x)}" for x in rng.integers(0, 10 ** 6, n))
    twice, null_copy, other, near = word(60), word(60), word(60), word(120)
    rows = [(1, twice), (1, twice), (2, null_copy), (None, null_copy), (None, null_copy),
            (3, twice), (3, other), (4, near), (4, near + " end"), (None, near + " stop"), (None, word(5)), (None, None)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, rid int")
    exact = exact_dedup.drop_copies(df)
    assert exact.columns == df.columns
    want = collections.Counter({(1, twice): 1, (2, null_copy): 1, (3, other): 1, (4, near): 1, (4, near + " end"): 1,
                                (None, near + " stop"): 1, rows[10]: 1, (None, None): 1})
    assert collections.Counter((r.doc_id, r.text) for r in exact.collect()) == want
    left = [(r.doc_id, r.text) for r in minhash.drop_near_duplicates(df, 5).collect()]
    assert sorted(i for i, t in left if t and i) == [1, 2, 3, 4]
    assert len(left) == 6 and sum(t is not None and t.startswith(near) for _, t in left) == 1
    staged = suffix_dedup.drop_repeats(minhash.drop_near_duplicates(exact, 5))
    texts = [r.text for r in staged.collect()]
    assert sorted(t for t in texts if t and len(t) > 100) == sorted(
        [twice, null_copy, other] + [t for _, t in left if t and t.startswith(near)])


def test_selection_drops_rows_not_ids(spark):
    good = [(i, f"fine words here number {i % 7} " * 5) for i in range(400)]
    bad = [(1000 + i, "SPAM!! insult " * 10 + str(i % 5)) for i in range(400)]
    mixed = [(0, bad[0][1]), (1000, good[0][1])] + [(None, bad[1][1])] * 3
    df = spark.createDataFrame(good + bad + mixed, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 200)] + [(1000 + i, 0, 1) for i in range(1, 200)],
                                   "doc_id long, quality int, toxic int")
    want = collections.Counter()
    for r in importance.select(df, labels).collect():
        want[r.doc_id] += r.kept
    got = collections.Counter(r.doc_id for r in importance.keep_selected(df, labels).collect())
    assert got == +want and got[0] == 1 and got[None] == 0


def test_unlucky_signatures_do_not_hide_a_link(spark):
    # true links whose signatures agree in few slots
    rng = np.random.default_rng(8)
    found = []
    while len(found) < 3:
        sets = []
        for _ in range(500):
            x = rng.integers(0, 2 ** 63, 100).astype(np.uint64)
            sets += [np.sort(x[:90]), np.sort(x[10:])]       # 80 of 100 shared
        sig = minhash.signatures(sets)
        same = (sig[::2] == sig[1::2]).sum(axis=1)
        found += [(sets[2 * i], sets[2 * i + 1], sig[2 * i:2 * i + 2]) for i in np.flatnonzero(same <= 65)]
    rows = []
    for k, (a, b, sig) in enumerate(found):
        small = minhash.mix(sig).astype(np.uint8)
        rows += [(k, 2, 2 * k, 90, small[0].tobytes(), a.tobytes(), 2 * k),
                 (k, 2, 2 * k + 1, 90, small[1].tobytes(), b.tobytes(), 2 * k + 1)]
    members = spark.createDataFrame(rows, "cluster long, size long, id long, n_shingles long, sig binary, "
                                          "items binary, component long")
    got = {tuple(sorted(r)) for r in minhash._cross_links(members, 80).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(len(found))}
    big = [np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64)) for n in (1, 50, 4000)]
    counts = minhash._bucket_counts(big)
    assert counts.sum(axis=1).tolist() == [len(s) for s in big]


ARTICLE = "".join(f"<p>Paragraph {i} of the article, which is long enough to be the main text of this page.</p>" for i in range(6))


@pytest.mark.parametrize("opening,closing", [
    ('<div class="content-sidebar-wrap">', "</div>"), ('<div class="content-with-sidebar">', "</div>"),
    ('<div class="layout--sidebar">', "</div>"), ('<div class="side-by-side">', "</div>"),
    ('<form id="aspnetForm" action="/x">', "</form>"), ('<div class="page-header">', "</div>"),
    ('<div class="sidebar">', "</div>"), ('<div class="widget" role="form"><main>', "</main></div>")])
def test_wrappers_keep_the_article(opening, closing):
    page = (f"<html><body><div class=menu><a href=/>Home</a></div>{opening}<div class=post><h1>The title</h1>{ARTICLE}"
            f"</div><div class='sidebar'><p>Other things to read here.</p></div>{closing}"
            "<div class='comments-area'><p>A reader says hello.</p></div></body></html>")
    text = html_text.main_text(page)
    assert text.startswith("The title\nParagraph 0") and text.count("Paragraph") == 6
    assert "reader" not in text and "Other things" not in text and "Home" not in text


def test_part_of_an_article_is_not_a_sidebar():
    page = (f"<body><article><div class='article-header'><h1>The title</h1></div>{ARTICLE}<div class='side-by-side'>"
            f"<p>Left half of the text.</p><p>Right half of the text.</p></div><div class='share-buttons'>Send it on</div>"
            "</article><div id=comments><article><p>" + "A long reader comment. " * 90 + "</p></article></div></body>")
    text = html_text.main_text(page)
    assert text.startswith("The title") and "Right half" in text
    assert "Send it on" not in text and "reader" not in text


@pytest.mark.parametrize("token,named", [
    ("sidebar", True), ("main-sidebar", True), ("sidebar2", True), ("sidebar-wrap", True), ("comment-list", True),
    ("widget-3", True), ("share-buttons", True), ("site__footer", True), ("content-sidebar-wrap", False),
    ("content-with-sidebar", False), ("layout--sidebar", False), ("side-by-side", False), ("has-sidebar", False),
    ("no-comments", False), ("social-studies", False), ("-", False), ("12", False)])
def test_names_of_other_elements(token, named):
    assert bool(html_text._name_kind(token)) == named


def test_neighbour_counts_beyond_32_bits(spark, monkeypatch):
    # 8,192 tasks that each hold the same counts
    from tessera.llm import common
    monkeypatch.setattr(maxent, "sum_blocks", lambda partials, dtype, blocks: common.sum_blocks(
        partials.crossJoin(spark.range(8192)).select("block", "data"), dtype, blocks))
    df = spark.createDataFrame([("a b " * 200_000,)], "text string").coalesce(1)
    ids = maxent.HeadIds([b"a", b"b", maxent.END])
    got = maxent.neighbour_counts(df, spark.sparkContext.broadcast(ids), [0, 1])
    # every neighbouring pair of words is one of a and b
    assert got[0, 1] == got[1, 0] == 8192 * 399_999 and got.min() >= 0
    with pytest.raises(ValueError):
        maxent.word_classes(np.array([[-2 ** 31] + [2 ** 30] * (maxent.NEAR - 1), [5] * maxent.NEAR]), np.array([3, 2]))


@pytest.mark.parametrize("dim,offset", [(64, 0.0), (64, 0.7), (384, 0.5)])
def test_vectors_with_a_common_offset(spark, dim, offset):
    # pairs at cosine 0.95 to 0.96 among vectors of mean cosine ``offset``
    rng = np.random.default_rng(dim)
    shared = np.zeros(dim)
    shared[0] = 1.0
    free = rng.normal(size=(600, dim))
    free /= np.linalg.norm(free, axis=1)[:, None]
    x = np.sqrt(offset) * shared + np.sqrt(1 - offset) * free
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = rng.uniform(0.9501, 0.96, size=(600, 1))
    y = cos * x + np.sqrt(1 - cos ** 2) * side
    both = np.concatenate([x, y])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in itq.link_vectors(df).collect())
    want = int((both @ both.T >= 0.95).sum()) - len(both)
    assert 0.95 * want <= found <= want


def test_codes_reach_the_recall_on_odd_samples():
    rng = np.random.default_rng(6)
    tight = np.eye(32)[0] + rng.normal(size=(500, 32)) * 1e-3
    for x in (rng.normal(size=(1, 8)), rng.normal(size=(3, 2)), np.ones((2, 1)), tight, rng.normal(size=(900, 100)) + 3):
        x = x / np.linalg.norm(x, axis=1)[:, None]
        shift, projection = itq.learn_codes(x, 0.95)
        assert projection.shape[0] == x.shape[1] and len(shift) == projection.shape[1]


def test_update_adds_gradients_of_equal_rows():
    rng = np.random.default_rng(6)
    z = rng.normal(size=(500, maxent.CLASSES)).astype(np.float32)
    row = np.sort(rng.zipf(1.4, 2000) % 300)
    at, edge = rng.integers(0, 500, 2000), np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    want = np.zeros((len(edge), maxent.CLASSES))
    np.add.at(want, np.cumsum(np.isin(np.arange(2000), edge)) - 1, z[at])
    got = maxent._sum_runs(z, at, edge, np.empty((2000, maxent.CLASSES), np.float32))
    assert np.allclose(got, want, atol=1e-4)


def test_update_follows_the_gradient():
    """One AdaGrad step against finite differences of the class log likelihood."""
    rng = np.random.default_rng(8)
    ids = maxent.HeadIds([b"a", b"b", b"c", maxent.END])
    sym, _, _ = maxent._stream([b"a b c a b", b"c c x a", b"b a"], ids)
    pos, work = maxent._positions(sym, ids), maxent.Work()
    cls = np.array([0, 1, 2, 3, *range(maxent.HEAD_CLASSES, maxent.CLASSES)])
    w = (rng.normal(size=(maxent.ROWS, maxent.CLASSES)) * 0.1).astype(np.float32)
    bias = np.zeros(maxent.CLASSES, np.float32)

    def likelihood(w):
        rows = maxent._features(sym, pos)
        z = sum(w[r].astype(float) for r in rows) + bias
        return (z[np.arange(len(pos)), cls[sym[pos]]] - np.log(np.exp(z).sum(axis=1))).sum()

    new, grad2, updates = w.copy(), np.full(w.shape, 1e-2, np.float32), np.zeros(maxent.ROWS, np.float32)
    maxent._update(new, grad2, updates, sym, pos, cls, bias, work)
    assert likelihood(new) > likelihood(w)
    for r, k in [(int(maxent._features(sym, pos)[f][i]), c) for f, i, c in ((0, 1, 0), (1, 2, 1), (2, 4, 2), (3, 5, 30))]:
        up = w.astype(float)
        up[r, k] += 1e-4
        g = -(likelihood(up) - likelihood(w)) / 1e-4
        assert abs((w[r, k] - new[r, k]) - maxent.RATE * g / math.sqrt(1e-2 + g * g)) < 1e-2


@pytest.mark.parametrize("least", [64, 100, 199, 257, 300, 400, 1000])
def test_repeats_of_other_lengths(spark, least):
    rng = np.random.default_rng(least)
    base = [bytes(rng.integers(97, 103, 1500).astype(np.uint8)) for _ in range(3)]
    texts = [base[0], b"x" + base[0][200:1400] + b"y" * 50, base[1] + base[2][:700], base[2], base[1][90:1250] * 2, b"ab" * 900]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    want = brute_repeats(texts, least)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, least=least).collect()}
    assert got == dict(enumerate(want)) if isinstance(want, list) else got == want


def test_repeats_too_short_are_refused(spark):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), least=63)


def test_few_sequences_for_any_number_of_partitions(spark):
    rng = np.random.default_rng(7)
    sizes = np.concatenate([np.full(300, 2048), rng.integers(1, 2049, 3000)])
    df = spark.createDataFrame([(i, 0, int(n), i * 7) for i, n in enumerate(sizes)],
                               "doc_id long, piece int, length long, ids_crc32 long")
    bound = -(-int(sizes.sum()) // 2048)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 8, 200, 1000):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = packing.pack(df, 2048)
            assert got.select("sequence_id").distinct().count() <= 1.02 * bound
            assert got.count() == len(sizes)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert packing.streams(10 ** 9, 400) == 400 and packing.streams(1153, 1000) == 1


PARAGRAPHS = "".join(f"<p>Paragraph {i} of the story has a number of plain words in it, and goes on for a while.</p>" for i in range(6))
STORY = "\n".join(f"Paragraph {i} of the story has a number of plain words in it, and goes on for a while." for i in range(6))
LEAD = "A lead of about one hundred characters that tells what the whole story is about, without any link."


@pytest.mark.parametrize("page,want", [
    (f"<article><h1>The title</h1><div class=body>{PARAGRAPHS}</div></article>", f"The title\n{STORY}"),
    (f"<main><h1>The title</h1><div class=body>{PARAGRAPHS}</div></main>", f"The title\n{STORY}"),
    (f"<div><h1>The title</h1><div class=body>{PARAGRAPHS}</div></div>", f"The title\n{STORY}"),
    (f"<body><h1>The title</h1><div class=body>{PARAGRAPHS}</div></body>", f"The title\n{STORY}"),
    (f"<div class=post><h1>The title</h1><p>{LEAD}</p><div class=entry>{PARAGRAPHS}</div></div>", f"The title\n{LEAD}\n{STORY}"),
    (f"<body><div class=lead>{LEAD}</div><div class=text>{PARAGRAPHS}</div></body>", f"{LEAD}\n{STORY}"),
    (f"<body><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><div class=text>{PARAGRAPHS}</div></body>", STORY),
    (f"<main><div><ul><li><a href=a>One link</a><li><a href=b>Two links</a></ul></div><div>{PARAGRAPHS}</div></main>", STORY),
])
def test_headline_and_lead_stay(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("name", ["siteFooter", "topNav", "mainSidebar", "commentThread", "cookieBanner", "adsbygoogle",
                                  "post-comments-section", "user-comments-list"])
def test_names_of_other_matter(name):
    page = f"<article><h1>T</h1>{PARAGRAPHS}<div class='{name}'><p>Not a part of the story at all, but quite long too.</p></div></article>"
    assert html_text.main_text(page) == f"T\n{STORY}"


def test_repeated_ids_with_other_vectors(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [0.0, 1.0, 0.01]), (9, [0.0, 0.0, 1.0]), (9, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in itq.link_vectors(df).collect())
    assert got == [(5, 0, 5, True), (5, 1, 5, True), (7, 1, 5, False), (9, 1, 9, True), (9, 1, 9, True)]


def test_importance_equals_plain_counts(spark):
    """Log weights and decisions against dictionaries of n-grams."""
    rng = np.random.default_rng(12)
    vocab = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        words = list(rng.choice(vocab[:40] if good else vocab[20:], size=int(rng.integers(1, 30))))
        if i % 7 == 0:
            words += ["again"] * int(rng.integers(2, 14))
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(good), int(not good and i % 5 == 0)))
    rows += [(1, rows[1][1]), (None, "w1 w2"), (301, None), (302, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def grams(text):
        w = (text or "").encode().lower().split()
        h = dict(zip(w, importance.word_hashes(w).tolist()))
        out = {("one", h[x] % importance.BUCKETS) for x in w}
        for cut, salt, ok in ((lambda x: x[:4], 1, lambda x: len(x) > 4), (lambda x: x[-2:], 2, lambda x: True)):
            parts = [cut(x) for x in set(w) if ok(x)]
            out |= {("one", int(v) % importance.BUCKETS) for v in importance.mix(importance.word_hashes(parts) + np.uint64(salt))}
        run = longest = 0
        for k, x in enumerate(w):
            run = run + 1 if k and x == w[k - 1] else 1
            longest = max(longest, run)
        out |= {("one", int(v) % importance.BUCKETS) for v in importance.mix(np.array(
            [n for n in importance.RUNS if n <= longest], dtype=np.uint64))}
        a = np.array([h[x] for x in w], dtype=np.uint64)
        return out | {("two", int(v) % importance.BUCKETS) for v in importance.pair_hashes(a[:-1], a[1:])}

    good = {i for i, q, t in labels if q == 1 and t == 0}
    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    weight = {}
    for kind in ("one", "two"):
        n, n_raw = (sum(v for (k, _), v in c.items() if k == kind) for c in (target, raw))
        ratio = {}
        for g in (g for g in raw if g[0] == kind):
            expected = raw[g] * n / n_raw
            r = math.log((target[g] + importance.SMOOTH) / (expected + importance.SMOOTH))
            ratio[g] = r if abs(target[g] - expected) > importance.Z * math.sqrt(expected + 1) and abs(r) >= math.log(
                importance.FACTOR) else 0.0
        mean = sum(ratio[g] * target[g] for g in ratio) / n
        weight |= {g: r - mean for g, r in ratio.items()}
    got = importance.select(docs, marks).collect()
    want = collections.Counter((i, round(sum(weight[g] for g in grams(t)), 3)) for i, t in rows)
    assert collections.Counter((r.doc_id, round(r.log_weight, 3)) for r in got) == want
    noise = {r[0]: r[1] for r in docs.select("doc_id", importance.gumbel("doc_id", 7)).collect()}
    assert all(abs(r.gumbel_key - r.log_weight - noise[r.doc_id]) < 1e-9 for r in got)
    lowest = {}
    for r in got:
        lowest[r.doc_id] = min(lowest.get(r.doc_id, math.inf), r.log_weight)
    marked = {i for i, *_ in labels}
    cut = importance.best_threshold(np.array([lowest[i] for i in sorted(marked & good)]), np.array([lowest[i] for i in sorted(marked - good)]))
    k = sum(r.log_weight >= cut for r in got)
    least = sorted((r.gumbel_key for r in got), reverse=True)[k - 1]
    assert 0 < k < len(got) and all(r.kept == (r.gumbel_key >= least) for r in got)
