"""The pipeline's stages on clashing names, empty tables and repeated rows."""

import os

import pytest

import corpus_pipeline
from tessera.llm import common, exact_dedup, importance, minhash, suffix_dedup

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, __t_row string, __t_key int, __t_id string, "
          "digest long, maybe string, row string, rid string, ranges int, cut int")
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def rows():
    texts = [None, "", "one two three", "one  two three", PASSAGE + " tail one", "head two " + PASSAGE, "alone " * 50,
             " ".join(f"n{i}" for i in range(200)), " ".join(f"n{i}" for i in range(199)) + " other"]
    out = [(i, t, "en", "s", len(t or ""), "r", i, "x", 5, "m", "w", "q", 1, 2) for i, t in enumerate(texts)]
    return out + [out[2], (None, "one two three", "en", "s", 3, "r", 1, "x", 5, "m", "w", "q", 1, 2)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """sf folders with a filled and an empty documents table; labels name some of the rows."""
    base = str(tmp_path_factory.mktemp("pipeline"))
    for name, data in (("full", rows()), ("empty", [])):
        spark.createDataFrame(data, SCHEMA).coalesce(2).write.parquet(f"{base}/{name}/documents.parquet")
        spark.createDataFrame([(6, 0, 0), (7, 1, 0), (6, None, 1), (None, 1, 1)] if data else [],
                              "doc_id long, quality int, toxic int").write.parquet(f"{base}/{name}/labels.parquet")
    return base


def test_stages_keep_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    labels = spark.read.parquet(f"{folder}/full/labels.parquet")
    for left in (importance.keep_selected(docs, labels), exact_dedup.drop_copies(docs), minhash.drop_near_duplicates(docs),
                 suffix_dedup.drop_repeats(docs)):
        got = left.collect()
        assert left.columns == docs.columns and got
        assert all(r["__t_row"] == "r" and r["row"] == "w" and r["rid"] == "q" and r["digest"] == 5 for r in got)
        assert all(r["__t_key"] in (1, r["doc_id"]) for r in got)
    assert sorted(r.text or "" for r in exact_dedup.drop_copies(docs).filter("doc_id in (0, 1, 2, 3) or doc_id is null").collect()) == [
        "", "one two three"]
    assert minhash.drop_near_duplicates(docs).filter("doc_id in (7, 8)").count() == 1
    cut = {r.doc_id: r for r in suffix_dedup.drop_repeats(docs).collect()}
    assert "shared30" not in cut[4].text and cut[4].n_chars == len(cut[4].text)


def test_empty_table_through_all_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/empty/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, f"{folder}/empty")
        assert got.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == docs.columns
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0


def test_scratch_of_a_stage_goes_once_its_result_is_stored(spark, folder, tmp_path):
    docs, folders = spark.read.parquet(f"{folder}/full/documents.parquet"), []
    common.end_stages(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, f"{folder}/full")
        folders.append(common._STAGES[spark.sparkContext.applicationId][-1])
        assert all(not os.path.exists(f.removeprefix("file:")) for f in folders[:-1])
        got.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    common.end_stages(spark)
    # a stage whose result was not stored keeps what the next one reads
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    near = corpus_pipeline.drop_near_copies(spark, docs, f"{folder}/full")
    assert corpus_pipeline.drop_repeated_passages(spark, near, f"{folder}/full").count() == near.count() > 0
    common.end_stages(spark)
    assert corpus_pipeline.run(spark, f"{folder}/full").count() > 0


def brute_pipeline(docs):
    """doc_id -> text after exact, near and passage dedup of ``(doc_id, text)`` rows."""
    import re

    first = {}
    for i, t in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t or ""))
    left = dict(first.values())

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, group = {i: shingles(t) for i, t in left.items()}, {i: i for i in left}
    for a in sorted(left):
        for b in sorted(left):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    left = {i: t for i, t in left.items() if group[i] == i}
    seen = {}
    for t in left.values():
        raw = t.encode()
        for k in range(len(raw) - 199):
            seen[raw[k:k + 200]] = seen.get(raw[k:k + 200], 0) + 1
    out = {}
    for i, t in left.items():
        raw, covered = t.encode(), bytearray(len(t.encode()))
        for k in range(len(raw) - 199):
            if seen[raw[k:k + 200]] > 1:
                covered[k:k + 200] = b"\1" * 200
        at, kept = 0, []
        for c in t:
            n = len(c.encode())
            if not all(covered[at:at + n]):
                kept.append(c)
            at += n
        out[i] = "".join(kept)
    return out


def test_run_equals_brute_force(spark, tmp_path):
    """Without labels every document is selected; all later stages against plain Python."""
    import random
    import zlib

    import numpy as np

    from tessera.llm import chunks
    from tessera.llm.queries import vocabulary

    rng = random.Random(11)
    word = lambda: rng.choice(["é", "ß", ""]) + f"w{rng.randrange(4000)}"
    passage = [" ".join(word() for _ in range(70)) for _ in range(3)]
    texts = [" ".join(word() for _ in range(rng.randrange(1, 120))) for _ in range(25)]
    texts += [t.replace(" ", " \n ", 2) for t in texts[:5]]                                   # exact copies
    for t in texts[5:15]:                                                                     # near copies, some too far
        w = t.split()
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(20)) + " " + rng.choice(passage) + " " + " ".join(word() for _ in range(25))
              for _ in range(12)]
    texts += ["", None, " \t", passage[0], "x" * 450, " ".join(word() for _ in range(3000))]
    docs = list(enumerate(texts))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lib = chunks.library_tokenizer(vocabulary("byte_bpe_50k.json"))
    want = set()
    for i, t in brute_pipeline(docs).items():
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want |= {(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        ends = [0, *(o + n for o, n in sorted(pieces))]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048


def test_encoders_of_a_worker_go_when_other_work_begins(spark):
    """Workers outlive stages: what encoding tasks keep for the next one must not stay while
    later stages run."""
    import pyarrow as pa

    from tessera.llm import bpe, chunks, packing, token_files
    from tessera.llm.queries import vocabulary

    def held(batches):
        import os
        for _ in batches:
            n = len(chunks._ENCODERS) + len(chunks._LIBRARY) + len(bpe._ENCODERS) + len(bpe._LIBRARY_ENCODERS)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([os.getpid()], pa.int64())], ["n", "pid"])

    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(64)], "doc_id long, text string").coalesce(1)
    byte, word = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
    for encode in (lambda: packing.pieces(docs, byte, 0, 2048).count(),
                   lambda: bpe.round_trip_digests(docs, word).count(),
                   lambda: token_files.write_files(docs, word, 1, common.scratch_path(spark, "token-files")).count()):
        encode()
        probe = docs.repartition(4 * spark.sparkContext.defaultParallelism)
        kept = common.map_arrow(probe, held, "n long, pid long", encodes=True).collect()
        assert any(r["n"] for r in kept)                                  # an encoding task finds them ...
        gone = common.map_arrow(probe, held, "n long, pid long").collect()
        assert gone and not any(r["n"] for r in gone)                     # ... any other one does not


def test_an_idle_worker_gives_its_freed_memory_back(spark):
    import pyarrow as pa

    def used(batches):
        import re
        for b in batches:
            text = open("/proc/self/smaps_rollup").read()
            kb = sum(map(int, re.findall(r"\n(?:Anonymous):\s+(\d+)", text)))
            yield pa.RecordBatch.from_arrays([pa.array([kb], pa.int64())], ["kb"])

    def work(batches):
        for b in batches:
            held = [b"x" * 3000 + str(i).encode() for i in range(60_000)]
            arrays = [pa.array([x] * 4000, pa.binary()) for x in held[:16]]
            yield pa.RecordBatch.from_arrays([pa.array([len(held) + len(arrays)], pa.int64())], ["kb"])

    one = spark.range(1).coalesce(1)
    before = common.map_arrow(one, used, "kb long").first()["kb"]
    assert common.map_arrow(one, work, "kb long").first()["kb"] == 60_016
    after = common.map_arrow(one, used, "kb long").first()["kb"]
    assert after < before + 40_000
