"""Language identification by a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes of 1 to 4 characters, its character pairs and
triples (hashed to ``BUCKETS``) and its language shares in a lexicon. Together with learned
transitions they give every word a distribution over languages by forward-backward over
the whole text, so a text that switches languages gets a label per word
(``label_words``). A document's language is the one with the largest mean word probability;
that mean is its score.

Training uses a bounded sample: the ``SAMPLE`` labelled training rows of smallest hash of (id,
text), equal rows once, with whole texts. Documents carry one label each, so runs of 6 to
40 words of different documents are dealt in random order into chains of ``CHAIN`` words, from
which the transitions learn to switch. Lexicon: the ``LEXICON`` most frequent words of the
sample. Each round the tasks sum the gradient of the chains' log likelihood as fixed-point
integers, which add up to the same bits in any order, and the driver takes an AdaGrad step
on the weights (BUCKETS x languages).

Forward-backward is exact on whole texts of any length: all texts of a slice form one chain
whose transitions are cut where a text begins; blocks of positions get their transfer
matrices side by side, a scan over the blocks gives the vectors at their borders, and the
blocks are filled in side by side.

A word is a maximal run of letters and digits other than decimal ones, lower-cased. A text
that is null or without a letter is ``und`` with score 0, as is every text when nothing could
be learned (no labels, empty table). Of equally probable languages the smallest name counts.
Rows that repeat an id are documents of their own; a null id counts as an empty text in the
fold and is not held out. Other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import collect_blocks, column, map_arrow, materialize, sum_blocks, text_slices
from .words import pair_hashes

SAMPLE = 2_000          # training documents
LEXICON = 50_000        # words with language shares
BUCKETS = 1 << 15       # hashed affixes and n-grams
CHAIN, RUN = 64, (6, 40)
PACK_WORDS = 1 << 16    # words trained on at once, about
ROUNDS, RATE = 12, 0.5
BLOCKS = 64             # parts of the gradient that are summed apart
UNIT = float(1 << 24)   # fixed-point gradients
CACHE_WORDS = 200_000   # words whose scores a worker keeps
CELLS = 1 << 22         # transfer matrix cells at once
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    langs: list
    weights: np.ndarray      # (BUCKETS, languages)
    lexical: np.ndarray      # (languages, languages): share in the lexicon -> score
    moves: np.ndarray        # (languages, languages): log transitions
    lexicon: dict            # word -> shares


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def _featurize(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' affixes and n-grams in a row, and the number of each word's."""
    text = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 2)                    # one past a word's closing mark
    first, of = end - size - 1, np.repeat(np.arange(len(words)), size + 2)
    parts, owners = [], []
    for kind, at, step in ((1, first, 1), (2, end - 2, -1)):
        h, mine = np.full(len(words), kind, dtype=np.uint64), np.arange(len(words))
        for n in range(4):
            mine = mine[size[mine] > n]
            h[mine] = pair_hashes(h[mine], text[at[mine] + step * n])
            parts.append(h[mine])
            owners.append(mine)
    h = text
    for n in (1, 2):
        h = pair_hashes(h[:-1], text[n:])
        inside = of[n:] == of[:-n]
        parts.append(h[inside])
        owners.append(of[:-n][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return ((np.concatenate(parts)[order] % np.uint64(BUCKETS)).astype(np.int32),
            np.bincount(owner, minlength=len(words)).astype(np.int32))


def _scores(feats: np.ndarray, counts: np.ndarray, shares: np.ndarray, m) -> np.ndarray:
    """Word scores (words x languages) from features and lexicon shares."""
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return (np.add.reduceat(m.weights[feats], start, axis=0) / np.sqrt(counts)[:, None] + shares @ m.lexical)


def _shares(words: list[str], lexicon: dict, n: int) -> np.ndarray:
    out = np.zeros((len(words), n))
    for i, w in enumerate(words):
        if w in lexicon:
            out[i] = lexicon[w]
    return out


def marginals(score: np.ndarray, starts: np.ndarray, moves: np.ndarray, expect: bool = True
              ) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over texts in a row: (probability of each language per word, sum of
    the expected transitions, if asked for). ``starts``: first word of each text (no text is empty)."""
    n, size = score.shape
    block = max(CHAIN, -(-n * size * size // CELLS))
    n_blocks = -(-n // block)
    p = np.ones((n_blocks * block, size))
    p[:n] = np.exp(score - score.max(axis=1, keepdims=True))
    cut = np.zeros(n_blocks * block, dtype=bool)
    cut[starts] = True
    cut[n:] = True
    p, cut = p.reshape(n_blocks, block, size), cut.reshape(n_blocks, block)
    move = np.exp(moves - moves.max())

    def enter(v, j):     # row vectors or matrices before position j of each block -> at it
        at = (v.reshape(-1, size) @ move).reshape(v.shape)
        at[cut[:, j]] = v[cut[:, j]].sum(axis=-1, keepdims=True)
        at *= p[:, j] if v.ndim == 2 else p[:, j, None, :]
        top = at.reshape(n_blocks, -1).max(axis=1)
        at /= top[:, None] if v.ndim == 2 else top[:, None, None]
        return at

    across = np.broadcast_to(np.eye(size), (n_blocks, size, size)).copy()
    for j in range(block):
        across = enter(across, j)
    first, last = np.ones((n_blocks, size)), np.ones((n_blocks, size))
    for b in range(n_blocks - 1):
        v = first[b] @ across[b]
        first[b + 1] = v / v.max()
    for b in range(n_blocks - 1, 0, -1):
        v = across[b] @ last[b]
        last[b - 1] = v / v.max()
    forward = np.empty_like(p)
    v = first
    for j in range(block):
        v = forward[:, j] = enter(v, j)
    out, pairs = np.empty_like(p), np.zeros((size, size))
    back = last
    for j in range(block - 1, -1, -1):
        g = forward[:, j] * back
        out[:, j] = g / g.sum(axis=1, keepdims=True)
        w = p[:, j] * back
        before = forward[:, j - 1] if j else first
        inside = ~cut[:, j]
        if expect and inside.any():
            x = before[inside][:, :, None] * move * w[inside][:, None, :]
            pairs += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = w @ move.T
        back[cut[:, j]] = w[cut[:, j]].sum(axis=1, keepdims=True)
        back = back / back.max(axis=1, keepdims=True)
    return out.reshape(-1, size)[:n], pairs


# --- training --------------------------------------------------------------------------


def sample(labelled: DataFrame, size: int) -> DataFrame:
    """``h, text, lang``: the rows of smallest hash, equal rows once."""
    hashed = labelled.select(F.xxhash64("doc_id", "text", "lang").alias("h"), "text", "lang")
    smallest = materialize(hashed.select("h").distinct().orderBy("h").limit(size), "sample-keys")   # at most ``size`` rows
    n = min(64, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialize(hashed.join(F.broadcast(smallest), "h", "left_semi").dropDuplicates(["h"])
                       .repartition(n, "h").sortWithinPartitions("h"), "sample")


def build_lexicon(rows: DataFrame, langs: list[str], size: int = LEXICON) -> dict:
    """The most frequent words of the sample with their smoothed language shares, less the mean."""
    def count(batches):
        for batch in batches:
            seen: dict = {}
            for text, lang in zip(column(batch, "text").to_pylist(), column(batch, "lang").to_pylist()):
                for w in words_of(text):
                    seen[w, lang] = seen.get((w, lang), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.string()),
                 pa.array(list(seen.values()), pa.int64())], ["word", "lang", "n"])

    per = map_arrow(rows, count, "word string, lang string, n long").groupBy("word").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}")
                                 for i, x in enumerate(langs)])
    out = {}
    for r in per.filter("n > 1").orderBy(F.desc("n"), "word").limit(size).collect():
        x = np.array(r[2:], dtype=float) + 0.25
        out[r["word"]] = x / x.sum() - 1 / len(langs)
    return out


_PACK = "words binary, labels binary, feats binary, counts binary, shares binary"


def packs(rows: DataFrame, langs: list[str], lexicon: dict) -> DataFrame:
    """The sample as chains of spliced runs, with the features of their distinct words."""
    shared = rows.sparkSession.sparkContext.broadcast((langs, lexicon))

    def run(batches):
        names, lex = shared.value
        number = {x: i for i, x in enumerate(names)}
        texts: list = []

        def pack():
            rng = np.random.default_rng(len(texts))
            runs = []
            for words, y in texts:
                at = 0
                while at < len(words):
                    n = int(rng.integers(*RUN))
                    runs.append((words[at:at + n], y))
                    at += n
            order = rng.permutation(len(runs)).tolist()
            flat = [w for i in order for w in runs[i][0]]
            label = np.concatenate([np.full(len(runs[i][0]), runs[i][1], np.int32) for i in order])
            kinds = list(dict.fromkeys(flat))
            place = {w: i for i, w in enumerate(kinds)}
            feats, counts = _featurize(kinds)
            cells = [np.fromiter(map(place.get, flat), np.int32, len(flat)), label, feats, counts,
                     _shares(kinds, lex, len(names))]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells],
                                              ["words", "labels", "feats", "counts", "shares"])

        size = 0
        for batch in batches:
            for text, lang in zip(column(batch, "text").to_pylist(), column(batch, "lang").to_pylist()):
                words = words_of(text)
                for at in range(0, len(words), PACK_WORDS):      # a very long text fills packs of its own
                    texts.append((words[at:at + PACK_WORDS], number[lang]))
                    size += len(texts[-1][0])
                    if size >= PACK_WORDS:
                        yield pack()
                        texts, size = [], 0
        if texts:
            yield pack()

    return materialize(map_arrow(rows, run, _PACK), "packs")


def gradient(m, word, label, feats, counts, shares) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient of the log likelihood of one pack: (weights, lexical, moves)."""
    size = shares.shape[1]
    starts = np.arange(0, len(word), CHAIN)
    prob, pairs = marginals(_scores(feats, counts, shares, m)[word], starts, m.moves)
    seen = np.zeros((size, size))
    inside = np.ones(len(word), dtype=bool)
    inside[starts] = False
    np.add.at(seen, (label[:-1][inside[1:]], label[1:][inside[1:]]), 1)
    diff = -prob
    diff[np.arange(len(word)), label] += 1
    per_word = np.stack([np.bincount(word, weights=diff[:, k], minlength=len(counts)) for k in range(size)], axis=1)
    spread = np.repeat(per_word / np.sqrt(counts)[:, None], counts, axis=0)
    g = np.stack([np.bincount(feats, weights=spread[:, k], minlength=BUCKETS) for k in range(size)], axis=1)
    return g, shares.T @ per_word, seen - pairs


def fit(labelled: DataFrame, size: int = SAMPLE, rounds: int = ROUNDS) -> Model | None:
    """Train on ``doc_id, text, lang`` rows; None if no row has a language and a word."""
    rows = sample(labelled.filter("lang is not null and text is not null"), size)
    langs = [r[0] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    lexicon = build_lexicon(rows, langs)
    table, k = packs(rows, langs, lexicon), len(langs)
    total = BUCKETS * k + 2 * k * k
    width = -(-total // BLOCKS)
    x, norm = np.zeros(width * BLOCKS), np.full(width * BLOCKS, 1e-8)
    x[BUCKETS * k:BUCKETS * k + k * k] = 4 * np.eye(k).ravel()

    def model(x, lexicon=None):
        a, b = BUCKETS * k, BUCKETS * k + k * k
        return Model(langs, x[:a].reshape(BUCKETS, k), x[a:b].reshape(k, k), x[b:total].reshape(k, k), lexicon or {})

    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(x)

        def run(batches):
            m, acc, n = model(shared.value), np.zeros(width * BLOCKS, dtype=np.int64), 0
            for batch in batches:
                for cells in zip(*(c.to_pylist() for c in batch.columns)):
                    word, label, feats, counts = (np.frombuffer(c, dtype=np.int32) for c in cells[:4])
                    parts = gradient(m, word, label, feats, counts, np.frombuffer(cells[4]).reshape(-1, k))
                    acc[:total] += np.rint(np.concatenate([g.ravel() for g in parts]) * UNIT).astype(np.int64)
                    n += len(word)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in acc.reshape(BLOCKS, width)], pa.binary())],
                    ["block", "data"])

        summed = sum_blocks(map_arrow(table, run, "block int, data binary"), "<i8", BLOCKS)
        g = collect_blocks(summed, "<i8", width * BLOCKS, BLOCKS) / UNIT
        shared.destroy()
        norm += g * g
        x += RATE * g / np.sqrt(norm)
    return model(x, lexicon)


# --- labelling -------------------------------------------------------------------------


class Places(dict):
    """word -> row of its scores; unseen words queue up."""

    def __init__(self):
        super().__init__()
        self.queue: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.queue.append(word)
        return n


class Scorer:
    """Word scores of a worker, kept for the words met last."""

    def __init__(self, m: Model):
        self.m, self.place = m, Places()
        self.table, self.letters = np.zeros((0, len(m.langs))), np.zeros(0, dtype=bool)

    def probabilities(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words x languages, number of words per text, has the text a letter?)."""
        words = [words_of(t) for t in texts]
        if len(self.place) > CACHE_WORDS:
            self.__init__(self.m)
        n = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        new, self.place.queue = self.place.queue, []
        if new:
            self.table = np.concatenate([self.table, _scores(*_featurize(new), _shares(new, self.m.lexicon, len(self.m.langs)), self.m)])
            self.letters = np.concatenate([self.letters, np.fromiter(map(has_letter, new), bool, len(new))])
        letters = np.zeros(len(texts), dtype=bool)
        if not len(ids):
            return np.zeros((0, len(self.m.langs))), n, letters
        starts = (np.cumsum(n) - n)[n > 0]
        letters[n > 0] = np.logical_or.reduceat(self.letters[ids], starts)
        return marginals(self.table[ids], starts, self.m.moves, expect=False)[0], n, letters


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def classify(docs: DataFrame, m: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` per document."""
    src = _source(docs, id_col, text_col)
    if m is None:
        return src.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(m)   # BUCKETS x languages, LEXICON words

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in text_slices(batch, "text"):
                prob, n, letters = scorer.probabilities(column(part, "text").to_pylist())
                lang, score = [UNKNOWN] * len(n), np.zeros(len(n))
                if len(prob):
                    some = np.flatnonzero(n)
                    mean = np.add.reduceat(prob, (np.cumsum(n) - n)[some], axis=0) / n[some, None]
                    for i, k, s in zip(some.tolist(), mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist()):
                        if letters[i]:
                            lang[i], score[i] = scorer.m.langs[k], min(1.0, s)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(lang, pa.string()), pa.array(score)],
                                                 ["doc_id", "lang_pred", "score"])

    return map_arrow(src, run, "doc_id long, lang_pred string, score double")


def label_words(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, langs, lengths``: the languages of a text's words in order, as runs."""
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in text_slices(batch, "text"):
                prob, n, _ = scorer.probabilities(column(part, "text").to_pylist())
                best, at, langs, lengths = prob.argmax(axis=1), 0, [], []
                for k in n.tolist():
                    y = best[at:at + k]
                    at += k
                    first = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]])) if k else np.zeros(0, np.int64)
                    langs.append([scorer.m.langs[y[i]] for i in first])
                    lengths.append(np.diff(np.append(first, k)))
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(langs, pa.list_(pa.string())), pa.array(lengths, pa.list_(pa.int32()))],
                    ["doc_id", "langs", "lengths"])

    return map_arrow(_source(docs, id_col, text_col), run, "doc_id long, langs array<string>, lengths array<int>")


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4 (null: empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4


def identify(docs: DataFrame, size: int = SAMPLE, rounds: int = ROUNDS, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn outside the held-out fold, label every document: ``doc_id, held_out, lang_pred, score``."""
    train = docs.filter(fold(id_col) != 2).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return classify(docs, fit(train, size, rounds), id_col, text_col).select(
        "doc_id", (fold("doc_id") == 2).alias("held_out"), "lang_pred", "score")
