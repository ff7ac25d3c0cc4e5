"""Token ids of whole texts through cached pieces of text.

A text is cut where a run of spaces, tabs or newlines follows a character that is not
white space. Both public tokenizers used here split there as well (white space is
dropped, or opens the next piece), so the ids of a text are the ids of its pieces in a
row. Each distinct piece is encoded once per worker; the cache holds at most
``CACHE_PIECES`` pieces and is emptied when full, but for the ``keep`` pieces (none unless
asked for) that were used most.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, compress
from typing import Callable

import numpy as np
import regex

from .common import worker_cache

CACHE_PIECES = 1_000_000

# a piece with its leading white space; blanks at the end of a text form a piece of their own
_SPACED = re.compile(r"\s*[^ \t\n]*?\S(?=[ \t\n])|\s*\S.*\Z|\s+\Z", re.S)


class PieceIds(dict):
    """piece -> number of its entry in the store; unseen pieces queue up."""

    def __init__(self):
        super().__init__()
        self.queue: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.queue.append(piece)
        return n


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of entries ``idx`` (each ``lens`` ids of ``flat`` from ``starts`` on) in a row, and
    where those of each end."""
    lens = lens[idx]
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat((starts[idx] - ends + lens).astype(np.int32), lens)
    at += np.arange(total, dtype=np.int32)
    return flat[at], ends


class ChunkEncoder:
    """``encode(texts)`` -> (ids of all texts in a row, number of ids of each text).

    ``encode_pieces(list of pieces)`` does the real encoding: to a list of id lists, or to the
    ids of all pieces in a row and the number of ids of each;
    ``split(text) -> list of pieces`` cuts a text. When the cache is full, up to ``keep``
    pieces that were used more than once stay, the most used ones; their counts are halved.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list], split: Callable[[str], list[str]],
                 limit: int = CACHE_PIECES, keep: int = 0):
        self.encode_pieces, self.split, self.limit, self.keep = encode_pieces, split, limit, keep
        self.reset()

    def reset(self) -> None:
        self.index = PieceIds()
        self.lens = np.zeros(1024, dtype=np.int64)
        self.starts = np.zeros(1024, dtype=np.int64)
        self.flat = np.zeros(4096, dtype=np.uint32)
        self.uses = np.zeros(1024, dtype=np.int64)
        self.used = 0

    def _shrink(self) -> None:
        """Empty the cache but for the pieces used most."""
        n, keep = len(self.index), self.keep
        uses = self.uses[:n]
        least = max(1, int(np.partition(uses, n - keep - 1)[n - keep - 1])) if n > keep else 1
        stay = uses > least
        pieces, idx = list(compress(self.index, stay.tolist())), np.flatnonzero(stay)
        flat, ends = gather(self.flat, self.starts, self.lens, idx)
        lens, uses = self.lens[idx], uses[idx] // 2
        self.reset()
        self.index.update(zip(pieces, range(len(pieces))))
        if pieces:
            self.lens, self.starts, self.flat, self.uses = lens, ends - lens, flat, uses
            self.used = len(flat)

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        b = np.zeros(max(n, 2 * len(a)), dtype=a.dtype)
        b[:len(a)] = a
        return b

    def _store(self) -> None:
        pieces, self.index.queue = self.index.queue, []
        if not pieces:
            return
        ids = self.encode_pieces(pieces)
        first = len(self.index) - len(pieces)
        if not isinstance(ids, tuple):
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            ids = np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens
        flat, lens = ids
        total = len(flat)
        self.lens = self._grown(self.lens, len(self.index))
        self.starts = self._grown(self.starts, len(self.index))
        self.uses = self._grown(self.uses, len(self.index))
        self.flat = self._grown(self.flat, self.used + total)
        self.lens[first:first + len(lens)] = lens
        self.starts[first:first + len(lens)] = self.used + np.cumsum(lens) - lens
        self.flat[self.used:self.used + total] = flat
        self.used += total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.limit:
            if self.keep:
                self._shrink()
            else:
                self.reset()
        get, split = self.index.__getitem__, self.split
        numbers, counts = [], []
        for t in texts:
            pieces = split(t)
            counts.append(len(pieces))
            numbers.append(np.fromiter(map(get, pieces), np.int32, len(pieces)))
        self._store()
        idx = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        if self.keep:
            self.uses[:len(self.index)] += np.bincount(idx, minlength=len(self.index))
        out, ends = gather(self.flat, self.starts, self.lens, idx)
        bounds = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])
        at = np.concatenate([[0], ends])[bounds]
        return out, np.diff(at)


LITERAL = "\ud800"   # marks a piece that stands for itself; no text holds a lone surrogate
_OWN_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")   # white space for Python only
_ASCII_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


def split_dropping(text: str) -> list[str]:
    """Pieces between white space, for tokenizers that drop white space."""
    if any(c in text for c in _OWN_SEPARATORS):
        return _ASCII_SPACE.split(text)
    return text.split()


def split_keeping(text: str) -> list[str]:
    """Pieces with the white space before them, for tokenizers that encode it. A piece
    after one space goes without that space; see ``piece_text``."""
    if text and " ".join(text.split()) == text.replace("\n", " "):
        out = text.replace("\n", " \n").split(" ")   # words between single blanks or line ends
        out[0] = LITERAL + out[0]
        return out
    return [p[1:] if len(p) > 1 and p[0] == " " and not p[1].isspace()
            else p if p[0].isspace() else LITERAL + p for p in _SPACED.findall(text)]


def piece_text(key: str) -> str:
    """What a piece of ``split_keeping`` stands for."""
    if key[0] == LITERAL:
        return key[1:]
    return key if key[0].isspace() else " " + key


_LIBRARY: dict[str, object] = worker_cache()


def library_tokenizer(definition: str):
    """A tokenizer of the tokenizers library from its JSON definition (one per worker)."""
    if definition not in _LIBRARY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # one core per Spark task
        from tokenizers import Tokenizer
        t = Tokenizer.from_str(definition)
        t.no_truncation()
        t.no_padding()
        _LIBRARY[definition] = t
    return _LIBRARY[definition]


# characters that this module and the library are sure to tell apart alike (letters, numbers,
# white space, others): blocks without late additions to Unicode
_SETTLED = (r"\x00-\u052f\u2010-\u2027\u2030-\u205e\u3001-\u3096\u30a1-\u30ff"
            r"\u20ac\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e")
_OTHER = re.compile(f"[^{_SETTLED}{LITERAL}]")
_BLANK = r"\t-\r \x85\xa0"   # the white space among them
# the pattern of the ByteLevel pre-tokenizer; LITERAL ends a piece like the end of a text
_WORDS = regex.compile(rf"{LITERAL}|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}{LITERAL}]+"
                       rf"|[{_BLANK}]+(?![^{_BLANK}{LITERAL}])|[{_BLANK}]+")
LONG_PIECE = 4096   # characters


def byte_level_words(definition: str) -> tuple[Callable, Callable] | None:
    """For tokenizers without normaliser whose words are those of the ByteLevel pattern (None
    for others): a function that tells whether a string has to go through the library's whole
    chain, and one from other pieces to their ids by the library's model. The model gets each
    distinct word of a call once; taking every piece through the whole chain costs more."""
    d = json.loads(definition)
    words = d.get("pre_tokenizer") or {}
    if d.get("normalizer") or d["model"]["type"] != "BPE" or words.get("type") != "ByteLevel" \
            or words.get("add_prefix_space") or not words.get("use_regex", True):
        return None
    from .bpe import byte_alphabet
    letters = dict(enumerate(byte_alphabet()))
    special = [t["content"] for t in d.get("added_tokens", [])]
    tokenize = library_tokenizer(definition).model.tokenize

    def in_letters(text: str) -> str:
        return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters)

    def odd(text: str) -> bool:
        return not text.isascii() and _OTHER.search(text) is not None or any(map(text.__contains__, special))

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = _WORDS.findall(LITERAL.join(["", *pieces, ""]))
        number = PieceIds()
        idx = np.fromiter(map(number.__getitem__, found), np.int32, len(found))   # 0: between pieces
        flat: list[int] = []
        sizes = [0]
        # no UTF-8 text holds the bytes of LITERAL
        for w in in_letters(LITERAL.join(number.queue[1:])).split(in_letters(LITERAL)):
            tokens = tokenize(w)
            sizes.append(len(tokens))
            flat += [t.id for t in tokens]
        lens = np.array(sizes, dtype=np.int64)
        out, ends = gather(np.array(flat, dtype=np.uint32), np.cumsum(lens) - lens, lens, idx)
        return out, np.diff(ends[idx == 0])

    return odd, encode


def library_encoder(definition: str, keeps_space: bool, limit: int = CACHE_PIECES, keep: int = 0) -> ChunkEncoder:
    """The library's ids. ``keeps_space``: the tokenizer encodes white space (else it drops it).
    ``limit``: pieces in the cache. ``keep``: of these, pieces that stay when it is full."""
    t = library_tokenizer(definition)
    by_words = byte_level_words(definition) if keeps_space else None

    def whole(batch: list[str]) -> list:
        out = []
        for i in range(0, len(batch), 20_000):
            part = batch[i:i + 20_000]
            out += [e.ids for e in t.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def pieces(batch: list[str]) -> list | tuple[np.ndarray, np.ndarray]:
        if keeps_space:
            batch = [piece_text(p) for p in batch]
        if by_words is None:
            return whole(batch)
        odd, encode = by_words
        if max(map(len, batch)) <= LONG_PIECE and not odd(LITERAL.join(batch)):
            return encode(batch)
        apart = [len(p) > LONG_PIECE or odd(p) for p in batch]
        theirs = iter(whole(list(compress(batch, apart))))
        flat, lens = encode([p for p, x in zip(batch, apart) if not x])
        flat, to = flat.tolist(), np.cumsum(lens).tolist()
        ours = (flat[a:b] for a, b in zip([0, *to], to))
        return [next(theirs if x else ours) for x in apart]

    return ChunkEncoder(pieces, split_keeping if keeps_space else split_dropping, limit, keep)


_ENCODERS: dict[tuple[str, bool, int, int], ChunkEncoder] = worker_cache()


def worker_encoder(definition: str, keeps_space: bool, limit: int = CACHE_PIECES, keep: int = 0) -> ChunkEncoder:
    """The encoder of this Python worker (its cache outlives a task, but not the stage)."""
    key = (definition, keeps_space, limit, keep)
    if key not in _ENCODERS:
        _ENCODERS[key] = library_encoder(definition, keeps_space, limit, keep)
    return _ENCODERS[key]
