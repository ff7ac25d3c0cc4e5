"""BPE encoding with a segment tree over adjacent pair ranks, and decoding.

For each piece of a word the leaves of a segment tree hold the merge rank of every
adjacent pair; the root is the leftmost pair of lowest rank. Merging it changes three
leaves (its own, its right and its left neighbour), each a point update along
log2(length) nodes. It ends when no pair of the piece can merge. Pieces of similar
length are laid out as rows of one matrix, so a step merges one pair in each row.

Works for tokenizer files of this kind: NFC, white space dropped, lower case, pieces
by pattern, byte alphabet, an end-of-word suffix, no decoder (tokens joined by a
blank). Others are refused. Null text is empty; an empty text has no ids and decodes
to the empty text. Special tokens written out in a text become their ids. Rows may
repeat; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, library_tokenizer, split_dropping
from .common import SLICE_BYTES, column, map_arrow, text_slices, worker_cache

# fixed values: the split pattern of the tokenizer file, with its white space spelled out
_SPACE = r"\t-\r \x85\xa0  -     　"
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = regex.compile(r"\n|" + PIECE_PATTERN.replace(r"\s", _SPACE))
MATRIX_CELLS = 1 << 19


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the
    others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class WordPieces:
    """White-space-free words -> their normalised pieces."""

    def __init__(self, special: list[str]):
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def split(self, words: list[str]) -> tuple[list[str], list[int]]:
        """All pieces in a row and the number of pieces of each word."""
        sections = words
        if self.special and any(self.special.search(w) for w in words if "<" in w):
            return self._with_special(words)
        joined = unicodedata.normalize("NFC", "\n".join(sections)).replace("Σ", "σ").lower()
        pieces, counts, n = [], [], 0
        for p in _PIECES.findall(joined):
            if p == "\n":
                counts.append(n)
                n = 0
            else:
                pieces.append(p)
                n += 1
        counts.append(n)
        return pieces, counts

    def _with_special(self, words: list[str]) -> tuple[list[str], list[int]]:
        pieces, counts = [], []
        for w in words:
            before = len(pieces)
            for i, section in enumerate(self.special.split(w)):
                if i % 2:
                    pieces.append(section)
                elif section:
                    low = unicodedata.normalize("NFC", section).replace("Σ", "σ").lower()
                    pieces += _PIECES.findall(low)
            counts.append(len(pieces) - before)
        return pieces, counts


class SegmentTreeBpe:
    """Byte pieces -> token ids by leftmost lowest-rank merges."""

    def __init__(self, definition: str):
        d = json.loads(definition)
        model = d["model"]
        suffix = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not suffix or d.get("decoder") is not None \
                or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("not a tokenizer file of the kind described in this module")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for tok, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = tok
        spaced = [t.encode() + b" " for t in self.tokens]
        self.token_len = np.array([len(t) for t in spaced], dtype=np.int64)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.token_flat = np.frombuffer(b"".join(spaced), dtype=np.uint8)
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
        self.size = size
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.none = np.int64(len(pairs))   # rank of a pair that cannot merge
        self.words = WordPieces(list(self.special))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def _merge(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of byte ids (width a power of two, ``n`` of them used) -> ids left, how many."""
        rows, width = ids.shape
        col = np.arange(width)
        no = self.none * width + width        # above any key rank * width + position
        leaf = np.full((rows, width), no, dtype=np.int64)
        if width > 1:
            r = self.rank(ids[:, :-1], ids[:, 1:])
            ok = (col[1:] < n[:, None]) & (r < self.none)
            leaf[:, :-1] = np.where(ok, r * width + col[:-1], no)
        tree = np.empty((rows, 2 * width), dtype=np.int64)
        tree[:, width:] = leaf
        for i in range(width.bit_length() - 2, -1, -1):
            lo, hi = 1 << i, 2 << i
            tree[:, lo:hi] = np.minimum(tree[:, 2 * lo:2 * hi:2], tree[:, 2 * lo + 1:2 * hi:2])
        nxt = np.tile(col + 1, (rows, 1)).ravel()
        prv = np.tile(col - 1, (rows, 1)).ravel()
        flat, t = ids.ravel(), tree.ravel()
        act = np.arange(rows)
        while len(act):
            root = t[act * (2 * width) + 1]
            act, root = act[root < no], root[root < no]
            if not len(act):
                break
            base, p, m = act * width, root % width, n[act]
            q = nxt[base + p]
            after = nxt[base + q]
            flat[base + p] = self.made[root // width]
            flat[base + q] = -1
            nxt[base + p] = after
            more = after < m
            prv[(base + after)[more]] = p[more]
            before = prv[base + p]
            left = before >= 0
            tb = act * (2 * width)
            t[tb + width + q] = no
            t[tb + width + p] = no
            r = self.rank(flat[(base + p)[more]], flat[(base + after)[more]])
            t[(tb + width + p)[more]] = np.where(r < self.none, r * width + p[more], no)
            r = self.rank(flat[(base + before)[left]], flat[(base + p)[left]])
            t[(tb + width + before)[left]] = np.where(r < self.none, r * width + before[left], no)
            at = np.concatenate([p, q, before[left]]) + width
            tb = np.concatenate([tb, tb, tb[left]])
            for _ in range(width.bit_length() - 1):
                at >>= 1
                t[tb + at] = np.minimum(t[tb + 2 * at], t[tb + 2 * at + 1])
        kept = (flat.reshape(rows, width) >= 0) & (col < n[:, None])
        return flat.reshape(rows, width)[kept], kept.sum(axis=1)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each normalised piece (a special token stands for itself)."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        raw: list[bytes] = []
        for i, p in enumerate(pieces):
            raw.append(p.encode())
            if p in self.special:
                out[i] = [self.special[p]]
            else:
                by_width.setdefault(1 << (len(raw[i]) - 1).bit_length(), []).append(i)
        for width, members in by_width.items():
            step = max(1, MATRIX_CELLS // width)
            for at in range(0, len(members), step):
                part = members[at:at + step]
                n = np.fromiter((len(raw[i]) for i in part), np.int64, len(part))
                buf = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in part), dtype=np.uint8)
                ids = self.inner[buf].reshape(len(part), width)
                ends = (np.arange(len(part)), n - 1)
                ids[ends] = self.last[buf.reshape(len(part), width)[ends]]
                flat, counts = self._merge(np.ascontiguousarray(ids), n)
                flat, to = flat.tolist(), np.cumsum(counts).tolist()
                for i, a, b in zip(part, [0, *to], to):
                    out[i] = flat[a:b]
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        pieces, counts = self.words.split(words)
        number = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        ids = self.encode_pieces(list(number))
        out, at = [], 0
        for c in counts:
            if c == 1:
                out.append(ids[number[pieces[at]]])
            else:
                out.append([x for p in pieces[at:at + c] for x in ids[number[p]]])
            at += c
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids: all tokens, special ones too, joined by a blank (UTF-8)."""
        return self.decode_many(ids, np.array([len(ids)]))[0]

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of several lists of ids that stand in a row."""
        lens = self.token_len[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((self.token_start[ids] - (ends - lens)).astype(np.int32), lens)
        at += np.arange(total, dtype=np.int32)
        raw = self.token_flat[at].tobytes()
        to = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:max(a, b - 1)] for a, b in zip(to, to[1:])]   # without the last blank


_ENCODERS: dict[str, tuple[SegmentTreeBpe, ChunkEncoder]] = worker_cache()


def worker_bpe(definition: str) -> tuple[SegmentTreeBpe, ChunkEncoder]:
    if definition not in _ENCODERS:
        bpe = SegmentTreeBpe(definition)
        _ENCODERS[definition] = (bpe, ChunkEncoder(bpe.encode_words, split_dropping))
    return _ENCODERS[definition]


def encode_column(df: DataFrame, definition: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every whole text."""
    def run(batches):
        _, enc = worker_bpe(definition)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, counts = enc.encode(column(part, "text").fill_null("").to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"),
                     pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))],
                    ["doc_id", "ids"])

    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(src, run, "doc_id long, ids array<int>", encodes=True)


def decode_column(df: DataFrame, definition: str, id_col: str = "doc_id",
                  ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of every list of ids (null: the empty text)."""
    def run(batches):
        bpe, _ = worker_bpe(definition)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], dtype=np.int64)).decode()
                     for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_arrow(src, run, "doc_id long, text string", encodes=True)


def round_trip_digests(df: DataFrame, definition: str, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    def run(batches):
        bpe, enc = worker_bpe(definition)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES // 2):
                flat, counts = enc.encode(column(part, "text").fill_null("").to_pylist())
                to = np.cumsum(counts).tolist()
                sha = [hashlib.sha256(flat[a:b].astype("<u4").tobytes()).hexdigest()
                       for a, b in zip([0, *to], to)]
                back = [hashlib.sha256(t).hexdigest() for t in bpe.decode_many(flat, counts)]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(counts, pa.int64()),
                     pa.array(sha, pa.string()), pa.array(back, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(src, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                     encodes=True)


_LIBRARY_ENCODERS: dict[str, ChunkEncoder] = worker_cache()


def worker_library_encoder(definition: str) -> ChunkEncoder:
    """The same ids from the tokenizers library: its BPE model merges each distinct
    normalised piece. (Encoding short strings through its whole chain of normaliser and
    pattern costs several times as much.)"""
    if definition not in _LIBRARY_ENCODERS:
        model = library_tokenizer(definition).model
        special = {t["content"]: t["id"] for t in json.loads(definition).get("added_tokens", [])}
        words = WordPieces(list(special))
        letters = {i: c for i, c in enumerate(byte_alphabet())}

        def encode(batch: list[str]) -> list[list[int]]:
            pieces, counts = words.split(batch)
            ids = {p: [special[p]] if p in special else
                   [t.id for t in model.tokenize(p.encode().decode("latin-1").translate(letters))]
                   for p in dict.fromkeys(pieces)}
            out, at = [], 0
            for c in counts:
                out.append(ids[pieces[at]] if c == 1 else
                           [x for p in pieces[at:at + c] for x in ids[p]])
                at += c
            return out

        _LIBRARY_ENCODERS[definition] = ChunkEncoder(encode, split_dropping)
    return _LIBRARY_ENCODERS[definition]
