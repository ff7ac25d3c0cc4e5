"""Token encoders and the token-array column expressions.

Two kinds of encoder:

* ``CodePoints`` is native: one id per Unicode code point, computed by
  built-in expressions (``split`` + ``ascii``), so it stays in the JVM and
  has an exact SQL oracle. Special ids sit just above the Unicode range.
* ``Vocab`` wraps a vocabulary file of an installed tokenizer library
  (``tokenizers``, ``tiktoken``, ``sentencepiece``) in an Arrow-batched
  ``pandas_udf``; the tokenizer object is loaded once per Python worker
  (module-level cache) and only its file path travels with the task.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from typing import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

IGNORE_INDEX = -100  # label value that a loss ignores (collator and masking default)

UNICODE_LIMIT = 0x110000
CP_EOS = UNICODE_LIMIT          # end-of-text id of the code point encoder
CP_PAD = UNICODE_LIMIT + 1      # padding id of the code point encoder

INT_ARRAY = T.ArrayType(T.IntegerType())


def empty_ids() -> Column:
    return F.array().cast("array<int>")


@dataclass(frozen=True)
class Encoder:
    name: str
    eos_id: int | None
    pad_id: int | None
    bos_id: int | None = None

    native = False

    # -- to implement -------------------------------------------------------
    def encode(self, text: Column, cutoff: int | None = None) -> Column:
        raise NotImplementedError

    def decode(self, ids: Column, skip_special: bool = True) -> Column:
        raise NotImplementedError

    # -- shared --------------------------------------------------------------
    def count(self, text: Column, cutoff: int | None = None) -> Column:
        """Number of ids of ``encode(text, cutoff)``."""
        return F.size(self.encode(text, cutoff))

    @property
    def special_ids(self) -> list[int]:
        return [i for i in (self.bos_id, self.eos_id, self.pad_id) if i is not None]


@dataclass(frozen=True)
class CodePoints(Encoder):
    """Native encoder: ids are code points; truncation cuts the string first,
    so long documents never expand into long arrays."""

    name: str = "codepoint"
    eos_id: int | None = CP_EOS
    pad_id: int | None = CP_PAD
    bos_id: int | None = None

    native = True

    def _keep(self, cutoff: int | None) -> int | None:
        if cutoff is None:
            return None
        return max(cutoff - (1 if self.bos_id is not None else 0), 0)

    def encode(self, text: Column, cutoff: int | None = None) -> Column:
        keep = self._keep(cutoff)
        t = text if keep is None else F.substring(text, 1, keep)
        ids = F.when(F.length(t) == 0, empty_ids()).otherwise(
            F.transform(F.split(t, ""), lambda c: F.ascii(c)))
        if self.bos_id is not None:
            ids = F.concat(F.array(F.lit(self.bos_id)), ids)
        return ids

    def count(self, text: Column, cutoff: int | None = None) -> Column:
        n = F.length(text) + F.lit(1 if self.bos_id is not None else 0)
        return n if cutoff is None else F.least(n, F.lit(cutoff))

    def decode(self, ids: Column, skip_special: bool = True) -> Column:
        valid = F.filter(ids, lambda i: (i >= 0) & (i < UNICODE_LIMIT)
                         & ~((i >= 0xD800) & (i <= 0xDFFF)))
        hexed = F.array_join(F.transform(valid, lambda i: F.lpad(F.hex(i), 8, "0")), "")
        return F.decode(F.unhex(hexed), "UTF-32")


# --- vocabulary encoders (Python worker, Arrow batches) ----------------------

_LOADED: dict[tuple[str, str], object] = {}


def _load(kind: str, path: str):
    key = (kind, path)
    obj = _LOADED.get(key)
    if obj is not None:
        return obj
    if kind == "tokenizers":
        from tokenizers import Tokenizer

        obj = Tokenizer.from_file(path)
        obj.encode_special_tokens = True
    elif kind == "tiktoken":
        import tiktoken
        import public_tokenizers as P   # the split pattern belongs to the rank files

        pattern = P.PATTERN
        with open(path, "rb") as fh:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, fh) if a}
        obj = tiktoken.Encoding(f"file:{path}", pat_str=pattern, mergeable_ranks=ranks,
                                special_tokens={})
    elif kind == "sentencepiece":
        import sentencepiece

        obj = sentencepiece.SentencePieceProcessor(model_file=path)
    else:
        raise ValueError(f"unknown encoder kind {kind!r}")
    _LOADED[key] = obj
    return obj


def encode_texts(kind: str, path: str, texts: list[str]) -> list[list[int]]:
    tok = _load(kind, path)
    if kind == "tokenizers":
        return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    if kind == "tiktoken":
        return tok.encode_ordinary_batch(texts, num_threads=1)
    return tok.encode(texts)


def decode_ids(kind: str, path: str, rows: Iterable[list[int]], skip: set[int]) -> list[str]:
    tok = _load(kind, path)
    rows = [[int(i) for i in r if int(i) not in skip] for r in rows]
    if kind == "tokenizers":
        return tok.decode_batch(rows, skip_special_tokens=True)
    if kind == "tiktoken":
        return [tok.decode(r) for r in rows]
    return [tok.decode(r) for r in rows]


@dataclass(frozen=True)
class Vocab(Encoder):
    """Encoder over a vocabulary file; runs in a ``pandas_udf``."""

    kind: str = "tokenizers"
    path: str = ""

    def encode(self, text: Column, cutoff: int | None = None) -> Column:
        ship_package()
        kind, path, bos = self.kind, self.path, self.bos_id

        @F.pandas_udf(INT_ARRAY)
        def _encode(s: pd.Series) -> pd.Series:
            mask = s.notna()
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            if mask.any():
                ids = encode_texts(kind, path, s[mask].astype(str).tolist())
                if bos is not None:
                    ids = [[bos] + x for x in ids]
                if cutoff is not None:
                    ids = [x[:cutoff] for x in ids]
                out[mask] = pd.Series(ids, index=s[mask].index, dtype=object)
            return out

        return _encode(text)

    def decode(self, ids: Column, skip_special: bool = True) -> Column:
        ship_package()
        kind, path = self.kind, self.path
        skip = set(self.special_ids) if skip_special else set()

        @F.pandas_udf(T.StringType())
        def _decode(s: pd.Series) -> pd.Series:
            mask = s.notna()
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            if mask.any():
                out[mask] = decode_ids(kind, path, s[mask].tolist(), skip)
            return out

        return _decode(ids)


def vocab_encoder(name: str) -> Vocab:
    """Encoders for the vocabulary files of the installed ``public_tokenizers`` package."""
    import public_tokenizers as P

    if name == "byte_bpe_50k":
        return Vocab(name=name, kind="tokenizers", path=P.path("byte_bpe_50k.json"),
                     eos_id=50256, pad_id=None)
    if name == "byte_bpe_50k_tiktoken":
        return Vocab(name=name, kind="tiktoken", path=P.path("byte_bpe_50k.tiktoken"),
                     eos_id=50256, pad_id=None)
    if name == "byte_bpe_multi_50k":
        return Vocab(name=name, kind="tiktoken", path=P.path("byte_bpe_multi_50k.tiktoken"),
                     eos_id=50256, pad_id=None)
    if name == "word_bpe_49k":
        return Vocab(name=name, kind="tokenizers", path=P.path("word_bpe_49k.json"),
                     eos_id=49407, pad_id=None)
    if name == "piece_bpe_32k":
        return Vocab(name=name, kind="sentencepiece", path=P.path("piece_bpe_32k.model"),
                     eos_id=2, pad_id=0, bos_id=1)
    raise ValueError(f"unknown vocabulary {name!r}")


def get_encoder(name: str = "codepoint") -> Encoder:
    if name in ("codepoint", "", None):
        return CodePoints()
    return vocab_encoder(name)


# --- token-array expressions -------------------------------------------------

def append_eos(ids: Column, eos_id: int, cutoff: int | None) -> Column:
    """Append end-of-text unless the last id already is it, or the row is full."""
    last_differs = F.coalesce(F.try_element_at(ids, F.lit(-1)) != F.lit(eos_id), F.lit(True))
    cond = last_differs
    if cutoff is not None:
        cond = cond & (F.size(ids) < F.lit(cutoff))
    return F.when(cond, F.concat(ids, F.array(F.lit(eos_id)))).otherwise(ids)


def ones_like(ids: Column) -> Column:
    """Attention mask of ones."""
    return F.array_repeat(F.lit(1), F.size(ids))


def mask_prefix(labels: Column, n: Column) -> Column:
    """T4: first ``n`` labels become -100; if ``n`` exceeds the length the
    result grows to ``n`` (list semantics of ``[-100]*n + labels[n:]``)."""
    rest = F.slice(labels, n + 1, F.greatest(F.size(labels) - n, F.lit(0)))
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), n), rest)


def cut_prompt(out_ids: Column, prompt_len: Column) -> Column:
    """The generated part of an output id sequence."""
    n = F.size(out_ids) - prompt_len
    return F.when(n > 0, F.slice(out_ids, prompt_len + 1, n)).otherwise(empty_ids())


def ids_text(ids: Column) -> Column:
    """Ids as one space-separated string (stable form for hashing/compare)."""
    return F.array_join(ids.cast("array<string>"), " ")


# --- SQL (DuckDB) counterparts used by oracle queries -------------------------

def codepoints_sql(text: str, cutoff: int | None = None) -> str:
    t = text if cutoff is None else f"substr({text}, 1, {cutoff})"
    return (f"(case when length({t}) = 0 then []::integer[] else "
            f"list_transform(string_split({t}, ''), lambda c: unicode(c)::integer) end)")
