"""Tokenized training records (T5, T6), encode-only (T7), decode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.templates import Template, render
from ..functions.tokens import CodePoints, Encoder, append_eos, mask_prefix, ones_like
from ..session import ship_package


def tokenize_records(df: DataFrame, template: Template, encoder: Encoder | None = None,
                     cutoff_len: int | None = None, train_on_inputs: bool = True,
                     add_eos: bool = True, truncation: bool = True,
                     instruction: str = "instruction", input: str = "input",
                     output: str = "output", keep: list[str] | None = None) -> DataFrame:
    """Render each record with ``template``, encode it, and build
    ``input_ids``, ``attention_mask``, ``labels``.

    * truncation keeps the first ``cutoff_len`` ids (a leading bos counts);
    * end-of-text is appended unless the last id already is it or the row
      already holds ``cutoff_len`` ids;
    * with ``train_on_inputs=False`` the first ``len(encode(user prompt))``
      labels become -100, where the user prompt is the rendering without the
      output, encoded with the same truncation and without end-of-text.

    The native encoder gets the user-prompt length from the string length
    (the user prompt is a prefix of the full prompt and one id is one code
    point), so nothing is encoded twice.
    """
    enc = encoder or CodePoints()
    if not enc.native:
        ship_package(df.sparkSession)
    if add_eos and enc.eos_id is None:
        raise ValueError(f"encoder {enc.name} has no end-of-text id")
    keep = list(keep if keep is not None else [c for c in ("id",) if c in df.columns])
    trunc = cutoff_len if truncation else None
    ins, inp, out = F.col(instruction), F.col(input), F.col(output)
    if enc.native and trunc is not None:
        # one id per character: the first `trunc` characters of the prompt only
        # ever use the first `trunc` characters of each value, so long
        # documents are cut before rendering instead of copied whole
        ins, inp, out = (F.substring(c.cast("string"), 1, max(trunc, 1)) for c in (ins, inp, out))
    full = render(template, ins, inp, out)
    cols = [F.col(c) for c in keep]
    staged = df.select(*cols, enc.encode(full, trunc).alias("_ids"),
                       *([] if train_on_inputs else
                         [enc.count(render(template, ins, inp), trunc).alias("_user_len")]))
    ids = F.col("_ids")
    if add_eos:
        ids = append_eos(ids, enc.eos_id, cutoff_len)
    staged = staged.withColumn("input_ids", ids)
    labels = F.col("input_ids")
    if not train_on_inputs:
        labels = mask_prefix(labels, F.col("_user_len"))
    return staged.select(*keep, "input_ids",
                         ones_like(F.col("input_ids")).alias("attention_mask"),
                         labels.alias("labels"))


def cut_fields(df: DataFrame, encoder: Encoder, cutoff_len: int | None,
               fields: tuple[str, ...] = ("instruction", "input", "output")) -> DataFrame:
    """What truncated records can use of their fields, for a shuffle before the encoding:
    with one id per character, the first ``cutoff_len`` characters of each field. Other
    encoders need whole texts and get them."""
    if not encoder.native or cutoff_len is None:
        return df
    return df.withColumns({f: F.substring(F.col(f).cast("string"), 1, max(cutoff_len, 1)) for f in fields})


def encode_column(df: DataFrame, text: str, encoder: Encoder | None = None,
                  out: str = "input_ids", cutoff: int | None = None) -> DataFrame:
    """Encode one text column (no end-of-text, no mask)."""
    enc = encoder or CodePoints()
    if not enc.native:
        ship_package(df.sparkSession)
    return df.withColumn(out, enc.encode(F.col(text), cutoff))


def decode_column(df: DataFrame, ids: str, encoder: Encoder | None = None,
                  out: str = "text", skip_special: bool = True) -> DataFrame:
    """Ids back to text, special ids skipped."""
    enc = encoder or CodePoints()
    if not enc.native:
        ship_package(df.sparkSession)
    return df.withColumn(out, enc.decode(F.col(ids), skip_special))
