"""Length guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("fail", "drop", "flag")


def length_guard(df: DataFrame, max_length: int, ids: str = "input_ids", reserve: int = 0,
                 mode: str = "fail", flag_col: str = "fits") -> DataFrame:
    """Rows must satisfy ``size(ids) + reserve <= max_length``.

    ``fail`` stops the job at a long row (the evaluation jobs' behaviour; the
    message states the sum that was tested), ``drop`` removes long rows,
    ``flag`` adds a boolean column. F2 is ``reserve=0``; F3 is ``reserve`` =
    the number of new tokens to generate.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    need = F.size(ids) + F.lit(reserve)
    fits = need <= F.lit(max_length)
    if mode == "flag":
        return df.withColumn(flag_col, fits)
    if mode == "drop":
        return df.filter(fits)
    check = F.when(fits, F.lit(True)).otherwise(F.raise_error(F.concat(
        F.lit(f"a row needs more than {max_length} tokens: "), need.cast("string"))).cast("boolean"))
    return df.filter(check)
