"""Sinks (K1, K2)."""

from __future__ import annotations

import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K1: one JSON object per line, UTF-8, non-ASCII unescaped; null fields
    are left out (reading back with the schema restores them as null)."""
    df.write.mode(mode).option("encoding", "UTF-8").json(path)


def write_json_arrays(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Files that hold one JSON array of objects each, a file per task (what
    ``readers.read_json_records`` reads); null fields are left out."""
    def as_array(batches):
        started = False
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if rows:
                rows[0] = ("," if started else "[") + rows[0]
                started = True
                yield pa.RecordBatch.from_arrays([pa.array([rows[0], *("," + r for r in rows[1:])], pa.string())], ["value"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    ship_package(df.sparkSession)
    objects = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    objects.mapInArrow(as_array, "value string").write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K2: CSV with a header, quoted only where needed, quotes doubled,
    empty strings and nulls as empty fields (the pandas ``to_csv`` form)."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
     .option("emptyValue", "").option("nullValue", "").option("lineSep", "\n").csv(path))


def result_name(task: str, model_path: str, lora: bool,
                when: datetime.datetime | None = None) -> str:
    """Result file stem: task, minute stamp, model name, optional ``_lora``."""
    stamp = (when or datetime.datetime.now()).strftime("%Y%m%d_%H%M")
    name = f"{task}_{stamp}_{model_path.rstrip('/').split('/')[-1]}"
    return name + "_lora" if lora else name


def write_results(df: DataFrame, save_dir: str, task: str, model_path: str, lora: bool = False,
                  when: datetime.datetime | None = None) -> str:
    """K2 for the evaluation results: columns ``ground, generated``."""
    path = f"{save_dir.rstrip('/')}/{result_name(task, model_path, lora, when)}.csv"
    write_csv(df.select("ground", "generated"), path)
    return path
