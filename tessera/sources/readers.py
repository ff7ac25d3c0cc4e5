"""File sources.

Schemas are explicit, so reading never needs an inference pass over the data.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_arrays import read_json_arrays

INSTRUCTION_SCHEMA = T.StructType([
    T.StructField("instruction", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
])

QA_SCHEMA = T.StructType([T.StructField("question", T.StringType()),
                          T.StructField("answer", T.StringType())])

PAIR_SCHEMA = T.StructType([
    T.StructField("sentence_pair_id", T.StringType()),
    T.StructField("sentence1", T.StringType()),
    T.StructField("sentence2", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("split", T.StringType()),
])

NESTED_QA_SCHEMA = T.StructType([T.StructField("qas", T.ArrayType(QA_SCHEMA))])


def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs_and_path(spark, path)
    return bool(fs.exists(hpath))


def _data_files(spark: SparkSession, paths: list[str]) -> list:
    """Status of every data file of a list of files, folders and globs, each once."""
    found = {}
    for path in paths:
        fs, hpath = _fs_and_path(spark, path)
        matches = fs.globStatus(hpath)
        if not matches:
            raise FileNotFoundError(f"no file matches {path}")
        for st in matches:
            inside = fs.listStatus(st.getPath()) if st.isDirectory() else [st]
            for f in inside:
                if f.isFile() and (not st.isDirectory() or not f.getPath().getName().startswith((".", "_"))):
                    found[f.getPath().toString()] = f
    return list(found.values())


_BLANK = b"\xef\xbb\xbf \t\r\n"     # byte order mark and blanks


def _head(spark: SparkSession, status, enough) -> bytes:
    """The first bytes of a file, read until ``enough(bytes)`` or its end."""
    fs, hpath = _fs_and_path(spark, status.getPath().toString())
    stream, head = fs.open(hpath), b""
    try:
        while not enough(head):
            more = bytes(stream.readNBytes(65536))
            if not more:
                break
            head += more
    finally:
        stream.close()
    return head


def _first_char_of(spark: SparkSession, status) -> str:
    """First character that is not blank, however many blanks stand before it; an empty
    file has none."""
    stripped = _head(spark, status, lambda h: bool(h.lstrip(_BLANK))).lstrip(_BLANK)
    return chr(stripped[0]) if stripped else ""


def first_char(spark: SparkSession, path: str | list[str]) -> str:
    """First non-blank character of the first file of ``path`` that has one."""
    files = _data_files(spark, _as_list(path))
    return next((c for c in (_first_char_of(spark, f) for f in files) if c), "")


def _as_list(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def first_record_keys(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The keys of the first record of the first file that has one (no more of the file is
    read than that record and the block that it ends in)."""
    decoder, keys = json.JSONDecoder(), []

    def parse(head: bytes) -> bool:
        text = head.decode("utf-8", "ignore").lstrip("\ufeff \t\r\n").removeprefix("[").lstrip()
        try:
            record, _ = decoder.raw_decode(text)
        except ValueError:
            return False
        keys[:] = list(record) if isinstance(record, dict) else []
        return True

    for status in _data_files(spark, _as_list(path)):
        _head(spark, status, parse)
        if keys:
            break
    return keys


def read_json_records(spark: SparkSession, path: str | list[str],
                      schema: T.StructType = INSTRUCTION_SCHEMA) -> DataFrame:
    """JSON records, either one array of objects per file or JSON lines, under any suffix.
    ``path``: a file, a folder, a glob, or a list of these.

    The first non-blank character decides. Arrays are read in parallel also inside a file
    (``json_arrays``); JSON lines by Spark's reader. A malformed record fails the read
    (FAILFAST), and so does a mixture of arrays and JSON lines.
    """
    files = _data_files(spark, _as_list(path))
    kinds = {f.getPath().toString(): c for f in files if (c := _first_char_of(spark, f))}
    arrays = [f for f, c in kinds.items() if c == "["]
    if arrays and len(arrays) < len(kinds):
        raise ValueError(f"{path} mixes JSON arrays and JSON lines")
    if arrays:
        sizes = {f.getPath().toString(): f.getLen() for f in files}
        return read_json_arrays(spark, arrays, schema, [sizes[f] for f in arrays])
    return spark.read.schema(schema).option("mode", "FAILFAST").json([f.getPath().toString() for f in files])


def read_instructions(spark: SparkSession, path: str | list[str],
                      schema: T.StructType = INSTRUCTION_SCHEMA, id_col: str = "id") -> DataFrame:
    """Paths that end in ``.json``/``.jsonl`` (files, globs, or a list of them) are JSON;
    anything else is a dataset: a parquet path, or a table name of the catalog. Records that
    carry an ``id_col`` of their own (the first record tells) keep it, as text."""
    paths = _as_list(path)
    as_json = [p.endswith((".json", ".jsonl")) for p in paths]
    if all(as_json):
        if id_col not in schema.fieldNames() and id_col in first_record_keys(spark, paths):
            schema = T.StructType([T.StructField(id_col, T.StringType()), *schema.fields])
        return read_json_records(spark, paths, schema)
    if any(as_json):
        raise ValueError(f"{path} mixes JSON files and datasets")
    if all("/" in p or path_exists(spark, p) for p in paths):
        return spark.read.parquet(*paths)
    if len(paths) > 1:
        raise ValueError(f"{path}: several datasets must be parquet paths")
    return spark.table(paths[0])


def flatten_qa(nested: DataFrame, keep=("question", "answer")) -> DataFrame:
    """S3 + S4: one row per entry of ``qas``, keeping only the named keys
    (a key missing in an entry stays null)."""
    return nested.select(F.explode("qas").alias("qa")).select(*[F.col(f"qa.{k}").alias(k) for k in keep])


def read_nested_qa(spark: SparkSession, path: str) -> DataFrame:
    """S3: a JSON array of documents, each with a ``qas`` list, flattened."""
    return flatten_qa(read_json_records(spark, path, NESTED_QA_SCHEMA))


def input_key(df: DataFrame, version: str = "") -> str:
    """Fingerprint of what ``df`` is built from: its input files with their sizes and times, its
    schema, and the caller's ``version`` of the steps between."""
    files = []
    for name in sorted(df.inputFiles()):
        fs, hpath = _fs_and_path(df.sparkSession, name)
        st = fs.getFileStatus(hpath)
        files.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return hashlib.sha256(json.dumps([files, df.schema.json(), version]).encode()).hexdigest()


def _read_text(spark: SparkSession, path: str) -> str | None:
    from py4j.protocol import Py4JJavaError

    fs, hpath = _fs_and_path(spark, path)
    try:
        stream = fs.open(hpath)
    except Py4JJavaError:
        if fs.exists(hpath):
            raise
        return None
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> bool:
    """Write a small file; False if it is there already, or if another writer's content came
    through (HDFS creates files atomically; other stores let the last writer win)."""
    from py4j.protocol import Py4JJavaError

    fs, hpath = _fs_and_path(spark, path)
    try:
        stream = fs.create(hpath, overwrite)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or path_exists(spark, path):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return _read_text(spark, path) == text


def materialize_once(df: DataFrame, path: str, fmt: str = "json", schema=None, key: str | None = None,
                     lease: float = 3600.0, poll: float = 0.5) -> DataFrame:
    """Write ``df`` to ``path`` unless a finished result is already there, then
    read ``path`` back (a later run reuses the stored result).

    One builder works at a time: it holds ``<path>.claim``, which is created atomically, writes
    to a folder of its own and renames it when finished. Others wait for the result; a claim
    older than ``lease`` seconds is taken over (its builder died). With a ``key`` (see
    ``input_key``) a result that was stored under another key is built again.
    """
    spark, path = df.sparkSession, path.rstrip("/")

    def finished() -> bool:      # a failed write left no result
        return path_exists(spark, f"{path}/_SUCCESS") and (key is None or _read_text(spark, f"{path}.key") == key)

    while not finished():
        token = uuid.uuid4().hex
        if _create(spark, f"{path}.claim", token):
            try:
                if not finished():
                    _build(df, path, fmt, token, key)
            finally:
                _delete(spark, f"{path}.claim")
            break
        if (held := _modified(spark, f"{path}.claim")) is not None and time.time() - held > lease:
            _delete(spark, f"{path}.claim")
        time.sleep(poll)
    reader = spark.read.format(fmt)
    if schema is not None or fmt == "json":
        reader = reader.schema(schema if schema is not None else df.schema)
    return reader.load(path)


def _modified(spark: SparkSession, path: str) -> float | None:
    fs, hpath = _fs_and_path(spark, path)
    found = fs.globStatus(hpath)
    return found[0].getModificationTime() / 1000 if found else None


def _delete(spark: SparkSession, path: str) -> None:
    fs, hpath = _fs_and_path(spark, path)
    fs.delete(hpath, True)


def _build(df: DataFrame, path: str, fmt: str, token: str, key: str | None) -> None:
    spark, building = df.sparkSession, f"{path}.building-{token}"
    try:
        df.write.format(fmt).save(building)
        fs, final = _fs_and_path(spark, path)
        fs.delete(final, True)                     # an unfinished or outdated result
        if not fs.rename(_fs_and_path(spark, building)[1], final):
            raise OSError(f"cannot rename {building} to {path}")
        if key is not None:
            _create(spark, f"{path}.key", key, overwrite=True)
    except BaseException:
        _delete(spark, building)
        raise
