"""Open interchange formats: TREC runs and judgements, JSON maps, NumPy matrices with id lists."""

from __future__ import annotations

import codecs
import json
import zipfile
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a task reads of a matrix, and that are read at once of a JSON file.
RANGE_BYTES, CHUNK_BYTES = 64_000_000, 1_000_000


def _open(path: str) -> BinaryIO:
    """A file of any file system that Arrow knows by the path's scheme (local without one), open for reading at any place."""
    system, own = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(own)


def json_entries(path: str, chunk: int = CHUNK_BYTES) -> Iterator[Any]:
    """The elements of a JSON list, or the (key, value)s of a JSON object, one by one; only an element's text and a chunk are held."""
    decoder, decode = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8")()
    with _open(path) as file:
        text, at, ended = "", 0, False

        def more() -> bool:
            nonlocal text, at, ended
            if ended:
                return False
            read = file.read(chunk)
            ended = not read
            text, at = text[at:] + decode.decode(read, final=ended), 0
            return True

        def sign() -> str:
            """The next character that is no space."""
            nonlocal at
            while True:
                while at < len(text) and text[at] in " \t\r\n":
                    at += 1
                if at < len(text):
                    return text[at]
                if not more():
                    raise ValueError(f"{path} ends too early")

        def value() -> Any:
            """The next value; more is read as long as it may go on."""
            nonlocal at
            sign()
            while True:
                try:
                    out, stop = decoder.raw_decode(text, at)
                    if stop < len(text) or ended:
                        at = stop
                        return out
                except ValueError:
                    if ended:
                        raise
                more()

        opening = sign()
        if opening not in "[{":
            raise ValueError(f"{path} is no JSON list or object")
        at += 1
        if sign() in "]}":
            return
        while True:
            entry = value()
            if opening == "{":
                if sign() != ":":
                    raise ValueError(f"{path}: a key without a value")
                at += 1
                entry = (entry, value())
            yield entry
            if sign() in "]}":
                return
            at += 1


def _stream(spark: SparkSession, path: str, rows: Callable[[Any], list[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows of each entry of a JSON file, which one task reads as a stream, since it can't be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)

        for given in batches:
            for name in given.column("path").to_pylist():
                held: list[tuple] = []
                for entry in json_entries(name):
                    held += rows(entry)
                    if len(held) >= 10_000:
                        yield batch(held)
                        held = []
                yield batch(held)

    return spark.createDataFrame([(path,)], "path string").coalesce(1).mapInArrow(run, ddl)


def _fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f"))
    return lines.where(F.size("f") >= least)


def read_trec_run(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """(model, query_id, doc_id, score, rank) of lines ``query Q0 doc rank score tag``; the tag is the model unless one is given.
    Shorter lines are skipped; numbers that can't be read are null."""
    f = _fields(spark, path, 6)
    tag = F.lit(model) if model else F.col("f")[5]
    return f.select(tag.alias("model"), F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id"), F.expr("try_cast(f[4] AS double)").alias("score"), F.expr("try_cast(f[3] AS int)").alias("rank"))


def write_trec_run(run: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes a run as TREC lines, one text file for each task. Ids must not have white space."""
    line = F.concat_ws(" ", "query_id", F.lit("Q0"), "doc_id", F.col("rank").cast("string"), F.col("score").cast("string"), F.regexp_replace("model", r"\s+", "_"))
    run.select(line.alias("value")).write.mode(mode).text(path)


def read_trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, relevance) of lines ``query iteration doc relevance``."""
    f = _fields(spark, path, 4)
    return f.select(F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id"), F.expr("try_cast(f[3] AS int)").alias("relevance"))


def read_json_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, relevance) of a JSON object {query: {document: relevance}}."""
    schema = pa.schema([("query_id", pa.string()), ("doc_id", pa.string()), ("relevance", pa.int32())])
    return _stream(spark, path, lambda e: [(e[0], d, r) for d, r in (e[1] or {}).items()], schema, "query_id string, doc_id string, relevance int")


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of a JSON object {query: text}."""
    return _stream(spark, path, lambda e: [e], pa.schema([("query_id", pa.string()), ("text", pa.string())]), "query_id string, text string")


def read_json_run(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(model, query_id, doc_id, score) of a JSON object {query: {document: score}}."""
    schema = pa.schema([("model", pa.string()), ("query_id", pa.string()), ("doc_id", pa.string()), ("score", pa.float64())])
    return _stream(spark, path, lambda e: [(model, e[0], d, s) for d, s in (e[1] or {}).items()], schema, "model string, query_id string, doc_id string, score double")


def read_ids(path: str, low: int = 0, high: int | None = None) -> list[str]:
    """The ids at the places ``low`` to ``high`` of a list in a JSON file; the others are passed over."""
    out = []
    for n, x in enumerate(json_entries(path)):
        if high is not None and n >= high:
            break
        if n >= low:
            out.append(str(x))
    return out


def _ranges(spark: SparkSession, rows: int, size: int, parts: int | None) -> DataFrame:
    """(low, high) of ranges of rows, a task for each: ``parts`` of them, or as many as ``size`` bytes in all need."""
    parts = max(1, min(parts or -(-size // RANGE_BYTES), rows or 1))
    edge = F.floor(F.col("id") * F.lit(rows) / F.lit(parts)), F.floor((F.col("id") + 1) * F.lit(rows) / F.lit(parts))
    return spark.range(0, parts, 1, parts).select(edge[0].alias("low"), edge[1].alias("high"))


def _header(file: BinaryIO) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and first byte of an array file; arrays in column order can't be read by rows."""
    version = np.lib.format.read_magic(file)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if by_column and len(shape) > 1:
        raise ValueError("the matrix is stored by columns")
    return shape, kind, file.tell()


def _slice(file: BinaryIO, low: int, high: int) -> np.ndarray:
    """Rows ``low`` to ``high`` of an array file; only their bytes are kept."""
    shape, kind, first = _header(file)
    high = min(high, shape[0])
    width = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
    file.seek(first + low * width)
    return np.frombuffer(file.read((high - low) * width), kind).reshape(high - low, *shape[1:])


def read_npy(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    """(id, embedding) of ``ids.json`` and ``merged.npy`` in a folder that all workers can read.

    Only the header is read in the driver; each task reads the bytes of its own range of rows, and keeps the ids of these.
    """
    rows, width = npy_shape(f"{folder}/merged.npy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
                with _open(f"{folder}/merged.npy") as file:
                    matrix = _slice(file, low, high).astype(np.float32).reshape(high - low, -1)
                ids = read_ids(f"{folder}/ids.json", low, high if high < rows else None)
                if len(ids) != len(matrix):
                    raise ValueError("ids and vectors differ in number")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, max(1, width)), pa.int32()), pa.array(matrix.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), vectors], names=["id", "embedding"])

    return _ranges(spark, rows, 4 * rows * width, parts).mapInArrow(run, "id string, embedding array<float>")


def npy_shape(path: str) -> tuple[int, int]:
    """Rows and columns of a matrix file, from its header."""
    with _open(path) as file:
        shape = _header(file)[0]
    return int(shape[0]), int(shape[1]) if len(shape) > 1 else 1


def read_csr(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    """(id, term, weight) of ``ids.json`` and a compressed-row matrix ``merged.npz`` (data, indices, indptr, shape).

    Each task keeps its own range of rows only; what is before it in a compressed member is read and dropped.
    """
    path = f"{folder}/merged.npz"

    def member(name: str, low: int, high: int) -> np.ndarray:
        with _open(path) as file, zipfile.ZipFile(file) as archive, archive.open(f"{name}.npy") as own:
            return _slice(own, low, high)

    rows = int(member("shape", 0, 1)[0])
    with _open(path) as file:
        size = file.size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
                at = member("indptr", low, high + 1)
                if high == low:
                    continue
                terms, weights = member("indices", int(at[0]), int(at[-1])), member("data", int(at[0]), int(at[-1]))
                owner = np.repeat(np.arange(high - low), np.diff(at))
                ids = pa.array(read_ids(f"{folder}/ids.json", low, high), pa.string())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array([str(t) for t in terms], pa.string()), pa.array(weights.astype(np.float64))], names=["id", "term", "weight"])

    return _ranges(spark, rows, size, parts).mapInArrow(run, "id string, term string, weight double")
