"""Encoding plans and encoders.

Models are injected: an encoder is any object with ``encode(texts, batch, length, is_query) -> matrix``, a sparse one has
``encode_sparse`` instead; small deterministic ones are built in. The plan sizes sequences and batches by the longest text of
a chunk, as models run best on texts of like length, and ``encode_planned`` obeys it: chunks of one band go to one task, which
hands the encoder the batch and the sequence length of each chunk.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import query_prompt

# Sequence lengths that a chunk is padded to, the batch size for each, and tokens for a word.
BANDS = ((512, 128), (2048, 32), (8192, 8), (16384, 4), (32768, 2))
TOKENS_PER_WORD = 1.5


class Encoder(Protocol):
    """What encodes texts to a float matrix, a row for each text: so many at once, cut at so many tokens (None: as the model has
    it), as queries or as documents."""

    def encode(self, texts: list[str], batch: int, length: int | None, is_query: bool) -> np.ndarray: ...


class SparseEncoder(Protocol):
    """What encodes texts to weighted terms, a dictionary for each text."""

    def encode_sparse(self, texts: list[str], batch: int, length: int | None, is_query: bool) -> list[dict[str, float]]: ...


@dataclass(frozen=True)
class EncoderSpec:
    """An encoder by name: how long its inputs may be, and what is put before queries and documents."""

    name: str
    max_query_length: int
    max_doc_length: int
    query_prompt: str = ""
    doc_prompt: str = ""


# The dense encoders that runs are made with. Models themselves are not bundled.
ENCODERS = {
    "e5-large": EncoderSpec("multilingual-e5-large-instruct", 512, 512, query_prompt="Instruct: {task}\nQuery: "),
    "bge-m3": EncoderSpec("bge-m3", 8192, 8192),
    "qwen3-0.6b": EncoderSpec("qwen3-embedding-0.6b", 32768, 32768, query_prompt="query"),
    "harrier": EncoderSpec("harrier-oss-v1-0.6b", 32768, 32768, query_prompt="web_search_query"),
    "jina-v5-small": EncoderSpec("jina-embeddings-v5-text-small-retrieval", 32768, 32768, query_prompt="query", doc_prompt="document"),
}


def _cut_words(text: str, length: int | None) -> list[str]:
    """Lower-case words, as many as a sequence of so many tokens takes."""
    own = re.findall(r"[^\W_]+", text.lower())
    return own if length is None else own[: max(1, int(length / TOKENS_PER_WORD))]


class HashingEncoder:
    """Signed feature hashing of lower-case words: deterministic, without a model."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: list[str], batch: int = 128, length: int | None = None, is_query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in enumerate(texts):
            for word in _cut_words(text, length):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[row, h % self.dim] += 1.0 if h >> 63 else -1.0
        return out


class TermEncoder:
    """Sparse vectors without a model: ln(1 + frequency) of each lower-case word."""

    def encode_sparse(self, texts: list[str], batch: int = 128, length: int | None = None, is_query: bool = False) -> list[dict[str, float]]:
        return [{w: math.log1p(n) for w, n in Counter(_cut_words(t, length)).items()} for t in texts]


def planned_tokens(words: Column) -> Column:
    """Tokens expected of a text of so many words."""
    return F.floor(words * F.lit(TOKENS_PER_WORD)).cast("int")


def sequence_length(expected: Column, model_max: int) -> Column:
    """The band that the tokens fit, at most what the model takes."""
    out = F.lit(model_max)
    for band, _ in reversed(BANDS):
        out = F.when(expected <= band, min(band, model_max)).otherwise(out)
    return out.cast("int")


def batch_size(length: Column, fallback: int) -> Column:
    """Texts in a batch of a sequence length."""
    out = F.lit(fallback)
    for band, size in reversed(BANDS):
        out = F.when(length <= band, size).otherwise(out)
    return out.cast("int")


def chunk_plan(docs: DataFrame, chunk_size: int, model_max: int, fallback: int = 2, key: str = "doc_id", words: str = "word_count") -> DataFrame:
    """(chunk, docs, max_words, tokens, sequence, batch) of the documents in order of their length.

    Chunks are cut by place in that order. The places come from counts by length, which are few, so the table itself is not
    sorted in one task; documents of one length share chunks by the order of their keys' hashes.
    """
    chunks = assign_chunks(docs, chunk_size, key, words)
    sized = chunks.groupBy("chunk").agg(F.count("*").alias("docs"), F.max(words).alias("max_words"))
    planned = sized.withColumn("tokens", planned_tokens(F.col("max_words"))).withColumn("sequence", sequence_length(F.col("tokens"), model_max))
    return planned.withColumn("batch", batch_size(F.col("sequence"), fallback))


def assign_chunks(docs: DataFrame, chunk_size: int, key: str = "doc_id", words: str = "word_count") -> DataFrame:
    """``docs`` with ``chunk``: the place in order of length, over the size of a chunk.

    A length with very many documents is ordered in slices of its own, by hash; the offset of a slice is a sum over counts.
    """
    slices = 64
    sliced = docs.withColumn("__slice", F.pmod(F.shiftright(F.xxhash64(key), 32), F.lit(slices)))
    counts = sliced.groupBy(words, "__slice").count()
    before = Window.orderBy(words, "__slice").rowsBetween(Window.unboundedPreceding, -1)  # 64 rows for each length
    offsets = counts.withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy(words, "__slice").orderBy(F.xxhash64(key), key))
    placed = sliced.withColumn("__place", place).join(offsets, [words, "__slice"])
    return placed.withColumn("chunk", F.floor((F.col("__before") + F.col("__place") - 1) / chunk_size)).drop("__slice", "__place", "__before")


def _vectors(matrix: np.ndarray, normalize: bool) -> pa.Array:
    matrix = np.asarray(matrix, np.float32)
    if normalize:
        size = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, max(1, matrix.shape[1])), pa.int32()), pa.array(matrix.ravel()))


def _texts(df: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), *more)


def _calls(rows: pa.RecordBatch, batch: int, length: int | None) -> Iterator[tuple[pa.RecordBatch, int, int | None]]:
    """Pieces of a batch of rows for one call each, with their batch and length: those of a chunk's plan, if rows have one."""
    at = 0
    planned = "sequence" in rows.schema.names
    while at < rows.num_rows:
        stop, size, cut = rows.num_rows, batch, length
        if planned:
            chunk = rows.column("chunk").to_numpy()
            stop = at + int(np.argmax(np.append(chunk[at:] != chunk[at], True)))
            size, cut = rows.column("batch")[at].as_py(), rows.column("sequence")[at].as_py()
        for start in range(at, stop, size):
            yield rows.slice(start, min(size, stop - start)), size, cut
        at = stop


def encode(df: DataFrame, key: str, text: str, make: Callable[[], Encoder], prompt: str = "", batch: int = 128, normalize: bool = True, is_query: bool = False, length: int | None = None) -> DataFrame:
    """(id, embedding): the encoder's vectors, of unit length if ``normalize``. Null texts count as empty; null keys are dropped.

    The encoder is made once for each task and sees batches of ``batch`` texts; no vector leaves the task but as a row.
    """
    return _texts(df, key, text).mapInArrow(_encoded(make, prompt, batch, normalize, is_query, length), "id string, embedding array<float>")


def _encoded(make: Callable[[], Encoder], prompt: str, batch: int, normalize: bool, is_query: bool, length: int | None):  # noqa: ANN202
    schema = pa.schema([("id", pa.string()), ("embedding", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for rows in batches:
            for part, size, cut in _calls(rows, batch, length):
                matrix = model.encode([prompt + (t or "") for t in part.column("text").to_pylist()], size, cut, is_query)
                yield pa.RecordBatch.from_arrays([part.column("id"), _vectors(matrix, normalize)], schema=schema)

    return run


def planned(docs: DataFrame, chunk_size: int, model_max: int, key: str = "doc_id", words: str = "word_count", partitions: int | None = None) -> DataFrame:
    """``docs`` with their chunk, sequence and batch, spread so that a task has chunks of one band or of neighbouring ones, in order."""
    plan = chunk_plan(docs, chunk_size, model_max, key=key, words=words).select("chunk", "sequence", "batch")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return assign_chunks(docs, chunk_size, key, words).join(plan, "chunk").repartitionByRange(n, "sequence", "chunk").sortWithinPartitions("sequence", "chunk", F.xxhash64(key))


def encode_planned(docs: DataFrame, make: Callable[[], Encoder], model_max: int, chunk_size: int = 10_000, key: str = "doc_id", text: str = "full_text", words: str = "word_count", prompt: str = "", normalize: bool = True, partitions: int | None = None) -> DataFrame:
    """``encode`` of documents by their plan: each chunk with the sequence length and the batch of its longest text."""
    rows = _texts(planned(docs, chunk_size, model_max, key, words, partitions), key, text, F.col("chunk"), F.col("sequence"), F.col("batch"))
    return rows.mapInArrow(_encoded(make, prompt, 128, normalize, False, None), "id string, embedding array<float>")


def encode_sparse(df: DataFrame, key: str, text: str, make: Callable[[], SparseEncoder], prompt: str = "", batch: int = 128, is_query: bool = False, length: int | None = None) -> DataFrame:
    """(id, term, weight): the sparse encoder's weights that are not 0. Null texts count as empty; null keys are dropped."""
    schema = pa.schema([("id", pa.string()), ("term", pa.string()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for rows in batches:
            for part, size, cut in _calls(rows, batch, length):
                found = model.encode_sparse([prompt + (t or "") for t in part.column("text").to_pylist()], size, cut, is_query)
                flat = [(i, t, float(w)) for i, own in zip(part.column("id").to_pylist(), found, strict=True) for t, w in own.items() if w]
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in flat], f.type) for n, f in enumerate(schema)], schema=schema)

    return _texts(df, key, text).mapInArrow(run, "id string, term string, weight double")


def prompted(queries: DataFrame, task: str, text: str = "text") -> DataFrame:
    """Queries with ``prompt``: the instruction and the text."""
    return queries.withColumn("prompt", query_prompt(task, F.col(text)))
