"""Encoding of documents as they arrive: a stream of texts to a growing table of vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.encode import Encoder, encode


def encode_stream(docs: DataFrame, key: str, text: str, make: Callable[[], Encoder], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that appends (id, embedding) of each new row of the stream ``docs`` to the table at ``path``.

    Stateless: a row's vector doesn't depend on others. What was read and written is kept in ``checkpoint``, so a restarted
    query goes on behind the last whole batch and writes no row twice.
    """
    writer = encode(docs, key, text, make).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
