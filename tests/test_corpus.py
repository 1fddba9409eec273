from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import naming, text, vector
from rankloom.operators import corpus, encode, qrels, stats
from rankloom.schema import FusionStrategy

TEXTS = [("T", "a b", "T. a b", 3), (None, " a  b\n", " a  b\n", 2), ("", "x", "x", 1), (None, None, "", 0), ("T", None, "T.", 1), (None, "a b", "a b", 2), ("  T", "x　", "T. x", 2), (None, "a\x1cb\x85c", "a\x1cb\x85c", 3)]


def test_full_text_and_words(spark):
    df = spark.createDataFrame([(str(i), t, x) for i, (t, x, _, _) in enumerate(TEXTS)], "docid string, title string, text string")
    rows = {int(r["docid"]): r for r in corpus.format_and_count(df).collect()}
    for i, (title, body, full, count) in enumerate(TEXTS):
        assert rows[i]["full_text"] == full and rows[i]["word_count"] == count == len(full.split())
        assert full == (f"{title}. {body or ''}".strip() if title else body or "")


def test_missing_columns(spark):
    df = spark.createDataFrame([(1,), (2,)], "docid int")
    assert [tuple(r) for r in corpus.format_and_count(df).select("docid", "full_text", "word_count").orderBy("docid").collect()] == [("1", "", 0), ("2", "", 0)]
    with pytest.raises(ValueError):
        corpus.normalize_corpus(df.withColumnRenamed("docid", "x"))


def test_filter_is_inclusive(spark):
    df = spark.createDataFrame([("a", "x " * 5), ("b", "x " * 6), ("c", "x " * 7)], "docid string, text string")
    counted = corpus.format_and_count(df)
    assert {r["docid"] for r in corpus.filter_by_words(counted, 6).collect()} == {"a", "b"}
    assert corpus.filter_by_words(counted, None).count() == 3
    assert tuple(corpus.kept_report(counted, 6).first()) == (3, 2, pytest.approx(66.6667))
    assert tuple(corpus.kept_report(counted.limit(0), 6).first()) == (0, 0, None)


def test_qrels_and_pruning(spark):
    rows = [(1, "d1", "uno", "2024-01-01"), (1, "d1", "UNO", "2024-01-02"), (1, "d2", None, "2024-01-03"), (2, "d3", "dos", None), (None, "d1", "x", None), (3, None, "tres", None)]
    judged = spark.createDataFrame(rows, "id long, docid string, query string, at string")
    built = qrels.build_qrels(judged)
    assert {tuple(r) for r in built.collect()} == {("1", "d1", 1), ("1", "d2", 1), ("2", "d3", 1)}
    texts = qrels.query_map(judged, "id", "query", "at")
    assert {tuple(r) for r in texts.collect()} == {("1", "UNO"), ("2", "dos"), ("3", "tres")}
    kept = spark.createDataFrame([("d1",), ("d1",)], "doc_id string")
    pruned = qrels.prune_qrels(built, kept)
    assert {tuple(r) for r in pruned.collect()} == {("1", "d1", 1)}
    assert qrels.prune_qrels(pruned, kept).exceptAll(pruned).count() == 0
    assert [r["query_id"] for r in qrels.prune_queries(texts, pruned).collect()] == ["1"]
    assert tuple(qrels.prune_report(built, pruned).first()) == (2, 3, 1, 1)
    assert qrels.build_qrels(judged.limit(0)).count() == 0


def test_encoding_plan(spark):
    words = [341, 342, 1366, 30000]
    df = spark.createDataFrame([(w,) for w in words], "w int").select(encode.planned_tokens(F.col("w")).alias("t"))
    long = df.select("t", encode.sequence_length(F.col("t"), 32768).alias("s")).select("t", "s", encode.batch_size(F.col("s"), 1).alias("b"))
    assert [tuple(r) for r in long.collect()] == [(511, 512, 128), (513, 2048, 32), (2049, 8192, 8), (45000, 32768, 2)]
    short = df.select("t", encode.sequence_length(F.col("t"), 512).alias("s")).select("s", encode.batch_size(F.col("s"), 1).alias("b"))
    assert [tuple(r) for r in short.collect()] == [(512, 128)] * 4


def test_chunks_are_in_order_of_length(spark):
    docs = spark.createDataFrame([(f"d{i}", (i * 37) % 50 if i % 3 else 7) for i in range(500)], "doc_id string, word_count int")
    rows = encode.assign_chunks(docs, 64).collect()
    by_chunk: dict[int, list[int]] = {}
    for r in rows:
        by_chunk.setdefault(r["chunk"], []).append(r["word_count"])
    assert [len(by_chunk[c]) for c in sorted(by_chunk)] == [64] * 7 + [52]
    assert all(max(by_chunk[c]) <= min(by_chunk[c + 1]) for c in range(7))
    plan = encode.chunk_plan(docs, 64, 32768).collect()
    assert {r["chunk"]: r["max_words"] for r in plan} == {c: max(v) for c, v in by_chunk.items()}


def test_encoder(spark):
    docs = spark.createDataFrame([("a", "uno dos", 2), ("b", None, 0), ("c", "", 0), (None, "x", 1), ("d", "dos uno", 2)], "doc_id string, full_text string, word_count int")
    rows = {r["id"]: r["embedding"] for r in encode.encode_planned(docs, encode.HashingEncoder, 512, 3).collect()}
    assert set(rows) == {"a", "b", "c", "d"} and rows["a"] == rows["d"]
    assert sum(x * x for x in rows["a"]) == pytest.approx(1.0) and not any(rows["b"])
    assert encode.encode(docs.limit(0), "doc_id", "full_text", encode.HashingEncoder).count() == 0


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [1.0], None)], "a array<float>, b array<float>, c array<float>, d array<float>").select(
        vector.dot(F.col("a"), F.col("b")).alias("dot"), vector.norm(F.col("a")).alias("norm"), vector.cosine(F.col("a"), F.col("b")).alias("cos"),
        vector.dot(F.col("a"), F.col("c")).alias("short"), vector.sound(F.col("d")).alias("null"), vector.sound(F.col("a"), 2).alias("two"), vector.sound(F.col("a"), 3).alias("three"),
    ).first()
    assert tuple(row) == (24.0, 5.0, pytest.approx(0.96), None, False, True, False)


def test_maxsim_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    q, d = rng.normal(size=(3, 8)), rng.normal(size=(5, 8))
    df = spark.createDataFrame([(q.tolist(), d.tolist())], "q array<array<double>>, d array<array<double>>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    assert df.select(vector.maxsim(F.col("q"), F.col("d"))).first()[0] == pytest.approx((unit(q) @ unit(d).T).max(1).sum())


def test_statistics(spark):
    import numpy as np

    values = [1, 2, 2, 3, 50, 700]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v int")
    row = stats.summary(df, "v").first()
    assert (row["n"], row["least"], row["greatest"], row["median"]) == (6, 1, 700, 2.5)
    assert row["std"] == pytest.approx(np.std(values), abs=1e-6) and row["p95"] == pytest.approx(np.percentile(values, 95))
    counts, _ = np.histogram(values, bins=np.logspace(0, np.log10(701), 80))
    assert {r["bin"]: r["n"] for r in stats.log_histogram(df, "v").collect()} == {i + 1: n for i, n in enumerate(counts.tolist()) if n}
    assert {(r["value"], r["n"], r["percent"]) for r in stats.histogram(df, "v").collect()} >= {(2, 2, 33.3333)}
    assert stats.histogram(df.limit(0), "v").count() == 0
    assert stats.random_row(df, "v", 3).collect() == stats.random_row(df, "v", 3).collect()


def test_names(spark):
    df = spark.createDataFrame([("a/b", None), ("c", 400)], "name string, words int")
    key = naming.cache_key_of(F.lit("full"), F.lit("1.2"), F.lit(64), F.lit(256), F.col("words"))
    rows = df.select(naming.model_slug_of(F.col("name")), naming.short_name_of(F.col("name")), key).collect()
    assert [tuple(r) for r in rows] == [("a__b", "b", "full_v1.2_q64_d256_nofilter"), ("c", "c", "full_v1.2_q64_d256_filt400w")]
    assert FusionStrategy("x", {"phi": 0.95, "k": 60}).label == "phi=0.95,k=60" and FusionStrategy("x").label == ""


def test_analyzer(spark):
    df = spark.createDataFrame([("Los árboles y las canciones de París",), (None,), ("",)], "t string")
    rows = df.select(text.analyze_es(F.col("t")).alias("x"), text.snippet(F.col("t"), 3).alias("s")).collect()
    assert [r["x"] for r in rows] == [["arbol", "cancion", "paris"], [], []]
    assert [r["s"] for r in rows] == ["Los...", None, ""]


class Watching(encode.HashingEncoder):
    """Tells its calls in the vectors."""

    def __init__(self) -> None:
        super().__init__(4)

    def encode(self, texts, batch=128, length=None, is_query=False):
        assert len(texts) <= batch
        return np.array([[len(texts), batch, length or 0, float(is_query)]] * len(texts), np.float32)


def test_the_encoder_is_called_by_the_plan(spark):
    sizes = [5] * 300 + [400] * 200 + [2000] * 20
    docs = spark.createDataFrame([(f"d{i:03d}", "x", n) for i, n in enumerate(sizes)], "doc_id string, full_text string, word_count int")
    plan = {r["chunk"]: (r["batch"], r["sequence"]) for r in encode.chunk_plan(docs, 100, 8192).collect()}
    assert plan == {0: (128, 512), 1: (128, 512), 2: (128, 512), 3: (32, 2048), 4: (32, 2048), 5: (8, 8192)}
    rows = {r["id"]: r["embedding"] for r in encode.encode_planned(docs, Watching, 8192, 100, normalize=False, partitions=3).collect()}
    assert len(rows) == 520
    for i, n in enumerate(sizes):
        called, batch, length, query = rows[f"d{i:03d}"]
        assert (batch, length) == ((128, 512) if n == 5 else (32, 2048) if n == 400 else (8, 8192)) and called <= batch and not query
    bands = encode.planned(docs, 100, 8192, partitions=3).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.countDistinct("sequence").alias("n")).collect()
    assert all(r["n"] <= 2 for r in bands)  # a task has one band, or at the edge of its range two
    asked = encode.encode(docs, "doc_id", "full_text", Watching, normalize=False, is_query=True, length=64, batch=7).first()["embedding"]
    assert asked[1:] == [7.0, 64.0, 1.0]


def test_sparse_encoder(spark):
    docs = spark.createDataFrame([("a", "Sol sol luna"), ("b", None), ("c", ""), (None, "x")], "id string, text string")
    rows = {(r["id"], r["term"]): r["weight"] for r in encode.encode_sparse(docs, "id", "text", encode.TermEncoder, "sol ").collect()}
    assert rows == {("a", "sol"): math.log(4), ("a", "luna"): math.log(2), ("b", "sol"): math.log(2), ("c", "sol"): math.log(2)}
    assert {r["term"] for r in encode.encode_sparse(docs, "id", "text", encode.TermEncoder, length=3).collect()} == {"sol"}
    assert encode.encode_sparse(docs.limit(0), "id", "text", encode.TermEncoder).count() == 0


def test_split_or_the_first(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "a")], "id int, split string")
    ids = lambda name: sorted(r["id"] for r in qrels.split_or_first(df, name).collect())
    assert ids("b") == [1] and ids("none") == [2, 4]
    assert qrels.split_or_first(df.limit(0), "b").count() == 0
