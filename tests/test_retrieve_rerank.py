from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from rankloom.operators import rerank, retrieve


def vectors(spark, matrix, prefix):
    return spark.createDataFrame([(f"{prefix}{i:03d}", [float(x) for x in v]) for i, v in enumerate(matrix)], "id string, embedding array<float>")


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(2)
    d, q = rng.normal(size=(300, 8)).astype(np.float32), rng.normal(size=(20, 8)).astype(np.float32)
    scores = np.round(q.astype(float) @ d.astype(float).T, 6)
    expected = {(f"q{i:03d}", f"d{j:03d}", r) for i, row in enumerate(scores) for r, j in enumerate(np.lexsort((np.arange(300), -row))[:7], 1)}
    for block in (16_384, 50):
        got = retrieve.dense_topk(vectors(spark, q, "q"), vectors(spark, d, "d"), 7, block)
        assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got.collect()} == expected


def test_dense_dirt(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("n", None), ("e", []), ("z", [0.0, 0.0]), ("x", [float("nan"), 1.0]), (None, [1.0, 1.0])], "id string, embedding array<float>")
    got = retrieve.dense_topk(docs.where("id = 'a'"), docs, 100).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [("a", 1.0), ("b", -1.0)]
    assert retrieve.dense_topk(docs, docs.limit(0)).count() == 0


def test_sparse_positive_only(spark):
    docs = spark.createDataFrame([("d1", "x", 1.0), ("d1", "x", 1.0), ("d2", "x", -1.0), ("d3", "y", 1.0), ("d4", None, 1.0)], "id string, term string, weight double")
    asked = spark.createDataFrame([("q", "x", 2.0), ("q2", "zzz", 1.0)], "id string, term string, weight double")
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in retrieve.sparse_topk(asked, docs).collect()] == [("q", "d1", 4.0)]
    both = {(r["doc_id"], r["score"]) for r in retrieve.sparse_topk(asked, docs, positive=False).collect()}
    assert both == {("d1", 4.0), ("d2", -2.0)}
    assert retrieve.sparse_topk(asked.limit(0), docs).count() == 0
    maps = {r["id"]: r["entries"] for r in retrieve.csr_rows(docs).collect()}
    assert maps["d1"] == {"x": 2.0} and set(maps) == {"d1", "d2", "d3"}


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("d1", "sol sol luna"), ("d2", "luna"), ("d3", ""), ("d4", None)], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "SOL luna"), ("none", "¿?"), ("null", None)], "query_id string, text string")
    rows = {r["doc_id"]: r["score"] for r in retrieve.bm25_topk(asked, docs).collect()}
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf / (tf + 0.9 * (0.6 + 0.4 * dl / 1.0))
    assert rows == pytest.approx({"d1": idf(1) * part(2, 3) + idf(2) * part(1, 3), "d2": idf(2) * part(1, 1)}, abs=1e-6)


@pytest.fixture
def parts(spark):
    run = spark.createDataFrame([("q1", "d1", 1), ("q1", "d2", 2), ("q1", "gone", 3), ("q2", "d1", 1), ("q3", "d1", 1)], "query_id string, doc_id string, rank int")
    queries = spark.createDataFrame([("q1", "casa roja"), ("q2", None), ("q3", "")], "query_id string, text string")
    docs = spark.createDataFrame([("d1", "una casa"), ("d2", "casa roja")], "doc_id string, full_text string")
    return run, queries, docs


def test_candidates_and_scorers(spark, parts):
    pairs = rerank.candidates(*parts)
    assert {(r["query_id"], r["doc_id"], r["doc_text"]) for r in pairs.collect()} == {("q1", "d1", "una casa"), ("q1", "d2", "casa roja"), ("q1", "gone", ""), ("q3", "d1", "una casa")}
    for out in (rerank.pointwise(pairs), rerank.listwise(pairs)):
        rows = out.where("query_id = 'q1'").orderBy("rank").collect()
        assert [r["doc_id"] for r in rows] == ["d2", "d1", "gone"] and out.count() == 4
    own = rerank.pointwise(pairs, lambda q, d: pd.Series(-d.str.len().astype(float)))
    assert [r["doc_id"] for r in own.where("query_id = 'q1'").orderBy("rank").collect()] == ["gone", "d1", "d2"]
    kept = rerank.listwise(pairs, lambda query, texts: [float(-i) for i in range(len(texts))]).where("query_id = 'q1'").orderBy("rank").collect()
    assert [r["doc_id"] for r in kept] == ["d1", "d2", "gone"]


def test_pending_and_empty(spark, parts):
    run, queries, docs = parts
    assert {r["query_id"] for r in rerank.pending(run, run.where("query_id = 'q1'")).collect()} == {"q2", "q3"}
    assert rerank.listwise(rerank.candidates(run.limit(0), queries, docs)).count() == 0


def test_late_interaction(spark):
    run = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 2), ("x", "d1", 1)], "query_id string, doc_id string, rank int")
    q = spark.createDataFrame([("q", [[1.0, 0.0], [0.0, 2.0]])], "id string, tokens array<array<float>>")
    d = spark.createDataFrame([("d1", [[1.0, 1.0]])], "id string, tokens array<array<float>>")
    assert [(r["doc_id"], r["score"], r["rank"]) for r in rerank.late_interaction(run, q, d).orderBy("rank").collect()] == [("d1", 1.414214, 1), ("d2", 0.0, 2)]


def test_hybrid_keeps_all_candidates(spark, parts):
    _, queries, docs = parts
    run = spark.createDataFrame([(m, "q1", d, s, r) for m, own in (("a", ["d1", "d2"]), ("b", ["d2", "gone"])) for r, (d, s) in enumerate(zip(own, (2.0, 1.0), strict=True), 1)], "model string, query_id string, doc_id string, score double, rank int")
    assert {r["doc_id"] for r in rerank.hybrid(run, queries, docs).collect()} == {"d1", "d2", "gone"}


@pytest.mark.parametrize("language", [None, "es"])
def test_a_stored_index_finds_the_same(spark, tmp_path, language):
    words = "sol luna mar río casas niños faro torre".split()
    docs = spark.createDataFrame([(f"d{i % 50:02d}", " ".join(words[(i * j) % 8] for j in range(i % 9))) for i in range(60)] + [("e", ""), ("n", None), (None, "sol")], "doc_id string, full_text string")
    asked = spark.createDataFrame([("q1", "sol y mar"), ("q2", "torres"), ("q3", None), ("q4", "nada")], "query_id string, text string")
    path = str(tmp_path / "index")
    with pytest.raises(RuntimeError):
        retrieve.open_index(spark, path)
    retrieve.build_index(docs, path, language=language, buckets=8)
    index = retrieve.open_index(spark, path)
    assert index.docs == 52 and index.language == language
    for search in (retrieve.bm25_topk, retrieve.learned_sparse_topk):
        plain, stored = (sorted(map(tuple, search(asked, x, doc_text="full_text", language=language).collect())) for x in (docs, index))
        assert plain == stored and plain
    hits = index.hits(retrieve.postings(asked.where("query_id = 'q1'"), "query_id", "text", language))
    assert "PartitionFilters: [bucket" in hits.postings._jdf.queryExecution().simpleString()
    empty = str(tmp_path / "empty")
    retrieve.build_index(docs.limit(0), empty)
    assert retrieve.bm25_topk(asked, retrieve.open_index(spark, empty)).count() == 0
    assert retrieve.bm25_topk(asked, docs.limit(0), doc_text="full_text").count() == 0


def test_work_items(spark):
    run = spark.createDataFrame([("q1", "d1"), ("q1", "d2"), ("q2", "gone"), ("q3", "d2"), ("q0", "d1")], "query_id string, doc_id string")
    docs = spark.createDataFrame([("d1", 5), ("d2", 9)], "doc_id string, word_count int")
    rows = [tuple(r) for r in rerank.work_items(run, docs).orderBy("place").collect()]
    assert rows == [("q1", 2, 9, 1), ("q3", 1, 9, 2), ("q0", 1, 5, 3), ("q2", 1, 0, 4)]
    assert rerank.work_items(run.limit(0), docs).count() == 0
