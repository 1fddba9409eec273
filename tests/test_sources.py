from __future__ import annotations

import json

import numpy as np
import pytest

from rankloom.operators import encode, rerank
from rankloom.plans import workflow
from rankloom.schema import STRATEGIES
from rankloom.sources import interchange, store
from rankloom.streaming.incremental import encode_stream

RUN = "model string, query_id string, doc_id string, score double, rank int"


def run_rows(spark):
    return spark.createDataFrame([("a b", "q1", "d1", 2.5, 1), ("a b", "q1", "d2", 1.0, 2), ("c", "q2", "d1", 0.1, 1)], RUN)


def test_trec(spark, tmp_path):
    interchange.write_trec_run(run_rows(spark), str(tmp_path / "run"))
    got = {tuple(r) for r in interchange.read_trec_run(spark, str(tmp_path / "run")).collect()}
    assert got == {("a_b", "q1", "d1", 2.5, 1), ("a_b", "q1", "d2", 1.0, 2), ("c", "q2", "d1", 0.1, 1)}
    (tmp_path / "odd.txt").write_text("q Q0 d\tx 1.5  t\n\nq Q0 d 1 y t\nshort\n")
    assert {tuple(r) for r in interchange.read_trec_run(spark, str(tmp_path / "odd.txt"), "m").collect()} == {("m", "q", "d", 1.5, None), ("m", "q", "d", None, 1)}
    (tmp_path / "qrels.txt").write_text("q 0 d 1\nq 0 e 0\n")
    assert {tuple(r) for r in interchange.read_trec_qrels(spark, str(tmp_path / "qrels.txt")).collect()} == {("q", "d", 1), ("q", "e", 0)}


def test_json(spark, tmp_path):
    (tmp_path / "qrels.json").write_text(json.dumps({"1": {"d1": 1, "d2": 2}, "2": {}}))
    (tmp_path / "map.json").write_text(json.dumps({"1": "uno\ndos"}))
    (tmp_path / "run.json").write_text(json.dumps({"1": {"d1": 0.5}}))
    assert {tuple(r) for r in interchange.read_json_qrels(spark, str(tmp_path / "qrels.json")).collect()} == {("1", "d1", 1), ("1", "d2", 2)}
    assert [tuple(r) for r in interchange.read_json_map(spark, str(tmp_path / "map.json")).collect()] == [("1", "uno\ndos")]
    assert [tuple(r) for r in interchange.read_json_run(spark, str(tmp_path / "run.json"), "m").collect()] == [("m", "1", "d1", 0.5)]


def test_matrices(spark, tmp_path):
    matrix = np.arange(21, dtype=np.float32).reshape(7, 3)
    np.save(tmp_path / "merged.npy", matrix)
    (tmp_path / "ids.json").write_text(json.dumps([f"d{i}" for i in range(7)]))
    rows = {r["id"]: r["embedding"] for r in interchange.read_npy(spark, str(tmp_path), 3).collect()}
    assert rows == {f"d{i}": matrix[i].tolist() for i in range(7)} and interchange.npy_shape(str(tmp_path / "merged.npy")) == (7, 3)
    np.savez(tmp_path / "merged.npz", data=np.array([1.0, 2.0, 3.0]), indices=np.array([4, 5, 4]), indptr=np.array([0, 2, 2, 3, 3, 3, 3, 3]), shape=np.array([7, 9]))
    assert {tuple(r) for r in interchange.read_csr(spark, str(tmp_path), 2).collect()} == {("d0", "4", 1.0), ("d0", "5", 2.0), ("d2", "4", 3.0)}


def test_runs_by_model(spark, tmp_path):
    path = str(tmp_path / "runs")
    store.save_run(run_rows(spark), path)
    assert store.is_complete(spark, path)
    got = store.load_runs(spark, path, ["c"], {"c": "short"})
    assert [tuple(r) for r in got.collect()] == [("short", "q2", "d1", 0.1, 1)]
    assert store.load_runs(spark, path).count() == 3


def test_materialize_and_guard(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return run_rows(spark)

    for _ in range(2):
        assert store.materialize(spark, str(tmp_path / "t"), build).count() == 3
    assert made == [1] and store.status(spark, {"t": str(tmp_path / "t"), "u": str(tmp_path / "u")}) == {"t": True, "u": False}
    with pytest.raises(RuntimeError):
        store.load_or_fail(spark, str(tmp_path / "none"), None)
    for _ in range(2):
        store.guard(spark, run_rows(spark), "doc_id", "rank", str(tmp_path / "mark"))
    with pytest.raises(RuntimeError):
        store.guard(spark, run_rows(spark).limit(1), "doc_id", "rank", str(tmp_path / "mark"))


def test_resume_goes_on_behind_a_failure(spark, tmp_path):
    work = spark.createDataFrame([(f"q{i}", f"d{j}", 1, "casa", "casa") for i in range(12) for j in range(3)], "query_id string, doc_id string, rank int, query_text string, doc_text string")
    schema, calls = "query_id string, doc_id string, score double, rank int", []

    def job(rest):
        calls.append({r["query_id"] for r in rest.select("query_id").distinct().collect()})
        if len(calls) == 2:
            raise OSError("killed")
        return rerank.listwise(rest)

    path = str(tmp_path / "work")
    with pytest.raises(OSError):
        store.resume(spark, work, path, schema, job, 3)
    assert store.resume(spark, work, path, schema, job, 3).count() == 36
    assert not calls[0] & set().union(*calls[2:]) and set().union(*calls) == {f"q{i}" for i in range(12)}
    store.remove(spark, path)
    assert store.load_checkpoint(spark, path, schema).count() == 0


def test_paths():
    data = workflow.Dataset("r", max_words=400)
    assert data.shared("docs") == "r/docs/country=full/version=1.2/max_words=400"
    assert workflow.Dataset("r/").of_model("run", "a/b", 64, 256) == "r//run/model=a%2Fb/country=full/version=1.2/query_length=64/doc_length=256/max_words=__HIVE_DEFAULT_PARTITION__"
    assert data.reranked("x/y", store.fusion_name("mnz", ["a", "b"])).endswith("/reranker=x%2Fy/over=mnz_a%2Bb")


def test_partition_columns_of_paths(spark, tmp_path):
    for model, length in (("a/b", 64), ("c", 512)):
        run_rows(spark).drop("model").write.parquet(workflow.Dataset(str(tmp_path)).of_model("run", model, length, 256))
    read = spark.read.parquet(str(tmp_path / "run"))
    assert {(r["model"], r["query_length"], r["max_words"]) for r in read.select("model", "query_length", "max_words").collect()} == {("a/b", 64, None), ("c", 512, None)}
    setup = workflow.Dataset(str(tmp_path))
    assert {r["model"] for r in workflow.first_stage(spark, setup, "a/b", 64, 256).collect()} == {"a/b"}
    with pytest.raises(RuntimeError):
        workflow.first_stage(spark, setup, "a/b", 128, 256)


def test_other_pipelines(spark, data, tmp_path):
    from rankloom.sources.tables import read_table

    docs, judged = read_table(spark, data, "corpus"), read_table(spark, data, "judgements")
    setup = workflow.Dataset(str(tmp_path), max_words=400)
    text, sparse = encode.EncoderSpec("own/bm25", 512, 512), encode.EncoderSpec("own/terms", 512, 512)
    assert not any(workflow.cached(spark, setup, text).values())
    run, metrics = workflow.text_baseline(spark, setup, text, docs, judged, 20)
    other, weights = workflow.sparse_baseline(spark, setup, sparse, encode.TermEncoder, docs, judged, 20)
    assert 0.0 < metrics.first()["recall_100"] <= 1.0 and 0.0 < weights.first()["recall_100"] <= 1.0
    assert workflow.cached(spark, setup, text) == {"docs": True, "qrels": True, "queries": True, "doc_embeddings": False, "query_embeddings": False, "run": True}
    kept, _, texts = workflow.prepared(spark, setup, docs, judged)
    said: list[str] = []
    pairs = run.join(texts, "query_id", "left_semi").count()
    one = workflow.rerank_stored(spark, str(tmp_path / "points"), run, texts, kept, shards=2, job=lambda rest: rerank.pointwise(rest, rerank.jaccard), say=said.append)
    assert one.count() == pairs and len(said) == 2 and "rows a second" in said[0]
    vectors = lambda df, key, text: encode.encode(df, key, text, encode.HashingEncoder).selectExpr("id", "array(embedding) AS tokens")
    q, d = vectors(texts, "query_id", "text"), vectors(kept, "doc_id", "full_text")
    late = workflow.rerank_stored(spark, str(tmp_path / "late"), run, texts, kept, shards=2, job=lambda rest: rerank.late_interaction(rest, q, d))
    assert late.count() == pairs
    mixed = workflow.hybrid_stored(spark, str(tmp_path / "hybrid"), run.unionByName(other), texts, kept, STRATEGIES["combmnz"], shards=2)
    assert mixed.count() == run.unionByName(other).select("query_id", "doc_id").distinct().join(texts, "query_id", "left_semi").count()
    assert workflow.hybrid_stored(spark, str(tmp_path / "hybrid"), run, texts, kept, STRATEGIES["combmnz"]).count() == mixed.count()
    assert workflow.executor_memory(spark)


def test_json_is_streamed(spark, tmp_path):
    made = {f"q{i} ñ\"": {f"d{j}": j * 1.5 for j in range(i % 4)} for i in range(50)} | {"n": None}
    (tmp_path / "run.json").write_text(json.dumps(made, indent=1))
    for chunk in (1, 7, 1_000_000):
        assert dict(interchange.json_entries(str(tmp_path / "run.json"), chunk)) == made
    rows = interchange.read_json_run(spark, str(tmp_path / "run.json"), "m").collect()
    assert {(r["query_id"], r["doc_id"], r["score"]) for r in rows} == {(q, d, s) for q, own in made.items() for d, s in (own or {}).items()}
    (tmp_path / "ids.json").write_text("[1, \"b\", 345]")
    assert [list(interchange.json_entries(str(tmp_path / "ids.json"), c)) for c in (1, 2, 99)] == [[1, "b", 345]] * 3
    assert interchange.read_ids(str(tmp_path / "ids.json"), 1, 2) == ["b"] and interchange.read_ids(str(tmp_path / "ids.json")) == ["1", "b", "345"]
    for text in ("", "[1, 2", "3", '{"a" 1}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError):
            list(interchange.json_entries(str(tmp_path / "bad.json")))
    (tmp_path / "empty.json").write_text(" {} ")
    assert list(interchange.json_entries(str(tmp_path / "empty.json"))) == []


def test_compressed_matrices(spark, tmp_path):
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, 40)
    indptr = np.concatenate([[0], np.cumsum(counts)])
    values, terms = rng.random(indptr[-1]).astype(np.float32), rng.integers(0, 99, indptr[-1])
    np.savez_compressed(tmp_path / "merged.npz", data=values, indices=terms, indptr=indptr, shape=np.array([40, 99]))
    (tmp_path / "ids.json").write_text(json.dumps(list(range(40))))
    for parts in (1, 7, None):
        rows = sorted(map(tuple, interchange.read_csr(spark, str(tmp_path), parts).collect()))
        assert rows == sorted((str(i), str(terms[k]), float(values[k])) for i in range(40) for k in range(indptr[i], indptr[i + 1]))


def test_whole_pipelines(spark, data, tmp_path):
    from rankloom.sources.tables import read_table

    docs, judged = read_table(spark, data, "corpus"), read_table(spark, data, "judgements")
    spec = encode.EncoderSpec("own/hashing", 64, 256, query_prompt="query: ")
    setup = workflow.Dataset(str(tmp_path), max_words=400)
    run, metrics = workflow.dense_baseline(spark, setup, spec, encode.HashingEncoder, docs, judged, 20)
    first = metrics.first()
    assert run.count() > 0 and 0.0 <= first["ndcg_10"] <= 1.0 and first["model"] == "own/hashing"
    with workflow.timer("again", lambda line: None):
        _, again = workflow.dense_baseline(spark, setup, spec, lambda: None, docs, judged, 20)
    assert again.first() == first
    other = run.selectExpr("'b' AS model", "query_id", "doc_id", "-score AS score", "21 - rank AS rank")
    grid = workflow.fuse_and_evaluate(run.unionByName(other), workflow.prepared(spark, setup, docs, judged)[1], ["own/hashing", "b"], [STRATEGIES["rrf"], STRATEGIES["isr"]], 2, 2)
    assert grid.count() == 2
    prepared_docs, _, texts = workflow.prepared(spark, setup, docs, judged)
    one = workflow.rerank_stored(spark, str(tmp_path / "rerank"), run, texts, prepared_docs, shards=2)
    assert one.count() == run.join(texts, "query_id", "left_semi").count() and not store.exists(spark, str(tmp_path / "rerank/checkpoint"))


def test_stream(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = spark.createDataFrame([("a", "uno"), ("b", None)], "id string, text string")
    rows.write.json(source)
    stream = lambda: encode_stream(spark.readStream.schema("id string, text string").json(source), "id", "text", encode.HashingEncoder, target, mark)
    stream().awaitTermination()
    spark.createDataFrame([("c", "dos")], "id string, text string").write.mode("append").json(source)
    stream().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]
