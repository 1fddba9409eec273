from __future__ import annotations

import numpy as np

from rankloom.llm import neighbours

SCHEMA = "id string, embedding array<float>, shard string"


def table(spark, vectors, prefix):
    return spark.createDataFrame([(f"{prefix}{i:04d}", [float(x) for x in v], "x") for i, v in enumerate(vectors)], SCHEMA)


def pairs(df):
    return {(r["query_id"], r["doc_id"]) for r in df.collect()}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    docs = centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    queries = centres[rng.integers(0, 30, 60)] + 0.3 * rng.normal(size=(60, 16))
    d, q = table(spark, docs, "d"), table(spark, queries, "q")
    exact = pairs(neighbours.nearest_exact(d, q, 10, dim=16))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    top = np.argsort(-(unit(queries.astype(np.float32).astype(float)) @ unit(docs.astype(np.float32).astype(float)).T), axis=1)[:, :10]
    assert exact == {(f"q{i:04d}", f"d{j:04d}") for i, own in enumerate(top) for j in own}
    found = pairs(neighbours.nearest(d, q, 10, dim=16))
    assert len(found) == 600 and len(found & exact) / 600 >= 0.9
    for block in (64, 16):  # groups of rows, and blocks of queries too
        assert pairs(neighbours.nearest(d, q, 10, dim=16, block=block)) == found


def test_dirt_ties_and_copies(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [(f"d{i:03d}", one, "x") for i in range(50)] + [("d000", one, "x"), ("far", [0.0, 1.0, 0.0, 0.0], "x"), ("long", [2.0, 0.0, 0.0, 0.0], "x")]
    rows += [("n", None, "x"), ("e", [], "x"), ("z", [0.0] * 4, "x"), ("s", [1.0], "x"), ("nan", [float("nan"), 1.0, 1.0, 1.0], "x"), ("inf", [float("inf"), 1.0, 1.0, 1.0], "x"), (None, one, "x")]
    d = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame([("q", [3.0, 0.0, 0.0, 0.0], "x"), ("q", [3.0, 0.0, 0.0, 0.0], "x"), ("bad", [0.0] * 4, "x")], SCHEMA)
    for search in (neighbours.nearest, neighbours.nearest_exact):
        got = [r["doc_id"] for r in search(d, q, 10, dim=4).orderBy("rank").collect()]
        assert got == [f"d{i:03d}" for i in range(10)]
    assert neighbours.nearest(d.limit(0), q, 10, dim=4).count() == 0
    assert neighbours.nearest(d, q.limit(0), 10, dim=4).count() == 0


def test_probe_goes_by_summed_distance():
    first, second = np.array([[0.0], [1.0], [3.0]]), np.array([[0.0], [2.0]])
    index = neighbours.MultiIndex(first, second, {(i, j): 1 for i in range(3) for j in range(2)})
    assert index.probe(np.array([0.0, 0.0]), 2) == {0: [0], 1: [0]}
    assert sum(map(len, index.probe(np.array([0.0, 0.0]), 99).values())) == 6


def test_hot_cells_have_groups_of_their_own():
    layout = neighbours._layout({(0, 0): 3, (0, 1): 4, (0, 2): 25, (1, 0): 2, (1, 1): 9}, 10)
    assert layout == [(0, 0, 0, 1), (0, 1, 0, 1), (0, 2, 1, 3), (1, 0, 4, 1), (1, 1, 5, 1)]


def test_an_id_with_several_vectors_counts_once(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 8))
    d = spark.createDataFrame([(f"d{i % 40:03d}", [float(x) for x in v], "x") for i, v in enumerate(vectors)], SCHEMA)
    q = table(spark, rng.normal(size=(20, 8)), "q")
    exact = neighbours.nearest_exact(d, q, 10, dim=8).collect()
    assert len(exact) == 200 and len({(r["query_id"], r["doc_id"]) for r in exact}) == 200
    unit = lambda x: x / np.linalg.norm(x)
    ask = {r["id"]: unit(np.array(r["embedding"])) for r in q.collect()}
    for name, a in ask.items():
        near = sorted(((-max(float(a @ unit(v.astype(np.float32).astype(float))) for v in vectors[i::40])), f"d{i:03d}") for i in range(40))[:10]
        assert [r["doc_id"] for r in sorted(exact, key=lambda r: r["rank"]) if r["query_id"] == name] == [x for _, x in near]
    assert pairs(neighbours.nearest(d, q, 10, dim=8, probe=99, block=64)) == {(r["query_id"], r["doc_id"]) for r in exact}
