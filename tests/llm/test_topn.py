from __future__ import annotations

import math
import random

from rankloom.llm import topn


def brute(rows, n):
    best: dict[tuple, dict] = {}
    for m, q, d, s, _ in rows:
        if None in (m, q, d, s) or math.isnan(s):
            continue
        own = best.setdefault((m, q), {})
        own[d] = max(s, own.get(d, -math.inf))
    return sorted((m, q, d, s, r) for (m, q), own in best.items() for r, (d, s) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:n], 1))


SCHEMA = "model string, query_id string, doc_id string, score double, rank int"


def test_against_brute_force(spark):
    random.seed(3)
    rows = []
    for _ in range(6000):
        q = "hot" if random.random() < 0.4 else f"q{random.randrange(60)}"
        score = random.choice([None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1.5]) if random.random() < 0.2 else round(random.gauss(0, 1), 1)
        rows.append((random.choice(["a", "b", None]), random.choice([q, q, q, None]), random.choice([f"d{random.randrange(400)}", "ñ", None, "d1"]), score, 7))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for options in ({}, {"chunk_rows": 50}, {"max_bounds": 1}, {"chunk_rows": 40, "max_bounds": 3}, {"chunk_rows": 40, "max_bounds": 0}):
        got = sorted(tuple(r) for r in topn.top_n(df, ["model", "query_id"], "doc_id", "score", 10, **options).collect())
        assert [(m, q, d, s + 0.0, r) for m, q, d, s, r in got] == [(m, q, d, s + 0.0, r) for m, q, d, s, r in brute(rows, 10)]


def test_bounds_are_used_and_valid(spark):
    rows = [("a", "q", f"d{i:05d}", float(i), 0) for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    keyed = df.selectExpr("query_id", "doc_id AS item", "score")
    bounds = topn.group_bounds(keyed, ["query_id"], 10).collect()
    assert len(bounds) == 1 and bounds[0]["bound_score"] <= 4990.0
    assert bounds[0]["bound_score"] > 4000.0


def test_ties_and_empty(spark):
    rows = [("a", "q", f"d{i:03d}", 1.0, 0) for i in range(300)] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = [r["doc_id"] for r in topn.top_n(df, ["model", "query_id"], "doc_id", "score", 3).orderBy("rank").collect()]
    assert got == ["d000", "d001", "d002"]
    assert topn.top_n(df.limit(0), ["model", "query_id"], "doc_id", "score", 3).count() == 0
