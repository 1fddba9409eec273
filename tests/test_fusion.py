"""Fusion formulas on micro-fixtures, and what must hold of any fusion."""

from __future__ import annotations

import pytest

from rankloom.operators import fusion, runs
from rankloom.schema import STRATEGIES

A = [("A", "q1", "d1", 3.0), ("A", "q1", "d2", 2.0), ("A", "q1", "d3", 1.0)]
B = [("B", "q1", "d2", 0.9), ("B", "q1", "d4", 0.5), ("B", "q1", "d1", 0.1)]
SCHEMA = "model string, query_id string, doc_id string, score double"
EXPECTED = {
    "rrf": {"d1": 0.032266458, "d2": 0.032522475, "d3": 0.015873016, "d4": 0.016129032},
    "rbc": {"d1": 0.095125, "d2": 0.0975, "d3": 0.045125, "d4": 0.0475},
    "isr": {"d1": 2.222222222, "d2": 2.5, "d3": 0.111111111, "d4": 0.25},
    "mnz": {"d1": 2.0, "d2": 3.0, "d3": 0.0, "d4": 0.5},
    "bordafuse": {"d1": 6.0, "d2": 7.0, "d3": 3.0, "d4": 4.0},
    "condorcet": {"d1": 1.0, "d2": 2.0, "d3": 0.0, "d4": 0.0},
}
METHODS = {s.method: s.params for s in STRATEGIES.values()}


def prepared(spark, rows):
    return runs.prepare_run(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("method", sorted(EXPECTED))
def test_formula(spark, method):
    rows = fusion.fuse(prepared(spark, A + B), method, METHODS[method]).collect()
    assert {r["doc_id"]: r["score"] for r in rows} == pytest.approx(EXPECTED[method], abs=1e-9)


def test_order_of_rrf(spark):
    rows = fusion.fuse(prepared(spark, A + B), "rrf").orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == ["d2", "d1", "d4", "d3"]


@pytest.mark.parametrize("method", sorted(EXPECTED))
def test_order_of_runs_does_not_matter(spark, method):
    swapped = [({"A": "Z", "B": "C"}[m], q, d, s) for m, q, d, s in B + A]
    first, second = (sorted(map(tuple, fusion.fuse(prepared(spark, rows), method, METHODS[method]).collect())) for rows in (A + B, swapped))
    assert first == second


@pytest.mark.parametrize("method", ["rrf", "rbc", "isr", "bordafuse", "condorcet"])
def test_one_run_keeps_its_order(spark, method):
    rows = fusion.fuse(prepared(spark, A), method, METHODS[method]).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == ["d1", "d2", "d3"]


@pytest.mark.parametrize("method", sorted(EXPECTED))
def test_degenerate_runs(spark, method):
    one = fusion.fuse(prepared(spark, [("A", "q", "d", 5.0)]), method, METHODS[method]).collect()
    assert len(one) == 1 and one[0]["rank"] == 1
    equal = fusion.fuse(prepared(spark, [("A", "q", f"d{i}", 1.0) for i in (3, 1, 2)]), method, METHODS[method]).orderBy("rank").collect()
    assert [r["doc_id"] for r in equal] == ["d1", "d2", "d3"]
    assert fusion.fuse(prepared(spark, []), method, METHODS[method]).count() == 0


def test_cleaning(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("A", "q", "d1", 1.0), ("A", "q", "d1", 2.0), ("A", "q", "d1", 2.0), ("A", "q", "d2", nan), ("A", "q", "d3", inf), ("A", "q", "d4", None), (None, "q", "d5", 1.0), ("A", None, "d6", 1.0), ("A", "q", None, 1.0), ("A", "q", "d7", 2.0)]
    got = prepared(spark, rows).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"], r["rank"]) for r in got] == [("d1", 2.0, 1), ("d7", 2.0, 2)]
    many = runs.prepare_run(spark.createDataFrame([("A", "q", f"d{i:04d}", float(i % 7)) for i in range(900)], SCHEMA), 5).orderBy("rank").collect()
    assert [r["doc_id"] for r in many] == ["d0006", "d0013", "d0020", "d0027", "d0034"]


def test_grid_equals_single_fusions(spark):
    run = prepared(spark, A + B + [("C", "q1", "d9", 1.0), ("C", "q2", "d1", 1.0)])
    grid = fusion.fusion_grid(run, fusion.choices(["A", "B", "C"], 2, 3))
    assert grid.select("combo").distinct().count() == 4
    for strategy in fusion.GRID:
        own = {(r["doc_id"], r["score"], r["rank"]) for r in grid.where(f"combo = 'A+B' AND strategy = '{strategy.method}'").collect()}
        assert own == {(r["doc_id"], r["score"], r["rank"]) for r in fusion.fuse(prepared(spark, A + B), strategy.method, strategy.params).collect()}


@pytest.mark.parametrize("block", [10**6, 7])
def test_judged_ranks_are_those_of_the_grid(spark, block):
    rows = [(m, f"q{q}", f"d{(i * k) % 40:02d}", float(i % 9)) for q in range(4) for k, m in ((3, "A"), (7, "B"), (11, "C")) for i in range(30)]
    run, combos = prepared(spark, rows), fusion.choices(["A", "B", "C"], 2, 3)
    qrels = spark.createDataFrame([(f"q{q}", f"d{d:02d}", 1) for q in range(3) for d in (1, 7, 20, 39)] + [("q0", "gone", 1), ("q3", "d01", 0)], "query_id string, doc_id string, relevance int")
    expected = fusion.fusion_grid(run, combos).join(qrels.where("relevance > 0"), ["query_id", "doc_id"], "left_semi")
    columns = ["combo", "strategy", "params", "query_id", "doc_id", "rank"]
    assert sorted(map(tuple, fusion.judged_grid(run, qrels, combos, block=block).select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        fusion.score_expr("none")
