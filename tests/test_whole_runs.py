"""Stored runs are used whole, whatever the number of documents of a query."""

from __future__ import annotations

import random

import pytest

from rankloom.operators import fusion, runs
from rankloom.plans import oracle as sql

SCHEMA = "model string, query_id string, doc_id string, score double"


def test_the_sql_is_of_whole_runs():
    assert "LIMIT" not in sql.oracle_sql()["fuse_grid"] and "rank <= 100" not in sql._CTES["run"]


def test_a_stored_run_is_not_cut(spark):
    rows = [("A", "q", f"d{i:04d}", float(i)) for i in range(250)]
    run = runs.prepare_run(spark.createDataFrame(rows, SCHEMA))
    assert run.count() == 250
    norms = {r["doc_id"]: r["norm"] for r in runs.minmax(run).collect()}
    assert norms["d0249"] == 1.0 and norms["d0000"] == 0.0 and norms["d0150"] == pytest.approx(150 / 249)


def test_ranks_beyond_the_root_of_an_int(spark):
    stored = spark.range(50_000).selectExpr("'A' AS model", "'q' AS query_id", "format_string('d%05d', id) AS doc_id", "double(-id) AS score")
    run = runs.prepare_run(stored)
    last = {"isr": fusion.fuse(run, "isr"), "all": fusion.fuse_all(run), "grid": fusion.fusion_grid(run, [("A",)]).where("strategy = 'isr'")}
    assert [df.where("doc_id = 'd49999'").count() for df in last.values()] == [1, 1, 1]
    assert last["isr"].where("doc_id = 'd49999'").first()["score"] == round(1 / 50_000**2, 9)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_condorcet_in_blocks_against_brute_force(spark, block):
    rng = random.Random(3)
    lists = {m: rng.sample([f"d{i:03d}" for i in range(160)], n) for m, n in (("A", 150), ("B", 120), ("C", 40), ("D", 7))}
    rows = [(m, "hot", d, float(-i)) for m, docs in lists.items() for i, d in enumerate(docs)] + [("A", "q", "d1", 2.0), ("B", "q", "d2", 1.0)]
    place = {m: {d: i for i, d in enumerate(docs)} for m, docs in lists.items()}
    docs = sorted({d for x in lists.values() for d in x})
    last = len(docs)

    def beats(a, b):
        deltas = [p.get(b, last) - p.get(a, last) for p in place.values()]
        return sum((x > 0) - (x < 0) for x in deltas) > 0

    expected = {("hot", a): float(sum(beats(a, b) for b in docs)) for a in docs} | {("q", "d1"): 0.0, ("q", "d2"): 0.0}
    got = fusion.copeland_wins(runs.prepare_run(spark.createDataFrame(rows, SCHEMA)), block).collect()
    assert len(got) == len(expected)
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in got} == expected
