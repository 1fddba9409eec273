"""The grid has every combination of two or three of the table's models."""

from __future__ import annotations

import itertools
import random

from rankloom.plans import oracle as sql
from rankloom.plans import queries as core
from tests.oracle import connection, rows_of_spark, rows_of_sql

MODELS = ["a", "b", "c", "d", "e", "f"]


def test_grid_of_all_models(spark, tmp_path):
    rng = random.Random(8)
    rows = [(m, q, d, rng.random()) for m in MODELS for q in ("q1", "q2") for d in rng.sample([f"d{i}" for i in range(12)], rng.randrange(1, 9))]
    spark.createDataFrame(rows, "model string, query_id string, doc_id string, score double").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "retrieval_run.parquet")
    grid = core.queries()["fuse_grid"](spark, str(tmp_path))
    combos = {"+".join(c) for n in (2, 3) for c in itertools.combinations(MODELS, n)}
    assert len(combos) == 35 and {r[0] for r in grid.select("combo").distinct().collect()} == combos
    names, expected = rows_of_sql(connection(str(tmp_path)), sql.oracle_sql()["fuse_grid"])
    assert sorted(grid.columns) == names
    assert rows_of_spark(grid) == expected

    # By hand, without SQL: reciprocal ranks.
    for combo in ("a+f", "d+e+f"):
        score: dict = {}
        for m, q in itertools.product(combo.split("+"), ("q1", "q2")):
            own = sorted((r for r in rows if r[0] == m and r[1] == q), key=lambda r: (-r[3], r[2]))
            for n, r in enumerate(own, 1):
                score[q, r[2]] = score.get((q, r[2]), 0) + 1 / (60 + n)
        got = {(r["query_id"], r["doc_id"]): r["score"] for r in grid.where(f"combo = '{combo}' AND strategy = 'rrf'").collect()}
        assert got == {k: round(v, 9) for k, v in score.items()}
