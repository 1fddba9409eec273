from __future__ import annotations

import pytest

from rankloom.operators import evaluate, runs

RANKED = ["d2", "d1", "d4", "d3"]


def run_of(spark, lists):
    rows = [(m, q, d, float(len(docs) - i), i + 1) for m, q, docs in lists for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "model string, query_id string, doc_id string, score double, rank int")


def judged(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id string, relevance int")


def test_metrics_by_hand(spark):
    qrels = judged(spark, [("q1", d, 1) for d in ("d1", "d4", "d9")])
    row = evaluate.evaluate(run_of(spark, [("m", "q1", RANKED)]), qrels).first()
    assert [row[m] for m in evaluate.METRICS] == pytest.approx([0.530721, 0.666667, 0.5, 0.388889, 0.2, 0.04], abs=1e-6)


def test_ideal_run_and_missing_queries(spark):
    qrels = judged(spark, [("q1", "d1", 3), ("q1", "d2", 1), ("q2", "d1", 1), ("q3", "d5", 0)])
    rows = {(r["model"], r["query_id"]): r for r in evaluate.per_query(run_of(spark, [("good", "q1", ["d1", "d2"]), ("bad", "q9", ["d1"])]), qrels).collect()}
    assert rows["good", "q1"]["ndcg_10"] == 1.0 and rows["good", "q1"]["map"] == 1.0
    assert all(rows[k][m] == 0.0 for k in (("good", "q2"), ("good", "q3"), ("bad", "q1")) for m in evaluate.METRICS)
    assert ("bad", "q9") not in rows and len(rows) == 6


def test_bounds_and_recall_grows(spark):
    docs = [f"d{i:03d}" for i in range(300)]
    qrels = judged(spark, [("q", d, 1) for d in docs[::7]])
    row = evaluate.evaluate(run_of(spark, [("m", "q", docs)]), qrels).first()
    assert all(0.0 <= row[m] <= 1.0 for m in evaluate.METRICS)
    assert row["p_50"] * 50 <= row["recall_100"] * len(docs[::7])


def test_empty(spark):
    qrels = judged(spark, [("q", "d", 1)])
    run = run_of(spark, [("m", "q", ["d"])])
    assert evaluate.evaluate(run.limit(0), qrels).count() == 0
    assert evaluate.evaluate(run, qrels.limit(0)).count() == 0


def test_paired_t(spark):
    scores = spark.createDataFrame([(m, f"q{i}", x + i * d) for i in range(4) for m, x, d in (("a", 0.5, 0.1), ("b", 0.4, 0.05))], "model string, query_id string, ndcg_10 double")
    row = evaluate.paired_t(scores, "ndcg_10").first()
    assert (row["first"], row["second"], row["n"]) == ("a", "b", 4)
    assert row["mean_delta"] == pytest.approx(0.175) and row["t"] == pytest.approx(0.175 / (0.0645497 / 2), rel=1e-3)


def test_tables(spark):
    metrics = spark.createDataFrame([("m", "", None, *([0.25] * 6)), ("longer", "rrf", "k=60", *([1.0] * 6))], "model string, strategy string, params string, " + ", ".join(f"{m} double" for m in evaluate.METRICS))
    rows = evaluate.result_rows(metrics)
    lines = [r["line"] for r in evaluate.markdown_lines(rows, evaluate.TITLES).orderBy("model").collect()]
    whole = evaluate.markdown_table([r.asDict() for r in rows.orderBy("model").collect()]).split("\n")
    assert whole[2:] == lines and len({len(x) for x in whole}) == 1
    assert evaluate.inline(metrics.where("model = 'longer'").first().asDict(), "rrf", "k=60").startswith("longer (rrf, k=60): ndcg@10 1.0000")


def test_ranks(spark):
    df = spark.createDataFrame([("m", "q", "b", 1.0), ("m", "q", "a", 1.0), ("m", "q", "c", 2.0)], "model string, query_id string, doc_id string, score double")
    assert [r["doc_id"] for r in runs.rank_run(df).orderBy("rank").collect()] == ["c", "a", "b"]
    norm = {r["doc_id"]: r["norm"] for r in runs.minmax(df).collect()}
    assert norm == {"a": 0.0, "b": 0.0, "c": 1.0}


def test_reports(spark):
    metrics = spark.createDataFrame([("longer", "rrf", "k=60", *([1.0] * 6)), ("m", "", None, *([0.25] * 6))], "model string, strategy string, params string, " + ", ".join(f"{m} double" for m in evaluate.METRICS))
    said: list[str] = []
    for mode in ("box", "inline", "quiet"):
        assert evaluate.report(metrics, mode, said.append) is metrics
    box = said[0].split("\n")
    assert len(said) == 4 and len({len(x) for x in box}) == 1 and "longer (rrf, k=60)" in box[1] and len(box) == 10
    assert said[3].startswith("m: ndcg@10 0.2500")


@pytest.mark.parametrize("t,n,p", [(2.0, 2, 0.2951672), (2.0, 3, 0.1835034), (2.0, 4, 0.1393260), (2.0, 5, 0.1161165), (0.8788, 80, 0.3821749), (3.1, 200, 0.0022157), (0.0, 9, 1.0)])
def test_two_sided(t, n, p):
    assert evaluate.two_sided(t, n - 1) == evaluate.two_sided(-t, n - 1) == pytest.approx(p, abs=1e-7)


def test_lists_without_hits_in_parts(spark):
    qrels = judged(spark, [("q1", "d1", 1), ("q2", "d1", 1)])
    run = run_of(spark, [(f"m{i}", "q1", ["d9"]) for i in range(40)])
    rows = evaluate.per_query(run, qrels).collect()
    assert len(rows) == 80 and all(r["map"] == 0.0 for r in rows)
