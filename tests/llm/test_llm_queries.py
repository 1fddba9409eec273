"""The queries of the folder against their SQL, or against what else is known of their results."""

from __future__ import annotations

import pytest

from rankloom.llm import queries as llm
from tests.oracle import connection, rows_of_spark, rows_of_sql

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name not in SQL:
        assert df.count() > 0
        return
    names, expected = rows_of_sql(connection(data), SQL[name])
    assert sorted(df.columns) == names
    got = rows_of_spark(df)
    if name == "p2_found":  # an index may miss a few
        assert len(set(got) & set(expected)) >= 0.9 * len(expected)
    else:
        assert got == expected


def test_columns():
    assert all(any(q.startswith(f"p{n}_") for q in QUERIES) for n in range(1, 9))


def test_pieces_of_all_rows(spark, data):
    rows = QUERIES["p1_pieces"](spark, data).collect()
    assert rows and all(len(r["piece_text"]) <= 2000 and r["stop"] - r["start"] == len(r["piece_text"]) for r in rows)


def test_recall(spark, data):
    assert QUERIES["p2_recall"](spark, data).first()["recall"] >= 0.9


def test_fill(spark, data):
    row = QUERIES["p3_fill"](spark, data).first()
    assert row["fullest"] <= 512 and row["containers"] >= row["least"] and row["fill"] > 0.85
