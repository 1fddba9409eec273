"""Every query of the core against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from rankloom.plans import oracle as sql
from rankloom.plans import queries as core
from tests.oracle import connection, rows_of_spark, rows_of_sql

QUERIES, SQL = core.queries(), sql.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name not in SQL:
        assert df.count() > 0
        return
    names, expected = rows_of_sql(connection(data), SQL[name])
    assert sorted(df.columns) == names
    assert rows_of_spark(df) == expected


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
