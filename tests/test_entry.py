"""The driver's contract."""

import __spark_entry__ as entry
from logloom.queries import ORACLE, QUERIES


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["key", "count"] and out.count() == 10


def test_queries_and_sql():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())
