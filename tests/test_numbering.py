"""Global and grouped numbers against plain sorting."""

import random

from pyspark.sql import functions as F

from logloom.operators.numbering import numbered


def rows_of(n):
    r = random.Random(5)
    return [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(n // 2)]), i) for i in range(n)]


def test_numbers_of_a_table(spark):
    rows = rows_of(3000)
    table = spark.createDataFrame(rows, "g string, t int, i int").repartition(7)
    got = {r.i: r.n for r in numbered(table, [(F.col("t"), "desc_nulls_last"), (F.col("i"), "asc_nulls_last")], name="n").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
    assert got == {r[2]: k + 1 for k, r in enumerate(want)}


def test_numbers_of_groups(spark):
    rows = rows_of(3000)
    table = spark.createDataFrame(rows, "g string, t int, i int").repartition(7)
    out = numbered(table, [(F.col("t"), "asc_nulls_first"), (F.col("i"), "asc_nulls_last")], ["g"])
    got = {r.i: r.number for r in out.collect()}
    want = {}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: k + 1 for k, r in enumerate(own)}
    assert got == want and out.columns == ["g", "t", "i", "number"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_numbers_of_awkward_tables(spark):
    empty = spark.createDataFrame([], "a int, `b.c` string, _id int")
    assert numbered(empty, [(F.col("a"), "asc")]).count() == 0 and numbered(empty, [(F.col("a"), "asc")], ["a"]).count() == 0
    same = spark.createDataFrame([(1, "x", 2)] * 5, empty.schema)
    out = numbered(same, [(F.col("`b.c`"), "asc")])
    assert sorted(r.number for r in out.collect()) == [1, 2, 3, 4, 5] and out.columns == ["a", "b.c", "_id", "number"]
