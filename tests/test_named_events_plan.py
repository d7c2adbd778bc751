"""All named events at size: no map of data is built, equal values are counted before anything is sorted."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.log_queries import field_summary, named_event_fields, named_events_all
from logloom.plans import rules
from logloom.schema import conform
from logloom.sources.mixed_log import PLACES, WORDS, keys, value_list, value_sql

SF = "/root/testdata/sf0.001"


def test_value_lists_equal_the_sql(spark):
    orders = spark.range(500).selectExpr("id AS o_orderkey", "if(id % 50 = 7, null, id * 7 % 83) AS o_custkey")
    placed = orders.selectExpr("*", *PLACES.replace(" AS plain_at, ", " AS plain_at|").split("|"))
    wrong = []
    for key in keys():
        listed = F.get(F.array(*map(F.lit, value_list(key))), F.col("word_at" if key in WORDS else "plain_at"))
        want = F.expr(value_sql(key, True).replace("\\", "\\\\"))
        if key in WORDS:  # a null place has no word, as in DuckDB; Spark's element_at() takes some
            want = F.when(F.col("o_custkey").isNotNull(), want)
        wrong.append(F.count_if(~listed.eqNullSafe(want)).alias(key))
    assert {k: n for k, n in placed.agg(*wrong).first().asDict().items() if n} == {}


def plan(df, kind: str) -> str:
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.mark.parametrize("query", [named_event_fields, named_events_all])
def test_no_data_map_is_built(spark, query):
    found = plan(query(spark, SF), "optimizedPlan")
    assert "data_ci" not in found and "map_filter" not in found


def test_events_are_counted_without_sorting_them(spark):
    lines = plan(named_event_fields(spark, SF), "executedPlan").split("\n")
    below = [x for x in lines if "Aggregate(" in x or "Generate " in x]
    assert "Generate" in below[-1] and "HashAggregate(" in below[-2]


def test_first_rule_of_many_is_asked_once(spark):
    frame = conform(spark.createDataFrame([(1, 4624, "Security", "x"), (2, 1, "Security", "x")], "record_id bigint, id int, log_name string, provider_name string"))
    made = rules.classify(frame, list(rules.RULES)).select("record_id", "named_event")
    assert plan(made, "optimizedPlan").count("THEN AADConnectRunProfile END") == 1
    assert [tuple(r) for r in made.collect()] == [(1, "ADUserLogon")]


def test_times_of_any_year_compare_as_texts(spark):
    times = ["0999-05-05 01:02:03.5", "1997-08-13 13:45:30", "12000-01-01 00:00:00", None]
    made = spark.createDataFrame([(i, 4660, "Security", t) for i, t in enumerate(times)], "record_id bigint, id int, log_name string, t string")
    found = made.withColumn("time_created", F.when(F.col("record_id") == 2, F.lit(datetime(9999, 1, 1)).cast("timestamp_ntz") + F.expr("INTERVAL '2001' YEAR")).otherwise(F.col("t").cast("timestamp_ntz")))
    when = {r.field: r for r in field_summary(conform(found.drop("t"))).where("named_event = 'ObjectDeletion'").collect()}["When"]
    texts = [r[0] for r in found.select(F.col("time_created").cast("string")).collect() if r[0] is not None]
    assert (when.events, when.given, when.least, when.greatest, when.chars) == (4, 3, min(texts), max(texts), sum(map(len, texts)))
