"""The entry point over an event table."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.api import EventLog, spec
from logloom.operators import tables
from logloom.plans.requests import QueryFailure, TimelineRequest, security_request
from logloom.sources.events import events, with_data

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return EventLog(with_data(events(spark, SF)))


def test_get_events(log):
    newest = log.get_list(spec(event_ids=(4625,)), max_events=5)
    assert len(newest) == 5 and newest[0].time_created >= newest[-1].time_created and {r.id for r in newest} == {4625}
    assert log.get_events(query="*[System[(EventID=4625)]]").count() == log.get_events(spec(event_ids=(4625,))).count()
    assert log.get_events(named_events=["ADUserLockouts"], max_events=3).count() == 3
    assert "TargetUserName" in log.get_events(spec(event_ids=(4740,)), expand=True).columns
    assert log.get_events(max_events=2, per_host=True).count() == 10
    state = tables.next_state(log.events)
    assert log.get_events(state=state).count() == 0


def test_inventory(log):
    assert log.get_info().first().record_count == 1000 and log.get_logs("sec*").count() == 1 and log.get_providers("audit", 1).count() == 1
    assert log.probe().first().status == "Ok" and log.get_scripts().count() == 0 and log.get_executions().count() == 0
    assert {r.dim for r in log.stats().collect()} == {"event_id", "provider", "computer", "level"}
    seen = []
    assert tables.for_each(log.events.orderBy("record_id"), lambda r: seen.append(r.id) or len(seen) < 4) == 4
    policies = log.spark.createDataFrame([("System", True), ("app", False), ("Security", True)], "name string, enabled boolean")
    assert [r.name for r in tables.named_rows(policies, patterns=["s*"], enabled_only=True).collect()] == ["Security", "System"]
    assert [r.name for r in tables.named_rows(policies, contains="P").collect()] == ["app"]


def test_reports(log):
    top, samples = log.security_report("failed_logons", security_request("x", top=2, include_samples=True, sample_size=3))
    assert samples.count() == 3 and top.groupBy("dim").count().agg(F.max("count")).first()[0] <= 2
    built = log.timeline(TimelineRequest(("ADUserLogonFailed", "ADUserLogon"), max_events=50))
    assert built.rows.count() == 50 and built.groups.count() > 0 and built.buckets.agg(F.sum("event_count")).first()[0] == 50
    with pytest.raises(QueryFailure):
        log.timeline(TimelineRequest(("Nothing",)))


def test_filters_and_write(log, tmp_path):
    assert log.get_filter(log.check_filter(event_ids=[1]), xpath_only=True) == "*[System[EventID=1]]"
    log.write(f"file://{tmp_path}/t")
    back = EventLog(log.spark.read.parquet(f"file://{tmp_path}/t"))
    assert back.get_events(spec(start=datetime(2024, 1, 5), end=datetime(2024, 1, 6))).count() == log.get_events(spec(start=datetime(2024, 1, 5), end=datetime(2024, 1, 6))).count() > 0
    assert log.with_events(log.events.limit(1)).watchers is log.watchers
