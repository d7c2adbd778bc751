"""Watchers on file streams."""

import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from logloom.streaming import watch

SF = "/root/testdata/sf0.001"


def stream(spark):
    source = spark.read.parquet(f"{SF}/events.parquet")
    raw = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{SF}/events*.parquet")
    return raw.select(F.col("event_id").alias("record_id"), F.col("ts").alias("time_created"), (F.col("event_id") % 5).cast("int").alias("id"), F.lit("Security").alias("log_name"))


def ended(w):
    for _ in range(200):
        if w.wait(0.2) and not (w.query and w.query.isActive):
            return True
        time.sleep(0.1)
    return False


def test_watch_all_available(spark):
    seen = []
    w = watch.Watcher("a", None, watch.matching(stream(spark), "Security", [1]), lambda df: seen.append(df.count()), trigger={"availableNow": True}).start()
    w.query.awaitTermination(60)
    assert sum(seen) == w.found == spark.read.parquet(f"{SF}/events.parquet").where("event_id % 5 = 1").count()


def test_stop_after_never_overshoots(spark):
    seen = []
    w = watch.Watcher("b", None, watch.matching(stream(spark), event_ids=[1]), lambda df: seen.append(df.count()), stop_after=3).start()
    assert ended(w) and sum(seen) == w.found == 3


def test_action_error_ends(spark):
    def broken(df):
        raise RuntimeError("no")

    w = watch.Watcher("c", None, stream(spark), broken, stop_on_match=True).start()
    assert ended(w) and isinstance(w.error, RuntimeError)


def test_registry_and_timeout(spark):
    registry = watch.WatcherRegistry()
    first = registry.start(watch.Watcher("Same", None, watch.matching(stream(spark), event_ids=[99]), lambda df: None))
    assert registry.start(watch.Watcher("same", None, stream(spark), lambda df: None)) is first
    assert registry.get("SAME") == [first] and registry.stop_by_name("same") == 1 and registry.get() == []
    timed = registry.start(watch.Watcher("t", None, watch.matching(stream(spark), event_ids=[99]), lambda df: None, timeout=timedelta(seconds=1)))
    assert ended(timed)
    assert registry.stop(timed.id) and not registry.stop(timed.id) and registry.stop_all() == 0


def test_staging_ids():
    assert watch.watched_ids([1, 5], True) == [1, 5, 350]


@pytest.mark.parametrize("make", [watch.bucket_counts, watch.dedup_stream])
def test_stream_aggregates(spark, make):
    q = make(stream(spark)).writeStream.format("memory").queryName(f"m_{make.__name__}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table(f"m_{make.__name__}").count() > 0
