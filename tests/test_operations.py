"""Deadlines, isolated hosts, probes, incremental statistics, resume state, account filters and reverse names."""

import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.api import EventLog
from logloom.functions import lookups as L, parse as P
from logloom.messages import MESSAGES, Messages
from logloom.operators import accounts, deadlines, probe, reports, scripts, tables, timeline
from logloom.operators.resume_state import ResumeState, state_key
from logloom.operators.stats_state import MOST_BATCHES, StatsBuilder
from logloom.plans.requests import QueryFailure
from logloom.sources.events import events
from logloom.sources.hosts import scan_hosts
from logloom.sources.state_files import StateFile
from logloom.streaming import watch

SF = "/root/testdata/sf0.001"
T0 = datetime(2026, 2, 10, 10)


def slow(spark, seconds=60.0, rows=4):
    """A table whose tasks sleep: the first partition gives its rows at once."""

    def wait(batches):
        for b in batches:
            if not b.column(0)[0].as_py() == 0:
                time.sleep(seconds)
            yield b

    return spark.range(0, rows, 1, rows).mapInArrow(wait, "id bigint")


def running(spark):
    return [j for j in spark.sparkContext.statusTracker().getActiveJobsIds()]


# ------------------------------------------------------------------------------------ deadlines


def test_work_within_its_time(spark):
    assert deadlines.within(spark, 60, lambda: spark.range(10).count()) == 10
    with pytest.raises(ZeroDivisionError):
        deadlines.within(spark, 60, lambda: 1 // 0)


def test_work_over_its_time_is_cancelled(spark):
    began = time.monotonic()
    with pytest.raises(QueryFailure) as failure:
        deadlines.within(spark, 1.0, lambda: slow(spark).count())
    assert failure.value.kind == "Timeout" and time.monotonic() - began < 12 and not running(spark)
    assert spark.range(5).count() == 5  # other work goes on


def test_work_is_cancelled_when_asked(spark):
    cancel = deadlines.Cancellation()
    cancel.cancel()
    with pytest.raises(QueryFailure) as failure:
        deadlines.within(spark, None, lambda: 1, cancel)
    assert failure.value.kind == "Cancelled"


def test_row_stream(spark):
    table = spark.range(0, 5000, 1, 7)
    with deadlines.RowStream(table, stall=30, ahead=16) as rows:
        assert [r.id for r in rows] == list(range(5000)) and rows.status == "Complete"
    first = deadlines.RowStream(table, limit=3, ahead=2)
    assert [r.id for r in first] == [0, 1, 2] and first.status == "Limit" and not running(spark)
    broken = deadlines.RowStream(table.select(F.raise_error(F.lit("no")).alias("x")))
    with pytest.raises(Exception, match="no"):
        next(broken)
    assert broken.status == "Failed"


def test_stalled_stream_ends_in_its_budget(spark):
    began = time.monotonic()
    some = deadlines.RowStream(slow(spark), stall=2.0)
    assert [r.id for r in some] == [0] and some.status == "Stalled" and not running(spark)
    none = deadlines.RowStream(slow(spark).where("id > 0"), stall=1.0)
    with pytest.raises(QueryFailure) as failure:
        next(none)
    assert failure.value.kind == "Timeout" and none.status == "Stalled" and not running(spark) and time.monotonic() - began < 40
    cancel = deadlines.Cancellation()
    asked = deadlines.RowStream(slow(spark), cancel=cancel)
    assert next(asked).id == 0
    cancel.cancel()
    with pytest.raises(QueryFailure):
        next(asked)
    assert asked.status == "Cancelled" and not running(spark)


# ----------------------------------------------------------------------------------------- hosts


def test_hosts_fail_alone(spark, tmp_path):
    good = spark.range(6).select(F.col("id").alias("record_id"))
    for name in ("a", "b"):
        good.write.parquet(f"file://{tmp_path}/{name}")
    os.makedirs(tmp_path / "c")
    (tmp_path / "c" / "part-0.parquet").write_bytes(b"no parquet at all")
    good.write.parquet(f"file://{tmp_path}/d")
    part = next(p for p in (tmp_path / "d").iterdir() if p.name.endswith(".parquet"))
    data = part.read_bytes()
    part.write_bytes(data[:4] + b"\0" * (len(data) - 100) + data[-96:])  # the footer is whole, the pages are not
    for p in (tmp_path / "d").glob(".*.crc"):
        p.unlink()
    sources = {n: f"file://{tmp_path}/{n}" for n in ("a", "b", "c", "d", "missing")} | {"other": lambda: spark.range(2), "frame": good}
    out = scan_hosts(spark, sources, lambda rows: rows.where("record_id >= 2") if "record_id" in rows.columns else rows, at_once=3)
    assert {(r.host, r["count"]) for r in out.rows.groupBy("host").count().collect()} == {("a", 4), ("b", 4), ("frame", 4)}
    kinds = {r.host: r.kind for r in out.errors.collect()}
    assert set(kinds) == {"c", "d", "missing", "other"} and kinds["missing"] == "NotFound" and kinds["other"] == "InvalidArgument"
    assert out.scanned == ("a", "b", "frame")
    for none in ({}, {" ": good}):
        with pytest.raises(QueryFailure):
            scan_hosts(spark, none)
    assert scan_hosts(spark, {"missing": sources["missing"]}).rows is None


def test_slow_hosts_time_out(spark):
    out = scan_hosts(spark, {"slow": lambda: slow(spark), "fast": spark.range(2)}, seconds=15)
    assert [r.id for r in out.rows.orderBy("id").collect()] == [0, 1] and [(r.host, r.kind) for r in out.errors.collect()] == [("slow", "Timeout")] and not running(spark)


# ----------------------------------------------------------------------------------------- probes

EVENT = "record_id bigint, time_created timestamp_ntz, id int, log_name string, computer_name string"


@pytest.fixture(scope="module")
def log_table(spark, tmp_path_factory):
    """Ten days of 30 records in 3 files a day; the newest 20 records have no time."""
    path = f"file://{tmp_path_factory.mktemp('log')}/t"
    rows = [(i, T0 + timedelta(days=i // 30, minutes=i) if i < 280 else None, i % 5, "Security", f"H{i % 2}") for i in range(300)]
    frame = spark.createDataFrame(rows, EVENT).withColumn("event_date", F.date_add(F.lit("2026-02-10").cast("date"), (F.col("record_id") / 30).cast("int")))
    frame.repartitionByRange(30, "record_id").write.partitionBy("log_name", "event_date").parquet(path)
    spark.createDataFrame([(5000, T0, 1, "System", "H0", T0.date())], EVENT + ", event_date date").write.mode("append").partitionBy("log_name", "event_date").parquet(path)
    return path


def test_probe_opens_the_newest_files_only(spark, log_table):
    found = probe.probe_table(spark, log_table, "Security")
    assert (found.status, found.record_id, found.scanned) == ("Ok", 279, 21) and found.event_time == T0 + timedelta(days=9, minutes=279)
    files = [f for f in probe.data_files(spark, log_table) if f.log == "Security"]
    assert 2 <= found.files <= sum(f.day == "2026-02-19" for f in files) <= 5 and len(files) >= 30
    timed = probe.probe_table(spark, log_table, "System")
    assert (timed.status, timed.record_id, timed.files, timed.scanned) == ("Ok", 5000, 1, 1)
    of_host = probe.probe_table(spark, log_table, "Security", "*[System[EventID=3]]", "h0")
    assert (of_host.status, of_host.record_id) == ("Ok", 278)


def test_probe_states_of_one_table(spark, log_table):
    limit = probe.probe_table(spark, log_table, "Security", most=12)
    assert (limit.status, limit.scanned, limit.event_time) == ("LimitReached", 12, None) and "12" in limit.message
    assert probe.probe_table(spark, log_table, "Application").status == "NoEvent"
    nothing = probe.probe_table(spark, log_table, "Security", "*[System[EventID=77]]")
    assert (nothing.status, nothing.files) == ("NoEvent", len([f for f in probe.data_files(spark, log_table) if f.log == "Security"]))
    assert probe.probe_table(spark, f"{log_table}-missing", "Security").status == "Error"
    waits = F.udf(lambda x: time.sleep(60) is None, "boolean")
    late = probe.probe_table(spark, log_table, "Security", where=waits("record_id"), seconds=1.5)
    assert late.status == "Timeout" and late.seconds < 20 and not running(spark)
    with pytest.raises(QueryFailure):
        probe.probe_table(spark, log_table, " ")


def test_probe_takes_overlapping_files_in_order(spark, tmp_path):
    """Files whose record ids overlap: the newest record may be in the file with the lower largest id's neighbour."""
    path = f"file://{tmp_path}/t"
    for k, ids in enumerate([[1, 50], [40, 45], [2, 49]]):
        rows = [(i, None if i in (50, 49) else T0 + timedelta(minutes=i), 1, "Security", "H") for i in ids]
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)
        assert k < 3
    found = probe.probe_table(spark, path, "Security")
    assert (found.status, found.record_id, found.scanned, found.files) == ("Ok", 45, 3, 3)


# ------------------------------------------------------------------------------------- statistics


def report_of(built):
    return sorted(map(tuple, built.counts.collect())), [tuple(r) for r in built.summary.collect()], sorted(map(tuple, built.levels.collect()))


def test_builder_adds_up(spark, tmp_path):
    b = StatsBuilder(spark, f"file://{tmp_path}/s")
    assert report_of(b.build()) == ([], [(0, None, None)], [])
    common = dict(provider_name="Microsoft-Windows-Security-Auditing")
    b.add(id=4624, time_created=T0, computer_name="DC01", level=4, level_display_name="Information", record_id=1, **common)
    b.add(id=4625, time_created=T0 + timedelta(hours=1), computer_name="dc01", level=2, level_display_name="Error", record_id=2, **common)
    b.add(id=4624, time_created=T0 - timedelta(minutes=30), computer_name="DC02", level=4, level_display_name="Info", record_id=3, provider_name=" ")
    built = b.build()
    assert tuple(built.summary.first()) == (3, T0 - timedelta(minutes=30), T0 + timedelta(hours=1))
    assert [tuple(r) for r in built.top("event_id", 10).collect()] == [(4624, 2), (4625, 1)] and [tuple(r) for r in built.top("computer", 1).collect()] == [("DC01", 2)]
    assert sorted(map(tuple, built.levels.collect())) == [(2, "Error", 1), (4, "Info", 2)] and {(r.key, r["count"]) for r in built.counts.where("dim = 'provider'").collect()} == {("(unknown)", 1), (common["provider_name"], 2)}
    again = StatsBuilder(spark, f"file://{tmp_path}/s")
    again.add(id=1, computer_name="X")
    assert again.build().summary.first().scanned == 4


def test_builder_in_slices_equals_one_pass(spark, tmp_path):
    rows = events(spark, SF)
    whole, parts = StatsBuilder(spark, f"file://{tmp_path}/w"), StatsBuilder(spark, f"file://{tmp_path}/p")
    whole.add_range(rows)
    for k in (2, 0, 1, 0):
        parts.add_range(rows.where(F.col("record_id") % 3 == k), f"slice-{k}")  # slice 0 twice: it counts once
    assert report_of(whole.build()) == report_of(parts.build())
    parts.compact()
    assert report_of(whole.build()) == report_of(parts.build()) and parts.state().count() == whole.state().count()
    assert sorted(map(tuple, whole.build().counts.collect())) == sorted(map(tuple, reports.stats(rows).select("dim", "key", "count").collect()))


def test_builder_on_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k * 10 + i, T0 + timedelta(minutes=i), i % 2, "Security", "H") for i in range(5)], EVENT).withColumns({"provider_name": F.lit("p"), "level": F.lit(4)}).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    b = StatsBuilder(spark, f"file://{tmp_path}/s")
    stream = spark.readStream.schema(EVENT + ", provider_name string, level int").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    stream.writeStream.foreachBatch(b.on_batch).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(90)
    assert b.build().summary.first().scanned == 15
    b.on_batch(spark.createDataFrame([(1, T0, 1, "Security", "H", "p", 4)], EVENT + ", provider_name string, level int"), 1)  # a retried batch
    assert b.build().summary.first().scanned == 15 and MOST_BATCHES > 3


# ---------------------------------------------------------------------------------- resume state


def test_state_file_is_replaced_whole(spark, tmp_path):
    file = StateFile(spark, f"file://{tmp_path}/s.json")
    assert file.read() is None and file.read({}) == {}
    for value in ({"é": 1}, {"b": [1, None]}):
        file.write(value)
        assert file.read() == value
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["s.json"]


def test_resume_loses_and_repeats_nothing(spark, tmp_path):
    key = state_key(None, "Security", ["B", "a"])
    assert key == "security|a|b" == state_key("", "SECURITY", ["A", "b", " "]) and state_key(" k ") == "k"
    with pytest.raises(ValueError):
        state_key()
    rows = [(i, T0, 1, "Security", f"H{i % 2}") for i in range(20)]
    log = lambda n: spark.createDataFrame(rows[:n] + [(None, T0, 9, "Security", "H0")], EVENT)
    seen = []

    def take(batch):
        seen.extend(r.record_id for r in batch.where("record_id is not null").collect())
        if len(seen) == 14 and not stopped:
            stopped.append(True)
            raise RuntimeError("stopped before the state moved")

    stopped = []
    path = f"file://{tmp_path}/state.json"
    assert ResumeState(spark, path).read(log(10), key, take) == 11
    with pytest.raises(RuntimeError):
        ResumeState(spark, path).read(log(14), key, take)
    del seen[10:]  # what the stopped reader had not kept
    ResumeState(spark, path).read(log(14), key, take)
    ResumeState(spark, path).read(log(20), key, take)
    ResumeState(spark, path).read(log(20), key, take)
    assert sorted(seen) == list(range(20)) and ResumeState(spark, path).get(key) == {"Security": {"H0": 18, "H1": 19}}
    ResumeState(spark, path).advance(log(3), key)  # never backwards
    assert ResumeState(spark, path).get(key) == {"Security": {"H0": 18, "H1": 19}}
    assert ResumeState(spark, path).forget(key) and not ResumeState(spark, path).forget(key) and ResumeState(spark, path).table(key).count() == 0


def test_watcher_goes_on_from_its_state(spark, tmp_path):
    spark.createDataFrame([(i, T0, 1, "Security", "H") for i in range(8)], EVENT).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema(EVENT).parquet(f"file://{tmp_path}/in")
    seen = []
    for _ in range(2):  # each with a checkpoint of its own
        w = watch.Watcher("w", None, stream(), lambda df: seen.extend(r.record_id for r in df.collect()), trigger={"availableNow": True}, state=ResumeState(spark, f"file://{tmp_path}/s.json")).start()
        w.query.awaitTermination(60)
        assert w.error is None
        spark.createDataFrame([(i, T0, 1, "Security", "H") for i in range(8, 11)], EVENT).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert sorted(seen) == list(range(11))


def test_watcher_keeps_the_first_error(spark, tmp_path):
    spark.createDataFrame([(1, T0, 1, "Security", "H")], EVENT).write.parquet(f"file://{tmp_path}/in")
    broken = spark.readStream.schema(EVENT).parquet(f"file://{tmp_path}/in").withColumn("x", F.raise_error(F.lit("broken rows")))
    w = watch.Watcher("b", None, broken, lambda df: None, trigger={"availableNow": True}).start()
    w.query.awaitTermination(60)
    assert w.error is not None and "broken rows" in str(w.error)


def test_registry_counts_and_ids_only(spark):
    registry = watch.WatcherRegistry()
    source = spark.read.parquet(f"{SF}/events.parquet")
    raw = spark.readStream.schema(source.schema).parquet(f"{SF}/events*.parquet").select(F.col("event_id").alias("record_id"), F.col("ts").alias("time_created"), F.lit(4740).alias("id"), F.lit("Security").alias("log_name"), F.lit(None).cast("map<string,string>").alias("data_ci"), F.lit("x").alias("provider_name"))
    w = registry.start(watch.Watcher("n", None, watch.matching(raw, named_events=["ADUserLockouts"], ids_only=True), lambda df: None, trigger={"availableNow": True}))
    w.query.awaitTermination(60)
    assert registry.events_found == w.found == source.count()


# ------------------------------------------------------------------------- accounts and addresses

DIMENSION = [("CORP\\Ann", "S-1-5-21-1"), ("Corp\\Bob", "S-1-5-21-2"), ("OTHER\\ann", "S-1-5-21-3"), (None, "S-1-5-21-4"), ("CORP\\None", None)]


def test_accounts_by_name(spark, tmp_path):
    dim = spark.createDataFrame(DIMENSION, "account string, sid string")
    path = f"file://{tmp_path}/e"
    spark.createDataFrame([(i, f"S-1-5-21-{i % 6}") for i in range(60)], "record_id bigint, user_id string").write.parquet(path)
    rows = spark.read.parquet(path)
    ids = lambda *names, **o: sorted({int(r.user_id[-1]) for r in accounts.by_account(rows, dim, list(names), **o).collect()})
    assert ids("ann") == [1, 3] and ids("corp\\ANN ") == [1] and ids("bob", "S-1-5-21-5") == [2, 5] and ids("nobody") == [] and ids("corp\\none") == []
    assert ids("ann", "S-1-5-21-0", most=1) == [0, 1, 3]
    plan = accounts.by_account(rows, dim, ["ann"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(user_id, [S-1-5-21-1,S-1-5-21-3])]" in plan
    with pytest.raises(ValueError):
        accounts.by_account(rows, dim, [" "])


def test_accounts_prune_partitions(spark, tmp_path):
    dim = spark.createDataFrame(DIMENSION, "account string, sid string")
    spark.createDataFrame([(i, f"S-1-5-21-{i % 6}") for i in range(60)], "record_id bigint, user_id string").write.partitionBy("user_id").parquet(f"file://{tmp_path}/p")
    rows = accounts.by_account(spark.read.parquet(f"file://{tmp_path}/p"), dim, ["corp\\bob"])
    shown = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 10 and "user_id" in shown.split("PartitionFilters: [")[1].split("]")[0]


def test_reverse_names_ask_once(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def resolver(address, folder=str(asked)):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(address)
        if address == "10.0.0.3":
            raise OSError("no such host")
        return None if address == "10.0.0.2" else f"host-{address}"

    calls = lambda: sorted(p.read_text() for p in asked.iterdir())
    table = spark.createDataFrame([(i, f" 10.0.0.{i % 4}" if i < 40 else None) for i in range(50)] + [(99, "-")], "i int, ip string").repartition(5)
    named, known = accounts.reverse_names(table, "ip", resolver, now=1000.0)
    found = {r.ip.strip(): r.ip_name for r in named.where("ip is not null and ip != '-'").collect()}
    assert found == {"10.0.0.0": "host-10.0.0.0", "10.0.0.1": "host-10.0.0.1", "10.0.0.2": None, "10.0.0.3": None} and named.count() == 51 and calls() == sorted(found)
    again, known2 = accounts.reverse_names(table, "ip", resolver, known=known, now=2000.0)
    assert again.count() == 51 and known2.count() == 4 and calls() == sorted(found)
    accounts.reverse_names(table, "ip", resolver, known=known, now=9000.0)
    assert calls() == sorted([*found, *found])


# ------------------------------------------------------------------------------- scripts, timeline


def test_scripts_stay_in_their_folder(spark, tmp_path):
    rows = [("../../escaped", "M1", "a"), ("a/b", "M1", "b"), ("a_b", "M1", "c"), ("plain-1", "M1", "d\ne"), ("x" * 300, "M1", "f"), ("..", "..", "g"), ("é:*?\"<>|\\\0", "M2", "h"), ("id\nwith line", "M1", "i")]
    out = tmp_path / "deep" / "er"
    scripts.save_scripts(spark.createDataFrame(rows, "script_id string, machine string, script string"), f"file://{out}", header=False)
    files = {p.name: p.read_text() for p in out.iterdir()}
    assert [p.name for p in tmp_path.rglob("*") if p.is_file()] and all(p.parent == out for p in tmp_path.rglob("*") if p.is_file())
    assert sorted(files.values()) == sorted(f"{t}\n" for *_, t in rows) and all(len(n) < 130 and not n.startswith(".") and ".." not in n for n in files)
    assert files["M1_plain-1.ps1"] == "d\ne\n" and files["M1_a_b.ps1"] == "c\n" and sum(n.startswith("M1_a_b-") for n in files) == 1


def test_executions_across_hosts(spark):
    rows = [(i, T0 + timedelta(minutes=(i * 7) % 50), f"H{i % 3}", 4100, {"CONTEXTINFO": f"User = u{i}"}) for i in range(50)]
    table = spark.createDataFrame(rows, "record_id bigint, time_created timestamp_ntz, computer_name string, id int, data_ci map<string,string>").repartition(4)
    got = {r.record_id: r.execution_index for r in scripts.executions(table, across=True).collect()}
    assert got == {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2], r[0])))}


def test_timeline_without_a_cap(spark):
    rows = [(i, T0 + timedelta(minutes=(i * 7) % 300), "Named", "w", "o", "c", 1, "H") for i in range(300)]
    table = spark.createDataFrame(rows, "record_id bigint, time_created timestamp_ntz, named_event string, who string, object_affected string, computer string, id int, computer_name string").repartition(4)
    every = timeline.timeline_rows(table, max_events=None)
    assert sorted((r.sequence, r.record_id) for r in every.collect()) == [(k + 1, r[0]) for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))]
    assert "SinglePartition" not in every._jdf.queryExecution().executedPlan().toString()
    group = timeline.timeline_groups(timeline.correlated(table)).first()
    assert group.event_count == 300 and group.groups_total == 1
    assert timeline.timeline_rows(table, max_events=5).count() == 5 == timeline.timeline_rows(table, max_events=5).agg(F.max("sequence")).first()[0]


# --------------------------------------------------------------------- inventory and messages


def test_known_fields_and_keys(spark, monkeypatch):
    row = spark.createDataFrame([({"CLIENTIP": " 1.2.3.4 ", "#TEXT": "t", "A": "x"},)], "data_ci map<string,string>")
    shown = row.select(P.known(F.col("data_ci"), "ClientIp").alias("a"), P.known(F.col("data_ci"), "TextPayload").alias("b"), P.known(F.col("data_ci"), "HwAddress").alias("c")).first()
    assert tuple(shown) == ("1.2.3.4", "t", "") and len(L.KNOWN_FIELDS) == 31 and L.NAS_PORT_TYPE["FTTP"] == 27 and L.AUTHENTICATION_TYPE["EAP"] == 5
    with pytest.raises(ValueError):
        P.known(F.col("data_ci"), "Nothing")
    assert tables.data_keys(row, "data_ci") == ["#TEXT", "A", "CLIENTIP"]
    monkeypatch.setattr(tables, "MOST_KEYS", 2)
    with pytest.raises(ValueError, match="more than 2 keys"):
        tables.data_keys(row, "data_ci")


def test_catalog_pages(spark):
    names = spark.createDataFrame([("b",), ("A",), ("a",), (" ",), (None,)], "name string")
    page = lambda most: [(r.name, r.truncated) for r in tables.catalog_page(names, "name", most=most).collect()]
    assert page(1) == [("A", True)] and page(2) == [("A", True), ("b", True)] and page(3) == [("A", False), ("b", False)]


def test_top_rows(spark):
    counts = spark.createDataFrame([("b", 2), ("A", 2), ("c", 5)], "key string, count bigint")
    assert [(r.key, r["count"]) for r in reports.keyed_top(counts, 2, "user").collect()] == [({"user": "c"}, 5), ({"user": "A"}, 2)]
    assert [r.cells for r in reports.preview_top(counts, 3).collect()] == [["c", "5"], ["A", "2"], ["b", "2"]] and reports.preview_top(counts, 0).count() == 0
    with pytest.raises(ValueError):
        reports.keyed_top(counts, 2, " ")


def test_log_details_of_files(spark, log_table):
    policies = spark.createDataFrame([("Security", "Circular", 10), ("System", "Retain", 1 << 30), ("None", "?", 5)], "log_name string, mode string, maximum_bytes bigint")
    files = spark.read.parquet(log_table).withColumn("provider_name", F.when(F.col("record_id") % 2 == 0, "P").otherwise("p"))
    out = {r.log_name: r for r in tables.log_details(files, policies).collect()}
    sizes = {}
    for f in probe.data_files(spark, log_table):
        sizes[f.log] = sizes.get(f.log, 0) + os.path.getsize(f.path.removeprefix("file:"))
    assert (out["Security"].size_bytes, out["System"].size_bytes, out["None"].size_bytes) == (sizes["Security"], sizes["System"], 0)
    assert (out["Security"].is_full, out["System"].is_full, out["Security"].record_count, out["None"].record_count) == (True, False, 300, 0)
    assert [out[n].event_action[:6] for n in ("Security", "System", "None")] == ["Overwr", "DoNotO", "Unknow"] and out["Security"].providers == ["P"]


def test_classic_log_state(spark):
    logs = spark.createDataFrame([("Application", 512, "OverwriteAsNeeded", 7)], "log_name string, maximum_kb int, overflow_action string, retention_days int")
    sources = spark.createDataFrame([("MyApp", "Application"), ("Other", "Custom")], "source_name string, log_name string")
    wanted = spark.createDataFrame([("application", "MYAPP"), ("Custom", "Other"), ("application", "none")], "log_name string, source_name string")
    out = {(r.log_name, r.source_name): r for r in tables.classic_log_state(wanted, logs, sources).collect()}
    first = out["application", "MYAPP"]
    assert (first.log_exists, first.source_exists, first.source_registered_log_name, first.maximum_kilobytes, first.log_display_name) == (True, True, "Application", 512, "Application")
    assert (out["Custom", "Other"].log_exists, out["Custom", "Other"].source_registered_log_name, out["application", "none"].source_exists) == (False, "Custom", False)


def test_messages(spark, tmp_path, capsys):
    log = Messages(("warning",))
    seen = []
    remove = log.listen("warning", seen.append)
    log.listen("warning", lambda m: 1 // 0)
    log.write("warning", "one")
    remove()
    log.write("warning", "two")
    assert [m.text for m in seen] == ["one"] and "[warning] two" in capsys.readouterr().err
    with log.gathered() as found:
        log.progress("work", "part", 1, 3)
        log.write("debug", "x")
    assert [(m.kind, m.percent) for m in found] == [("progress", 33), ("debug", None)]
    for wrong in (lambda: log.write("loud", "x"), lambda: log.listen("loud", print)):
        with pytest.raises(ValueError):
            wrong()
    with MESSAGES.gathered("warning", "progress") as found:
        scan_hosts(spark, {"here": spark.range(2), "gone": f"file://{tmp_path}/gone"})
    assert [(m.kind, m.operation) for m in found if m.kind == "progress"] == [("progress", "here")] and any(m.kind == "warning" and m.text.startswith("gone: ") for m in found)


def test_entry_point(spark, tmp_path):
    log = EventLog(events(spark, SF))
    assert len(log.get_list(max_events=4, seconds=60)) == 4
    with log.stream_rows(max_events=5, stall=60) as rows:
        assert len(list(rows)) == 5
    directory = spark.createDataFrame([("CORP\\a", "S-1-5-21-1")], "account string, sid string")
    assert {r.user_id for r in log.of_accounts(directory, ["A"]).events.select("user_id").distinct().collect()} == {"S-1-5-21-1"}
    state, seen = ResumeState(spark, f"file://{tmp_path}/s.json"), []
    assert log.read_new(state, "k", lambda df: seen.append(df.count())) == seen[0] == 1000 and log.read_new(state, "k", lambda df: seen.append(0)) == 0
    assert log.stats_builder(f"file://{tmp_path}/st").build().summary.first().scanned == 1000
    wanted = spark.createDataFrame([("Security", "DC1"), ("Security", "DC9")], "log_name string, computer_name string")
    assert {r.computer_name: r.status for r in log.probe(wanted).collect()} == {"DC1": "Ok", "DC9": "NoEvent"} and log.get_executions(across=True).count() == 0
