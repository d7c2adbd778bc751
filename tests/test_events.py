"""Goldens of the event operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.functions import decode as D, lookups as L, parse as P, periods
from logloom.operators import filters, reports, scripts, tables, timeline
from logloom.operators.filters import FilterSpec
from logloom.plans import profiles, requests, rules, xpath
from logloom.schema import conform
from logloom.sources import xml_events

NOW = datetime(2026, 2, 20, 12, 34, 56)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def event(spark, **fields):
    from pyspark.sql import types as T

    known = {"id": "int", "log_name": "string", "provider_name": "string", "message": "string", "message_subject": "string", "computer_name": "string", "record_id": "bigint", "data": "map<string,string>"}
    schema = ", ".join(f"{k} {known[k]}" for k in fields)
    assert T
    return conform(spark.createDataFrame([tuple(fields.values())], schema).withColumn("time_created", F.lit(NOW).cast("timestamp_ntz")))


def test_ticket_request(spark):
    data = {"TargetUserName": "u", "TicketOptions": "0x40810010", "Status": "0x0", "TicketEncryptionType": "0x12", "PreAuthType": "2", "IpAddress": "::ffff:192.168.241.15"}
    row = rules.project(event(spark, id=4768, log_name="Security", provider_name="Microsoft-Windows-Security-Auditing", data=data), "KerberosTGTRequest").first()
    assert row.IpAddress == "192.168.241.15" and "AES256" in row.TicketEncryptionTypeText and "0x00000000" in row.StatusText
    assert all(w in row.TicketOptionsText for w in ("Forwardable", "Renewable", "0x40810010")) and "Password" in row.PreAuthTypeText


def test_failed_logon(spark):
    data = {"WorkstationName": "CLIENT01", "LogonType": "3", "Status": "0xC000006D", "SubStatus": "0xC0000072", "FailureReason": "%%2304", "AuthenticationPackageName": "NTLM"}
    row = rules.project(event(spark, id=4625, log_name="Security", provider_name="x", data=data), "ADUserLogonFailed").first()
    assert (row.LogonType, row.Status, row.SubStatus, row.FailureReason, row.Who, row.PackageName) == ("Network", "StatusLogonFailure", "StatusAccountDisabled", "UnknownUserNameOrBadPassword", "CLIENT01", "NTLM")
    assert row.FailureDescription.count("\n") == 2


def test_dispatch_first_name_wins_and_checks_ids(spark):
    frame = event(spark, id=4624, log_name="Security", provider_name="x", data={"LmPackageName": "ntlm v1"})
    assert rules.classify(frame, ["ADUserLogon", "ADUserLogonNTLMv1"]).first().named_event == "ADUserLogon"
    assert rules.classify(frame, ["ADUserLogonNTLMv1", "ADUserLogon"]).first().named_event == "ADUserLogonNTLMv1"
    assert rules.classify(frame, ["OSBugCheck", "AADSyncProvisionCredentialsPing"]).count() == 0
    plan = rules.scan_plan(["OSStartup", "OSShutdown", "OSUncleanShutdown", "OSStartupSecurity", "OSCrashOnAuditFailRecovery"])
    assert plan == {"System": {12, 13, 41}, "Security": {4608, 4621}}


def test_register_rule(spark):
    spec = rules.RuleSpec("Mine", "App", (7,), "C;T;Thing=A", rules.value_is("A", "B"))
    rules.register_rule(spec, replace=True)
    try:
        assert rules.project(event(spark, id=7, log_name="App", data={"a": "b"}), "Mine").first().Thing == "b"
        with pytest.raises(ValueError):
            rules.register_rule(spec)
    finally:
        rules.RULES.pop("Mine")


def test_messages(spark):
    message = F.lit("Subject line\r\nKey: value:with:colon\r\nAnother: entry\r\nkey: last")
    assert one(spark, P.message_subject(message)) == "Subject line"
    assert {k.lower(): v for k, v in one(spark, P.message_map(message)).items()} == {"message": "Subject line", "key": "last", "another": "entry"}
    lines = P.message_lines(F.lit("first\n second \nthird"))
    assert [one(spark, P.message_line(lines, i)) for i in (1, -1, 99)] == ["second", "third", ""]
    assert one(spark, P.message_lines(F.lit(""))) == []


def test_join_accessor_joins(spark):
    a, b, n = F.lit("x"), F.lit("y"), F.lit(None).cast("string")
    assert [one(spark, P.joined(*p)) for p in ((a, b), (a, n), (n, b), (n, n))] == ["x\\y", "x", "y", ""]


def test_xml(spark):
    doc = "<Event><System><EventID>5</EventID></System><EventData><Data Name='A'>1</Data><Data>x</Data><Data> </Data><Data>k: v</Data><Data Name='a'>2</Data></EventData></Event>"
    user = "<Event><UserData><Thing xmlns='u'><Path>p</Path></Thing></UserData></Event>"
    rows = xml_events.parse_xml(spark.createDataFrame([(doc,), (user,), ("<broken",), (None,)], "xml_data string")).select("data").collect()
    assert [r.data for r in rows] == [{"NoNameA0": "x", "NoNameA1": "k: v", "a": "2", "k": "v"}, {"Path": "p"}, {}, {}]


def test_xml_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<Events><Event><System><Provider Name='P'/><EventID>9</EventID><Level>2</Level><TimeCreated SystemTime='2024-01-02T03:04:05.1234567Z'/><EventRecordID>3</EventRecordID><Channel>System</Channel></System><EventData><Data Name='K'>v</Data><Binary>0x4142</Binary></EventData></Event></Events>")
    row = xml_events.read_xml(spark, f"file://{tmp_path}").first()
    assert (row.id, row.record_id, row.provider_name, row.level_display_name, row.data, bytes(row.attachments[0])) == (9, 3, "P", "Error", {"K": "v"}, b"AB")
    assert row.time_created == datetime(2024, 1, 2, 3, 4, 5, 123456)


def test_attachments(spark):
    got = [one(spark, P.attachment(F.lit(x))) for x in ("0x41 42", "QUI=", "414", "?")]
    assert [bytes(g) if g is not None else None for g in got[:2]] == [b"AB", b"AB"] and got[3] is None


def test_xpath_text():
    build = lambda **k: xpath.build_xpath(FilterSpec(**k))
    assert build(event_ids=(1, 2)) == "*[System[(EventID=1) or (EventID=2)]]"
    assert build() == "*"
    assert build(named_data={"A": ("x", "y")}) == "*[EventData[(Data[@Name='A'] = 'x') or (Data[@Name='A'] = 'y')]]"
    assert build(named_data_exclude={"A": ("x", "y")}) == "*[EventData[(Data[@Name='A'] != 'x') and (Data[@Name='A'] != 'y')]]"
    assert "&amp;" in build(providers=("a&b",)) and build(keywords=(1, 4)) == "*[System[band(Keywords,5)]]"
    assert xpath.build_xpath(FilterSpec(start=NOW + timedelta(days=1)), NOW) == "*[System[TimeCreated[timediff(@SystemTime) &lt;= 0]]]"
    assert xpath.build_query_list(FilterSpec(event_ids=(1, 2)), path="c:\\a.evtx").startswith('<QueryList><Query Id="0" Path="file://c:\\a.evtx"><Select>')


def test_xpath_reads_what_it_builds(spark):
    frame = event(spark, id=2, log_name="S", provider_name="Pp", data={"A": "x"}, record_id=1)
    specs = [dict(event_ids=(1, 2)), dict(event_ids=(3,)), dict(providers=("pp",)), dict(named_data={"a": ("x",)}), dict(named_data_exclude={"a": ("x",)}), dict(named_data_exclude={"a": ("y",)}), dict(data_values=("x",)), dict(event_ids=(2,), providers=("q",))]
    for s in specs:
        spec = FilterSpec(**s)
        assert frame.where(xpath.xpath_column(xpath.build_xpath(spec))).count() == frame.where(filters.to_column(spec)).count(), s
    with pytest.raises(ValueError):
        xpath.xpath_column("*[System[Nonsense=1]]")


def test_periods():
    assert periods.resolve("PastHour", NOW) == (datetime(2026, 2, 20, 11), datetime(2026, 2, 20, 12), None)
    assert periods.resolve("Last7Days", NOW)[0] == datetime(2026, 2, 13)
    assert periods.resolve("Today", NOW)[:2] == (datetime(2026, 2, 20), datetime(2026, 2, 21))
    assert periods.resolve("PastQuarter", NOW)[:2] == (datetime(2025, 10, 1), datetime(2026, 1, 1))
    assert periods.resolve("TillLastFriday", NOW)[0] == NOW and periods.resolve("TillLastMonday", NOW)[0] == NOW - timedelta(days=4)
    with pytest.raises(ValueError):
        periods.resolve("Someday", NOW)


def test_structured_filter():
    ok = requests.structured_filter(event_ids=[3, 1, 3], level="warn", keywords="audit_failure", named_data={"K": ["a", "A"]})
    assert ok.event_ids == (3, 1) and ok.levels == (3,) and ok.keywords == (4503599627370496,) and ok.named_data == {"K": ("a", "A")}
    assert requests.structured_filter(keywords="none").keywords == () and requests.structured_filter(level="any").levels == ()
    bad = [dict(event_ids=range(1, 258)), dict(event_ids=[0]), dict(level="-1"), dict(level="loud"), dict(keywords="+5"), dict(named_data_exclude={"K": []}), dict(provider="a\tb"), dict(start=NOW, end=NOW - timedelta(1)), dict(named_data={"": ["x"]})]
    for b in bad:
        with pytest.raises(requests.QueryFailure) as e:
            requests.structured_filter(**b)
        assert e.value.kind == "InvalidArgument" and e.value.descriptor()["error_code"] == "invalid_argument"


def test_requests():
    r = requests.security_request(" p ", max_scanned=10**9, top=0, sample_size=999)
    assert (r.path, r.max_scanned, r.top, r.sample_size) == ("p", 200_000, 20, 200)
    with pytest.raises(requests.QueryFailure):
        requests.security_request("")
    t = requests.timeline_request(requests.TimelineRequest(("A",), bucket_minutes=9999, max_groups=9999), {"A"})
    assert (t.bucket_minutes, t.max_groups) == (1440, 2000)
    for bad in (requests.TimelineRequest(()), requests.TimelineRequest(("B",)), requests.TimelineRequest(("A",), keys=("nope",))):
        with pytest.raises(requests.QueryFailure):
            requests.timeline_request(bad, {"A"})
    assert requests.QueryFailure.of(OSError("Path does not exist: x")).kind == "NotFound"


def test_profiles():
    assert profiles.resolve_profile(" Actor-Activity ") == ("who", "action") and profiles.snake_case("ObjectAffected2") == "object_affected_2"
    for bad in ("-", "___", "x"):
        with pytest.raises(ValueError):
            profiles.resolve_profile(bad)


def test_stats_golden(spark):
    rows = [(1, datetime(2026, 2, 10, 10), 4624, "P", "DC01", 4), (2, datetime(2026, 2, 10, 9, 30), 4625, "P", "dc01", 2), (3, datetime(2026, 2, 10, 11), 4624, "P", "DC02", 4)]
    frame = spark.createDataFrame(rows, "record_id bigint, time_created timestamp, id int, provider_name string, computer_name string, level int")
    s = reports.summary(frame).first()
    assert (s.scanned, s.min_utc, s.max_utc) == (3, datetime(2026, 2, 10, 9, 30), datetime(2026, 2, 10, 11))
    assert {(r.dim, r.key, r["count"]) for r in reports.stats(frame).collect()} == {("event_id", "4624", 2), ("event_id", "4625", 1), ("computer", "dc01", 2), ("computer", "DC02", 1), ("provider", "P", 3), ("level", "4", 2), ("level", "2", 1)}
    assert reports.top(reports.count_number(frame, "id"), 1, text=False).first().key == 4624 and reports.top(reports.count_number(frame, "id"), 0).count() == 0


def test_decoders(spark):
    get = lambda c: one(spark, c)
    assert get(D.decode_uac(F.lit("0x202"))) == "ACCOUNTDISABLE, NORMAL_ACCOUNT" and get(D.decode_uac(F.lit("-"))) == "" and get(D.decode_uac(F.lit("%%x"))) == ""
    assert get(D.enum_name(D.decode_enum(F.lit("%%1833"), L.IMPERSONATION_LEVEL), L.IMPERSONATION_LEVEL)) == "Impersonation"
    assert get(D.enum_name(D.decode_enum(F.lit("77"), L.LOGON_TYPE), L.LOGON_TYPE)) == "77" and get(D.decode_enum(F.lit("zz"), L.LOGON_TYPE)) is None
    assert get(D.unlabeled_timestamp(F.lit("2/3/2024"), F.lit("4:05:06 PM"))) == datetime(2024, 2, 3, 16, 5, 6)
    assert get(D.parse_utc(F.lit("2026-02-20T12:34:56+02:00"))) == datetime(2026, 2, 20, 10, 34, 56) and get(D.parse_utc(F.lit("not-a-timestamp"))) is None
    links = get(D.gpo_links(F.lit("[LDAP://cn={AB},dc=x;0][LDAP://cn={CD},dc=x;1]")))
    assert [(x.is_enabled, x.guid) for x in links] == [(True, "AB"), (False, "CD")]
    assert get(D.word_counts(F.lit("Adds: 3 Deletes: 4"))) == {"Adds": 3, "Deletes": 4}
    assert get(D.kerberos_policy(F.lit("KerMaxT: 0x53d1ac1000 (0x0); KerOpts: 0x80 ;"))) == {"KerMaxT": 10.0, "KerOpts": 1.0}
    assert get(D.format_script(F.lit("if (x) {\ny\n}\n}"))) == "if (x) {\n    y\n}\n}"
    assert get(D.authentication_type(F.lit("mschapV2"))) == "MSCHAPv2" and get(D.authentication_type(F.lit("?"))) == "Unknown"
    assert get(D.endpoint(F.lit("[::1]:389"))).asDict() == {"ip": "::1", "port": "389"} and get(D.bind_type(F.lit(""))) == "Unknown"
    assert get(D.first_int(F.lit("x"), F.lit(" 7 "))) == 7 and get(D.convert_size(F.lit(-1))) == 0.0


def test_timeline(spark):
    rows = [(i, datetime(2026, 1, 1, 0, 7 * i), "N" if i % 2 else "M", 1, "L", "pc", None if i == 5 else "a", "b", "pc") for i in range(6)]
    frame = spark.createDataFrame(rows, "record_id bigint, time_created timestamp, named_event string, id int, log_name string, computer_name string, who string, object_affected string, computer string").withColumn("time_created", F.col("time_created").cast("timestamp_ntz"))
    built = timeline.build(frame, max_events=5, bucket_minutes=15)
    assert [r.sequence for r in built.rows.orderBy("sequence").collect()] == [1, 2, 3, 4, 5]
    group = built.groups.first()
    assert (group.event_count, group.duration_minutes, group.named_events, group.groups_total) == (5, 28.0, ["M", "N"], 1)
    assert [(r.bucket_start.minute, r.event_count) for r in built.buckets.collect()] == [(0, 3), (15, 2)]
    assert built.counters.first().n_kept == 6


def test_scripts(spark, tmp_path):
    parts = spark.createDataFrame([("a", 2, 2, "B", 1), ("a", 1, 2, "A", 2), ("a", 1, 2, "Z", 3), ("a", 0, 2, "meta", 4), ("a", 3, 2, "over", 5), ("b", 1, 1, "0", 6), (None, 1, 1, "x", 7)], "script_id string, number int, total int, text string, seq int").withColumn("machine", F.lit("pc"))
    out = scripts.reassemble(parts)
    assert [(r.script_id, r.n_parts, r.script) for r in out.collect()] == [("a", 2, "ZB")]
    assert scripts.reassemble(parts, ["zb"]).count() == 1 and scripts.reassemble(parts, ["q"]).count() == 0
    scripts.save_scripts(out, f"file://{tmp_path}/s")
    assert spark.read.text(f"file://{tmp_path}/s").count() == 2


def test_tables(spark, tmp_path):
    frame = event(spark, id=2, log_name="S", provider_name="Pp", data={"b": "1", "A": "x"}, record_id=1)
    assert tables.data_keys(frame) == ["A", "b"] and tables.flatten(frame.select("id", "data")).first().asDict() == {"id": 2, "A": "x", "b": "1"}
    tables.write_events(frame.select("id", "log_name", "time_created"), f"file://{tmp_path}/t")
    back = spark.read.parquet(f"file://{tmp_path}/t")
    assert back.count() == 1 and tables.file_information(back).first().record_count == 1
    found = tables.subscription("<Subscription><Description> d </Description><Query><Select>a</Select><Select> b </Select></Query></Subscription>")
    assert (found["description"], found["queries"]) == ("d", ["a", "b"]) and "\n" not in found["canonical"]
    for bad in ("<!DOCTYPE x><Subscription/>", "<Other/>"):
        with pytest.raises(ValueError):
            tables.subscription(bad)


def test_filters_push_down(spark):
    from logloom.sources.events import events

    plan = events(spark, "/root/testdata/sf0.001").where(filters.to_column(FilterSpec(start=datetime(2024, 1, 5), end=datetime(2024, 1, 6)))).select("record_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "props" not in plan.split("ReadSchema")[1]
