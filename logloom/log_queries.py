"""Queries over events of many logs (sources.mixed_log): all named events with their plain fields, all periods, probes and catalogs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from .functions import periods
from .operators import filters, probe, reports as R, tables
from .operators.filters import FilterSpec
from .plans import rules
from .queries import query
from .sources.mixed_log import MOMENT, duckdb_log, log_with_data, mixed_log, plain_fields

_LOG = duckdb_log()


def _log_query(sql: str):
    return query(_LOG + sql, evt=False)


# ------------------------------------------------------------------------------- named events


def _provider(*names: str) -> str:
    return f"upper(provider_name) IN ({', '.join(repr(n.upper()) for n in names)})"


def _is(key: str, *values: str) -> str:
    return f"""upper("{key}") IN ({", ".join(repr(v.upper()) for v in values)})"""


_EVENTLOG = _provider("EventLog", "Microsoft-Windows-Eventlog")
_AUDIT = _provider("Microsoft-Windows-Security-Auditing")
_SYNC = _provider("Directory Synchronization")
_KERNEL = _provider("Microsoft-Windows-Kernel-General")
_GPC = _is("OBJECTCLASS", "groupPolicyContainer")
_POLICY = f"({_provider('Microsoft-Windows-GroupPolicy')} OR log_name = 'Microsoft-Windows-GroupPolicy/Operational')"
_DRIVER_OF = """coalesce(CASE WHEN trim("DRIVERNAME") <> '' THEN "DRIVERNAME" END, CASE WHEN trim("SERVICENAME") <> '' THEN "SERVICENAME" END, CASE WHEN trim("PARAM1") <> '' THEN "PARAM1" END, CASE WHEN trim("NONAMEA0") <> '' THEN "NONAMEA0" END, '')"""
_HAS_DRIVER = "({0} LIKE '%npcap%' OR {0} LIKE '%npf%' OR {0} LIKE '%netmon%')"
_ACCOUNT = """CASE WHEN "{0}DOMAINNAME" IS NOT NULL AND "{0}USERNAME" IS NOT NULL THEN "{0}DOMAINNAME" || '\\' || "{0}USERNAME" ELSE coalesce("{0}USERNAME", "{0}DOMAINNAME", '') END"""
#: What a rule asks for besides its channel and ids.
PREDICATES = {
    "ADComputerChangeDetailed": _is("OBJECTCLASS", "computer"), "ADGroupPolicyChanges": _is("OBJECTCLASS", "groupPolicyContainer", "container"), "ADGroupPolicyChangesDetailed": _GPC,
    "ADGroupPolicyEdits": f"{_GPC} AND {_is('ATTRIBUTELDAPDISPLAYNAME', 'versionNumber')}", "ADGroupPolicyLinks": f"{_is('OBJECTCLASS', 'domainDNS', 'organizationalUnit', 'site')} AND {_is('ATTRIBUTELDAPDISPLAYNAME', 'gpLink')}",
    "GpoCreated": _GPC, "GpoDeleted": _GPC, "GpoModified": _GPC, "ADGroupChange": _ACCOUNT.format("SUBJECT") + " <> '*ANONYMOUS*'", "ADGroupChangeDetailed": _is("OBJECTCLASS", "group"),
    "ADOrganizationalUnitChangeDetailed": f"{_is('OBJECTCLASS', 'organizationalUnit')} AND (\"ATTRIBUTELDAPDISPLAYNAME\" IS NULL OR NOT {_is('ATTRIBUTELDAPDISPLAYNAME', 'qPLik')})",
    "ADOtherChangeDetailed": f"NOT {_is('OBJECTCLASS', 'user', 'computer', 'organizationalUnit', 'group')}", "ADSMBServerAuditV1": _provider("Microsoft-Windows-SMBServer"), "ADUserChangeDetailed": _is("OBJECTCLASS", "user"),
    "ADUserLogonNTLMv1": _is("LMPACKAGENAME", "NTLM V1"), "AADSyncCycleStage": _SYNC, "AADSyncFilterStatus": _provider("ADSync"), "AADSyncImportStatus": _SYNC, "AADSyncPasswordHashSyncStatus": _SYNC,
    "DhcpLeaseCreated": _provider("Microsoft-Windows-DHCP-Server"), "KerberosServiceTicket": _AUDIT, "KerberosTGTRequest": _AUDIT, "KerberosTicketFailure": _AUDIT, "LogsClearedOther": _EVENTLOG, "LogsClearedSecurity": _EVENTLOG,
    "ClientGroupPoliciesApplication": _POLICY, "ClientGroupPoliciesSystem": _POLICY, "FirewallRuleChange": _provider("Microsoft-Windows-Security-Auditing", "Microsoft-Windows-Windows Firewall With Advanced Security"),
    "NetworkMonitorDriverLoaded": f"({_provider('Service Control Manager')} AND id IN (7035, 7045) AND {_HAS_DRIVER.format('lower(message_subject)')} OR {_provider('Microsoft-Windows-FilterManager')} AND id = 6 AND {_HAS_DRIVER.format(f'lower({_DRIVER_OF})')})",
    "NetworkPromiscuousMode": _provider("Ndis"), "OSCrash": _EVENTLOG, "OSCrashOnAuditFailRecovery": _AUDIT, "OSShutdown": _KERNEL, "OSStartup": _KERNEL, "OSUncleanShutdown": _provider("Microsoft-Windows-Kernel-Power"),
    "WindowsUpdateFailure": _provider("Microsoft-Windows-WindowsUpdateClient"),
}


def _guard(rule: rules.RuleSpec) -> str:
    return f"(log_name = '{rule.channel}' AND id IN ({', '.join(map(str, rule.ids))}) AND coalesce({PREDICATES.get(rule.name, 'TRUE')}, FALSE))"


def _field(text: str) -> str:
    """A plain field of a rule's notation in SQL."""
    if text in ("C", "T"):
        return {"C": "computer_name", "T": "CAST(time_created AS VARCHAR)"}[text]
    if text in ("W", "subject", "target"):
        return _ACCOUNT.format("TARGET" if text == "target" else "SUBJECT")
    names = [f'"{k.upper()}"' for k in (text[5:].split("|") if text.startswith(("join:", "pick:")) else [text])]
    if text.startswith("join:"):
        return f"CASE WHEN {names[0]} IS NOT NULL AND {names[1]} IS NOT NULL THEN {names[0]} || '\\' || {names[1]} ELSE coalesce({names[0]}, {names[1]}, '') END"
    if text.startswith("pick:"):
        return "coalesce(" + ", ".join(f"CASE WHEN trim({n}) <> '' THEN {n} END" for n in names) + ", '')"
    return f"coalesce(trim({names[0]}), '')"


_FIRST = " CASE " + " ".join(f"WHEN {_guard(r)} THEN '{r.name}'" for r in rules.RULES.values()) + " END"


@_log_query(f", n AS (SELECT record_id, {_FIRST} AS named_event FROM log) SELECT record_id, named_event FROM n WHERE named_event IS NOT NULL")
def named_events_all(spark, sf_dir):
    """Every event under the first of all 79 rules that holds."""
    return rules.classify(log_with_data(spark, sf_dir), list(rules.RULES)).select("record_id", "named_event")


_CELLS = ", ".join(f"CASE WHEN {_guard(r)} THEN [" + ", ".join(f"{{'named_event': '{r.name}', 'field': '{n}', 'value': {_field(t)}}}" for n, t in plain_fields(r.notation).items()) + "] END" for r in rules.RULES.values() if plain_fields(r.notation))


@_log_query(f", c AS (SELECT unnest(flatten(list_filter([{_CELLS}], lambda x : x IS NOT NULL))) AS c FROM log) SELECT c.named_event, c.field, count(*) AS events, count(*) FILTER (c.value <> '') AS given, min(c.value) AS least, max(c.value) AS greatest, coalesce(sum(length(c.value)), 0)::BIGINT AS chars FROM c GROUP BY ALL")
def named_event_fields(spark, sf_dir):
    """The plain fields of the typed projections of all 79 named events, an event under every rule that holds: how many events, how many filled, and what of."""
    return field_summary(log_with_data(spark, sf_dir))


def field_summary(events: DataFrame) -> DataFrame:
    """Per named event and plain field: events, given, least, greatest, chars.

    Equal values are counted first, so the least and greatest text are taken of distinct values and nothing sorts the events.
    Nearly all times differ: they stay times, whose order is the order of their texts in years of four digits; other years are texts.
    """
    time = F.col("time_created").cast("timestamp_ntz")
    plain = time.between(F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"), F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz"))
    made = []
    for rule in rules.RULES.values():
        makers = rule.makers()
        cells = []
        for name, source in plain_fields(rule.notation).items():
            value = makers[name]().cast("string")
            value, moment = (F.when(~plain, value), F.when(plain, time)) if source == "T" else (value, F.lit(None).cast("timestamp_ntz"))
            cells.append(F.struct(F.lit(rule.name).alias("named_event"), F.lit(name).alias("field"), value.alias("value"), moment.alias("moment")))
        if cells:
            made.append(F.when(rule.guard(), F.array(*cells)))
    # A projection of its own, so that lookups in the map become the looked up values.
    held = events.where(rules.scan_guard(list(rules.RULES))).select(F.flatten(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("cells"))
    cells = held.select(F.explode_outer("cells").alias("c")).where("c is not null").select("c.*")
    shown = F.coalesce("value", F.col("moment").cast("string"))
    values = cells.groupBy("named_event", "field", "value").agg(
        F.count("*").alias("n"), F.count_if((F.col("value") != "") | F.col("moment").isNotNull()).alias("filled"), F.min("moment").alias("first"), F.max("moment").alias("last"), F.sum(F.length(shown)).alias("length")
    )
    least, greatest = F.least("value", F.col("first").cast("string")), F.greatest("value", F.col("last").cast("string"))
    return values.groupBy("named_event", "field").agg(F.sum("n").alias("events"), F.sum("filled").alias("given"), F.min(least).alias("least"), F.max(greatest).alias("greatest"), F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("chars"))


_PLANNED = ["ADUserLogonFailed", "ADUserLogon", "ADUserLockouts", "OSStartup", "OSCrash", "AADSyncImportStatus", "ADLdapBindingSummary", "AADSyncProvisionCredentialsPing"]


@_log_query(
    " SELECT log_name AS channel, id AS event_id, count(*) AS events FROM log WHERE "
    + " OR ".join(f"(log_name = '{r.channel}' AND id IN ({', '.join(map(str, r.ids))}))" for r in (rules.RULES[n] for n in _PLANNED if n in rules.RULES))
    + " GROUP BY ALL"
)
def named_events_plan_counts(spark, sf_dir):
    """The scan plan of some named events, with what each (channel, id) of it holds."""
    plan = spark.createDataFrame([(c, i) for c, ids in rules.scan_plan(_PLANNED).items() for i in sorted(ids)], "channel string, event_id int")
    rows = mixed_log(spark, sf_dir).where(rules.scan_guard(_PLANNED))
    return rows.join(F.broadcast(plan), (F.col("log_name") == F.col("channel")) & (F.col("id") == F.col("event_id"))).groupBy("channel", "event_id").agg(F.count("*").alias("events"))


# --------------------------------------------------------------------------- periods and scans

PERIODS = [
    "PastHour", "CurrentHour", "PastDay", "Yesterday", "CurrentDay", "Today", "PastMonth", "CurrentMonth", "PastQuarter", "CurrentQuarter", "Everything",
    *[f"Last{n}Days" for n in (3, 7, 14)], *[f"Last{n}Hour{'s' * (n > 1)}" for n in periods.LAST_HOURS], *[f"TillLast{d}" for d in periods.WEEKDAYS],
]


def _bounds_sql() -> dict[str, str]:
    """What each period keeps, in SQL's own date arithmetic."""
    now, day, hour = f"TIMESTAMP '{MOMENT}'", f"date_trunc('day', TIMESTAMP '{MOMENT}')", f"date_trunc('hour', TIMESTAMP '{MOMENT}')"
    month, quarter = day.replace("day", "month", 1), day.replace("day", "quarter", 1)
    within = lambda a, b: f"time_created BETWEEN {a} AND {b}"
    out = {
        "PastHour": within(f"{hour} - INTERVAL 1 HOUR", hour), "CurrentHour": within(hour, f"{hour} + INTERVAL 1 HOUR"), "PastDay": within(f"{day} - INTERVAL 1 DAY", day), "Yesterday": within(f"{day} - INTERVAL 1 DAY", day),
        "CurrentDay": within(day, f"{day} + INTERVAL 1 DAY"), "Today": within(day, f"{day} + INTERVAL 1 DAY"), "PastMonth": within(f"{month} - INTERVAL 1 MONTH", month), "CurrentMonth": within(month, f"{month} + INTERVAL 1 MONTH"),
        "PastQuarter": within(f"{quarter} - INTERVAL 3 MONTH", quarter), "CurrentQuarter": within(quarter, f"{quarter} + INTERVAL 3 MONTH"), "Everything": "TRUE",
    }
    out |= {f"Last{n}Days": f"time_created >= {day} - INTERVAL {n} DAY" for n in (3, 7, 14)}
    out |= {f"Last{n}Hour{'s' * (n > 1)}": f"time_created >= {now} - INTERVAL {n} HOUR" for n in periods.LAST_HOURS}
    return out | {f"TillLast{d}": f"time_created >= {now} - INTERVAL 1 DAY * ((isodow({now}) - {i + 1} + 7) % 7)" for i, d in enumerate(periods.WEEKDAYS)}


@_log_query(" " + " UNION ALL ".join(f"SELECT '{p}' AS period, count(*) FILTER ({w}) AS events FROM log" for p, w in _bounds_sql().items()))
def period_counts(spark, sf_dir):
    """Events of every named period, counted in one pass."""
    rows = mixed_log(spark, sf_dir).select("time_created")
    counts = rows.agg(*[F.count_if(filters.to_column(FilterSpec(period=p, now=MOMENT))).alias(p) for p in PERIODS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(p).alias("events")) for p in PERIODS])).alias("c")).select("c.*")


@_log_query(" SELECT record_id, id, time_created FROM log WHERE log_name = 'Directory Service' AND time_created BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-12-31'")
def scan_known_logs(spark, sf_dir):
    spec = FilterSpec(log_name="DirectoryService", start=datetime(1995, 1, 1), end=datetime(1999, 12, 31))
    return mixed_log(spark, sf_dir).where(filters.to_column(spec)).select("record_id", "id", "time_created")


@_log_query(" SELECT record_id, log_name, time_created FROM log WHERE level = 2 ORDER BY time_created DESC NULLS LAST, record_id DESC LIMIT 120")
def scan_newest_of_logs(spark, sf_dir):
    """Null times come last."""
    return filters.scan(mixed_log(spark, sf_dir), FilterSpec(levels=(2,)), 120).select("record_id", "log_name", "time_created")


@_log_query(" SELECT log_name, max(time_created) AS latest_time, arg_max(record_id, (time_created, record_id)) FILTER (time_created IS NOT NULL) AS latest_record, CASE WHEN max(time_created) IS NULL THEN 'NoEvent' ELSE 'Ok' END AS status FROM log GROUP BY log_name")
def probe_latest_logs(spark, sf_dir):
    return tables.probe_latest(mixed_log(spark, sf_dir))


@_log_query(""", e AS (SELECT log_name, computer_name, record_id, time_created AS t, row_number() OVER (PARTITION BY log_name, computer_name ORDER BY record_id DESC) AS n FROM log),
    r AS (SELECT log_name, computer_name, min(n) FILTER (t IS NOT NULL) AS hit, count(*) AS n FROM e WHERE n <= 2 GROUP BY ALL)
    SELECT r.log_name, r.computer_name, CASE WHEN hit IS NOT NULL THEN 'Ok' WHEN r.n >= 2 THEN 'LimitReached' ELSE 'NoEvent' END AS status, e.t AS latest_time, e.record_id AS latest_record, coalesce(hit, r.n) AS scanned
    FROM r LEFT JOIN e ON r.log_name = e.log_name AND r.computer_name = e.computer_name AND e.n = r.hit""")
def probe_log_hosts(spark, sf_dir):
    """Every (log, host), the two newest records of each."""
    rows = mixed_log(spark, sf_dir)
    return probe.probe_states(rows, rows.select("log_name", "computer_name").distinct(), 2)


@_log_query(" SELECT log_name, count(*) AS record_count, min(record_id) AS oldest_record, max(record_id) AS newest_record, min(time_created) AS oldest_event, max(time_created) AS newest_event FROM log GROUP BY log_name")
def log_information_logs(spark, sf_dir):
    return tables.log_information(mixed_log(spark, sf_dir))


@_log_query(" SELECT min(log_name) AS name FROM log WHERE contains(upper(log_name), 'WINDOWS') GROUP BY upper(log_name)")
def catalog_channel_names(spark, sf_dir):
    return tables.catalog(mixed_log(spark, sf_dir), "log_name", contains="windows")


@_log_query(" SELECT * FROM (SELECT min(provider_name) AS name, count(*) OVER () >= 5 AS truncated FROM log WHERE trim(provider_name) <> '' GROUP BY upper(provider_name) ORDER BY upper(min(provider_name)) LIMIT 5)")
def catalog_provider_page(spark, sf_dir):
    """The first five providers, and whether the page is full."""
    return tables.catalog_page(mixed_log(spark, sf_dir), "provider_name", most=5)


_COUNTED = " SELECT arg_min(key, (coalesce(time_created, TIMESTAMP '9999-01-01'), record_id)) AS key, count(*) AS count FROM (SELECT {0} AS key, time_created, record_id FROM log) WHERE key <> '' GROUP BY upper(key)"


@_log_query(_COUNTED.format("computer_name"))
def count_by_host_mixed_case(spark, sf_dir):
    """Hosts equal without case, shown as first seen; null times are seen last."""
    return R.count_text(mixed_log(spark, sf_dir), F.col("computer_name"))


@_log_query(_COUNTED.format("CASE WHEN trim(provider_name) = '' THEN '(unknown)' ELSE trim(provider_name) END") + " ORDER BY count DESC, upper(key) LIMIT 4")
def top_provider_rows(spark, sf_dir):
    """Top rows with a named key and as cells of a preview, flattened."""
    rows = R.keyed_top(R.count_text(mixed_log(spark, sf_dir), F.col("provider_name"), unknown=True), 4, "provider")
    return rows.select(F.col("key")["provider"].alias("key"), "count")


@_log_query(" SELECT CAST(id AS VARCHAR) || ',' || CAST(count(*) AS VARCHAR) AS cells FROM log GROUP BY id ORDER BY count(*) DESC, id LIMIT 6")
def top_event_id_cells(spark, sf_dir):
    return R.preview_top(R.count_number(mixed_log(spark, sf_dir), "id"), 6, text=False).select(F.array_join("cells", ",").alias("cells"))


@_log_query(""", p AS (SELECT unnest(['Security', 'System', 'Application', 'Setup', 'Gone']) AS log_name, unnest(['Circular', 'Retain', 'AutoBackup', 'Odd', 'Circular']) AS mode, unnest([500, 100000000, 20, 1048576, 1]) AS most),
    l AS (SELECT log_name, count(*) AS record_count, min(record_id) AS oldest_record, max(time_created) AS newest_event, count(DISTINCT upper(provider_name)) FILTER (trim(provider_name) <> '') AS providers, sum(length(message_subject))::BIGINT AS size_bytes FROM log GROUP BY log_name)
    SELECT p.log_name, coalesce(record_count, 0) AS record_count, oldest_record, newest_event, coalesce(providers, 0) AS providers, coalesce(size_bytes, 0) AS size_bytes, coalesce(round(size_bytes::DOUBLE / 1048576, 2), 0) AS size_mb, coalesce(round(most::DOUBLE / 1048576, 2), 0) AS maximum_mb,
    CASE mode WHEN 'Circular' THEN 'OverwriteEventsAsNeededOldestFirst' WHEN 'Retain' THEN 'DoNotOverwriteEventsClearLogManually' WHEN 'AutoBackup' THEN 'ArchiveTheLogWhenFullDoNotOverwrite' ELSE 'Unknown' END AS event_action, coalesce(size_bytes, 0) >= most AS is_full FROM p LEFT JOIN l USING (log_name)""")
def log_details(spark, sf_dir):
    """Logs of a policy table with their sizes, providers, action when full, and whether they are."""
    policies = [("Security", "Circular", 500), ("System", "Retain", 100_000_000), ("Application", "AutoBackup", 20), ("Setup", "Odd", 1 << 20), ("Gone", "Circular", 1)]
    known = spark.createDataFrame(policies, "log_name string, mode string, maximum_bytes bigint")
    rows = tables.log_details(mixed_log(spark, sf_dir), known, size=F.length("message_subject"))
    return rows.select("log_name", "record_count", "oldest_record", "newest_event", F.size("providers").cast("bigint").alias("providers"), "size_bytes", "size_mb", "maximum_mb", "event_action", "is_full")
