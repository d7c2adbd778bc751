"""Every query of the event operators over the whole tables, with the DuckDB SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import decode as D, lookups as L, parse as P
from .operators import accounts, filters, probe, reports as R, scripts, tables, timeline as T
from .operators.filters import FilterSpec
from .operators.resume_state import ResumeState, state_key
from .operators.stats_state import StatsBuilder
from .plans import profiles, rules, xpath
from .sources.events import DUCKDB_EVT, events, table, with_data
from .sources.hosts import scan_hosts
from .sources.staging import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = datetime(2024, 1, 20, 13, 45, 30)
NOW_SQL = "TIMESTAMP '2024-01-20 13:45:30'"


def query(sql: str | None, evt: bool = True):
    """Registers a function of (spark, sf_dir); evt puts the adapter's CTE before the SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (DUCKDB_EVT + sql) if evt else sql
        return f

    return add


def data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_data(events(spark, sf_dir))


def _scan_query(name: str, spec: FilterSpec, where: str, **options) -> None:
    """Registers a filter query that returns whole rows."""
    columns = "record_id, id, time_created, level, computer_name"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = data(spark, sf_dir) if spec.named_data or spec.named_data_exclude or spec.data_values else events(spark, sf_dir)
        return rows.where(filters.to_column(spec)).select(*columns.split(", "))

    run.__name__ = name
    query(f" SELECT {columns} FROM evt WHERE {where}")(run)


# ------------------------------------------------------------------------------------ scans


def _head(df: DataFrame) -> DataFrame:
    return df.select("record_id", "id", "time_created", "computer_name")


@query(" SELECT record_id, id, time_created, computer_name FROM evt WHERE id IN (4624, 4625) ORDER BY time_created DESC, record_id DESC LIMIT 100")
def scan_newest_first(spark, sf_dir):
    return _head(filters.scan(events(spark, sf_dir), FilterSpec(event_ids=(4624, 4625)), 100))


@query(" SELECT record_id, id, time_created, computer_name FROM evt WHERE level = 2 ORDER BY time_created, record_id LIMIT 100")
def scan_oldest_first(spark, sf_dir):
    return _head(filters.scan(events(spark, sf_dir), FilterSpec(levels=("Error",)), 100, oldest=True))


@query(" SELECT log_name, count(*) AS n FROM evt WHERE log_name = 'Security' GROUP BY log_name")
def scan_known_log(spark, sf_dir):
    return events(spark, sf_dir).where(filters.to_column(FilterSpec(log_name="Security"))).groupBy("log_name").agg(F.count("*").alias("n"))


@query(" SELECT record_id, id, time_created, computer_name FROM evt WHERE (id = 4625 OR id = 4740) AND level <= 3 AND time_created >= TIMESTAMP '2024-01-10 00:00:00'")
def scan_xpath_subset(spark, sf_dir):
    text = "*[System[(EventID=4625 or EventID=4740) and (Level <= 3) and TimeCreated[@SystemTime>='2024-01-10T00:00:00Z']]]"
    return _head(events(spark, sf_dir).where(xpath.xpath_column(text)))


@query(
    """ SELECT record_id, id, time_created, computer_name FROM evt WHERE ((level IN (2, 3) AND task <> 5) OR (logon_type = '10' AND id <> 4740))
    AND NOT (workstation = '-' AND id = 4625) AND NOT (status = '0xC000006D' OR user_id = 'S-1-5-21-2') OR record_id IN (3, 4)"""
)
def xpath_query_list(spark, sf_dir):
    """Several Selects less several Suppresses; not() and UserData among them."""
    text = """<QueryList><Query Id="0" Path="Security">
      <Select>*[System[(Level=2 or Level=3) and not(Task=5)]]</Select>
      <Select Path="Security">*[EventData[Data[@Name='LogonType']='10'] and not(System/EventID=4740)]</Select>
      <Suppress>*[System[EventID=4625]] and *[EventData[Data[@Name='WorkstationName' and .='-']]]</Suppress>
      <Suppress>*[UserData/Holder/Status='0xC000006D' or System[Security[@UserID='S-1-5-21-2']]]</Suppress></Query>
      <Query Id="1" Path="Security"><Select>*[System[EventRecordID &gt;= 3 and EventRecordID &lt; 5]]</Select></Query></QueryList>"""
    return _head(data(spark, sf_dir).where(xpath.xpath_column(text)))


@query(" SELECT computer_name AS host, count(*) AS n, 'Ok' AS status FROM evt WHERE level = 2 AND computer_name <> 'DC4' GROUP BY computer_name UNION ALL SELECT 'GONE', 0, 'NotFound'")
def scan_hosts_isolated(spark, sf_dir):
    """Each host is a job of its own; one that isn't there costs one error row."""
    own = {f"DC{i}": events(spark, sf_dir).where(f"computer_name = 'DC{i}'") for i in range(4)}
    found = scan_hosts(spark, own | {"GONE": f"{sf_dir}/no-such-host.parquet"}, lambda rows: rows.where(filters.to_column(FilterSpec(levels=(2,)))).select("record_id"))
    good = found.rows.groupBy("host").agg(F.count("*").alias("n")).withColumn("status", F.lit("Ok"))
    return good.unionByName(found.errors.select("host", F.lit(0).cast("bigint").alias("n"), F.col("kind").alias("status")))


_UNTIMED = "computer_name = 'DC1' OR (computer_name IN ('DC2', 'DC3') AND record_id % 13 <> 5)"


@query(
    f""", e AS (SELECT computer_name, record_id, CASE WHEN {_UNTIMED} THEN NULL ELSE time_created END AS t, row_number() OVER (PARTITION BY computer_name ORDER BY record_id DESC) AS n FROM evt WHERE computer_name <> 'DC2' OR id = 4740),
    r AS (SELECT computer_name, min(n) FILTER (t IS NOT NULL) AS hit, count(*) AS n FROM e WHERE n <= 40 GROUP BY computer_name)
    SELECT 'Security' AS log_name, w.computer_name, CASE WHEN r.hit IS NOT NULL THEN 'Ok' WHEN r.n >= 40 THEN 'LimitReached' ELSE 'NoEvent' END AS status, e.t AS latest_time, e.record_id AS latest_record, coalesce(r.hit, r.n, 0) AS scanned
    FROM (SELECT 'DC' || range AS computer_name FROM range(7)) w LEFT JOIN r ON w.computer_name = r.computer_name LEFT JOIN e ON e.computer_name = r.computer_name AND e.n = r.hit"""
)
def probe_states(spark, sf_dir):
    """Newest record with a time of each wanted host, 40 records at most; DC5 and DC6 don't exist."""
    rows = events(spark, sf_dir).where("computer_name != 'DC2' or id = 4740").withColumn("time_created", F.when(~F.expr(_UNTIMED), F.col("time_created")))
    wanted = spark.range(7).select(F.lit("Security").alias("log_name"), F.concat(F.lit("DC"), F.col("id").cast("string")).alias("computer_name"))
    return probe.probe_states(rows, wanted, 40)


_scan_query("scan_by_record_id", FilterSpec(record_ids=(5, 17, 900, 5)), "record_id IN (5, 17, 900)")


@query(" SELECT computer_name, count(*) AS n, max(record_id) AS newest FROM evt WHERE computer_name IN ('DC1', 'DC3') AND id = 4624 GROUP BY computer_name")
def scan_multi_host(spark, sf_dir):
    rows = events(spark, sf_dir).where(filters.to_column(FilterSpec(machines=("DC1", "DC3"), event_ids=(4624,))))
    return rows.groupBy("computer_name").agg(F.count("*").alias("n"), F.max("record_id").alias("newest"))


@query(" SELECT log_name, max(time_created) AS latest_time, arg_max(record_id, (time_created, record_id)) AS latest_record, 'Ok' AS status FROM evt GROUP BY log_name")
def probe_latest(spark, sf_dir):
    return tables.probe_latest(events(spark, sf_dir))


@query(" SELECT * FROM (SELECT record_id, computer_name, time_created, row_number() OVER (PARTITION BY computer_name ORDER BY time_created DESC, record_id DESC) AS r FROM evt) WHERE r <= 5", True)
def limit_per_host(spark, sf_dir):
    from pyspark.sql import Window

    rows = filters.scan(events(spark, sf_dir), FilterSpec(), 5, per_host=True)
    return rows.select("record_id", "computer_name", "time_created", F.row_number().over(Window.partitionBy("computer_name").orderBy(F.desc("time_created"), F.desc("record_id"))).alias("r"))


@query(
    """ SELECT strftime(time_created, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS time_utc, id, record_id, log_name, coalesce(provider_name, '') AS provider_name, level, computer_name, left('event ' || target_user, 9) AS message
    FROM evt WHERE id = 4740 ORDER BY time_created, record_id LIMIT 200"""
)
def evtx_read(spark, sf_dir):
    rows = events(spark, sf_dir).where("id = 4740").withColumn("message", F.concat(F.lit("event "), "target_user"))
    return tables.report_rows(rows, True, 9, 200)


@query(
    """, r AS (SELECT * FROM evt WHERE level = 2 ORDER BY time_created DESC, record_id DESC LIMIT 150)
    SELECT record_id, id, task, opcode, keywords, level, computer_name, (SELECT count(*) FROM r) >= 150 AS truncated FROM r"""
)
def live_rows(spark, sf_dir):
    from pyspark.sql import Window

    rows = filters.scan(events(spark, sf_dir), FilterSpec(levels=(2,)), 150)  # the window sees no more than these
    return rows.select("record_id", "id", "task", "opcode", "keywords", "level", "computer_name", (F.count("*").over(Window.partitionBy()) >= 150).alias("truncated"))


# ---------------------------------------------------------------------------------- filters

_scan_query("filter_event_ids", FilterSpec(event_ids=(4625, 4740, 4625)), "id IN (4625, 4740)")
_scan_query("filter_exclude_ids", FilterSpec(exclude_ids=(4624, 4768)), "id NOT IN (4624, 4768)")
_scan_query("filter_provider", FilterSpec(providers=("microsoft-windows-security-auditing",)), "upper(provider_name) = 'MICROSOFT-WINDOWS-SECURITY-AUDITING'")
_scan_query("filter_level", FilterSpec(levels=("Error", 3)), "level IN (2, 3)")
_scan_query("filter_keywords_mask", FilterSpec(keywords=("AuditFailure",)), "(keywords & 4503599627370496) <> 0")
_scan_query("filter_task_opcode", FilterSpec(tasks=(1, 2, 3), opcodes=(0, 4)), "task IN (1, 2, 3) AND opcode IN (0, 4)")
_scan_query("filter_time_range", FilterSpec(start=datetime(2024, 1, 5), end=datetime(2024, 1, 6, 12)), "time_created BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 12:00:00'")
_scan_query("filter_last_n_hours", FilterSpec(period="Last6Hours", now=NOW), f"time_created >= {NOW_SQL} - INTERVAL 6 HOUR")
_scan_query("filter_user", FilterSpec(users=("S-1-5-21-1", "S-1-5-21-3")), "user_id IN ('S-1-5-21-1', 'S-1-5-21-3')")
_scan_query("filter_any_data", FilterSpec(data_values=("WKS4", "::1")), "'WKS4' IN (target_user, target_domain, workstation, logon_type, ip_address, status, sub_status, failure_reason, subject_user, subject_domain) OR ip_address = '::1'")
_scan_query("filter_named_data", FilterSpec(named_data={"workstationname": ("WKS1", "WKS2"), "LogonType": ("10",)}), "workstation IN ('WKS1', 'WKS2') OR logon_type = '10'")
_scan_query("filter_named_data_exclude", FilterSpec(named_data_exclude={"WorkstationName": ("WKS1", "-"), "NoSuchKey": ("x",)}), "workstation NOT IN ('WKS1', '-')")
_scan_query("period_past_month", FilterSpec(period="PastMonth", now=datetime(2024, 2, 10)), "time_created BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-01'")
_scan_query("period_current_quarter", FilterSpec(period="CurrentQuarter", now=NOW), "time_created BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-04-01'")
_scan_query("period_last_24h", FilterSpec(period="Last24Hours", now=NOW), f"time_created >= {NOW_SQL} - INTERVAL 24 HOUR")
_scan_query("period_till_last_monday", FilterSpec(period="TillLastMonday", now=NOW), "time_created >= TIMESTAMP '2024-01-15 13:45:30'")


@query("SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e|copyright \\d{4}')", False)
def filter_message_regex(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumnRenamed("text", "message")
    return rows.where(filters.to_column(FilterSpec(message_regex=r"(?i)licen[sc]e|copyright \d{4}"))).select("doc_id", "n_chars")


_STATE = ", s AS (SELECT log_name, computer_name, max(record_id) // 2 AS last_record FROM evt WHERE computer_name <> 'DC4' GROUP BY 1, 2)"


@query(_STATE + " SELECT e.computer_name, count(*) AS n, max(e.record_id) AS last_record FROM evt e LEFT JOIN s ON e.log_name = s.log_name AND e.computer_name = s.computer_name WHERE s.last_record IS NULL OR e.record_id > s.last_record GROUP BY 1")
def resume_after(spark, sf_dir):
    rows = events(spark, sf_dir)
    state = tables.next_state(rows.where("computer_name <> 'DC4'")).withColumn("last_record", F.expr("last_record div 2"))
    return tables.resume(rows, state).groupBy("computer_name").agg(F.count("*").alias("n"), F.max("record_id").alias("last_record"))


@query(", s AS (SELECT computer_name, max(record_id) AS last_record FROM evt WHERE computer_name <> 'DC4' AND record_id % 3 = 0 GROUP BY 1) SELECT e.computer_name, count(*) AS n, max(e.record_id) AS last_record FROM evt e LEFT JOIN s USING (computer_name) WHERE s.last_record IS NULL OR e.record_id > s.last_record - 400 GROUP BY 1")
def resume_from_file(spark, sf_dir):
    """State kept in a file by one reader, read by another; the first reader's events end 400 before the newest."""
    state = ResumeState(spark, f"{shared_dir(spark)}/resume-{uuid.uuid4().hex}.json")
    rows, key = events(spark, sf_dir), state_key(None, "Security", ["DC0", "DC1"])
    state.advance(rows.where("computer_name <> 'DC4' and record_id % 3 = 0").withColumn("record_id", F.col("record_id") - 400), key)
    return state.behind(rows, key).groupBy("computer_name").agg(F.count("*").alias("n"), F.max("record_id").alias("last_record"))


@query(" SELECT DISTINCT computer_name AS name FROM evt WHERE computer_name LIKE 'DC_' AND computer_name LIKE '%3'")
def wildcard_logs(spark, sf_dir):
    return tables.catalog(events(spark, sf_dir), "computer_name", pattern="dc?").where(filters.wildcard(F.col("name"), "*3"))


@query(" SELECT min(provider_name) AS name FROM evt WHERE trim(provider_name) <> '' AND contains(upper(provider_name), 'SECURITY') GROUP BY upper(provider_name)")
def catalog_providers(spark, sf_dir):
    return tables.catalog(events(spark, sf_dir), "provider_name", contains="security")


@query(" SELECT min(log_name) AS name FROM evt GROUP BY upper(log_name)")
def catalog_channels(spark, sf_dir):
    return tables.catalog(events(spark, sf_dir), "log_name")


# ---------------------------------------------------------------------------------- parsers

_LINES = r"(CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split_regex(text, '\r?\n') END)"


@query(f"SELECT doc_id, len(l)::INT AS n_lines, coalesce(trim(l[2]), '') AS second_line, coalesce(trim(l[-1]), '') AS last_line FROM (SELECT doc_id, {_LINES} AS l FROM documents)", False)
def message_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", P.message_lines(F.col("text")).alias("l"))
    return lines.select("doc_id", F.size("l").alias("n_lines"), P.message_line(F.col("l"), 1).alias("second_line"), P.message_line(F.col("l"), -1).alias("last_line"))


@query(f"SELECT doc_id, coalesce(trim(list_filter({_LINES}, lambda x : trim(x) <> '')[1]), '') AS subject FROM documents", False)
def message_subject(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.message_subject(F.col("text")).alias("subject"))


@query(
    f"""WITH l AS (SELECT doc_id, list_filter({_LINES}, lambda x : trim(x) <> '') AS ls FROM documents),
    u AS (SELECT doc_id, unnest(ls[2:]) AS x, generate_subscripts(ls[2:], 1) AS i FROM l),
    p AS (SELECT doc_id, i, trim(substr(x, 1, instr(x, ':') - 1)) AS key, trim(substr(x, instr(x, ':') + 1)) AS value FROM u WHERE instr(x, ':') > 1)
    SELECT doc_id, arg_max(key, i) AS key, arg_max(value, i) AS value FROM p WHERE key <> '' AND upper(key) <> 'MESSAGE' GROUP BY doc_id, upper(key)""",
    False,
)
def message_pairs(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").select("doc_id", F.explode(P.message_map(F.col("text"))).alias("key", "value"))
    return pairs.where("upper(key) <> 'MESSAGE'")


@query("""SELECT record_id, key, value FROM (SELECT record_id, unnest([{'key': 'ACCOUNT', 'value': target_user || ':' || k::VARCHAR}, {'key': 'Workstation', 'value': workstation}, {'key': 'Odd key', 'value': ''}]) AS e,
  unnest([{'key': 'ACCOUNT', 'value': target_user || ':' || k::VARCHAR}, {'key': 'Workstation', 'value': workstation}, {'key': 'Odd key', 'value': ''}], recursive := true) FROM evt)""")
def message_pairs_events(spark, sf_dir):
    """Keys repeat in another casing, values hold colons and blanks, lines without a key are none."""
    text = F.concat(F.lit("Logon\r\nAccount: none\r\n : nothing\r\nWorkstation:  "), "workstation", F.lit(" \r\nno pair\nACCOUNT:"), "target_user", F.lit(":"), F.col("k").cast("string"), F.lit("\nOdd key :"))
    return events(spark, sf_dir).select("record_id", F.explode(P.message_map(text)).alias("key", "value")).where("key <> 'Message'")


@query(" SELECT record_id, n FROM (SELECT record_id, CASE WHEN k % 3 = 0 THEN 'aa-' || k::VARCHAR ELSE NULL END AS n FROM evt) WHERE n IS NOT NULL")
def nic_identifiers(spark, sf_dir):
    rows = events(spark, sf_dir).select("record_id", F.create_map(F.lit("CallingStationId"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("aa-"), F.col("k").cast("string"))), F.lit("Other"), F.lit("x")).alias("data"))
    return rows.select("record_id", F.explode(P.nic_identifiers(F.col("data"))).alias("n"))


@query(" SELECT record_id, target_user AS \"TargetUserName\", ip_address AS \"IpAddress\", CASE WHEN sub_status <> '' THEN sub_status END AS \"SubStatus\" FROM evt")
def flatten_data(spark, sf_dir):
    rows = data(spark, sf_dir).select("record_id", F.map_filter("data", lambda k, v: k.isin("TargetUserName", "IpAddress") | ((k == "SubStatus") & (v != ""))).alias("data"))
    return tables.flatten(rows, ["TargetUserName", "IpAddress", "SubStatus"])


@query("SELECT doc_id, left(text, 40) AS cut, '' AS nothing FROM documents", False)
def truncate_message(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.truncate(F.col("text"), 40).alias("cut"), P.truncate(F.col("text"), 0).alias("nothing"))


@query(" SELECT record_id, trim(workstation) AS workstation, '' AS missing FROM evt")
def data_lookup(spark, sf_dir):
    return data(spark, sf_dir).select("record_id", P.lookup(F.col("data_ci"), "workstationNAME").alias("workstation"), P.lookup(F.col("data_ci"), "NoSuchKey").alias("missing"))


@query(" SELECT record_id, ip_address || '\\' || workstation AS both_keys, ip_address AS one_key, '' AS no_key FROM evt")
def join_accessor(spark, sf_dir):
    get = lambda k: P.raw(F.col("data_ci"), k)
    return data(spark, sf_dir).select("record_id", P.joined(get("IpAddress"), get("WorkstationName")).alias("both_keys"), P.joined(get("Nothing"), get("IpAddress")).alias("one_key"), P.joined(get("Nothing"), get("Nobody")).alias("no_key"))


@query(" SELECT record_id, subject_domain || '\\' || subject_user AS who, target_domain || '\\' || target_user AS object_affected FROM evt")
def subject_account(spark, sf_dir):
    return data(spark, sf_dir).select("record_id", P.account(F.col("data_ci"), "Subject").alias("who"), P.account(F.col("data_ci"), "Target").alias("object_affected"))


# --------------------------------------------------------------------------------- decoders

_HEX = "CASE WHEN {0} LIKE '0x%' THEN CAST({0} AS BIGINT) ELSE TRY_CAST({0} AS BIGINT) END"


@query(f" SELECT record_id, {_HEX.format('status')} AS status_number, {_HEX.format('sub_status')} AS sub_status_number FROM evt")
def hex_parse(spark, sf_dir):
    return events(spark, sf_dir).select("record_id", D.parse_unsigned(F.col("status")).cast("bigint").alias("status_number"), D.parse_unsigned(F.col("sub_status")).cast("bigint").alias("sub_status_number"))


def _names(table_: dict[str, int], number: str) -> str:
    return "CASE " + number + "".join(f" WHEN {v} THEN '{k}'" for k, v in table_.items()) + f" ELSE CAST({number} AS VARCHAR) END"


_LOGON_NUMBER = "CASE lower(logon_type)" + "".join(f" WHEN '{k.lower()}' THEN {v}" for k, v in L.LOGON_TYPE.items()) + " ELSE TRY_CAST(logon_type AS BIGINT) END"
_REASON_NUMBER = "TRY_CAST(replace(failure_reason, '%%', '') AS BIGINT)"


@query(f", n AS (SELECT record_id, ({_LOGON_NUMBER})::BIGINT AS l, {_REASON_NUMBER} AS r FROM evt) SELECT record_id, {_names(L.LOGON_TYPE, 'l')} AS logon_type, {_names(L.FAILURE_REASON, 'r')} AS failure_reason FROM n")
def enum_decode(spark, sf_dir):
    return events(spark, sf_dir).select("record_id", D.enum_name(D.decode_enum(F.col("logon_type"), L.LOGON_TYPE, "decimal"), L.LOGON_TYPE).alias("logon_type"), D.enum_name(D.decode_enum(F.col("failure_reason"), L.FAILURE_REASON, "decimal"), L.FAILURE_REASON).alias("failure_reason"))


@query(" SELECT record_id, list_aggregate(list_filter([" + ", ".join(f"CASE WHEN (k * 37 & {v}) = {v} THEN '{n}' END" for n, v in sorted(L.UAC_FLAGS.items(), key=lambda x: x[1])) + "], lambda x : x IS NOT NULL), 'string_agg', ', ') AS flags FROM evt WHERE k * 37 & " + str(sum(L.UAC_FLAGS.values())) + " <> 0")
def flags_describe(spark, sf_dir):
    rows = events(spark, sf_dir).select("record_id", D.decode_uac(F.hex((F.col("k") * 37).cast("bigint"))).alias("flags"))
    return rows.where("flags <> ''")


@query(f", n AS (SELECT record_id, {_HEX.format('status')} AS s FROM evt) SELECT record_id, {_names(L.STATUS_CODE, 's')} || ' (0x' || lpad(upper(printf('%x', s)), 8, '0') || ')' AS status_text FROM n")
def status_describe(spark, sf_dir):
    return events(spark, sf_dir).select("record_id", D.describe_status(D.decode_enum(F.col("status"), L.STATUS_CODE, "hexadecimal"), F.col("status")).alias("status_text"))


@query(" SELECT record_id, CASE k % 4 WHEN 0 THEN 'Value Added' WHEN 1 THEN 'Value Deleted' WHEN 2 THEN 'Unknown' ELSE 'Unknown Operation' END AS operation FROM evt")
def optype_decode(spark, sf_dir):
    return events(spark, sf_dir).select("record_id", D.operation_type(F.concat(F.lit("%%"), (F.lit(14674) + F.col("k") % 4).cast("string"))).alias("operation"))


@query(" SELECT record_id, CASE k % 4 WHEN 0 THEN 'Logitech' WHEN 1 THEN 'Realtek' WHEN 2 THEN 'USB VID FFFF' ELSE '' END AS vendor, CASE k % 4 WHEN 0 THEN 'Disk Drive' WHEN 1 THEN 'USB Device' WHEN 2 THEN 'Imaging Device' ELSE 'Other' END AS device FROM evt")
def vendor_translate(spark, sf_dir):
    kind = F.col("k") % 4
    ids = F.when(kind == 0, "USB\\VID_046D&PID_1").when(kind == 1, "PCI\\VEN_0bda").when(kind == 2, "USB_VID_FFFF").otherwise("")
    name = F.when(kind == 0, "DiskDrive").when(kind == 1, "My usb stick").when(kind == 2, "WebCamera").otherwise("Other")
    return events(spark, sf_dir).select("record_id", D.translate_vendor(ids).alias("vendor"), D.translate_device(name).alias("device"))


@query(" SELECT record_id, CASE WHEN logon_type = '10' THEN workstation ELSE target_user END AS v FROM evt")
def overwrite_by_field(spark, sf_dir):
    return events(spark, sf_dir).select("record_id", D.overwrite_by_field(F.col("logon_type"), "10", F.col("target_user"), F.col("workstation")).alias("v"))


@query(" SELECT record_id, CASE WHEN ip_address = '::1' THEN '127.0.0.1' ELSE regexp_replace(ip_address, '(?i)^::ffff:', '') END AS ip FROM evt")
def normalize_ip(spark, sf_dir):
    return events(spark, sf_dir).select("record_id", D.normalize_ip(F.col("ip_address")).alias("ip"))


@query(" SELECT record_id, CASE WHEN target_domain = '' THEN '' ELSE target_domain END AS domain, CASE WHEN target_domain = '' THEN '\\' || target_user ELSE target_user END AS account FROM evt")
def split_account(spark, sf_dir):
    parts = D.split_account(F.concat("target_domain", F.lit("\\"), "target_user"))
    return events(spark, sf_dir).select("record_id", parts["domain"].alias("domain"), parts["user"].alias("account"))


@query(" SELECT record_id, CASE WHEN k % 3 = 2 THEN NULL WHEN k % 3 = 1 THEN date_trunc('second', time_created) - INTERVAL 2 HOUR ELSE date_trunc('second', time_created) END AS utc FROM evt")
def utc_parse(spark, sf_dir):
    plain = F.date_format("time_created", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("k") % 3 == 2, "not-a-timestamp").when(F.col("k") % 3 == 1, F.concat(plain, F.lit("+02:00"))).otherwise(F.concat(plain, F.lit("Z")))
    return events(spark, sf_dir).select("record_id", F.to_timestamp_ntz(F.date_format(D.parse_utc(text), "yyyy-MM-dd HH:mm:ss")).alias("utc"))


@query(" SELECT record_id, CASE WHEN length(workstation) > length(target_user) THEN workstation ELSE target_user END AS longest FROM evt")
def longest_message(spark, sf_dir):
    return events(spark, sf_dir).select("record_id", D.longest_text(F.lit(" "), F.col("target_user"), F.col("workstation"), F.lit(None).cast("string")).alias("longest"))


@query(" SELECT record_id, CASE WHEN ip_address LIKE '::%' THEN ip_address ELSE ip_address END AS ip, CAST(50000 + k AS VARCHAR) AS port FROM evt")
def endpoint_split(spark, sf_dir):
    text = F.when(F.col("ip_address").contains(":"), F.concat(F.lit("["), "ip_address", F.lit("]"))).otherwise(F.col("ip_address"))
    part = D.endpoint(F.concat(text, F.lit(":"), (F.col("k") + 50000).cast("string")))
    return events(spark, sf_dir).select("record_id", part["ip"].alias("ip"), part["port"].alias("port"))


@query(" SELECT record_id, CASE WHEN k % 2 = 0 THEN target_user ELSE hex(target_user) || 'F' END AS ascii_text FROM evt")
def hex_ascii(spark, sf_dir):
    coded = F.when(F.col("k") % 2 == 0, F.hex(F.col("target_user").cast("binary"))).otherwise(F.concat(F.hex(F.col("target_user").cast("binary")), F.lit("F")))
    return events(spark, sf_dir).select("record_id", D.hex_ascii(coded).alias("ascii_text"))


@query(" SELECT record_id, target_user AS connector FROM evt")
def text_after_marker(spark, sf_dir):
    return events(spark, sf_dir).select("record_id", D.text_after(F.concat(F.lit("Cycle start.\nConnector: "), "target_user", F.lit(" \nEnd")), "connector:").alias("connector"))


@query("SELECT doc_id, CASE WHEN n_chars > 0 THEN round(n_chars * 1000.0::DOUBLE / 1048576, 2) ELSE 0 END AS mb FROM documents", False)
def size_mb(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.convert_size(F.col("n_chars") * 1000).alias("mb"))


# ------------------------------------------------------------------------------ aggregations


def _counted(column: str, unknown: bool = False) -> str:
    shown = f"CASE WHEN trim({column}) = '' THEN '(unknown)' ELSE trim({column}) END" if unknown else f"trim({column})"
    return f" SELECT arg_min(key, (time_created, record_id)) AS key, count(*) AS count FROM (SELECT {shown} AS key, time_created, record_id FROM evt) WHERE key <> '' GROUP BY upper(key)"


@query(_counted("target_user"))
def count_by_target_user(spark, sf_dir):
    return R.count_text(events(spark, sf_dir), F.col("target_user"))


@query(_counted("provider_name", True))
def count_by_provider(spark, sf_dir):
    return R.count_text(events(spark, sf_dir), F.col("provider_name"), unknown=True)


@query(_counted("computer_name"))
def count_by_computer(spark, sf_dir):
    return R.count_text(events(spark, sf_dir), F.col("computer_name"))


@query(" SELECT id AS key, count(*) AS count FROM evt GROUP BY id")
def count_by_event_id(spark, sf_dir):
    return R.count_number(events(spark, sf_dir), "id")


@query(" SELECT level, CASE level WHEN 2 THEN 'Error' WHEN 3 THEN 'Warning' ELSE 'Information' END AS level_name, count(*) AS count FROM evt GROUP BY level")
def count_by_level(spark, sf_dir):
    from .schema import level_name

    return R.count_levels(events(spark, sf_dir), level_name(F.col("level")))


@query(" SELECT count(*) AS scanned, count(*) FILTER (level = 2) AS matched, min(time_created) FILTER (level = 2) AS min_utc, max(time_created) FILTER (level = 2) AS max_utc FROM evt")
def stats_summary(spark, sf_dir):
    return R.summary(events(spark, sf_dir), F.col("level") == 2)


@query(
    """, s AS (SELECT * FROM evt ORDER BY time_created DESC, record_id DESC LIMIT 3000)
    SELECT count(*) AS scanned, count(*) FILTER (time_created BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25') AS matched, min(time_created) FILTER (time_created BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25') AS min_utc,
    max(time_created) FILTER (time_created BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25') AS max_utc, count(*) >= 3000 AS truncated FROM s"""
)
def live_stats_summary(spark, sf_dir):
    return R.live_stats(events(spark, sf_dir), filters.to_column(FilterSpec(start=datetime(2024, 1, 5), end=datetime(2024, 1, 25))), 3000)


def _fanned(dimensions: dict[str, str], where: str = "TRUE") -> str:
    parts = " UNION ALL ".join(f"SELECT '{d}' AS dim, trim(coalesce(CAST({c} AS VARCHAR), '')) AS key, time_created, record_id FROM e" for d, c in dimensions.items())
    return f", e AS (SELECT * FROM evt WHERE {where}), f AS ({parts}) SELECT dim, arg_min(key, (time_created, record_id)) AS key, count(*) AS count FROM f WHERE key <> '' GROUP BY dim, upper(key)"


@query(_fanned({"event_id": "id", "provider": "CASE WHEN trim(provider_name) = '' THEN '(unknown)' ELSE provider_name END", "computer": "computer_name", "level": "level"}))
def stats_grouping_sets(spark, sf_dir):
    return R.stats(events(spark, sf_dir))


@query(
    _fanned({"event_id": "id", "provider": "CASE WHEN trim(provider_name) = '' THEN '(unknown)' ELSE provider_name END", "computer": "computer_name", "level": "level"})
    + " UNION ALL SELECT 'level_name', CASE level WHEN 2 THEN 'Error' WHEN 3 THEN 'Warning' ELSE 'Information' END, count(*) FROM evt GROUP BY ALL UNION ALL SELECT 'scanned', min(time_created) || ' - ' || max(time_created), count(*) FROM (SELECT date_trunc('second', time_created) AS time_created FROM evt)"
)
def stats_incremental(spark, sf_dir):
    """A report added up from three slices of the table, the last one first and one of them twice."""
    builder, rows = StatsBuilder(spark, f"{shared_dir(spark)}/stats-{uuid.uuid4().hex}"), events(spark, sf_dir)
    for k in (2, 0, 1, 0):
        builder.add_range(rows.where(F.pmod("record_id", F.lit(3)) == k), f"slice-{k}")
    built, text = builder.build(), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    names = built.levels.select(F.lit("level_name").alias("dim"), F.col("level_name").alias("key"), "count")
    whole = built.summary.select(F.lit("scanned").alias("dim"), F.concat(text("min_utc"), F.lit(" - "), text("max_utc")).alias("key"), F.col("scanned").alias("count"))
    return built.counts.unionByName(names).unionByName(whole)


_STATUS_SQL = _HEX.format("status")
_SUB_SQL = _HEX.format("sub_status")
_X8 = "'0x' || lpad(upper(printf('%x', {0})), 8, '0')"
#: An account without a domain keeps its backslash: only one inside parts an account.
_ACCOUNT = "CASE WHEN target_domain = '' THEN '\\' || target_user ELSE target_user END"
_DASH = "CASE WHEN trim({0}) = '-' THEN '' ELSE trim({0}) END"
_FAILED = {
    "target_user": _ACCOUNT, "target_domain": "target_domain", "logon_type": f"({_LOGON_NUMBER})::BIGINT", "ip_address": _DASH.format("ip_address"), "workstation": _DASH.format("workstation"), "computer": "computer_name",
    "status": _X8.format(f"({_STATUS_SQL})"), "status_name": _names(L.STATUS_CODE, f"({_STATUS_SQL})"), "sub_status": _X8.format(f"({_SUB_SQL})"), "sub_status_name": _names(L.SUB_STATUS_CODE, f"({_SUB_SQL})"), "failure_reason": _names(L.FAILURE_REASON, _REASON_NUMBER),
}


@query(_fanned(_FAILED, "id = 4625"))
def failed_logons_all_dims(spark, sf_dir):
    return R.security_counts(data(spark, sf_dir), "failed_logons")


@query(_fanned({"event_id": "id", "target_user": f"CASE WHEN id IN (4624, 4625) THEN {_ACCOUNT} ELSE target_user END", "target_domain": "target_domain", "logon_type": f"CASE WHEN id IN (4624, 4625) AND logon_type <> '' THEN CAST(({_LOGON_NUMBER})::BIGINT AS VARCHAR) ELSE logon_type END", "ip_address": _DASH.format("ip_address"), "workstation": _DASH.format("workstation"), "computer": "computer_name"}, "id IN (4624, 4625, 4634, 4647)"))
def user_logons_all_dims(spark, sf_dir):
    return R.security_counts(data(spark, sf_dir), "user_logons")


@query(_fanned({"target_user": _ACCOUNT, "target_domain": "target_domain", "caller_computer": _DASH.format("workstation"), "computer": "computer_name", "subject_user": "subject_domain || '\\' || subject_user"}, "id = 4740"))
def lockouts_all_dims(spark, sf_dir):
    return R.security_counts(data(spark, sf_dir), "lockouts")


@query(f" SELECT arg_min(key, (time_created, record_id)) AS key, count(*) AS count FROM (SELECT {_DASH.format('workstation')} AS key, time_created, record_id FROM evt WHERE id = 4625) WHERE key <> '' GROUP BY upper(key)")
def failed_logons_by_workstation(spark, sf_dir):
    return R.count_text(events(spark, sf_dir).where("id = 4625"), D.placeholder(F.col("workstation")))


@query(f", n AS (SELECT {_STATUS_SQL} AS s FROM evt WHERE id = 4625) SELECT {_X8.format('s')} AS status, {_names(L.STATUS_CODE, 's')} AS status_name, count(*) AS count FROM n GROUP BY s")
def failed_logons_by_status(spark, sf_dir):
    number = D.decode_enum(F.col("status"), L.STATUS_CODE, "hexadecimal")
    rows = events(spark, sf_dir).where("id = 4625").groupBy(number.alias("s")).agg(F.count("*").alias("count"))
    return rows.select(D.hex8(F.col("s")).alias("status"), D.enum_name(F.col("s"), L.STATUS_CODE).alias("status_name"), "count")


@query(f" SELECT record_id, id, time_created, {_ACCOUNT} AS target_user, {_DASH.format('ip_address')} AS ip_address, {_names(L.STATUS_CODE, f'({_STATUS_SQL})')} AS status_name FROM evt WHERE id = 4625 ORDER BY time_created, record_id LIMIT 20")
def failed_logon_samples(spark, sf_dir):
    return R.security_samples(data(spark, sf_dir), "failed_logons", 20).select("record_id", "id", "time_created", "target_user", "ip_address", "status_name")


@query(" SELECT id, count(DISTINCT upper(target_user)) AS users FROM evt GROUP BY id")
def distinct_users(spark, sf_dir):
    return events(spark, sf_dir).groupBy("id").agg(F.countDistinct(F.upper("target_user")).alias("users"))


@query(_counted("target_user") + " ORDER BY count DESC, upper(key) LIMIT 10")
def topk_target_user(spark, sf_dir):
    return R.top(R.count_text(events(spark, sf_dir), F.col("target_user")), 10)


@query(" SELECT id AS key, count(*) AS count FROM evt GROUP BY id ORDER BY count DESC, id LIMIT 3")
def topk_event_id(spark, sf_dir):
    return R.top(R.count_number(events(spark, sf_dir), "id"), 3, text=False)


@query(" SELECT level AS key, count(*) AS count FROM evt GROUP BY level ORDER BY count DESC, level LIMIT 2")
def topk_levels(spark, sf_dir):
    return R.top(R.count_number(events(spark, sf_dir), "level"), 2, text=False)


# ----------------------------------------------------------------- named events and timelines

NAMED = ["ADUserLogonFailed", "ADUserLogon", "ADUserLockouts", "KerberosTGTRequest"]
_DISPATCH = """, named AS (SELECT *, CASE id WHEN 4625 THEN 'ADUserLogonFailed' WHEN 4624 THEN 'ADUserLogon' WHEN 4740 THEN 'ADUserLockouts' WHEN 4768 THEN 'KerberosTGTRequest' END AS named_event,
    CASE WHEN id = 4625 THEN workstation WHEN id = 4768 THEN NULL ELSE subject_domain || '\\' || subject_user END AS who, target_domain || '\\' || target_user AS object_affected, computer_name AS computer
  FROM evt WHERE id IN (4624, 4625, 4740) OR (id = 4768 AND upper(provider_name) = 'MICROSOFT-WINDOWS-SECURITY-AUDITING'))"""
_TOKEN = "'computer=' || computer || '|object_affected=' || CASE WHEN trim(object_affected) = '' THEN '<empty>' ELSE trim(object_affected) END || '|who=' || CASE WHEN trim(coalesce(who, '')) = '' THEN '<empty>' ELSE trim(who) END"
_ORDER = "time_created, record_id, upper(named_event)"
_CORRELATED = _DISPATCH + f", t AS (SELECT *, substr(sha256({_TOKEN}), 1, 16) AS correlation_id FROM named)"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data(spark, sf_dir).withColumns({"message": F.lit(""), "message_subject": F.lit("")})
    return rules.unified(rows, NAMED, with_payload=False)


@query(_DISPATCH + " SELECT record_id, named_event, who, object_affected, computer FROM named")
def named_events_dispatch(spark, sf_dir):
    return named(spark, sf_dir).select("record_id", "named_event", "who", "object_affected", "computer")


@query(" SELECT channel, event_id, count(record_id) AS events FROM (VALUES ('Security', 4624), ('Security', 4625), ('Security', 4740), ('Security', 4768), ('System', 12)) t(channel, event_id) LEFT JOIN evt ON log_name = channel AND id = event_id GROUP BY ALL")
def named_events_plan(spark, sf_dir):
    """The scan plan of some named events, with what the log holds of each (channel, id)."""
    plan = rules.scan_plan([*NAMED, "OSStartup", "AADSyncProvisionCredentialsPing"])
    wanted = spark.createDataFrame([(c, i) for c, ids in plan.items() for i in ids], "channel string, event_id int")
    found = events(spark, sf_dir).groupBy("log_name", "id").agg(F.count("*").alias("n"))
    return wanted.join(found, (F.col("log_name") == F.col("channel")) & (F.col("id") == F.col("event_id")), "left").select("channel", "event_id", F.coalesce("n", F.lit(0)).alias("events"))


@query(_CORRELATED + f" SELECT row_number() OVER (ORDER BY {_ORDER}) AS sequence, record_id, named_event, correlation_id FROM t ORDER BY sequence LIMIT 2000")
def timeline_rows(spark, sf_dir):
    return T.timeline_rows(named(spark, sf_dir), max_events=2000).select("sequence", "record_id", "named_event", "correlation_id")


@query(_CORRELATED + f" SELECT row_number() OVER (ORDER BY {_ORDER}) AS sequence, record_id, named_event, correlation_id FROM t")
def timeline_numbered(spark, sf_dir):
    """The whole timeline, numbered by ranges."""
    return T.timeline_rows(named(spark, sf_dir), max_events=None).select("sequence", "record_id", "named_event", "correlation_id")


@query(_DISPATCH + f" SELECT record_id, substr(sha256({_TOKEN}), 1, 16) AS correlation_id FROM named")
def correlation_id(spark, sf_dir):
    return named(spark, sf_dir).select("record_id", T.correlation_id({k: F.col(k) for k in profiles.DEFAULT_KEYS}).alias("correlation_id"))


@query(
    _CORRELATED
    + """, g AS (SELECT correlation_id, count(*) AS event_count, min(time_created) AS first_seen, max(time_created) AS last_seen, list_sort(list(DISTINCT named_event)) AS names, list_sort(list(DISTINCT id)) AS ids, list_sort(list(DISTINCT upper(computer_name))) AS machines FROM t GROUP BY correlation_id)
    SELECT correlation_id, event_count, first_seen, last_seen, round((epoch_us(last_seen) - epoch_us(first_seen)) / 60000000.0::DOUBLE, 3) AS duration_minutes, array_to_string(names, ',') AS named_events, array_to_string(ids, ',') AS event_ids,
    array_to_string(machines, ',') AS machines, (SELECT count(*) FROM g) AS groups_total FROM g ORDER BY event_count DESC, first_seen, correlation_id LIMIT 250"""
)
def timeline_groups(spark, sf_dir):
    groups = T.timeline_groups(T.correlated(named(spark, sf_dir)))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return groups.select("correlation_id", "event_count", "first_seen", "last_seen", "duration_minutes", text("named_events"), text("event_ids"), text("machines"), "groups_total")


def _bucketed(minutes: int) -> str:
    return _CORRELATED + f" SELECT time_bucket(INTERVAL {minutes} MINUTE, time_created, TIMESTAMP '0001-01-01') AS bucket_start, count(*) AS event_count, count(DISTINCT correlation_id) AS correlation_count FROM t GROUP BY 1"


@query(_bucketed(15))
def timeline_buckets(spark, sf_dir):
    return T.timeline_buckets(T.correlated(named(spark, sf_dir)), 15)


@query(_bucketed(7))
def timeline_buckets_7m(spark, sf_dir):
    return T.timeline_buckets(T.correlated(named(spark, sf_dir)), 7)


@query(
    _DISPATCH
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY named_event ORDER BY time_created, record_id) > 500 AS over FROM named)
    SELECT count(*) FILTER (over) AS n_per_name, count(*) FILTER (NOT over AND upper(log_name) <> 'SECURITY') AS n_log_name, count(*) FILTER (NOT over AND id NOT IN (4624, 4625)) AS n_event_id, 0::BIGINT AS n_uncorrelated, count(*) FILTER (NOT over AND id IN (4624, 4625)) AS n_kept FROM o"""
)
def timeline_filter_counts(spark, sf_dir):
    return T.filter_counts(named(spark, sf_dir), profiles.DEFAULT_KEYS, 500, "security", (4624, 4625), False)


@query(_DISPATCH + " SELECT record_id, 'computer=' || computer || ';ip_address=' || ip_address || ';object_affected=' || object_affected AS payload FROM named WHERE id = 4625")
def timeline_payload(spark, sf_dir):
    rows = rules.unified(data(spark, sf_dir).withColumns({"message": F.lit(""), "message_subject": F.lit("")}), ["ADUserLogonFailed"], ("ip_address", "object_affected", "computer"))
    pairs = F.array_sort(F.transform(F.map_entries("payload"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.select("record_id", F.array_join(pairs, ";").alias("payload"))


@query(_DISPATCH + " SELECT record_id, named_event FROM (SELECT *, row_number() OVER (PARTITION BY named_event ORDER BY time_created, record_id) AS r FROM named) WHERE r <= 7")
def cap_per_named_event(spark, sf_dir):
    return T.timeline_rows(named(spark, sf_dir), max_events=100, per_name=7).select("record_id", "named_event")


@query(_DISPATCH + " SELECT id AS event_id, count(DISTINCT substr(sha256('action=<empty>|who=' || CASE WHEN trim(coalesce(who, '')) = '' THEN '<empty>' ELSE trim(who) END), 1, 16)) AS correlations FROM named GROUP BY id")
def timeline_profile_actor(spark, sf_dir):
    keys = profiles.resolve_profile("Actor-Activity")
    rows = named(spark, sf_dir).withColumn("correlation_id", T.correlation_id({k: F.col(k) for k in keys}))
    return rows.groupBy("event_id").agg(F.countDistinct("correlation_id").alias("correlations"))


# ------------------------------------------------------------- scripts, enrichment, inventory


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").cast("string").alias("script_id"), F.col("turn").alias("number"), F.lit(None).cast("bigint").alias("total"), "text", F.lit("DC1").alias("machine"), F.col("turn").alias("seq"))


_SCRIPT = "SELECT CAST(conv_id AS VARCHAR) AS script_id, count(*) FILTER (turn >= 1)::INT AS n_parts, coalesce(string_agg(text, '' ORDER BY turn) FILTER (turn >= 1), '') AS script FROM conversations WHERE trim(coalesce(text, '')) NOT IN ('', '0') GROUP BY conv_id"


@query(_SCRIPT, False)
def script_reassembly(spark, sf_dir):
    return scripts.reassemble(_parts(spark, sf_dir)).select("script_id", "n_parts", "script")


@query(f"SELECT script_id, n_parts FROM ({_SCRIPT}) WHERE contains(upper(script), 'THE') AND contains(upper(script), 'ING')", False)
def script_contains(spark, sf_dir):
    return scripts.reassemble(_parts(spark, sf_dir), ["the", None, "Ing"]).select("script_id", "n_parts")


@query(" SELECT record_id, row_number() OVER (PARTITION BY computer_name ORDER BY time_created, record_id)::INT AS execution_index, 'run ' || k::VARCHAR AS \"CommandName\", target_user AS \"User\" FROM evt WHERE level = 3")
def script_context(spark, sf_dir):
    text = F.concat(F.lit("Host Application = pwsh\r\n\r\nCommand Name = run "), F.col("k").cast("string"), F.lit("\nScriptName = \nUser="), F.col("target_user"))
    rows = events(spark, sf_dir).where("level = 3").select("record_id", "time_created", "computer_name", F.lit(4100).alias("id"), F.create_map(F.lit("CONTEXTINFO"), text).alias("data_ci"))
    return scripts.executions(rows).select("record_id", "execution_index", "CommandName", "User")


@query(" SELECT record_id, row_number() OVER (ORDER BY time_created, computer_name, record_id) AS execution_index FROM evt WHERE level = 3")
def script_executions_numbered(spark, sf_dir):
    """Executions of all computers in one order, numbered by ranges."""
    rows = events(spark, sf_dir).where("level = 3").select("record_id", "time_created", "computer_name", F.lit(4100).alias("id"), F.create_map(F.lit("CONTEXTINFO"), F.concat(F.lit("User="), "target_user")).alias("data_ci"))
    return scripts.executions(rows, across=True).select("record_id", "execution_index")


@query(" SELECT e.record_id, e.user_id FROM evt e WHERE e.user_id IN (SELECT 'S-1-5-21-' || s_suppkey % 4 FROM supplier WHERE upper(s_name) IN ('SUPPLIER#000000002', 'SUPPLIER#000000005') AND s_suppkey <> 5 UNION ALL SELECT 'S-1-5-21-3')")
def filter_account_name(spark, sf_dir):
    """Accounts by name, resolved from a dimension before the scan; one name is a SID, one is of another domain."""
    domain = F.when(F.col("s_suppkey") == 5, "OTHER\\").otherwise("CORP\\")
    known = table(spark, sf_dir, "supplier").select(F.concat(domain, "s_name").alias("account"), F.concat(F.lit("S-1-5-21-"), (F.col("s_suppkey") % 4).cast("string")).alias("sid"))
    return accounts.by_account(events(spark, sf_dir), known, ["supplier#000000002", "corp\\Supplier#000000005", "S-1-5-21-3"]).select("record_id", "user_id")


@query(" SELECT record_id, CASE WHEN ip_address IN ('-', '::1') THEN NULL ELSE 'host-' || replace(ip_address, '.', '-') END AS ip_address_name FROM evt")
def reverse_names(spark, sf_dir):
    """Names of addresses, each address resolved once."""
    found, _ = accounts.reverse_names(events(spark, sf_dir), "ip_address", lambda a: None if a == "::1" else "host-" + a.replace(".", "-"))
    return found.select("record_id", "ip_address_name")


@query(" SELECT e.record_id, s.s_name AS supplier FROM evt e LEFT JOIN supplier s ON e.user_number = s.s_suppkey")
def enrich_dim_left(spark, sf_dir):
    dimension = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("supplier"))
    return tables.enrich(events(spark, sf_dir), dimension, F.col("user_number") == F.col("s_suppkey")).select("record_id", "supplier")


@query(" SELECT e.record_id, c.c_name AS account, n.n_name AS nation FROM evt e LEFT JOIN customer c ON e.user_number = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def enrich_account(spark, sf_dir):
    accounts = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("account"), "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    rows = tables.enrich(events(spark, sf_dir), accounts, F.col("user_number") == F.col("c_custkey"))
    return tables.enrich(rows, nations, F.col("c_nationkey") == F.col("n_nationkey")).select("record_id", "account", "nation")


@query(" SELECT DISTINCT upper(computer_name) AS host FROM evt")
def distinct_hosts(spark, sf_dir):
    return events(spark, sf_dir).select(F.upper("computer_name").alias("host")).dropDuplicates()


@query(" SELECT DISTINCT coalesce(CASE WHEN k % 10 = 0 THEN NULL ELSE record_id END, -1) AS record_id FROM evt")
def dedup_record_id(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.when(F.col("k") % 10 != 0, F.col("record_id")).alias("record_id"))
    return tables.dedup_records(rows.unionByName(rows)).select(F.coalesce("record_id", F.lit(-1)).alias("record_id"))


@query(" SELECT log_name, count(*) AS record_count, min(record_id) AS oldest_record, max(record_id) AS newest_record, min(time_created) AS oldest_event, max(time_created) AS newest_event FROM evt GROUP BY log_name")
def log_information(spark, sf_dir):
    return tables.log_information(events(spark, sf_dir))
