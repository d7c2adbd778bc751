"""The driver's tables as canonical events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Columns of the adapter, as SQL that Spark and DuckDB share; {strip} is the number in props.
ADAPTER = """SELECT event_id AS record_id, ts AS time_created,
  CASE event_type WHEN 'click' THEN 4624 WHEN 'error' THEN 4625 WHEN 'purchase' THEN 4740 WHEN 'signup' THEN 4634 ELSE 4768 END AS id,
  'Security' AS log_name,
  CASE WHEN event_id % 40 = 0 THEN '' WHEN event_id % 3 = 0 THEN 'Microsoft-Windows-Security-Auditing' ELSE 'microsoft-windows-security-auditing' END AS provider_name,
  CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS level,
  CASE event_type WHEN 'error' THEN 4503599627370496 ELSE 9007199254740992 END AS keywords,
  concat('DC', CAST(user_id % 5 AS VARCHAR(10))) AS computer_name,
  CASE WHEN user_id % 2 = 0 THEN concat('User', CAST(user_id AS VARCHAR(10))) ELSE concat('USER', CAST(user_id AS VARCHAR(10))) END AS target_user,
  CASE WHEN user_id % 7 = 0 THEN '' ELSE 'CONTOSO' END AS target_domain,
  CASE WHEN user_id % 11 = 0 THEN '-' ELSE concat('WKS', CAST(user_id % 13 AS VARCHAR(10))) END AS workstation,
  {strip} AS k, value, user_id AS user_number,
  CASE {strip} % 5 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 2 THEN '10' WHEN 3 THEN 'Network' ELSE '' END AS logon_type,
  CASE {strip} % 9 WHEN 0 THEN '-' WHEN 1 THEN '::1' WHEN 2 THEN '::FFFF:10.1.2.3' ELSE concat('10.0.', CAST({strip} % 7 AS VARCHAR(10)), '.', CAST(user_id % 9 AS VARCHAR(10))) END AS ip_address,
  CASE {strip} % 4 WHEN 0 THEN '0xC000006D' WHEN 1 THEN '0xc0000234' WHEN 2 THEN '3221225586' ELSE '0x12345678' END AS status,
  CASE {strip} % 3 WHEN 0 THEN '0xC0000072' WHEN 1 THEN '0x0' ELSE '' END AS sub_status,
  CASE {strip} % 4 WHEN 0 THEN '%%2304' WHEN 1 THEN '%%2307' WHEN 2 THEN '%%2313' ELSE '' END AS failure_reason,
  CASE {strip} % 6 WHEN 0 THEN '' ELSE concat('svc', CAST({strip} % 3 AS VARCHAR(10))) END AS subject_user,
  CASE {strip} % 4 WHEN 0 THEN '' ELSE 'CORP' END AS subject_domain,
  CAST({strip} % 12 AS INTEGER) AS task, CAST({strip} % 5 AS INTEGER) AS opcode, concat('S-1-5-21-', CAST(user_id % 4 AS VARCHAR(10))) AS user_id
FROM events"""

DUCKDB_EVT = "WITH evt AS (" + ADAPTER.format(strip="CAST(regexp_replace(props, '[^0-9]', '', 'g') AS INTEGER)") + ")"
_SPARK = ADAPTER.format(strip="CAST(regexp_replace(props, '[^0-9]', '') AS INT)").replace("VARCHAR(10)", "STRING").replace("FROM events", "FROM {events}")

#: Event-data key of each adapter column.
DATA_KEYS = {
    "TargetUserName": "target_user", "TargetDomainName": "target_domain", "WorkstationName": "workstation", "LogonType": "logon_type", "IpAddress": "ip_address", "Status": "status",
    "CallerComputerName": "workstation", "SubStatus": "sub_status", "FailureReason": "failure_reason", "SubjectUserName": "subject_user", "SubjectDomainName": "subject_domain",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in adapter columns (flat: everything pushes down and prunes)."""
    return spark.sql(_SPARK, events=table(spark, sf_dir, "events"))


def with_data(evt: DataFrame) -> DataFrame:
    """Adds the event-data map; blank values stay, as in a log."""
    made = lambda name: F.create_map(*[x for k, c in DATA_KEYS.items() for x in (F.lit(name(k)), F.col(c))])
    return evt.withColumns({"data": made(str), "data_ci": made(str.upper)})
