"""Reports: counts by dimension, top-k, statistics, security reports.

Fan-outs unpivot once and aggregate once: one scan, one shuffle of (dimension, key) counters
with map-side combining, whatever the number of dimensions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import decode as D, lookups as L
from ..functions.parse import account, joined, raw

UNKNOWN = "(unknown)"


def _place() -> Column:
    """Time and record id as one number: unlike a struct it is a fixed-width aggregation buffer, so counting hashes and never sorts."""
    micros = F.coalesce(F.unix_micros(F.col("time_created").cast("timestamp")), F.lit(10**18 - 1)).cast("decimal(18,0)")  # null: after all others
    return (micros * F.lit(str(10**19)).cast("decimal(20,0)") + F.coalesce("record_id", F.lit((1 << 63) - 1)).cast("decimal(19,0)")).cast("decimal(38,0)")


def _folded(rows: DataFrame, *groups: str) -> DataFrame:
    """Counts of (groups, key, place) rows: first per exact key in a hash aggregation, then the few casings of each key together."""
    exact = rows.groupBy(*groups, "key").agg(F.min("place").alias("place"), F.count("*").alias("count"))
    folded = exact.groupBy(*groups, F.upper("key").alias("folded")).agg(F.min_by("key", "place").alias("key"), F.sum("count").alias("count"))
    return folded.select(*groups, "key", "count")


def count_text(events: DataFrame, key: Column, unknown: bool = False) -> DataFrame:
    """Rows (key, count): keys trimmed and equal without case, shown as first seen; blank ones skipped, or counted as (unknown)."""
    shown = F.trim(F.coalesce(key, F.lit("")))
    shown = F.when(shown == "", F.lit(UNKNOWN)).otherwise(shown) if unknown else shown
    return _folded(events.select(shown.alias("key"), _place().alias("place")).where("key != ''"))


def count_number(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("count"))


def count_levels(events: DataFrame, name: Column) -> DataFrame:
    """Rows (level, level_name, count); null levels count as 0, the first name seen stays."""
    rows = events.select(F.coalesce("level", F.lit(0)).alias("level"), name.alias("key"), _place().alias("place"))
    exact = rows.groupBy("level", "key").agg(F.min("place").alias("place"), F.count("*").alias("count"))
    return exact.groupBy("level").agg(F.min_by("key", "place").alias("level_name"), F.sum("count").alias("count"))


def top(counts: DataFrame, k: int, text: bool = True) -> DataFrame:
    """The k largest counts; ties by key, text without case."""
    return counts.orderBy(F.desc("count"), F.upper("key") if text else F.col("key")).limit(max(0, k))


def keyed_top(counts: DataFrame, k: int, name: str, text: bool = True) -> DataFrame:
    """top() as rows (key: {name: key}, count), in order."""
    if not name or not name.strip():
        raise ValueError("a name for the key is needed")
    return top(counts, k, text).select(F.create_map(F.lit(name), F.col("key").cast("string")).alias("key"), "count")


def preview_top(counts: DataFrame, k: int, text: bool = True) -> DataFrame:
    """top() as rows of text cells [key, count], in order."""
    return top(counts, k, text).select(F.array(F.col("key").cast("string"), F.col("count").cast("string")).alias("cells"))


def summary(events: DataFrame, matched: Column | None = None) -> DataFrame:
    """One row: scanned, matched, min_utc, max_utc (of matched ones)."""
    hit = F.lit(True) if matched is None else matched
    return events.agg(F.count("*").alias("scanned"), F.count_if(hit).alias("matched"), F.min(F.when(hit, F.col("time_created"))).alias("min_utc"), F.max(F.when(hit, F.col("time_created"))).alias("max_utc"))


def fan_out(events: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Rows (dim, key, count) of all dimensions from one unpivot; keys as in count_text."""
    cells = F.array(*[F.struct(F.lit(d).alias("dim"), F.trim(F.coalesce(c.cast("string"), F.lit(""))).alias("key")) for d, c in dimensions.items()])
    rows = events.select(_place().alias("place"), F.explode(cells).alias("c")).select("place", "c.*").where("key != ''")
    return _folded(rows, "dim")


def fan_out_top(counts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("dim").orderBy(F.desc("count"), F.upper("key"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def stats(events: DataFrame) -> DataFrame:
    """Counts by event id, provider, computer and level in one aggregation: rows (dim, key, count)."""
    return fan_out(events, {"event_id": F.col("id"), "provider": F.when(D.blank(F.col("provider_name")), F.lit(UNKNOWN)).otherwise(F.col("provider_name")), "computer": F.col("computer_name"), "level": F.coalesce("level", F.lit(0))})


def live_stats(events: DataFrame, matched: Column, scan_limit: int) -> DataFrame:
    """Summary over the newest scan_limit events: the limit counts scanned ones, the range comes after; truncated if reached."""
    scanned = events.orderBy(F.desc("time_created"), F.desc("record_id")).limit(scan_limit)
    return summary(scanned, matched).withColumn("truncated", F.col("scanned") >= scan_limit)


def _target(data: Column) -> tuple[Column, Column]:
    parts = D.split_account(joined(raw(data, "TargetUserName"), raw(data, "TargetDomainName"), reverse=True))
    user = D.first_filled(parts["user"], raw(data, "TargetUserName"), raw(data, "AccountName"))
    return user, D.first_filled(parts["domain"], raw(data, "TargetDomainName"))


def failed_logon_numbers(data: Column) -> dict[str, Column]:
    """What several columns are made of, decoded once."""
    user, domain = _target(data)
    numbers = {k: D.decode_enum(raw(data, k), table, base) for k, table, base in (("Status", L.STATUS_CODE, "hexadecimal"), ("SubStatus", L.SUB_STATUS_CODE, "hexadecimal"), ("FailureReason", L.FAILURE_REASON, "decimal"))}
    return {"user_": user, "domain_": domain, "status_": numbers["Status"], "sub_status_": numbers["SubStatus"], "reason_": numbers["FailureReason"], "logon_type_": D.decode_enum(raw(data, "LogonType"), L.LOGON_TYPE, "decimal")}


def failed_logon_columns(data: Column, made: dict[str, Column] | None = None) -> dict[str, Column]:
    """The report's columns; made: the columns of failed_logon_numbers where they exist."""
    made = failed_logon_numbers(data) if made is None else made
    user, domain, status, sub_status, reason = (made[k] for k in ("user_", "domain_", "status_", "sub_status_", "reason_"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return {
        "target_user": user, "target_domain": domain, "logon_type": text(made["logon_type_"].cast("string")), "ip_address": D.placeholder(raw(data, "IpAddress")),
        "workstation": D.placeholder(raw(data, "WorkstationName")), "computer": F.col("computer_name"), "status": text(D.hex8(status)), "status_name": text(D.enum_name(status, L.STATUS_CODE)),
        "sub_status": text(D.hex8(sub_status)), "sub_status_name": text(D.enum_name(sub_status, L.SUB_STATUS_CODE)), "failure_reason": text(D.enum_name(reason, L.FAILURE_REASON)),
    }


def user_logon_numbers(data: Column) -> dict[str, Column]:
    """The account's parts, and the logon type's number of the events that have one."""
    user, domain = _target(data)
    return {"user_": user, "domain_": domain, "logon_type_": F.when(F.col("id").isin(4624, 4625), D.decode_enum(raw(data, "LogonType"), L.LOGON_TYPE, "decimal"))}


def user_logon_columns(data: Column, made: dict[str, Column] | None = None) -> dict[str, Column]:
    made = user_logon_numbers(data) if made is None else made
    decoded = F.col("id").isin(4624, 4625)  # these have a joined account, others its parts
    user = F.when(decoded, made["user_"]).otherwise(D.first_filled(raw(data, "TargetUserName"), raw(data, "AccountName")))
    return {
        "event_id": F.col("id"), "target_user": user, "target_domain": made["domain_"], "logon_type": F.coalesce(made["logon_type_"].cast("string"), D.first_filled(raw(data, "LogonType"))),
        "ip_address": D.placeholder(D.first_filled(raw(data, "IpAddress"), raw(data, "ClientAddress"))), "workstation": D.placeholder(raw(data, "WorkstationName")), "computer": F.col("computer_name"),
    }


def account_parts(data: Column) -> dict[str, Column]:
    user, domain = _target(data)
    return {"user_": user, "domain_": domain}


def lockout_columns(data: Column, made: dict[str, Column] | None = None) -> dict[str, Column]:
    made = account_parts(data) if made is None else made
    return {"target_user": made["user_"], "target_domain": made["domain_"], "caller_computer": D.placeholder(raw(data, "CallerComputerName")), "computer": F.col("computer_name"), "subject_user": D.first_filled(account(data, "Subject"), raw(data, "SubjectUserName"))}


@dataclass(frozen=True)
class SecurityReport:
    event_ids: tuple[int, ...]
    columns: object
    numbers: object = None


REPORTS = {
    "failed_logons": SecurityReport((4625,), failed_logon_columns, failed_logon_numbers),
    "user_logons": SecurityReport((4624, 4625, 4634, 4647), user_logon_columns, user_logon_numbers),
    "lockouts": SecurityReport((4740,), lockout_columns, account_parts),
}
SECURITY_PROVIDER = "Microsoft-Windows-Security-Auditing"


def security_counts(events: DataFrame, report: str) -> DataFrame:
    """Rows (dim, key, count) of a security report."""
    spec, data = REPORTS[report], F.col("data_ci")
    rows = events.where(F.col("id").isin(*spec.event_ids))
    if spec.numbers is None:
        return fan_out(rows, spec.columns(data))
    made = spec.numbers(data)
    rows = rows.withColumns(made)
    return fan_out(rows, spec.columns(data, {k: F.col(k) for k in made}))


def security_samples(events: DataFrame, report: str, size: int) -> DataFrame:
    """The first rows in scan order (oldest first)."""
    spec = REPORTS[report]
    data = F.col("data_ci")
    rows = events.where(F.col("id").isin(*spec.event_ids)).orderBy("time_created", "record_id").limit(max(0, size))
    return rows.select("time_created", "record_id", "id", *[c.alias(n) for n, c in spec.columns(data).items() if n != "event_id"], account(data, "Subject").alias("subject"))
