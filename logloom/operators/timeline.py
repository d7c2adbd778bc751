"""Correlated timelines: rows, correlation groups and fixed time buckets of classified events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.profiles import DEFAULT_KEYS
from .numbering import numbered

EMPTY = "<empty>"
MAX_GROUPS, MAX_BUCKET_MINUTES = 2000, 1440
NUMBERED_IN_ONE_TASK = 10_000


def correlation_token(values: dict[str, Column]) -> Column:
    """Sorted key=value pairs joined by |; blank values read <empty>."""
    filled = lambda c: F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) == "", EMPTY).otherwise(F.trim(c.cast("string")))
    return F.concat_ws("|", *[F.concat(F.lit(f"{k}="), filled(values[k])) for k in sorted(values)])


def correlation_id(values: dict[str, Column]) -> Column:
    """The first 8 bytes of the token's SHA-256, lower-case hex."""
    return F.substring(F.sha2(correlation_token(values), 256), 1, 16)


def bucket_start(time: Column, minutes: int) -> Column:
    """Floor to buckets of N minutes counted from 0001-01-01."""
    n = max(1, min(MAX_BUCKET_MINUTES, minutes))
    offset = (-719162 * 1440) % n
    return F.window(time, f"{n} minutes", f"{n} minutes", f"{offset} minutes")["start"]


@dataclass(frozen=True)
class Timeline:
    rows: DataFrame
    groups: DataFrame
    buckets: DataFrame
    counters: DataFrame


def correlated(events: DataFrame, keys: tuple[str, ...] = DEFAULT_KEYS, per_name: int | None = None, log_name: str | None = None, event_ids: tuple[int, ...] = (), include_uncorrelated: bool = True) -> DataFrame:
    """Classified events (named_event and the key columns present) through the row filters in their order, with correlation_id; no cap."""
    out = events
    if per_name is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("named_event").orderBy(*_order()))).where(F.col("_n") <= per_name).drop("_n")
    if log_name is not None:
        out = out.where(F.upper("log_name") == log_name.upper())
    if event_ids:
        out = out.where(F.col("id").isin(*event_ids))
    values = {k: F.col(k) for k in keys}
    out = out.withColumn("correlation_id", correlation_id(values))
    return out if include_uncorrelated else out.where(~_uncorrelated(values))


def _order() -> list[Column]:
    return [F.asc_nulls_last("time_created"), F.asc_nulls_last("record_id"), F.upper("named_event").asc()]


def timeline_rows(events: DataFrame, keys: tuple[str, ...] = DEFAULT_KEYS, max_events: int | None = 500, **filters) -> DataFrame:
    """correlated() rows with sequence 1..n in time order: the earliest max_events of them, or all (None).

    Up to NUMBERED_IN_ONE_TASK rows are numbered as the sorted head that they are; more, or all, by ranges (operators.numbering).
    """
    out = correlated(events, keys, **filters)
    if max_events is not None:
        out = out.orderBy(*_order()).limit(max_events)
        if max_events <= NUMBERED_IN_ONE_TASK:
            return out.withColumn("sequence", F.row_number().over(Window.orderBy(*_order())).cast("bigint"))
    order = [(F.col("time_created"), "asc_nulls_last"), (F.col("record_id"), "asc_nulls_last"), (F.upper("named_event"), "asc")]
    return numbered(out, order, name="sequence")


def _uncorrelated(values: dict[str, Column]) -> Column:
    none = F.lit(True)
    for c in values.values():
        none = none & (F.trim(F.coalesce(c.cast("string"), F.lit(""))) == "")
    return none


def filter_counts(events: DataFrame, keys: tuple[str, ...], per_name: int | None, log_name: str | None, event_ids: tuple[int, ...], include_uncorrelated: bool) -> DataFrame:
    """How many rows each filter drops, in the order in which they apply.

    What the cap per name drops is counted; the later stages see rows under a row_number limit, which Spark applies before its shuffle too.
    """
    order = [F.asc_nulls_last("time_created"), F.asc_nulls_last("record_id")]
    other_log = F.upper("log_name") != log_name.upper() if log_name is not None else F.lit(False)
    other_id = ~F.col("id").isin(*event_ids) if event_ids else F.lit(False)
    loose = _uncorrelated({k: F.col(k) for k in keys}) if not include_uncorrelated else F.lit(False)
    stage = F.when(other_log, "log_name").when(other_id, "event_id").when(loose, "uncorrelated").otherwise("kept")
    kept, dropped = events, events.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n_per_name"))
    if per_name is not None:
        kept = events.withColumn("_n", F.row_number().over(Window.partitionBy("named_event").orderBy(*order))).where(F.col("_n") <= per_name)
        dropped = events.groupBy("named_event").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.greatest(F.col("c") - per_name, F.lit(0))), F.lit(0)).cast("bigint").alias("n_per_name"))
    stages = kept.select(stage.alias("stage")).agg(*[F.count_if(F.col("stage") == s).alias(f"n_{s}") for s in ("log_name", "event_id", "uncorrelated", "kept")])
    one = F.lit(1)  # two tables of one row each
    return dropped.withColumn("_k", one).join(stages.withColumn("_k", one), "_k").select("n_per_name", "n_log_name", "n_event_id", "n_uncorrelated", "n_kept")


def timeline_groups(rows: DataFrame, cap: int = 250) -> DataFrame:
    """One row per correlation id: count, first and last time, minutes between (3 digits), sets of names, ids and machines; groups_total is the number before the cap."""
    sets = lambda c: F.array_sort(F.collect_set(c))
    machine = F.when(F.trim(F.coalesce("computer_name", F.lit(""))) != "", F.upper(F.trim("computer_name")))
    groups = rows.groupBy("correlation_id").agg(
        F.count("*").alias("event_count"), F.min("time_created").alias("first_seen"), F.max("time_created").alias("last_seen"),
        sets("named_event").alias("named_events"), sets("id").alias("event_ids"), sets(machine).alias("machines"),
    )
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    groups = groups.withColumn("duration_minutes", F.round((seconds("last_seen") - seconds("first_seen")) / 60, 3))
    total = groups.agg(F.count("*").alias("groups_total")).withColumn("_one", F.lit(1))  # one row
    largest = groups.orderBy(F.desc("event_count"), F.asc_nulls_last("first_seen"), F.asc("correlation_id")).limit(min(cap, MAX_GROUPS))
    return largest.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")


def timeline_buckets(rows: DataFrame, minutes: int = 15) -> DataFrame:
    """Events and distinct correlation ids of each bucket that has any."""
    timed = rows.where("time_created is not null").withColumn("bucket_start", bucket_start(F.col("time_created"), minutes))
    return timed.groupBy("bucket_start").agg(F.count("*").alias("event_count"), F.countDistinct("correlation_id").alias("correlation_count")).orderBy("bucket_start")


def build(events: DataFrame, keys: tuple[str, ...] = DEFAULT_KEYS, max_events: int = 500, max_groups: int = 250, bucket_minutes: int = 15, **filters) -> Timeline:
    rows = timeline_rows(events, keys, max_events, **filters)  # the cap is the request's: groups and buckets are those of its rows
    counted = filter_counts(events, keys, filters.get("per_name"), filters.get("log_name"), filters.get("event_ids", ()), filters.get("include_uncorrelated", True))
    return Timeline(rows, timeline_groups(rows, max_groups), timeline_buckets(rows, bucket_minutes), counted)


def payload(columns: dict[str, Column], keep: tuple[str, ...] | None = None) -> Column:
    """map<string, string> of rule columns in snake case; null ones and those not asked for are left out."""
    from ..plans.profiles import snake_case

    names = {snake_case(k): c for k, c in columns.items() if not k.startswith("_")}
    wanted = {k: c for k, c in names.items() if keep is None or k in keep}
    if not wanted:
        return F.create_map().cast("map<string,string>")
    made = F.create_map(*[x for k, c in wanted.items() for x in (F.lit(k), c.cast("string"))])
    return F.map_filter(made, lambda _, v: v.isNotNull())
