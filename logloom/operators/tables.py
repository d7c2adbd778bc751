"""Flattening, inventory, probes, enrichment and set operations."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, Window, functions as F

from .filters import wildcard


#: Keys that become columns at most.
MOST_KEYS = 5000


def data_keys(events: DataFrame, column: str = "data") -> list[str]:
    """Every key of a map column, in order without case. Keys name columns of the result, so more than MOST_KEYS are refused."""
    rows = events.select(F.explode(F.map_keys(column)).alias("k")).distinct().limit(MOST_KEYS + 1).collect()
    if len(rows) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys: name those that are wanted")
    return sorted((r["k"] for r in rows), key=lambda k: (k.upper(), k))


def flatten(events: DataFrame, keys: list[str] | None = None, column: str = "data") -> DataFrame:
    """A string column for each key of the map (null where missing) behind the simple columns."""
    keys = data_keys(events, column) if keys is None else keys
    simple = [c for c, t in events.dtypes if not t.startswith(("map", "array", "struct")) and c not in keys]
    return events.select(*simple, *[F.try_element_at(column, F.lit(k)).alias(k) for k in keys])


def log_information(events: DataFrame) -> DataFrame:
    """Per log: records, newest and oldest record id and time."""
    return events.groupBy("log_name").agg(F.count("*").alias("record_count"), F.min("record_id").alias("oldest_record"), F.max("record_id").alias("newest_record"), F.min("time_created").alias("oldest_event"), F.max("time_created").alias("newest_event"))


def file_information(events: DataFrame) -> DataFrame:
    """Per source file (of a file scan): bytes, MB and records."""
    from ..functions.decode import convert_size

    files = events.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").agg(F.count("*").alias("record_count"))
    return files.withColumn("size_mb", convert_size(F.col("file_size")))


def probe_latest(events: DataFrame) -> DataFrame:
    """Per log: the newest event that has a time; status Ok or NoEvent."""
    newest = F.max_by("record_id", F.when(F.col("time_created").isNotNull(), F.struct("time_created", "record_id")))
    out = events.groupBy("log_name").agg(F.max("time_created").alias("latest_time"), newest.alias("latest_record"))
    return out.withColumn("status", F.when(F.col("latest_time").isNull(), "NoEvent").otherwise("Ok"))


def catalog(events: DataFrame, name: str, contains: str | None = None, pattern: str | None = None, most: int = 0) -> DataFrame:
    """Distinct names (equal without case, first in order shown) that contain a text or match a pattern, in order without case."""
    rows = events.select(F.col(name).alias("name")).where("trim(name) != ''")
    if contains:
        rows = rows.where(F.contains(F.upper("name"), F.lit(contains.upper())))
    if pattern:
        rows = rows.where(wildcard(F.col("name"), pattern))
    out = rows.groupBy(F.upper("name").alias("folded")).agg(F.min("name").alias("name")).orderBy("folded").select("name")
    return out.limit(most) if most else out


def catalog_page(events: DataFrame, name: str, contains: str | None = None, pattern: str | None = None, most: int = 100) -> DataFrame:
    """catalog() names, at most `most` of them, with truncated: the page is full, so there may be more."""
    page = catalog(events, name, contains, pattern, max(1, most))
    return page.withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(0))) >= max(1, most))  # of the page's rows


#: What a log does when it is full, by its mode; fixed names.
EVENT_ACTIONS = {"AutoBackup": "ArchiveTheLogWhenFullDoNotOverwrite", "Circular": "OverwriteEventsAsNeededOldestFirst", "Retain": "DoNotOverwriteEventsClearLogManually"}


def log_details(events: DataFrame, policies: DataFrame, size: Column | None = None) -> DataFrame:
    """One row for each log of a policy table (log_name, mode, maximum_bytes): what it holds, its size, and what happens when it is full.

    size: bytes of an event, for tables; without it they are the rows' share of the files that they were read from, so a log's
    size is that of its own files. A log without events has 0 records; one whose mode is not known has the action Unknown.
    """
    from ..functions.decode import blank, convert_size

    if size is None:
        events = events.withColumns({"_file": F.col("_metadata.file_path"), "_bytes": F.col("_metadata.file_size")})
        files = events.groupBy("log_name", "_file").agg(F.max("_bytes").alias("_bytes")).groupBy(F.col("log_name").alias("_log2")).agg(F.sum("_bytes").alias("_size"))
    provider = F.when(~blank(F.col("provider_name")), F.upper(F.trim("provider_name")))
    by = [F.count("*").alias("record_count"), F.min("record_id").alias("oldest_record"), F.max("record_id").alias("newest_record"), F.min("time_created").alias("oldest_event"), F.max("time_created").alias("newest_event"), F.array_sort(F.collect_set(provider)).alias("providers")]
    held = events.groupBy(F.col("log_name").alias("_log")).agg(*by, *([F.sum(size).alias("_size")] if size is not None else []))
    if size is None:
        held = held.join(files, F.col("_log").eqNullSafe(F.col("_log2"))).drop("_log2")
    out = policies.join(held, F.col("log_name") == F.col("_log"), "left")
    actions = F.create_map(*[F.lit(x) for kv in EVENT_ACTIONS.items() for x in kv])
    total = F.coalesce("_size", F.lit(0)).cast("bigint")
    return out.select(
        *policies.columns, F.coalesce("record_count", F.lit(0)).alias("record_count"), "oldest_record", "newest_record", "oldest_event", "newest_event", F.coalesce("providers", F.array().cast("array<string>")).alias("providers"),
        total.alias("size_bytes"), convert_size(total).alias("size_mb"), convert_size(F.col("maximum_bytes")).alias("maximum_mb"), F.coalesce(F.try_element_at(actions, F.col("mode")), F.lit("Unknown")).alias("event_action"), (total >= F.col("maximum_bytes")).alias("is_full"),
    )


def classic_log_state(wanted: DataFrame, logs: DataFrame, sources: DataFrame) -> DataFrame:
    """For each wanted (log_name, source_name): whether the log is among logs (log_name, maximum_kb, overflow_action, retention_days) and the source
    among sources (source_name, log_name), and for which log it is registered. Names are equal without case."""
    l = logs.select(F.upper("log_name").alias("_l"), F.col("log_name").alias("log_display_name"), F.col("maximum_kb").alias("maximum_kilobytes"), F.col("overflow_action").alias("overflow_action_name"), F.col("retention_days").alias("minimum_retention_days"))
    s = sources.groupBy(F.upper("source_name").alias("_s")).agg(F.min("log_name").alias("source_registered_log_name"))
    out = wanted.join(l, F.upper("log_name") == F.col("_l"), "left").join(s, F.upper("source_name") == F.col("_s"), "left")
    return out.withColumns({"log_exists": F.col("_l").isNotNull(), "source_exists": F.col("_s").isNotNull()}).drop("_l", "_s")


def enrich(events: DataFrame, dimension: DataFrame, on: Column, small_rows: int | None = None) -> DataFrame:
    """Left join with a lookup dimension. It is broadcast only if it is known to have at most small_rows rows; else Spark chooses by its size."""
    if small_rows is not None and small_rows <= 100_000 and dimension.limit(small_rows + 1).count() <= small_rows:
        dimension = F.broadcast(dimension)
    return events.join(dimension, on, "left")


def dedup_records(events: DataFrame) -> DataFrame:
    """One row per record id; all null ids count as one (-1)."""
    return events.withColumn("_key", F.coalesce("record_id", F.lit(-1))).dropDuplicates(["_key"]).drop("_key")


def resume(events: DataFrame, state: DataFrame) -> DataFrame:
    """Events behind the state's last record of their (log, host); rows without id or state pass."""
    s = state.select(F.col("log_name").alias("s_log"), F.col("computer_name").alias("s_host"), "last_record")
    joined = events.join(s, (F.col("log_name") == F.col("s_log")) & (F.col("computer_name") == F.col("s_host")), "left")
    return joined.where("last_record is null or record_id is null or record_id > last_record").drop("s_log", "s_host", "last_record")


def next_state(events: DataFrame) -> DataFrame:
    return events.groupBy("log_name", "computer_name").agg(F.max("record_id").alias("last_record"))


def retain(events: DataFrame, newer_than: Column | None = None) -> DataFrame:
    """The rows that a retention rule keeps."""
    return events if newer_than is None else events.where(F.col("time_created") >= newer_than)


def report_rows(events: DataFrame, include_message: bool = True, most_chars: int = 4000, limit: int = 0) -> DataFrame:
    """Report rows, oldest first: ISO time with 7 digits, nulls as "" or 0, message cut or null."""
    from ..functions.parse import truncate

    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    message = truncate(F.coalesce("message", F.lit("")), most_chars) if include_message else F.lit(None).cast("string")
    iso = F.concat(F.date_format("time_created", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))
    out = events.orderBy("time_created", "record_id")
    out = out.limit(limit) if limit else out
    return out.select(iso.alias("time_utc"), "id", F.coalesce("record_id", F.lit(0)).alias("record_id"), text("log_name"), text("provider_name"), F.coalesce("level", F.lit(0)).alias("level"), text("computer_name"), message.alias("message"))


def write_events(events: DataFrame, path: str) -> None:
    """Append events to a table partitioned by log and day, so that scans prune."""
    dated = events.withColumn("event_date", F.to_date("time_created"))
    dated.repartition("log_name", "event_date").write.mode("append").partitionBy("log_name", "event_date").parquet(path)


def subscription(xml: str) -> dict:
    """Description and Select texts of a subscription document, and its canonical one-line text; document types are refused."""
    if "<!DOCTYPE" in xml.upper():
        raise ValueError("a document type is not allowed")
    root = ET.fromstring(xml.strip())
    local = lambda e: e.tag.rpartition("}")[2]
    if local(root) != "Subscription":
        raise ValueError("the root is not Subscription")
    texts = [(e.text or "").strip() for e in root.iter() if local(e) == "Select"]
    inner = [q for e in root.iter() if local(e) == "Query" and e.text and "<Select" in e.text for q in [x.text.strip() for x in ET.fromstring(e.text.strip()).iter() if x.tag == "Select"]]
    description = next(((e.text or "").strip() for e in root.iter() if local(e) == "Description"), "")
    for e in root.iter():
        e.text, e.tail = (e.text or "").strip() or None, (e.tail or "").strip() or None
    return {"description": description, "queries": texts + inner, "canonical": " ".join(ET.tostring(root, encoding="unicode").split())}


def for_each(events: DataFrame, handler) -> int:
    """Calls handler(row) for each event, partition by partition on the driver, until it returns False; the number of calls."""
    calls = 0
    for row in events.toLocalIterator():
        calls += 1
        if handler(row) is False:
            break
    return calls


def named_rows(dimension: DataFrame, name: str = "name", patterns: list[str] = (), contains: str | None = None, enabled_only: bool = False) -> DataFrame:
    """Rows of a configuration table (channel policies, subscriptions, providers, classic logs) by name patterns or text, in order without case."""
    out = dimension
    if patterns:
        match = F.lit(False)
        for p in patterns:
            match = match | wildcard(F.col(name), p)
        out = out.where(match)
    if contains:
        out = out.where(F.contains(F.upper(name), F.lit(contains.upper())))
    if enabled_only:
        out = out.where("enabled")
    return out.orderBy(F.upper(name))
