"""The canonical event row and small helpers on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Column -> type of the canonical row.
EVENT_FIELDS = dict(
    part.split(" ", 1)
    for part in """record_id bigint; time_created timestamp_ntz; id int; version int; level int; level_display_name string; task int; task_display_name string;
    opcode int; opcode_display_name string; keywords bigint; keywords_display_names array<string>; provider_name string; provider_id string; qualifiers string;
    activity_id string; related_activity_id string; process_id int; thread_id int; log_name string; container_log string; computer_name string;
    user_id string; message string; message_subject string; message_lines array<string>; message_data map<string,string>; data map<string,string>;
    nic_identifiers array<string>; attachments array<binary>; xml_data string; queried_machine string; gathered_from string; gathered_log_name string""".replace("\n    ", " ").split("; ")
)

#: Fixed ladder of level names; other levels render as their number, null as "".
LEVEL_NAMES = {1: "Critical", 2: "Error", 3: "Warning", 4: "Information", 5: "Verbose"}


def literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def level_name(level: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(LEVEL_NAMES), level), level.cast("string"), F.lit(""))


def last_wins(entries: Column) -> Column:
    """Entries (key, value) without those whose key comes again later, whatever its case. Sorted once: no entry is compared with all others."""
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(F.upper(e["key"]).alias("k"), i.alias("i"), e.alias("e"))))
    last = lambda s: F.filter(s, lambda x, i: (i + 1 == F.size(s)) | (F.get(s, i + 1)["k"] != x["k"]))
    kept = F.get(F.transform(F.array(placed), last), F.lit(0))  # an array of one binds the sorted entries
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["e"].alias("e")))), lambda x: x["e"])


def upper_keys(data: Column) -> Column:
    """The map for lookups without case; of keys that differ in case only, the last wins."""
    return F.map_from_entries(F.transform(last_wins(F.map_entries(data)), lambda e: F.struct(F.upper(e["key"]), e["value"])))


def conform(df: DataFrame) -> DataFrame:
    """df with every canonical column (missing ones null), derived ones filled, and data_ci for lookups."""
    have = {c.lower() for c in df.columns}
    out = df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in EVENT_FIELDS.items()], *[c for c in df.columns if c.lower() not in EVENT_FIELDS])
    return out.withColumns(
        {
            "level_display_name": F.coalesce("level_display_name", level_name(F.col("level"))),
            "container_log": F.coalesce("container_log", "log_name"),
            "gathered_from": F.coalesce("queried_machine", "gathered_from"),
            "gathered_log_name": F.coalesce("gathered_log_name", "container_log", "log_name"),
            "message": F.coalesce("message", F.lit("")),
            "xml_data": F.coalesce("xml_data", F.lit("")),
            "data_ci": upper_keys(F.coalesce("data", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))),
        }
    )
