"""The filter algebra: one specification that becomes a Column (pushed down) or XPath text (plans.xpath)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lookups, periods
from ..functions.parse import raw


@dataclass(frozen=True)
class FilterSpec:
    """All given parts hold together. Named data: values of a key are alternatives; keys are joined by `keys` ("or" or "and")."""

    log_name: str | None = None
    event_ids: tuple[int, ...] = ()
    record_ids: tuple[int, ...] = ()
    exclude_ids: tuple[int, ...] = ()
    providers: tuple[str, ...] = ()
    levels: tuple[int | str, ...] = ()
    keywords: tuple[int | str, ...] = ()
    tasks: tuple[int, ...] = ()
    opcodes: tuple[int, ...] = ()
    start: datetime | None = None
    end: datetime | None = None
    period: str | None = None
    now: datetime | None = None
    users: tuple[str, ...] = ()
    data_values: tuple[str, ...] = ()
    named_data: dict[str, tuple[str, ...]] = field(default_factory=dict)
    named_data_exclude: dict[str, tuple[str, ...]] = field(default_factory=dict)
    keys: str = "or"
    message_regex: str | None = None
    after_record: int | None = None
    machines: tuple[str, ...] = ()


def level_numbers(levels: tuple[int | str, ...]) -> list[int]:
    return [lookups.LEVELS[x] if isinstance(x, str) else x for x in levels]


def keyword_mask(keywords: tuple[int | str, ...]) -> int:
    return reduce(lambda a, b: a | b, [lookups.KEYWORDS[x] if isinstance(x, str) else x for x in keywords], 0)


def named_data_column(data_ci: Column, wanted: dict[str, tuple[str, ...]], exclude: bool = False, keys: str = "or") -> Column:
    """Include: the key has one of the values (no value: it exists). Exclude: the key exists and has none of them."""
    parts = []
    for key, values in wanted.items():
        value = raw(data_ci, key)
        if exclude and not values:
            raise ValueError("an exclusion needs values")
        parts.append(value.isNotNull() if not values else value.isNotNull() & ~value.isin(*values) if exclude else value.isin(*values))
    return reduce((lambda a, b: a | b) if keys == "or" else (lambda a, b: a & b), parts)


def to_column(spec: FilterSpec) -> Column:
    """The predicate of a specification. Ids, times, levels and masks are plain comparisons of columns, so they reach the scan."""
    c: list[Column] = []
    if spec.log_name is not None:
        c.append(F.col("log_name") == lookups.KNOWN_LOGS.get(spec.log_name, spec.log_name))
    if spec.event_ids:
        if min(spec.event_ids) <= 0:
            raise ValueError("event ids are positive")
        c.append(F.col("id").isin(*dict.fromkeys(spec.event_ids)))
    if spec.record_ids:
        c.append(F.col("record_id").isin(*dict.fromkeys(spec.record_ids)))
    if spec.exclude_ids:
        c.append(~F.col("id").isin(*spec.exclude_ids))
    if spec.providers:
        c.append(F.upper("provider_name").isin(*[p.upper() for p in spec.providers]))
    if spec.levels:
        c.append(F.col("level").isin(*level_numbers(spec.levels)))
    if spec.keywords and keyword_mask(spec.keywords):
        c.append(F.col("keywords").bitwiseAND(F.lit(keyword_mask(spec.keywords))) != 0)
    for name, values in (("task", spec.tasks), ("opcode", spec.opcodes), ("user_id", spec.users), ("computer_name", spec.machines)):
        if values:
            c.append(F.col(name).isin(*values))
    start, end = (spec.start, spec.end) if spec.period is None else periods.bounds(spec.period, spec.now or datetime.now())
    if start is not None:
        c.append(F.col("time_created") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        c.append(F.col("time_created") <= F.lit(end).cast("timestamp_ntz"))
    if spec.data_values:
        c.append(F.exists(F.map_values("data"), lambda v: v.isin(*spec.data_values)))
    if spec.named_data:
        c.append(named_data_column(F.col("data_ci"), spec.named_data, keys=spec.keys))
    if spec.named_data_exclude:
        c.append(named_data_column(F.col("data_ci"), spec.named_data_exclude, True, spec.keys))
    if spec.message_regex is not None:
        c.append(F.col("message").rlike(spec.message_regex))
    if spec.after_record is not None:
        c.append(F.col("record_id").isNull() | (F.col("record_id") > spec.after_record))
    return reduce(lambda a, b: a & b, c, F.lit(True))


def scan(events: DataFrame, spec: FilterSpec, limit: int = 0, oldest: bool = False, per_host: bool = False) -> DataFrame:
    """Filtered events, newest first (or oldest first), at most limit (0: all); per_host limits each computer's rows."""
    out = events.where(to_column(spec))
    order = [F.asc("time_created"), F.asc("record_id")] if oldest else [F.desc("time_created"), F.desc("record_id")]
    if per_host and limit:
        from pyspark.sql import Window

        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("computer_name").orderBy(*order))).where(F.col("_n") <= limit).drop("_n")
        return out
    out = out.orderBy(*order)
    return out.limit(limit) if limit else out


def wildcard(column: Column, pattern: str) -> Column:
    """* and ? patterns over the whole text, without case."""
    import re

    return column.rlike("(?is)^" + "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern) + "$")


def contains_all(column: Column, terms: list[str | None]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(F.upper(column), F.lit(t.upper())) for t in terms if t], F.lit(True))
