"""One entry point over an event table: what a user of an event-log toolkit asks for, by name."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .operators import accounts, filters, probe, reports, scripts, tables, timeline
from .operators.deadlines import Cancellation, RowStream, within
from .operators.filters import FilterSpec
from .operators.resume_state import ResumeState
from .operators.stats_state import StatsBuilder
from .plans import requests, rules, xpath
from .schema import EVENT_FIELDS, conform
from .sources.hosts import source_of
from .streaming.watch import Watcher, WatcherRegistry, matching


class EventLog:
    """Queries over canonical events. `events` may lack columns; they are filled with nulls."""

    def __init__(self, events: DataFrame):
        self.spark: SparkSession = events.sparkSession
        self.events = events if "data_ci" in events.columns and set(EVENT_FIELDS) <= set(events.columns) else conform(events)
        self.watchers = WatcherRegistry()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> EventLog:
        """The events of a file, folder or pattern: native log files (.evtx), XML exports (.xml) or Parquet."""
        return cls(source_of(spark, path))

    def get_events(self, spec: FilterSpec | None = None, *, named_events: list[str] = (), query: str | None = None, max_events: int = 0, oldest: bool = False, per_host: bool = False, expand: bool = False, state: DataFrame | None = None, include_message: bool = True) -> DataFrame:
        """Events by filter, XPath and named events, in scan order. The limit is global and comes after the rules.

        expand puts the event data into columns; state resumes behind its records.
        """
        rows = self.events
        if query is not None:
            rows = rows.where(xpath.xpath_column(query))
        if state is not None:
            rows = tables.resume(rows, state)
        if named_events:
            rows = rules.classify(rows, list(named_events))
        rows = filters.scan(rows, spec or FilterSpec(), max_events, oldest, per_host)
        rows = rows if include_message else rows.drop("message", "message_lines", "message_data")
        return tables.flatten(rows) if expand else rows

    def get_list(self, *args, seconds: float | None = None, cancel: Cancellation | None = None, **options) -> list:
        """get_events collected, within a time if one is given: the caller bounds it with max_events or a filter."""
        rows = self.get_events(*args, **options)
        return rows.collect() if seconds is None and cancel is None else within(self.spark, seconds, rows.collect, cancel)

    def stream_rows(self, *args, stall: float | None = None, cancel: Cancellation | None = None, **options) -> RowStream:
        """get_events row by row as they come, ended when none comes for `stall` seconds."""
        return RowStream(self.get_events(*args, **options), stall=stall, cancel=cancel)

    def of_accounts(self, directory: DataFrame, names: list[str]) -> EventLog:
        """The log of accounts by name, by a directory (account, sid)."""
        return self.with_events(accounts.by_account(self.events, directory, names))

    def read_new(self, state: ResumeState, key: str, action, spec: FilterSpec | None = None) -> int:
        """Hands the matching events behind the state to action, then moves the state; their number."""
        return state.read(self.events.where(filters.to_column(spec or FilterSpec())), key, action)

    def stats_builder(self, path: str) -> StatsBuilder:
        """A report in a folder with these events added to what it holds."""
        builder = StatsBuilder(self.spark, path)
        builder.add_range(self.events)
        return builder

    def named(self, name: str, spec: FilterSpec | None = None) -> DataFrame:
        """The typed projection of one named event."""
        return rules.project(self.events.where(filters.to_column(spec or FilterSpec())), name)

    @staticmethod
    def get_filter(spec: FilterSpec, *, xpath_only: bool = False, path: str | None = None) -> str:
        return xpath.build_xpath(spec) if xpath_only else xpath.build_query_list(spec, path)

    @staticmethod
    def check_filter(**parts) -> FilterSpec:
        return requests.structured_filter(**parts)

    def get_info(self) -> DataFrame:
        return tables.log_information(self.events)

    def get_logs(self, pattern: str = "*") -> DataFrame:
        return tables.catalog(self.events, "log_name", pattern=pattern)

    def get_providers(self, contains: str | None = None, most: int = 0) -> DataFrame:
        return tables.catalog(self.events, "provider_name", contains=contains, most=most)

    def probe(self, wanted: DataFrame | None = None, most: int = probe.MOST) -> DataFrame:
        """The newest event of every log, or of each wanted (log_name, computer_name) among its `most` newest."""
        return tables.probe_latest(self.events) if wanted is None else probe.probe_states(self.events, wanted, most)

    def get_scripts(self, contains: list[str] | None = None, formatted: bool = False) -> DataFrame:
        return scripts.reassemble(scripts.script_parts(self.events), contains, formatted)

    def get_executions(self, across: bool = False) -> DataFrame:
        return scripts.executions(self.events, across)

    def stats(self) -> DataFrame:
        return reports.stats(self.events)

    def security_report(self, report: str, request: requests.SecurityRequest) -> tuple[DataFrame, DataFrame | None]:
        """(top counts by dimension, samples) of failed_logons, user_logons or lockouts, over the oldest max_scanned events in range."""
        spec = FilterSpec(providers=(reports.SECURITY_PROVIDER,), event_ids=reports.REPORTS[report].event_ids, start=request.start, end=request.end)
        rows = filters.scan(self.events, spec, request.max_scanned, oldest=True)
        top = reports.fan_out_top(reports.security_counts(rows, report), request.top)
        return top, reports.security_samples(rows, report, request.sample_size) if request.include_samples else None

    def timeline(self, request: requests.TimelineRequest, spec: FilterSpec | None = None, payload: bool = True) -> timeline.Timeline:
        checked = requests.timeline_request(request, set(rules.RULES) | rules.WITHOUT_RULE)
        rows = rules.unified(self.events.where(filters.to_column(spec or FilterSpec())), list(checked.named_events), with_payload=payload)
        return timeline.build(rows, checked.keys, checked.max_events, checked.max_groups, checked.bucket_minutes, include_uncorrelated=checked.include_uncorrelated)

    def enrich(self, dimension: DataFrame, on: Column) -> DataFrame:
        return tables.enrich(self.events, dimension, on)

    def write(self, path: str) -> None:
        tables.write_events(self.events.select(*EVENT_FIELDS), path)

    def watch(self, stream: DataFrame, name: str, action, *, log_name: str | None = None, event_ids: list[int] = (), named_events: list[str] = (), staging: bool = False, **options) -> Watcher:
        """Starts a watcher over a stream of canonical events (a live one of the same name is reused)."""
        return self.watchers.start(Watcher(name, None, matching(stream, log_name, event_ids, named_events, staging), action, **options))

    def with_events(self, events: DataFrame) -> EventLog:
        other = EventLog(events)
        other.watchers = self.watchers
        return other


def spec(**parts) -> FilterSpec:
    return replace(FilterSpec(), **parts)
