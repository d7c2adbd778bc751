"""Watchers: event streams with filters, actions, counters, stop rules and a registry; windowed counts of streams."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..messages import MESSAGES
from ..operators.resume_state import ResumeState
from ..plans import rules

#: Event id that the staging flag adds.
STAGING_ID = 350


def watched_ids(event_ids: list[int], staging: bool = False) -> list[int]:
    return sorted({*event_ids, *([STAGING_ID] if staging else [])})


def matching(stream: DataFrame, log_name: str | None = None, event_ids: list[int] = (), named_events: list[str] = (), staging: bool = False, ids_only: bool = False) -> DataFrame:
    """The rows of a stream that a watcher acts on: the log, and ids or named events (whole rules, or just their ids)."""
    out = stream if log_name is None else stream.where(F.col("log_name") == log_name)
    if named_events:
        out = out.where(rules.scan_guard(list(named_events))) if ids_only else rules.classify(out, list(named_events))
    ids = watched_ids(list(event_ids), staging)
    return out.where(F.col("id").isin(*ids)) if ids else out


@dataclass
class Watcher:
    """A running stream with an action per micro-batch.

    stop_after ends it once that many rows were found: a batch is cut at the count, so the action
    never sees more. An action's error ends the watcher and is kept in `error`. With a state, rows up to the highest record ids
    kept under state_key are passed over, and those of each acted-on batch are kept: a watcher that starts again, on a new checkpoint
    too, neither repeats nor loses rows whose ids ascend within their log and host.
    """

    name: str
    machine: str | None
    stream: DataFrame
    action: Callable[[DataFrame], None]
    stop_on_match: bool = False
    stop_after: int = 0
    timeout: timedelta | None = None
    checkpoint: str | None = None
    state: ResumeState | None = None
    state_key: str | None = None
    trigger: dict = field(default_factory=lambda: {"processingTime": "1 second"})
    id: uuid.UUID = field(default_factory=uuid.uuid4)
    started: datetime | None = None
    found: int = 0
    error: Exception | None = None
    query: StreamingQuery | None = None
    _timer: threading.Timer | None = None
    _done: threading.Event = field(default_factory=threading.Event)

    def start(self) -> Watcher:
        writer = self.stream.writeStream.queryName(f"watch-{self.id.hex}").trigger(**self.trigger).foreachBatch(self._batch)
        self.started = datetime.now()
        self.query = (writer.option("checkpointLocation", self.checkpoint) if self.checkpoint else writer).start()
        if self.timeout:
            self._timer = threading.Timer(self.timeout.total_seconds(), self.stop)
            self._timer.daemon = True
            self._timer.start()
        return self

    @property
    def active(self) -> bool:
        return self.query is not None and self.query.isActive and not self._done.is_set()

    def _batch(self, rows: DataFrame, _: int) -> None:
        if self._done.is_set():
            return
        if self.state is not None:
            rows = self.state.behind(rows, self.state_key or self.name)
        left = (1 if self.stop_on_match else self.stop_after) - self.found if self.stop_on_match or self.stop_after else 0
        if self.stop_on_match or self.stop_after:
            order = [c for c in ("time_created", "record_id") if c in rows.columns]
            rows = rows.orderBy(*order).limit(max(0, left))
        rows, count = rows.persist(), 0
        try:
            count = rows.count()
            if count:
                self.found += count
                self.action(rows)
                if self.state is not None:
                    self.state.advance(rows, self.state_key or self.name)
        except Exception as e:  # noqa: BLE001
            self.error = e
            MESSAGES.write("error", f"watcher {self.name}: {str(e)[:300]}")
            self._done.set()
        finally:
            rows.unpersist()
        if (self.stop_on_match or self.stop_after) and count >= left:
            self._done.set()
        if self._done.is_set():
            threading.Thread(target=self.stop, daemon=True).start()

    def stop(self) -> None:
        self._done.set()
        if self._timer:
            self._timer.cancel()
        if self.query is not None and self.query.isActive:
            self.query.stop()

    def wait(self, seconds: float) -> bool:
        """Whether it ended within the time."""
        if self.query is None:
            return True
        return self._done.wait(seconds) or not self.query.isActive


class WatcherRegistry:
    """Watchers by id and by name (without case); a live one of the same name is reused."""

    def __init__(self) -> None:
        self._lock, self._watchers = threading.Lock(), {}

    def start(self, watcher: Watcher) -> Watcher:
        with self._lock:
            for other in self._watchers.values():
                if other.name.lower() == watcher.name.lower() and other.active:
                    return other
            self._watchers[watcher.id] = watcher.start()
            return watcher

    def get(self, name: str | None = None) -> list[Watcher]:
        with self._lock:
            return [w for w in self._watchers.values() if name is None or w.name.lower() == name.lower()]

    def _drop(self, chosen: list[Watcher]) -> int:
        for w in chosen:
            w.stop()
            with self._lock:
                self._watchers.pop(w.id, None)
        return len(chosen)

    def stop(self, watcher_id: uuid.UUID) -> bool:
        return bool(self._drop([w for w in self.get() if w.id == watcher_id]))

    def stop_by_name(self, name: str) -> int:
        return self._drop(self.get(name))

    def stop_all(self) -> int:
        return self._drop(self.get())

    @property
    def events_found(self) -> int:
        return sum(w.found for w in self.get())


def as_stream_time(stream: DataFrame) -> DataFrame:
    """Event time as timestamp, which watermarks need."""
    return stream.withColumn("time_created", F.col("time_created").cast("timestamp"))


def bucket_counts(stream: DataFrame, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """Events of each bucket and id of a stream; buckets close when the watermark passes them."""
    timed = as_stream_time(stream).withWatermark("time_created", late)
    return timed.groupBy(F.window("time_created", f"{minutes} minutes").alias("w"), "id").agg(F.count("*").alias("event_count")).select(F.col("w.start").alias("bucket_start"), "id", "event_count")


def dedup_stream(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows of a stream, each record id once within the watermark."""
    return as_stream_time(stream).withWatermark("time_created", late).dropDuplicatesWithinWatermark(["record_id"])
