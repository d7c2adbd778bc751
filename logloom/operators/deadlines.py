"""Work with an end: Spark jobs that stop at a deadline or when asked to, and row iterators that don't wait for ever.

Every piece of work runs in a thread of its own whose jobs carry a tag; what runs over its time, or is no longer
wanted, is cancelled by that tag, and nothing else is.
"""

from __future__ import annotations

import contextlib
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession

from ..messages import MESSAGES
from ..plans.requests import QueryFailure

#: Seconds between looks at the clock and at the wish to stop, and those that cancelled jobs get to end.
TICK, GRACE = 0.05, 10.0


class Cancellation:
    """A wish to stop that other threads can set."""

    def __init__(self) -> None:
        self._event = threading.Event()

    def cancel(self) -> None:
        self._event.set()

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()


def _tagged(spark: SparkSession, work: Callable[[], object], finish: Callable[[object, BaseException | None], None]) -> tuple[str, threading.Thread]:
    tag = f"deadline-{uuid.uuid4().hex}"

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            finish(work(), None)
        except BaseException as e:  # noqa: BLE001
            finish(None, e)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    return tag, thread


def _cancel(spark: SparkSession, tag: str, thread: threading.Thread) -> None:
    """Cancels the jobs of a tag until its thread ends: it may be about to start another one."""
    until = time.monotonic() + GRACE
    while thread.is_alive() and time.monotonic() < until:
        with contextlib.suppress(Exception):
            spark.sparkContext.cancelJobsWithTag(tag)
        thread.join(TICK)


def within(spark: SparkSession, seconds: float | None, work: Callable[[], object], cancel: Cancellation | None = None):
    """The result of work(). QueryFailure Timeout after the seconds (None: no limit), Cancelled when asked to stop; its jobs are then cancelled."""
    if cancel is not None and cancel.cancelled:
        raise QueryFailure("Cancelled", "cancelled before it began")
    done: list[tuple[object, BaseException | None]] = []
    tag, thread = _tagged(spark, work, lambda value, error: done.append((value, error)))
    until = None if seconds is None else time.monotonic() + seconds
    while thread.is_alive():
        thread.join(TICK)
        late = until is not None and time.monotonic() >= until and thread.is_alive()
        if late or cancel is not None and cancel.cancelled:
            _cancel(spark, tag, thread)
            MESSAGES.write("warning", f"timed out after {seconds} s" if late else "cancelled")
            raise QueryFailure("Timeout", f"not done after {seconds} s") if late else QueryFailure("Cancelled", "cancelled while it ran")
    value, error = done[0]
    if error is not None:
        raise error
    return value


@dataclass
class RowStream(Iterator[Row]):
    """Rows of a plan as they come, partition by partition, at most `ahead` of them waiting.

    stall: seconds to wait for the next row. When they pass, the jobs are cancelled; a stream that gave no row raises
    QueryFailure Timeout, one that did just ends (status says so). status: Running, Complete, Limit, Stalled, Cancelled, Closed or Failed.
    """

    rows: DataFrame
    stall: float | None = None
    limit: int = 0
    cancel: Cancellation | None = None
    ahead: int = 1024
    given: int = 0
    status: str = "Running"
    _queue: queue.Queue = field(init=False)
    _stop: threading.Event = field(default_factory=threading.Event)

    def __post_init__(self) -> None:
        self._queue = queue.Queue(self.ahead)
        self._tag, self._thread = _tagged(self.rows.sparkSession, self._fill, self._end)

    def _put(self, item: tuple) -> bool:
        while not self._stop.is_set():
            with contextlib.suppress(queue.Full):
                self._queue.put(item, timeout=TICK)
                return True
        return False

    def _fill(self) -> None:
        for row in self.rows.toLocalIterator(prefetchPartitions=True):
            if not self._put(("row", row)):
                return

    def _end(self, _: object, error: BaseException | None) -> None:
        self._put(("error", error) if error is not None else ("end", None))

    def _close(self, status: str) -> None:
        self.status = status
        self._stop.set()
        _cancel(self.rows.sparkSession, self._tag, self._thread)

    def close(self) -> None:
        if self.status == "Running":
            self._close("Closed")

    def __enter__(self) -> RowStream:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def __next__(self) -> Row:
        if self.status != "Running":
            raise StopIteration
        if self.limit and self.given >= self.limit:
            self._close("Limit")
            raise StopIteration
        until = None if self.stall is None else time.monotonic() + self.stall
        while True:
            if self.cancel is not None and self.cancel.cancelled:
                self._close("Cancelled")
                raise QueryFailure("Cancelled", f"cancelled after {self.given} rows")
            try:
                kind, item = self._queue.get(timeout=TICK)
                break
            except queue.Empty:
                if until is not None and time.monotonic() >= until:
                    self._close("Stalled")
                    MESSAGES.write("verbose" if self.given else "warning", f"no row within {self.stall} s, {self.given} already given")
                    if self.given:
                        raise StopIteration from None
                    raise QueryFailure("Timeout", f"no row within {self.stall} s") from None
        if kind == "row":
            self.given += 1
            return item
        self.status = "Complete" if kind == "end" else "Failed"
        if kind == "error":
            raise item
        raise StopIteration
