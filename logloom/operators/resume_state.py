"""Resume state in a file: the highest record id of each log and host under a key, replaced in one step.

A reader takes the rows behind the state, hands them on, and only then advances it: a reader that is stopped in between
repeats its last batch and loses nothing; one that gets to the end repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.state_files import StateFile
from .tables import next_state, resume

#: (log, host) pairs that one state file may hold: they pass through the driver.
MOST_PAIRS = 100_000


def state_key(key: str | None = None, log_name: str | None = None, machines: list[str] = ()) -> str:
    """The key given, else one of the log and its machines (in any order and case)."""
    if key and key.strip():
        return key.strip()
    if not log_name or not log_name.strip():
        raise ValueError("a key or a log name is needed")
    return "|".join([log_name.strip().lower(), *sorted({m.strip().lower() for m in machines if m and m.strip()})])


class ResumeState:
    """States by key in one JSON file: {key: {log: {host: record id}}}. One process writes at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._file = spark, StateFile(spark, path)

    def get(self, key: str) -> dict[str, dict[str, int]]:
        return self._file.read({}).get(key, {})

    def table(self, key: str) -> DataFrame:
        """log_name, computer_name, last_record."""
        rows = [(log, host, last) for log, hosts in self.get(key).items() for host, last in hosts.items()]
        return self.spark.createDataFrame(rows, "log_name string, computer_name string, last_record bigint")

    def behind(self, events: DataFrame, key: str) -> DataFrame:
        """The events behind the state; rows without a record id pass, as do logs and hosts that it doesn't know."""
        return resume(events, self.table(key))

    def advance(self, events: DataFrame, key: str) -> None:
        """Moves the state to the highest record ids of events; never backwards."""
        found = next_state(events).where("last_record is not null and log_name is not null and computer_name is not null").limit(MOST_PAIRS + 1).collect()
        if len(found) > MOST_PAIRS:
            raise ValueError(f"a state file holds at most {MOST_PAIRS} logs and hosts")
        every = self._file.read({})
        own = every.setdefault(key, {})
        for r in found:
            hosts = own.setdefault(r["log_name"], {})
            hosts[r["computer_name"]] = max(r["last_record"], hosts.get(r["computer_name"], r["last_record"]))
        self._file.write(every)

    def forget(self, key: str) -> bool:
        every = self._file.read({})
        found = every.pop(key, None) is not None
        self._file.write(every)
        return found

    def read(self, events: DataFrame, key: str, action: Callable[[DataFrame], None]) -> int:
        """Hands the new events to action, then advances the state; the number of events."""
        rows = self.behind(events, key).persist()
        try:
            count = rows.count()
            if count:
                action(rows)
                self.advance(rows, key)
            return count
        finally:
            rows.unpersist()
