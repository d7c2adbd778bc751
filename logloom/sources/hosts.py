"""Scans of many hosts or files where one that fails costs only its own rows.

Each source is a Spark job of its own, some at once: what it keeps is written to the shared folder, or it leaves one row
that says why not. The result is read from what was written, so nothing of a failed source can fail it later.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..messages import MESSAGES
from ..operators.deadlines import Cancellation, within
from ..plans.requests import QueryFailure
from .evtx import read_evtx
from .staging import shared_dir
from .xml_events import read_xml

#: Jobs at once.
AT_ONCE = 8
ERRORS = "host string, kind string, message string"


@dataclass(frozen=True)
class HostScan:
    """rows: the kept columns and host; errors: a row (host, kind, message) for each source that failed."""

    rows: DataFrame | None
    errors: DataFrame
    scanned: tuple[str, ...]
    failed: tuple[str, ...]


def source_of(spark: SparkSession, where: str | DataFrame | Callable[[], DataFrame]) -> DataFrame:
    """Events of a table, of a function that makes one, or of a path (.evtx and .xml files, else Parquet)."""
    if isinstance(where, DataFrame):
        return where
    if callable(where):
        return where()
    if where.lower().endswith(".evtx"):
        return read_evtx(spark, where)
    return read_xml(spark, where) if where.lower().endswith(".xml") else spark.read.parquet(where)


def scan_hosts(spark: SparkSession, sources: dict[str, str | DataFrame | Callable[[], DataFrame]], work: Callable[[DataFrame], DataFrame] = lambda rows: rows, *, at_once: int = AT_ONCE, seconds: float | None = None, cancel: Cancellation | None = None) -> HostScan:
    """work(events) of every source. seconds: for each source; a stop asked for by cancel ends those that run and skips the rest.

    Sources whose result has other columns than the first good one's (by order of the sources) fail as InvalidArgument. Without
    any source the request is refused; where all fail, rows is None.
    """
    if not sources or any(not h or not h.strip() for h in sources):
        raise QueryFailure("InvalidArgument", "at least one host is needed, each with a name")
    base, names = f"{shared_dir(spark)}/hosts-{uuid.uuid4().hex}", list(sources)

    def one(place: int, where) -> tuple[str, object]:
        def job():
            out = work(source_of(spark, where))
            out.write.parquet(f"{base}/{place}")
            return out.schema

        host = names[place]
        try:
            found = within(spark, seconds, job, cancel)
            MESSAGES.progress("hosts", host, place + 1, len(names))
            return "", found
        except Exception as e:  # noqa: BLE001
            failure = e if isinstance(e, QueryFailure) else QueryFailure.of(e)
            MESSAGES.write("warning", f"{host}: {failure.message[:300]}")
            return failure.kind, failure.message

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        made = dict(zip(sources, pool.map(one, range(len(sources)), sources.values()), strict=True))
    schema = next((value for kind, value in made.values() if not kind), None)
    good, errors = [], []
    for place, (host, (kind, value)) in enumerate(made.items()):
        if not kind and [(f.name, f.dataType) for f in value] != [(f.name, f.dataType) for f in schema]:
            kind, value = "InvalidArgument", "its columns differ from the others'"
        if kind:
            errors.append((host, kind, value[:2000]))
        else:
            good.append((host, place))
    rows = None
    if good:
        # One read of all folders; the folder's name is the source's place.
        read = spark.read.schema(schema).parquet(*[f"{base}/{place}" for _, place in good])
        hosts = spark.createDataFrame([(str(p), h) for h, p in good], "_place string, host string")
        place = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        rows = read.withColumn("_place", place).join(F.broadcast(hosts) if len(good) <= 10_000 else hosts, "_place").drop("_place")
    return HostScan(rows, spark.createDataFrame(errors, ERRORS), tuple(h for h, _ in good), tuple(e[0] for e in errors))
