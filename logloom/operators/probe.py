"""Latest-event probes: the newest record that has a time, found without reading a log through.

probe_table reads newest first: day folders of a table backwards, in a folder the files by the largest record id of their
footers, one file at a time, until no other file can hold a newer record. probe_states answers for many
(log, host) pairs in one aggregation. Both look at `most` newest matching records at most.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from itertools import groupby
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.requests import QueryFailure
from ..plans.xpath import xpath_column
from .deadlines import Cancellation, within

#: Records looked at, and seconds, if nothing else is asked for.
MOST, SECONDS = 4096, 15.0


@dataclass(frozen=True)
class Probe:
    log_name: str
    machine: str | None
    status: str  # Ok, NoEvent, Timeout, LimitReached or Error
    event_time: datetime | None = None
    record_id: int | None = None
    scanned: int = 0
    files: int = 0
    seconds: float = 0.0
    message: str | None = None


@dataclass(frozen=True)
class DataFile:
    path: str
    log: str | None  # from the folders log_name=... and event_date=..., where there are any
    day: str | None


def data_files(spark: SparkSession, path: str) -> list[DataFile]:
    """The Parquet files of a table, with what their folders say."""
    conf, path_of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path_of(path).getFileSystem(conf)
    base, found, out = files.makeQualified(path_of(path)).toString(), files.listFiles(path_of(path), True), []
    while found.hasNext():
        file = found.next().getPath().toString()
        folders = dict(x.split("=", 1) for x in file[len(base) :].split("/")[:-1] if "=" in x)
        if not file.rsplit("/", 1)[1].startswith(("_", ".")):
            out.append(DataFile(file, unquote(folders["log_name"]) if "log_name" in folders else None, folders.get("event_date")))
    return out


def largest_of(spark: SparkSession, file: str, column: str) -> int | None:
    """The largest value of a column by the file's footer; None if it doesn't say or all are null."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        values = []
        for block in reader.getFooter().getBlocks():
            for chunk in block.getColumns():
                if chunk.getPath().toDotString() == column:
                    stats = chunk.getStatistics()
                    if stats is not None and stats.hasNonNullValue():
                        values.append(stats.genericGetMax())
        return max(values, default=None)
    finally:
        reader.close()


def newest_first(spark: SparkSession, files: list[DataFile], column: str) -> Iterator[tuple[DataFile, int | None, int | None]]:
    """(file, its largest value, the largest one of any file behind it in its folder), day by day backwards; footers are read a day at a time."""
    for _, day in groupby(sorted(files, key=lambda f: f.day or "", reverse=True), key=lambda f: f.day or ""):
        ranked = sorted(((largest_of(spark, f.path, column), f) for f in day), key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
        for (largest, file), behind in zip(ranked, [*ranked[1:], (None, None)], strict=True):
            yield file, largest, behind[0]


def probe_table(spark: SparkSession, path: str, log_name: str, xpath: str | None = None, machine: str | None = None, *, where: Column | None = None, seconds: float = SECONDS, most: int = MOST, cancel: Cancellation | None = None) -> Probe:
    """The newest matching record with a time of one log in a Parquet table of canonical events, within a budget.

    Records are ordered by record id, which in a log follows time; a table in day folders is taken day by day. Records
    without a time are looked at and passed over. Errors of reading become the status Error, never an exception.
    """
    if not log_name or not log_name.strip():
        raise QueryFailure("InvalidArgument", "a log name is needed")
    most = most if most > 0 else MOST
    began, seen = time.monotonic(), {"scanned": 0, "files": 0}

    def look() -> tuple[str, object]:
        files = [f for f in data_files(spark, path) if f.log is None or f.log == log_name]
        if not files:
            return "NoEvent", None
        predicate = (F.col("log_name") == log_name) & xpath_column(xpath)
        predicate = predicate if machine is None else predicate & (F.upper("computer_name") == machine.upper())
        predicate = predicate if where is None else predicate & where
        schema = spark.read.parquet(path).schema
        waiting: list[tuple[int | None, datetime | None]] = []  # newest first; not yet known to be newer than all others
        for file, _, behind in newest_first(spark, files, "record_id"):
            rows = spark.read.schema(schema).option("basePath", path).parquet(file.path).where(predicate)
            found = rows.select("record_id", "time_created").orderBy(F.desc_nulls_last("record_id"), F.desc_nulls_last("time_created")).limit(most - seen["scanned"]).collect()
            seen["files"] += 1
            waiting = sorted([*waiting, *map(tuple, found)], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None), reverse=True)
            settled = [r for r in waiting if behind is None or r[0] is not None and r[0] >= behind]
            waiting = waiting[len(settled) :]
            for record, created in settled:
                seen["scanned"] += 1
                if created is not None:
                    return "Ok", (record, created)
                if seen["scanned"] >= most:
                    return "LimitReached", None
        return "NoEvent", None

    try:
        status, hit = within(spark, seconds, look, cancel)
        message = f"{seen['scanned']} records without a time (limit {most})" if status == "LimitReached" else None
    except Exception as e:  # noqa: BLE001
        failure = e if isinstance(e, QueryFailure) else QueryFailure.of(e)
        status, hit, message = "Timeout" if failure.kind == "Timeout" else "Error", None, failure.message[:2000]
    return Probe(log_name, machine, status, hit[1] if hit else None, hit[0] if hit else None, seen["scanned"], seen["files"], time.monotonic() - began, message)


def probe_states(events: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """One row for each wanted (log_name, computer_name): status Ok, NoEvent or LimitReached, latest_time, latest_record, scanned.

    Only the `most` newest records of a pair are looked at; Spark cuts to them before it shuffles.
    """
    newest = Window.partitionBy("log_name", "computer_name").orderBy(F.desc_nulls_last("record_id"), F.desc_nulls_last("time_created"))
    rows = events.select("log_name", "computer_name", "record_id", "time_created").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
    timed = F.when(F.col("time_created").isNotNull(), F.struct(F.col("_n"), F.col("time_created"), F.col("record_id")))
    found = rows.groupBy(F.col("log_name").alias("_log"), F.col("computer_name").alias("_host")).agg(F.min(timed).alias("hit"), F.count("*").alias("n"))
    out = wanted.join(found, F.col("log_name").eqNullSafe(F.col("_log")) & F.col("computer_name").eqNullSafe(F.col("_host")), "left")
    status = F.when(F.col("hit").isNotNull(), "Ok").when(F.col("n") >= most, "LimitReached").otherwise("NoEvent")
    return out.select("log_name", "computer_name", status.alias("status"), F.col("hit.time_created").alias("latest_time"), F.col("hit.record_id").alias("latest_record"), F.coalesce("hit._n", "n", F.lit(0)).cast("bigint").alias("scanned"))
