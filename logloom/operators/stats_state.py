"""Statistics that grow batch by batch: partial counters in a table, merged and finished on demand.

A batch of events becomes a few rows of counters: for each dimension and exact key its count and first-seen
place, and one row with the number and range of times. Counters of batches add up in any order, so late batches, retried ones
and slices of one table give what one pass gives. A list of live batches is replaced in one step: a batch counts once, whole, or not at all.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import decode as D
from ..schema import level_name
from ..sources.state_files import StateFile
from .reports import UNKNOWN, _place, top

#: A batch's counters: dim "" is the batch itself, without a key.
STATE = "dim string, key string, name string, place decimal(38,0), count bigint, min_utc timestamp_ntz, max_utc timestamp_ntz"
#: Live batches beyond which adding one merges them.
MOST_BATCHES = 64


def partial(events: DataFrame) -> DataFrame:
    """Counters of one batch, in the columns of STATE. One scan, one shuffle, whatever the number of dimensions."""
    level = F.coalesce("level", F.lit(0))
    named = F.coalesce(F.col("level_display_name"), level_name(F.col("level"))) if "level_display_name" in events.columns else level_name(F.col("level"))
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    none = F.lit(None).cast("string")
    keys = {"event_id": (text(F.col("id")), none), "provider": (F.when(D.blank(F.col("provider_name")), F.lit(UNKNOWN)).otherwise(text(F.col("provider_name"))), none), "computer": (text(F.col("computer_name")), none), "level": (level.cast("string"), named), "": (F.lit("*"), none)}
    cells = F.array(*[F.struct(F.lit(d).alias("dim"), key.alias("key"), name.alias("name")) for d, (key, name) in keys.items()])
    rows = events.select(_place().alias("place"), "time_created", F.explode(cells).alias("c")).select("place", "time_created", "c.*").where("key != ''")
    made = rows.groupBy("dim", "key", "name").agg(F.min("place").alias("place"), F.count("*").alias("count"), F.min("time_created").alias("min_utc"), F.max("time_created").alias("max_utc"))
    return made.select("dim", "key", "name", "place", "count", "min_utc", "max_utc")


def merged(state: DataFrame) -> DataFrame:
    """The counters of several batches as those of one."""
    out = state.groupBy("dim", "key", "name").agg(F.min("place").alias("place"), F.sum("count").alias("count"), F.min("min_utc").alias("min_utc"), F.max("max_utc").alias("max_utc"))
    return out.select("dim", "key", "name", "place", "count", "min_utc", "max_utc")


@dataclass(frozen=True)
class StatsReport:
    """summary: one row scanned, min_utc, max_utc; counts: (dim, key, count), keys as first seen; levels: (level, level_name, count)."""

    summary: DataFrame
    counts: DataFrame
    levels: DataFrame

    def top(self, dim: str, k: int) -> DataFrame:
        """The k largest counts of a dimension, as (key, count)."""
        rows = self.counts.where(F.col("dim") == dim).select("key", "count")
        if dim in ("event_id", "level"):
            return top(rows.withColumn("key", F.col("key").cast("int")), k, text=False)
        return top(rows, k)


def finished(state: DataFrame) -> StatsReport:
    """The report of counters, merged or not."""
    whole = state.where("dim = ''").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("scanned"), F.min("min_utc").alias("min_utc"), F.max("max_utc").alias("max_utc"))
    keyed = state.where("dim != ''")
    counts = keyed.groupBy("dim", F.upper("key").alias("_folded")).agg(F.min_by("key", "place").alias("key"), F.sum("count").alias("count")).drop("_folded")
    levels = keyed.where("dim = 'level'").groupBy(F.col("key").cast("int").alias("level")).agg(F.min_by("name", "place").alias("level_name"), F.sum("count").alias("count"))
    return StatsReport(whole, counts, levels)


class StatsBuilder:
    """A report that events are added to, kept in a folder: another builder on the folder goes on where this one stopped.

    add() takes single events as dictionaries (written with the next batch or report), add_range() a batch of events; a batch given a
    name counts once, however often it is added, as a retried micro-batch is. One builder writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._live = StateFile(spark, f"{self.path}/live.json")
        self._single: list[dict] = []

    def add(self, **event) -> None:
        """One event: id, time_created, provider_name, computer_name, level, level_display_name, record_id; what is missing is null."""
        self._single.append(event)
        if len(self._single) >= 10_000:
            self._flush()

    def add_range(self, events: DataFrame, batch: str | int | None = None) -> None:
        """A batch of events. Names of batches are kept; a stream's are numbers, so on_batch() keeps the last one only."""
        live = self._read_live()
        if batch is None or str(batch) not in live["batches"]:
            self._add(events, live | ({"batches": [*live["batches"], str(batch)]} if batch is not None else {}))

    def on_batch(self, rows: DataFrame, batch_id: int) -> None:
        """For foreachBatch: batches come in order, and one that was counted before a restart comes again."""
        live = self._read_live()
        if batch_id > live["stream"]:
            self._add(rows, live | {"stream": batch_id})

    def _read_live(self) -> dict:
        return {"folders": [], "batches": [], "stream": -1} | self._live.read({})

    def _add(self, events: DataFrame, live: dict) -> None:
        live = live | {"folders": [*live["folders"], self._write(partial(events))]}
        self._live.write(live)
        if len(live["folders"]) > MOST_BATCHES:
            self.compact()

    def compact(self) -> None:
        """Merges the live batches into one."""
        live = self._read_live()
        if len(live["folders"]) > 1:
            self._live.write(live | {"folders": [self._write(merged(self._read(live["folders"])))]})
            self._drop(live["folders"])

    def state(self) -> DataFrame:
        self._flush()
        return self._read(self._read_live()["folders"])

    def build(self) -> StatsReport:
        """The report of everything added so far; adding can go on."""
        return finished(self.state())

    def _flush(self) -> None:
        if self._single:
            fields = "record_id bigint, time_created timestamp_ntz, id int, provider_name string, computer_name string, level int, level_display_name string"
            names = [f.split()[0] for f in fields.split(", ")]
            rows = self.spark.createDataFrame([tuple(e.get(n) for n in names) for e in self._single], fields)
            self._single = []
            self.add_range(rows)

    def _write(self, counters: DataFrame) -> str:
        folder = f"part-{uuid.uuid4().hex}"
        counters.write.parquet(f"{self.path}/{folder}")
        return folder

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*[f"{self.path}/{f}" for f in folders])

    def _drop(self, folders: list[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for f in folders:
            target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{f}")
            target.getFileSystem(conf).delete(target, True)
