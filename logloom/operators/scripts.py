"""Scripts in events: parts put together, contexts read."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.decode import format_script
from ..functions.parse import context_map, raw
from .filters import contains_all
from .numbering import numbered


def reassemble(parts: DataFrame, contains: list[str] | None = None, formatted: bool = False) -> DataFrame:
    """Rows (script_id, machine, n_parts, script) from (script_id, number, total, text[, machine, seq]).

    Blank texts, the text "0" and null ids are skipped; of parts with one number the last (by seq) stays;
    part 0 is the meta record; parts 1..total are joined in order, missing ones skipped.
    """
    rows = parts.where("script_id is not null and trim(coalesce(text, '')) not in ('', '0')")
    best = rows.groupBy("script_id", "number").agg(F.max_by("text", "seq").alias("text"), F.max("total").alias("total"), F.min("machine").alias("machine"))
    grouped = best.groupBy("script_id").agg(
        F.min("machine").alias("machine"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.when(F.col("number") >= 1, F.struct("number", "text")))).alias("p")
    )
    kept = F.filter("p", lambda x: F.col("total").isNull() | (x["number"] <= F.col("total")))
    script = F.array_join(F.transform(kept, lambda x: x["text"]), "")
    out = grouped.select("script_id", "machine", F.size(kept).alias("n_parts"), (format_script(script) if formatted else script).alias("script"))
    return out.where(contains_all(F.col("script"), contains)) if contains else out


def script_parts(events: DataFrame) -> DataFrame:
    """The parts of script-block events (ids 4103, 4104)."""
    data = F.col("data_ci")
    found = events.where(F.col("id").isin(4103, 4104))
    number = lambda k: F.trim(raw(data, k)).try_cast("int")
    return found.select(raw(data, "ScriptBlockId").alias("script_id"), number("MessageNumber").alias("number"), number("MessageTotal").alias("total"), raw(data, "ScriptBlockText").alias("text"), F.col("computer_name").alias("machine"), F.col("record_id").alias("seq"))


def executions(events: DataFrame, across: bool = False) -> DataFrame:
    """Script executions (id 4100) with their context as columns, numbered in time order per computer, or (across) over all computers by ranges."""
    found = events.where("id = 4100").withColumn("context", context_map(raw(F.col("data_ci"), "ContextInfo")))
    pick = lambda k: F.try_element_at("context", F.lit(k)).alias(k)
    if across:
        found = numbered(found.select("record_id", "time_created", "computer_name", "context"), [(F.col("time_created"), "asc_nulls_last"), (F.col("computer_name"), "asc"), (F.col("record_id"), "asc_nulls_last")], name="execution_index")
        index = F.col("execution_index")
    else:
        index = F.row_number().over(Window.partitionBy("computer_name").orderBy("time_created", "record_id"))
    return found.select("record_id", "time_created", "computer_name", index.alias("execution_index"), pick("HostApplication"), pick("ScriptName"), pick("CommandName"), pick("User"), "context")


def script_name(machine: Column, script_id: Column) -> Column:
    """<machine>_<id> as a file name: what no file name may hold becomes _, and a name that had to change gets part of its hash, so names stay apart.

    Ids and machines come from event data: no path, no "..", no hidden or overlong name is left.
    """
    own = F.concat_ws("_", machine, script_id)
    safe = F.substring(F.regexp_replace(F.regexp_replace(own, "[^A-Za-z0-9._-]", "_"), r"^[.-]|\.(?=\.)", "_"), 1, 100)
    return F.when(safe == own, own).otherwise(F.concat(safe, F.lit("-"), F.substring(F.sha2(own, 256), 1, 12)))


def save_scripts(scripts: DataFrame, path: str, header: bool = True) -> None:
    """One text file a script, <machine>_<id>.ps1 directly in path. Executors write the texts; the driver only renames their files."""
    body = F.when(F.lit(header), F.concat(F.lit("# "), F.regexp_replace("script_id", r"\s", " "), F.lit("\n"), "script")).otherwise(F.col("script"))
    named = scripts.select(script_name(F.col("machine"), F.col("script_id")).alias("name"), body.alias("value"))
    parts = f"{path.rstrip('/')}/_parts-{uuid.uuid4().hex}"
    named.repartition("name").write.partitionBy("name").text(parts)
    context = scripts.sparkSession.sparkContext
    path_of = context._jvm.org.apache.hadoop.fs.Path
    files = path_of(parts).getFileSystem(context._jsc.hadoopConfiguration())
    found = files.listFiles(path_of(parts), True)
    while found.hasNext():
        file = found.next().getPath()
        folder = file.getParent().getName()
        if folder.startswith("name="):
            name = unquote(folder[5:])
            files.rename(file, path_of(f"{path.rstrip('/')}/{name}.ps1"))
            files.delete(path_of(f"{path.rstrip('/')}/.{name}.ps1.crc"), False)  # local file systems' checksums
    files.delete(path_of(parts), True)
