"""Event XML: exported files and XML columns as canonical events.

The reader and the parser of EventData are built in (the XML source and from_xml). UserData
has element names that differ by event, so it goes through one Arrow UDF.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.parse import attachment, colon_pairs, message_lines
from ..schema import conform, last_wins

EVENT_XML = """System struct<Provider: struct<_Name: string, _Guid: string>, EventID: struct<_VALUE: string, _Qualifiers: string>, Version: int, Level: int, Task: int, Opcode: int, Keywords: string,
  TimeCreated: struct<_SystemTime: string>, EventRecordID: bigint, Correlation: struct<_ActivityID: string, _RelatedActivityID: string>, Execution: struct<_ProcessID: int, _ThreadID: int>,
  Channel: string, Computer: string, Security: struct<_UserID: string>>, EventData struct<Data: array<struct<_Name: string, _Type: string, _VALUE: string>>, Binary: array<string>>,
  RenderingInfo struct<Message: string>"""


def _local(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def xml_pairs(xml: str | None) -> list[tuple[str, str]]:
    """Named values of an event's EventData, else of the first child of its UserData.

    A Data element without a name is NoNameA0, NoNameA1, ... (blank ones are skipped and not
    counted); other elements go by their own name. A document that can't be read has none.
    """
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    holder = next((e for e in root.iter() if _local(e) == "EventData"), None)
    if holder is None:
        user = next((e for e in root.iter() if _local(e) == "UserData"), None)
        holder = next(iter(user), None) if user is not None else None
    pairs, unnamed = [], 0
    for e in holder if holder is not None else []:
        text = "".join(e.itertext())
        if e.get("Name"):
            pairs.append((e.get("Name"), text))
        elif _local(e) == "Data":
            if text.strip():
                pairs.append((f"NoNameA{unnamed}", text))
                unnamed += 1
        else:
            pairs.append((_local(e), text))
    return pairs


def xml_entries(xml: Column) -> Column:
    """xml_pairs of a column, as an Arrow UDF."""

    @F.arrow_udf("array<struct<key:string,value:string>>")
    def entries(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
        return pa.array([[{"key": k, "value": v} for k, v in xml_pairs(x)] for x in column.to_pylist()], kind)

    return entries(xml)


def data_map(entries: Column) -> Column:
    """The map of entries: the last of equal keys wins; colon lines inside values are added where their key is new."""
    lines = F.flatten(F.transform(entries, lambda e: colon_pairs(message_lines(e["value"]))))
    # Lines before the entries, last line first: what comes last wins.
    return F.map_from_entries(last_wins(F.concat(F.reverse(lines), entries)))


def event_data_entries(parsed: Column) -> Column:
    """Entries of EventData as from_xml gives it, without Python."""
    data = F.coalesce(parsed["EventData"]["Data"], F.array().cast("array<struct<_Name:string,_Type:string,_VALUE:string>>"))
    kept = F.filter(data, lambda d: d["_Name"].isNotNull() | (F.trim(F.coalesce(d["_VALUE"], F.lit(""))) != ""))
    unnamed_before = lambda i: F.size(F.filter(F.slice(kept, F.lit(1), i), lambda d: d["_Name"].isNull()))
    return F.transform(kept, lambda d, i: F.struct(F.coalesce(d["_Name"], F.concat(F.lit("NoNameA"), unnamed_before(i).cast("string"))).alias("key"), F.coalesce(d["_VALUE"], F.lit("")).alias("value")))


def _canonical(rows: DataFrame, e: Column, entries: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    s = e["System"]
    binaries = F.concat(F.coalesce(e["EventData"]["Binary"], F.array().cast("array<string>")), F.transform(F.filter(F.coalesce(e["EventData"]["Data"], F.array().cast("array<struct<_Name:string,_Type:string,_VALUE:string>>")), lambda d: d["_Type"] == "Binary"), lambda d: d["_VALUE"]))
    keywords = F.conv(F.regexp_replace(s["Keywords"], "^0[xX]", ""), 16, -10).cast("bigint")
    made = rows.select(
        s["EventRecordID"].alias("record_id"), F.to_timestamp_ntz(F.date_format(F.try_to_timestamp(s["TimeCreated"]["_SystemTime"]), "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("time_created"),
        s["EventID"]["_VALUE"].try_cast("int").alias("id"), s["Version"].alias("version"), s["Level"].alias("level"), s["Task"].alias("task"), s["Opcode"].alias("opcode"), keywords.alias("keywords"),
        s["Provider"]["_Name"].alias("provider_name"), s["Provider"]["_Guid"].alias("provider_id"), s["EventID"]["_Qualifiers"].alias("qualifiers"), s["Correlation"]["_ActivityID"].alias("activity_id"),
        s["Correlation"]["_RelatedActivityID"].alias("related_activity_id"), s["Execution"]["_ProcessID"].alias("process_id"), s["Execution"]["_ThreadID"].alias("thread_id"), s["Channel"].alias("log_name"),
        s["Computer"].alias("computer_name"), s["Security"]["_UserID"].alias("user_id"), e["RenderingInfo"]["Message"].alias("message"), data_map(entries).alias("data"),
        F.filter(F.transform(binaries, attachment), lambda b: b.isNotNull()).alias("attachments"), *keep,
    )
    return conform(made)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Events of exported XML files (row tag Event), EventData only: no Python runs."""
    rows = spark.read.format("xml").option("rowTag", "Event").schema(EVENT_XML).load(path)
    e = F.struct("System", "EventData", "RenderingInfo")
    return _canonical(rows, e, event_data_entries(e))


def parse_xml(df: DataFrame, column: str = "xml_data", keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of an XML column, UserData included. keep: canonical columns of df that the events have too."""
    rows = df.select(F.from_xml(F.col(column), EVENT_XML).alias("e"), xml_entries(F.col(column)).alias("entries"), *[F.col(c).alias(c) for c in keep])
    return _canonical(rows, F.col("e"), F.col("entries"), keep)
