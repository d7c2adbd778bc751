"""Row parsers: message lines and pairs, event data, accessors, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import last_wins
from .decode import blank
from .lookups import KNOWN_FIELDS

EMPTY_MAP = "map<string,string>"


def message_lines(message: Column) -> Column:
    """Lines of a message; an empty or null message has none."""
    return F.when(F.coalesce(message, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(message, r"\r?\n"))


def message_subject(message: Column) -> Column:
    """The first line that is not blank, trimmed; else ""."""
    filled = F.filter(message_lines(message), lambda x: F.trim(x) != "")
    return F.coalesce(F.trim(F.get(filled, F.lit(0))), F.lit(""))


def _last_wins(entries: Column) -> Column:
    """Map of entries (key, value); of keys equal without case the last stays."""
    return F.map_from_entries(last_wins(entries))


def colon_pairs(lines: Column) -> Column:
    """Entries `key: value` of lines, parted at the first colon that is not the first character, both trimmed."""
    pairs = F.transform(F.filter(lines, lambda x: F.locate(":", x) > 1), lambda x: F.struct(F.trim(F.substr(x, F.lit(1), F.locate(":", x) - 1)).alias("key"), F.trim(F.substr(x, F.locate(":", x) + 1)).alias("value")))
    return F.filter(pairs, lambda p: p["key"] != "")


def message_map(message: Column) -> Column:
    """Message -> the subject, then the pairs of the lines behind it; the last of equal keys wins."""
    lines = F.filter(message_lines(message), lambda x: F.trim(x) != "")
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    first = F.when(F.size(lines) > 0, F.array(F.struct(F.lit("Message").alias("key"), F.trim(F.get(lines, F.lit(0))).alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return _last_wins(F.concat(first, colon_pairs(rest)))


def context_map(context: Column) -> Column:
    """Map of `key = value` lines: parted at the first =, blanks of the key dropped, values trimmed, blank ones null."""
    lines = F.filter(F.split(F.coalesce(context, F.lit("")), r"\r?\n"), lambda x: (F.trim(x) != "") & (F.locate("=", x) > 1))
    value = lambda x: F.trim(F.substr(x, F.locate("=", x) + 1))
    return _last_wins(F.transform(lines, lambda x: F.struct(F.regexp_replace(F.substr(x, F.lit(1), F.locate("=", x) - 1), r"\s", "").alias("key"), F.when(value(x) != "", value(x)).alias("value"))))


def message_line(lines: Column, index: int, trim: bool = True) -> Column:
    """Line by index from 0, or from the end if negative; missing: ""."""
    line = F.try_element_at(lines, F.lit(index + 1 if index >= 0 else index))
    return F.coalesce(F.trim(line) if trim else line, F.lit(""))


def lookup(data_ci: Column, key: str, trim: bool = True) -> Column:
    """Value of a key without case, else "". data_ci has upper-case keys."""
    value = raw(data_ci, key)
    return F.coalesce(F.trim(value) if trim else value, F.lit(""))


def raw(data_ci: Column, key: str) -> Column:
    """Value of a key without case, null if missing. Of a map made of columns it is just the column, which prunes and pushes down."""
    return data_ci.getItem(key.upper())


def known(data_ci: Column, field: str, trim: bool = True) -> Column:
    """Value of a field known by name (lookups.KNOWN_FIELDS), else ""; other names are refused."""
    if field not in KNOWN_FIELDS:
        raise ValueError(f"{field!r} is no known field")
    return lookup(data_ci, KNOWN_FIELDS[field], trim)


def joined(first: Column, second: Column, separator: str = "\\", reverse: bool = False) -> Column:
    """Both present: joined (second first if reverse); one: it; none: "". A join, not a fallback."""
    a, b = (second, first) if reverse else (first, second)
    return F.when(first.isNotNull() & second.isNotNull(), F.concat(a, F.lit(separator), b)).otherwise(F.coalesce(first, second, F.lit("")))


def account(data_ci: Column, who: str) -> Column:
    """domain\\user of Subject or Target."""
    return joined(raw(data_ci, f"{who}UserName"), raw(data_ci, f"{who}DomainName"), reverse=True)


def nic_identifiers(data: Column) -> Column:
    """Values that are not blank of keys that name a network card."""
    named = F.map_filter(data, lambda k, v: k.rlike("(?i)nic|nasidentifier|calledstationid|callingstationid|mac") & ~blank(v))
    return F.map_values(named)


def attachment(text: Column) -> Column:
    """Bytes of a text: hexadecimal of even length (0x allowed), else base64, else null."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\s", ""), "^0[xX]", "")
    return F.when(bare == "", F.lit(None)).when(bare.rlike("^([0-9a-fA-F]{2})+$"), F.try_to_binary(bare, F.lit("hex"))).otherwise(F.try_to_binary(bare, F.lit("base64")))


def truncate(value: Column, most: int) -> Column:
    return F.lit("") if most <= 0 else F.substring(value, 1, most)
