"""The orders table as events of many logs: every (channel, id) of the named events and some of none, providers and hosts in mixed
case, times over years and around one moment, some missing, and event data for every key that the rules read."""

from __future__ import annotations

from datetime import datetime
from functools import cache
from math import lcm

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans import rules
from .events import table
from .staging import staged

#: Half of the events lie within 55 hours before this moment.
MOMENT = datetime(1997, 8, 13, 13, 45, 30)
#: Provider names as they occur; fixed names of the rules, some in another case.
PROVIDERS = (
    "Microsoft-Windows-Security-Auditing", "microsoft-windows-security-auditing", "EventLog", "MICROSOFT-WINDOWS-EVENTLOG", "Directory Synchronization", "ADSync", "Microsoft-Windows-SMBServer", "Microsoft-Windows-DHCP-Server",
    "Microsoft-Windows-GroupPolicy", "Microsoft-Windows-Windows Firewall With Advanced Security", "Service Control Manager", "Microsoft-Windows-FilterManager", "Ndis", "Microsoft-Windows-Kernel-General",
    "Microsoft-Windows-Kernel-Power", "Microsoft-Windows-WindowsUpdateClient", "Other", " ",
)
#: Values of the keys that predicates ask for.
WORDS = {
    "OBJECTCLASS": ("user", "Computer", "GROUPPOLICYCONTAINER", "group", "organizationalUnit", "domainDNS", "container", "site"), "ATTRIBUTELDAPDISPLAYNAME": ("versionNumber", "gPLink", "QPLIK", "member"),
    "LMPACKAGENAME": ("NTLM V1", "ntlm v1", "NTLM V2"), "DRIVERNAME": ("\\FileSystem\\NPCAP", "other.sys", "netmon3"), "SUBJECTUSERNAME": ("*ANONYMOUS*", "svc", "Admin"),
}
SUBJECTS = ("A service was started: Npcap", "A directory service object was moved.", "Nothing")
NOISE = (("System", 9999), ("Windows PowerShell", 4100), ("security", 4624))


@cache
def pairs() -> tuple[tuple[str, int], ...]:
    return (*sorted({(r.channel, i) for r in rules.RULES.values() for i in r.ids}), *NOISE)


@cache
def keys() -> tuple[str, ...]:
    """Upper-case data keys that rules read as they are."""
    found = set(WORDS) | {f"{who}{part}NAME" for who in ("SUBJECT", "TARGET") for part in ("USER", "DOMAIN")}
    for rule in rules.RULES.values():
        for text in plain_fields(rule.notation).values():
            found.update(k.upper() for k in (text[5:].split("|") if text.startswith(("join:", "pick:")) else [text]) if k not in ("C", "T", "W", "target", "subject"))
    return tuple(sorted(found))


def plain_fields(notation: str) -> dict[str, str]:
    """Name -> source of the fields of a rule's notation that no decoder changes."""
    out = {}
    for part in (p.strip() for p in notation.split(";")):
        name, _, text = part.partition("=")
        if part in ("C", "T", "W"):
            out[{"C": "Computer", "T": "When", "W": "Who"}[part]] = part
        elif part and part != "A" and text.partition(":")[0] not in rules.KINDS:
            out[name] = text or name
    return out


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pick(values, index: str, spark: bool) -> str:
    listed = ", ".join(_text(v) if isinstance(v, str) else str(v) for v in values)
    return f"element_at(array({listed}), CAST({index} AS INT) + 1)" if spark else f"([{listed}])[CAST({index} AS INT) + 1]"


def value_sql(key: str, spark: bool) -> str:
    """The value of an upper-case key: missing, empty, padded or plain, by the record."""
    seed = sum(key.encode()) % 97
    if key in WORDS:
        words = WORDS[key]
        return f"CASE WHEN (o_orderkey + {seed}) % 9 = 4 THEN NULL ELSE {_pick(words, f'(o_orderkey * 7 + o_custkey + {seed}) % {len(words)}', spark)} END"
    plain = f"concat({_text(key.lower())}, '-', CAST((o_orderkey + {seed}) % 5 AS {'STRING' if spark else 'VARCHAR'}))"
    return f"CASE (o_orderkey * 3 + o_custkey + {seed}) % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('  ', {plain}, ' ') ELSE {plain} END"


def mixed_sql(spark: bool, data: bool = True) -> str:
    """The events with flat data columns, or with the places of data values in value_list()."""
    text = "STRING" if spark else "VARCHAR"
    moment = f"TIMESTAMP{'_NTZ' if spark else ''} '{MOMENT}'"
    own = pairs()
    place = f"(o_orderkey * 31 + o_custkey) % {len(own)}"
    last = ", ".join(f"{value_sql(k, spark)} AS `{k}`" if spark else f'{value_sql(k, spark)} AS "{k}"' for k in keys()) if data else PLACES
    return f"""SELECT o_orderkey AS record_id, {_pick([c for c, _ in own], place, spark)} AS log_name, {_pick([i for _, i in own], place, spark)} AS id,
      CASE WHEN o_orderkey % 17 = 3 THEN NULL WHEN o_orderkey % 2 = 0 THEN {moment} - INTERVAL '1' SECOND * (o_orderkey * 61 % 200000) ELSE o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 86400) END AS time_created,
      {_pick(PROVIDERS, f'(o_orderkey * 5 + o_custkey * 3) % {len(PROVIDERS)}', spark)} AS provider_name, CAST(o_orderkey % 6 AS INT) AS level,
      CASE WHEN o_custkey % 3 = 0 THEN lower(concat('HOST', CAST(o_custkey % 7 AS {text}))) ELSE concat('HOST', CAST(o_custkey % 7 AS {text})) END AS computer_name,
      {_pick(SUBJECTS, f'(o_orderkey + o_custkey) % {len(SUBJECTS)}', spark)} AS message_subject, {last} FROM {'{orders}' if spark else 'orders'}"""


def mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with flat data columns."""
    return spark.sql(mixed_sql(True).replace("\\", "\\\\"), orders=table(spark, sf_dir, "orders"))


#: Where an order's plain values and words stand in value_list(): all values of a key repeat with these remainders of the (never negative) keys.
WORD_ROUND = lcm(*map(len, WORDS.values()))
PLACES = f"CAST(coalesce((o_orderkey * 3 + o_custkey) % 6, 6) * 5 + o_orderkey % 5 AS INT) AS plain_at, CAST(o_orderkey % 9 * {WORD_ROUND} + (o_orderkey * 7 + o_custkey) % {WORD_ROUND} AS INT) AS word_at"


def value_list(key: str) -> list[str | None]:
    """All values of value_sql() for an upper-case key, by plain_at, or word_at if it has words."""
    seed = sum(key.encode()) % 97
    if key in WORDS:
        return [None if (r + seed) % 9 == 4 else WORDS[key][(m + seed) % len(WORDS[key])] for r in range(9) for m in range(WORD_ROUND)]
    plain = [f"{key.lower()}-{(b + seed) % 5}" for b in range(5)]
    return [{0: None, 1: "", 2: f"  {p} "}.get((a + seed) % 6 if a < 6 else 3, p) for a in range(7) for p in plain]


def log_with_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the map data_ci; a missing key is null.

    Staged without data and spread by key, however few row groups the table has. The map is made of places in lists, as cheap as
    columns: Catalyst takes out what a rule looks up, so values are read only where a rule holds, and no map is built.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition("o_orderkey")
    rows = staged(spark.sql(mixed_sql(True, data=False).replace("\\", "\\\\"), orders=orders), "mixed-log")
    values = lambda k: F.get(F.array(*map(F.lit, value_list(k))), F.col("word_at" if k in WORDS else "plain_at"))
    made = F.create_map(*[x for k in keys() for x in (F.lit(k), values(k))])
    return rows.select(*[c for c in rows.columns if c not in ("plain_at", "word_at")], F.lit("").alias("message"), made.alias("data_ci"))


#: The events as a CTE for DuckDB.
def duckdb_log() -> str:
    return f"WITH log AS MATERIALIZED ({mixed_sql(False)})"
