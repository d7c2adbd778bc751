"""Scalar decoders of event fields, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import literal_map
from . import lookups as L

BLANK = r"^\s*$"


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def first_filled(*cs: Column) -> Column:
    """The first value that is not blank, else ""."""
    return F.coalesce(*[F.when(~blank(c), c) for c in cs], F.lit(""))


def parse_unsigned(value: Column, base: str = "auto") -> Column:
    """Unsigned integer text up to 64 bits, as decimal(20,0). auto: 0x means hexadecimal, else decimal, else hexadecimal; decimal; hexadecimal. Else null."""
    text = F.trim(value)
    prefixed = text.rlike("^0[xX]")
    digits = F.when(prefixed, F.substring(text, 3, 64)).otherwise(text)
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    hexed = F.when(bare.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(bare, 16, 10).cast("decimal(20,0)"))
    number = F.when(bare.rlike("^[0-9]{1,20}$"), bare.cast("decimal(20,0)"))
    plain = F.when(number <= F.lit(str((1 << 64) - 1)).cast("decimal(20,0)"), number)
    if base == "decimal":
        return plain
    return hexed if base == "hexadecimal" else F.when(prefixed, hexed).otherwise(F.coalesce(plain, hexed))


def decode_enum(value: Column, table: dict[str, int], base: str = "auto", prefix: str = "%%") -> Column:
    """Number of an enum's text: its name or decimal first, then by base. Numbers without a name are kept."""
    text = F.trim(value)
    text = F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 20)).otherwise(text) if prefix else text
    names = literal_map({k.upper(): v for k, v in table.items()})
    named = F.try_element_at(names, F.upper(text)).cast("bigint")
    plain = parse_unsigned(F.when(text.rlike("^[0-9]+$"), text), "decimal")
    return F.coalesce(named.cast("decimal(20,0)"), plain, parse_unsigned(text, base)).try_cast("bigint")


def enum_name(number: Column, table: dict[str, int]) -> Column:
    """Name of a number, else the number as text; null stays null."""
    names = literal_map({v: k for k, v in table.items()}).cast("map<bigint,string>")
    return F.coalesce(F.try_element_at(names, number.cast("bigint")), number.cast("string"))


def flag_names(number: Column, table: dict[str, int]) -> Column:
    """Names of all set flags in the order of their bits, joined by ", "; no flag: ""."""
    flags = F.array(*[F.struct(F.lit(k).alias("n"), F.lit(v).cast("bigint").alias("m")) for k, v in sorted(table.items(), key=lambda kv: kv[1]) if v])
    return F.array_join(F.transform(F.filter(flags, lambda f: number.cast("bigint").bitwiseAND(f["m"]) == f["m"]), lambda f: f["n"]), ", ")


def describe_flags(number: Column, table: dict[str, int]) -> Column:
    names = flag_names(number, table)
    return F.when(names == "", number.cast("string")).otherwise(names)


def hex8(number: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(number.cast("bigint")), 8, "0"))


def describe_status(number: Column, raw: Column) -> Column:
    return F.when(number.isNull(), F.coalesce(raw, F.lit(""))).otherwise(F.concat(enum_name(number, L.STATUS_CODE), F.lit(" ("), hex8(number), F.lit(")")))


def describe_options(number: Column, raw: Column) -> Column:
    names = flag_names(number, L.TICKET_OPTIONS)
    return F.when(number.isNull(), F.coalesce(raw, F.lit(""))).when(names == "", hex8(number)).otherwise(F.concat(names, F.lit(" ("), hex8(number), F.lit(")")))


def describe_pre_auth(number: Column, raw: Column) -> Column:
    text = F.coalesce(F.try_element_at(literal_map(L.PRE_AUTH_TEXT).cast("map<bigint,string>"), number), number.cast("string"))
    return F.when(number.isNull(), F.coalesce(raw, F.lit(""))).otherwise(F.concat(text, F.lit(" ("), number.cast("string"), F.lit(")")))


def describe_encryption(number: Column, raw: Column) -> Column:
    return F.when(number.isNull(), F.coalesce(raw, F.lit(""))).otherwise(F.concat(enum_name(number, L.TICKET_ENCRYPTION), F.lit(" (0x"), F.hex(number.cast("bigint")), F.lit(")")))


def decode_uac(value: Column) -> Column:
    """Names of account-control flags in a hexadecimal text; "-", blank and unreadable texts give ""."""
    number = parse_unsigned(value, "hexadecimal").try_cast("bigint")
    return F.coalesce(F.when(number.isNotNull(), flag_names(number, L.UAC_FLAGS)), F.lit(""))


def operation_type(value: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(L.OPERATION_TYPE), value), F.lit("Unknown Operation"))


def translate_privilege(value: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(L.PRIVILEGES), value), value, F.lit(""))


def translate_device(name: Column) -> Column:
    up = F.upper(F.coalesce(name, F.lit("")))
    ladder = F.when(up == "DISKDRIVE", "Disk Drive").when(up.contains("USB"), "USB Device").when(up.contains("NETWORK"), "Network Adapter")
    return ladder.when(up.contains("IMAGE") | up.contains("CAMERA"), "Imaging Device").otherwise(F.coalesce(name, F.lit("")))


def translate_vendor(ids: Column) -> Column:
    vid = F.upper(F.regexp_extract(ids, "(?:VID|VEN)_([0-9A-Fa-f]{4})", 1))
    scsi = F.regexp_extract(ids, r"(?i)SCSI\\\\Disk([^\\_]+)", 1)
    known = F.try_element_at(literal_map(L.VENDORS), vid)
    return F.when(blank(ids), F.lit("")).otherwise(F.coalesce(known, F.when(scsi != "", scsi), F.translate(ids, "_", " ")))


def overwrite_by_field(find: Column, expected: str, current: Column, insert: Column) -> Column:
    return F.when(find == expected, insert).otherwise(current)


def normalize_ip(ip: Column) -> Column:
    text = F.trim(F.coalesce(ip, F.lit("")))
    return F.when(text == "::1", "127.0.0.1").otherwise(F.regexp_replace(text, "(?i)^::ffff:", ""))


def placeholder(value: Column) -> Column:
    """Trimmed; "-" and null: ""."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.when(text == "-", "").otherwise(text)


def split_account(value: Column) -> Column:
    """struct<domain, user> of domain\\user; a backslash at an edge parts nothing."""
    text = F.trim(F.coalesce(value, F.lit("")))
    at = F.locate("\\", text)
    parted = (at > 1) & (at < F.length(text))
    return F.struct(F.when(parted, F.substr(text, F.lit(1), at - 1)).otherwise("").alias("domain"), F.when(parted, F.substr(text, at + 1)).otherwise(text).alias("user"))


def parse_utc(value: Column) -> Column:
    """Timestamp of ISO text; an offset is honoured, none means UTC (the session's zone), bad text is null."""
    return F.try_to_timestamp(value)


def unlabeled_timestamp(date: Column, time: Column) -> Column:
    """Timestamp of a date text and a time text, in the forms that logs use."""
    both = F.regexp_replace(F.concat_ws(" ", F.trim(date), F.trim(time)), "[‎‏]", "")
    forms = ("M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "d.M.yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(both, F.lit(f)) for f in forms], F.try_to_timestamp(both))


def longest_text(*texts: Column) -> Column:
    """The longest text that is not blank; the earlier one of equals; else ""."""
    filled = F.filter(F.array(*[F.coalesce(t, F.lit("")) for t in texts]), lambda t: F.trim(t) != "")
    return F.coalesce(F.aggregate(filled, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best)), F.lit(""))


def first_int(*values: Column) -> Column:
    return F.coalesce(*[F.trim(v).try_cast("int") for v in values])


def endpoint(value: Column) -> Column:
    """struct<ip, port> at the last colon, brackets trimmed; no colon: all is the address."""
    text = F.trim(F.coalesce(value, F.lit("")))
    ip = F.when(text.contains(":"), F.regexp_extract(text, "^(.*):[^:]*$", 1)).otherwise(text)
    return F.struct(F.regexp_replace(ip, r"^\[+|\]+$", "").alias("ip"), F.when(text.contains(":"), F.substring_index(text, ":", -1)).otherwise("").alias("port"))


def bind_type(raw: Column) -> Column:
    text = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(text == "0", "Unsigned").when(text == "1", "Simple").when(text == "", "Unknown").otherwise(text)


def hex_ascii(value: Column) -> Column:
    """ASCII text of an even number of hex digits; any other text as it is."""
    return F.when(value.rlike("^([0-9a-fA-F]{2})+$"), F.decode(F.unhex(value), "US-ASCII")).otherwise(value)


def gpo_links(value: Column) -> Column:
    """array<struct<distinguished_name, is_enabled, guid>> of [LDAP://dn;flag] entries."""
    found = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"(?i)(\[LDAP://[^;\]]+;\d+\])"), F.lit(1))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"(?i)\[LDAP://([^;\]]+);", 1).alias("distinguished_name"), (F.regexp_extract(m, r";(\d+)\]", 1) == "0").alias("is_enabled"), F.regexp_extract(m, r"\{([^}]+)\}", 1).alias("guid")))


def text_after(text: Column, marker: str) -> Column:
    """What follows a marker (without case) on its line, trimmed; else ""."""
    at = F.locate(marker.upper(), F.upper(text))
    return F.when(at > 0, F.trim(F.regexp_extract(F.substr(text, at + len(marker)), r"^([^\r\n]*)", 1))).otherwise("")


def sync_stage(text: Column) -> Column:
    up = F.lower(F.trim(text))
    ladder = F.when(up.startswith("starting"), "Start").when(up.contains("import"), "Import").when(up.contains("synchroniz") & ~up.contains("cycle"), "Synchronization").when(up.contains("export"), "Export")
    return ladder.when(up.contains("completed") | up.contains("finished"), "Completed").when(up.contains("failed") | up.contains("error"), "Failed").otherwise("Unknown")


def kerberos_policy(value: Column) -> Column:
    """map<string, double>: of each `name: ... 0xHEX` entry of a ; list its first number, 100 ns ticks scaled.

    KerMaxT and KerMinT count hours, KerMaxR days, KerProxy minutes; KerOpts is its flag 0x80.
    """
    entries = F.filter(F.split(F.coalesce(value, F.lit("")), ";"), lambda e: e.rlike(r"^\s*[^:]+:.*0[xX][0-9a-fA-F]{1,15}"))

    def number(e: Column) -> Column:
        raw = F.conv(F.regexp_extract(e, "0[xX]([0-9a-fA-F]{1,15})", 1), 16, 10).cast("double")
        name = F.trim(F.substring_index(e, ":", 1))
        ticks = F.lit(1e7)
        scaled = F.when(name.isin("KerMaxT", "KerMinT"), raw / (ticks * 3600)).when(name == "KerMaxR", raw / (ticks * 86400)).when(name == "KerProxy", raw / (ticks * 60))
        return scaled.when(name == "KerOpts", (F.floor(raw / 128) % 2).cast("double")).otherwise(raw)

    return F.map_from_entries(F.transform(entries, lambda e: F.struct(F.trim(F.substring_index(e, ":", 1)), number(e))))


def word_counts(text: Column) -> Column:
    """map<string, int> of all `word: digits` pairs."""
    pairs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\w+:\s*\d{1,9})"), F.lit(1))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, ":", 1).alias("k"), F.trim(F.substring_index(p, ":", -1)).cast("int").alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def convert_size(value: Column, unit_from: str = "B", unit_to: str = "MB", digits: int = 2) -> Column:
    """Size in another unit, rounded; nothing above 0 gives 0."""
    steps = ("B", "KB", "MB", "GB", "TB")
    factor = 1024.0 ** (steps.index(unit_from) - steps.index(unit_to))
    return F.when(value > 0, F.round(value.cast("double") * factor, digits)).otherwise(F.lit(0.0))


def format_script(script: Column) -> Column:
    """Lines re-indented by 4 blanks a brace: a leading } steps out, a trailing { steps in, never below 0."""
    lines = F.transform(F.split(script, r"\r?\n"), lambda x: F.trim(x))
    step_in = lambda x: x.endswith("{").cast("int")
    step_out = lambda x: x.startswith("}").cast("int")
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def walk(acc: Column, line: Column) -> Column:
        here = F.greatest(acc["depth"] - step_out(line), F.lit(0))
        return F.struct((here + step_in(line)).alias("depth"), F.concat(acc["out"], F.array(F.concat(F.repeat(F.lit(" "), here * 4), line))).alias("out"))

    return F.array_join(F.aggregate(lines, start, walk)["out"], "\n")


def failure_description(status: Column, sub_status: Column, reason: Column) -> Column:
    part = lambda name, c: F.when(~blank(c), F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", part("Status", status), part("SubStatus", sub_status), part("Reason", reason))


def authentication_type(value: Column) -> Column:
    names = literal_map({k.upper(): k for k in L.AUTHENTICATION_TYPE})
    return F.coalesce(F.try_element_at(names, F.upper(F.trim(value))), F.lit("Unknown"))
