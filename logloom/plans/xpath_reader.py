"""Event XPath and query lists as predicates over canonical events.

The text becomes a small tree (any of, all of, not, a path with conditions), and the tree one Column. Negation is pushed down
to the comparisons, which then also hold for missing values; so "not" is two-valued as in XPath, and comparisons that
are not negated stay plain ones of a column, which reach the Parquet scan.

Understood: System with its elements and attributes, EventData/Data by name, by value or by several conditions,
UserData/<holder>/<element>, "*" and "Event" as first steps, paths with /, and, or, not(), parentheses, = != < <= > >=, band(Keywords, n)
and timediff(@SystemTime). A path without a comparison asks whether it is there. Names that an event doesn't have are refused.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.parse import raw


@dataclass(frozen=True)
class AnyOf:
    parts: tuple


@dataclass(frozen=True)
class AllOf:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Mask:
    bits: int


@dataclass(frozen=True)
class Age:
    sign: str
    millis: int


@dataclass(frozen=True)
class Path:
    """Steps (name, conditions), and a comparison of the last one, if any."""

    steps: tuple
    sign: str | None = None
    value: str | None = None


# ------------------------------------------------------------------------------------ reading

_TOKENS = re.compile(r"""\s*(?:(?P<text>'[^']*'|"[^"]*")|(?P<number>0[xX][0-9a-fA-F]+|\d+)(?![\w.])|(?P<name>@?[A-Za-z_][\w.-]*)|(?P<sign>!=|<=|>=|=|<|>)|(?P<mark>[()\[\]*/,.]))""")
_ESCAPES = (("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'"), ("&quot;", '"'), ("&amp;", "&"))


class _Tokens:
    def __init__(self, text: str):
        for a, b in _ESCAPES[:2]:
            text = text.replace(a, b)  # signs; escapes in values are read with them
        self.items, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKENS.match(text, at)
            if not m:
                raise ValueError(f"XPath not understood at {text[at : at + 20].strip()!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    @property
    def next(self) -> str:
        return self.items[self.at][1] if self.at < len(self.items) else ""

    @property
    def kind(self) -> str:
        return self.items[self.at][0] if self.at < len(self.items) else "end"

    def take(self, *wanted: str) -> str:
        found = self.next
        if not found or wanted and found not in wanted:
            raise ValueError(f"XPath: {' or '.join(wanted) or 'more'} expected, found {found or 'the end'}")
        self.at += 1
        return found

    def literal(self) -> str:
        if self.kind not in ("text", "number"):
            raise ValueError(f"XPath: a value expected, found {self.next or 'the end'}")
        kind, found = self.kind, self.take()
        if kind == "number":
            return found
        found = found[1:-1]
        for a, b in _ESCAPES[2:]:
            found = found.replace(a, b)
        return found


def _list(t: _Tokens, word: str, one: Callable, made: type):
    parts = [one(t)]
    while t.next == word:
        t.take()
        parts.append(one(t))
    return parts[0] if len(parts) == 1 else made(tuple(parts))


def _either(t: _Tokens):
    return _list(t, "or", _both, AnyOf)


def _both(t: _Tokens):
    return _list(t, "and", _one, AllOf)


def _one(t: _Tokens):
    word = t.next
    if word == "(":
        t.take()
        out = _either(t)
        t.take(")")
        return out
    called = t.at + 1 < len(t.items) and t.items[t.at + 1][1] == "("
    if called and word == "not":
        t.take(), t.take("(")
        out = Not(_either(t))
        t.take(")")
        return out
    if called and word == "band":
        t.take(), t.take("("), t.take("Keywords"), t.take(",")
        out = Mask(int(t.literal(), 0))
        t.take(")")
        return out
    if called and word == "timediff":
        t.take(), t.take("("), t.take("@SystemTime"), t.take(")")
        return Age(t.take("<", "<=", ">", ">="), int(t.literal()))
    return _path(t)


def _path(t: _Tokens) -> Path:
    steps = []
    while True:
        if t.next not in ("*", ".") and t.kind != "name":
            raise ValueError(f"XPath: a name expected, found {t.next or 'the end'}")
        name, conditions = t.take(), []
        while t.next == "[":
            t.take()
            conditions.append(_either(t))
            t.take("]")
        steps.append((name, tuple(conditions)))
        if t.next != "/":
            break
        t.take()
    if t.kind == "sign":
        sign = t.take()
        return Path(tuple(steps), sign, t.literal())
    return Path(tuple(steps))


def parse(text: str):
    """The tree of an XPath."""
    t = _Tokens(text)
    out = _either(t)
    if t.next:
        raise ValueError(f"XPath: {t.next!r} left over")
    return out


# ------------------------------------------------------------------------------------ columns

_NUMBERS = {
    ("EventID",): "id", ("EventRecordID",): "record_id", ("Level",): "level", ("Task",): "task", ("Opcode",): "opcode", ("Version",): "version", ("Keywords",): "keywords",
    ("Execution", "@ProcessID"): "process_id", ("Execution", "@ThreadID"): "thread_id",
}
_TEXTS = {
    ("Channel",): "log_name", ("Computer",): "computer_name", ("Security", "@UserID"): "user_id", ("Provider", "@Guid"): "provider_id", ("EventID", "@Qualifiers"): "qualifiers",
    ("Correlation", "@ActivityID"): "activity_id", ("Correlation", "@RelatedActivityID"): "related_activity_id",
}
_ELEMENTS = {k[0] for k in (*_NUMBERS, *_TEXTS)} | {"Provider", "TimeCreated"}
_SIGNS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
_OPPOSITE = {"=": "!=", "!=": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def _compared(left: Column, sign: str | None, right: Column | None, want: bool) -> Column:
    """The comparison, or that it doesn't hold: then for nulls too. Without a sign: whether the value is there."""
    if sign is None:
        return left.isNotNull() if want else left.isNull()
    if want:
        return getattr(left, _SIGNS[sign])(right)
    return getattr(left, _SIGNS[_OPPOSITE[sign]])(right) | left.isNull()


def _joined(parts: list[Column], every: bool) -> Column:
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), parts)


class _Compiler:
    def __init__(self, now: datetime | None):
        self.now = now

    def column(self, node, place: tuple[str, ...], want: bool = True) -> Column:
        """The predicate that a node holds at a place of the event (want), or doesn't."""
        if isinstance(node, AnyOf | AllOf):
            return _joined([self.column(p, place, want) for p in node.parts], isinstance(node, AllOf) == want)
        if isinstance(node, Not):
            return self.column(node.part, place, not want)
        if isinstance(node, Mask):
            return _compared(F.col("keywords").bitwiseAND(F.lit(node.bits)), "!=", F.lit(0), want)
        if isinstance(node, Age):
            if place[-1:] != ("TimeCreated",):
                raise ValueError("XPath: timediff belongs into TimeCreated")
            age = F.unix_millis(F.lit(self.now or datetime.now()).cast("timestamp")) - F.unix_millis(F.col("time_created").cast("timestamp"))
            return _compared(age, node.sign, F.lit(node.millis), want)
        return self.path(node, place, want)

    def path(self, node: Path, place: tuple[str, ...], want: bool) -> Column:
        """All conditions on the way and the comparison at its end."""
        parts, steps = [], list(node.steps)
        for k, (name, conditions) in enumerate(steps):
            if not place and name in ("*", "Event"):
                below = ()
            elif name == ".":
                below = place
            else:
                below = (*place, name)
            last = k == len(steps) - 1
            if below and below[0] == "EventData" and len(below) == 2:
                if not last or name not in ("Data", "*"):
                    raise ValueError(f"XPath: {'/'.join(n for n, _ in steps)} is not among the supported names")
                parts.append(self.data(conditions, node.sign, node.value, want))
                return _joined(parts, want)
            if below and below[0] == "UserData" and len(below) == 3:
                if not last or conditions:
                    raise ValueError("XPath: UserData is read one element below its first one")
                parts.append(_compared(raw(F.col("data_ci"), name), node.sign, None if node.sign is None else F.lit(node.value), want))
                return _joined(parts, want)
            if below and below[0] not in ("System", "EventData", "UserData") or below[:1] == ("System",) and len(below) == 2 and name not in _ELEMENTS:
                raise ValueError(f"XPath: {name} is not among the supported names")
            parts += [self.column(c, below, want) for c in conditions]
            place = below
        if node.sign is not None or len(place) == 3 or place[:1] == ("System",) and len(place) == 2 and place[1] not in ("Provider", "TimeCreated", "Execution", "Security", "Correlation"):
            parts.append(self.field(place, node.sign, node.value, want))
        return _joined(parts, want) if parts else F.lit(want)

    def field(self, place: tuple[str, ...], sign: str | None, value: str | None, want: bool) -> Column:
        key = place[1:]
        if place[:1] == ("System",) and key in _NUMBERS:
            return _compared(F.col(_NUMBERS[key]), sign, None if sign is None else F.lit(int(value, 0)), want)
        if place[:1] == ("System",) and key in _TEXTS:
            return _compared(F.col(_TEXTS[key]), sign, None if sign is None else F.lit(value), want)
        if place == ("System", "Provider", "@Name"):
            return _compared(F.upper("provider_name"), sign, None if sign is None else F.lit(value.upper()), want)
        if place == ("System", "TimeCreated", "@SystemTime"):
            return _compared(F.col("time_created"), sign, None if sign is None else F.lit(_utc(value)).cast("timestamp_ntz"), want)
        raise ValueError(f"XPath: {'/'.join(place)} is not among the supported names")

    def data(self, conditions: tuple, sign: str | None, value: str | None, want: bool) -> Column:
        """Some Data element has all conditions and compares. By name alone it is a lookup, else a search of the entries."""
        if len(conditions) == 1 and isinstance(conditions[0], Path) and conditions[0].steps == (("@Name", ()),) and conditions[0].sign == "=":
            return _compared(raw(F.col("data_ci"), conditions[0].value), sign, None if sign is None else F.lit(value), want)

        def holds(entry: Column) -> Column:
            parts = [self.entry(c, entry) for c in conditions]
            if sign is not None:
                parts.append(_compared(entry["value"], sign, F.lit(value), True))
            return _joined(parts, True) if parts else F.lit(True)

        found = F.coalesce(F.exists(F.map_entries("data"), holds), F.lit(False))
        return found if want else ~found

    def entry(self, node, entry: Column, want: bool = True) -> Column:
        if isinstance(node, AnyOf | AllOf):
            return _joined([self.entry(p, entry, want) for p in node.parts], isinstance(node, AllOf) == want)
        if isinstance(node, Not):
            return self.entry(node.part, entry, not want)
        if isinstance(node, Path) and len(node.steps) == 1 and not node.steps[0][1] and node.steps[0][0] in ("@Name", ".", "Data"):
            named = node.steps[0][0] == "@Name"
            left, right = (F.upper(entry["key"]), node.value and node.value.upper()) if named else (entry["value"], node.value)
            return _compared(left, node.sign, None if node.sign is None else F.lit(right), want)
        raise ValueError("XPath: a Data element is known by @Name and its value")


def _utc(text: str) -> datetime:
    found = datetime.fromisoformat(text)
    return found if found.tzinfo is None else found.astimezone(UTC).replace(tzinfo=None)


# -------------------------------------------------------------------------------- query lists


def _local(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def query_list_column(text: str, now: datetime | None = None) -> Column:
    """A QueryList: in each Query what a Select takes and no Suppress takes back; the queries' results together.

    A Select or Suppress without a Path has its Query's; a path that names a channel limits it to that channel, one of a
    file (file://...) does not: the rows at hand are the file's.
    """
    if "<!DOCTYPE" in text.upper():
        raise ValueError("a document type is not allowed")
    try:
        root = ET.fromstring(text.strip())
    except ET.ParseError as e:
        raise ValueError(f"the query list can't be read: {e}") from e
    queries = [q for q in root.iter() if _local(q) == "Query"]
    if _local(root) != "QueryList" or not queries:
        raise ValueError("a QueryList with a Query is needed")
    make = _Compiler(now)

    def part(element: ET.Element, query: ET.Element, want: bool) -> Column:
        inner = (element.text or "").strip()
        node = AllOf(()) if inner in ("", "*") else parse(inner)
        made = [] if inner in ("", "*") else [make.column(node, (), want)]
        path = element.get("Path") or query.get("Path") or ""
        if path and not path.lower().startswith("file:"):
            made.append(_compared(F.col("log_name"), "=", F.lit(path), want))
        return _joined(made, want) if made else F.lit(want)

    out = []
    for q in queries:
        chosen = {kind: [e for e in q if _local(e) == kind] for kind in ("Select", "Suppress")}
        if not chosen["Select"]:
            raise ValueError("a Query needs a Select")
        taken = _joined([part(e, q, True) for e in chosen["Select"]], False)
        out.append(_joined([taken, *[part(e, q, False) for e in chosen["Suppress"]]], True))
    return _joined(out, False)


def query_column(text: str | None, now: datetime | None = None) -> Column:
    """The predicate of an XPath or a QueryList; blank and "*" select all."""
    bare = (text or "").strip()
    if bare in ("", "*"):
        return F.lit(True)
    return query_list_column(bare, now) if bare.startswith("<") else _Compiler(now).column(parse(bare), ())
