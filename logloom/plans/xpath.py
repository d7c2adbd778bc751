"""XPath text of filter specifications; plans.xpath_reader reads it, and other event XPath, back into a Column."""

from __future__ import annotations

from datetime import datetime
from xml.sax.saxutils import escape

from pyspark.sql import Column

from ..operators.filters import FilterSpec, keyword_mask, level_numbers


def quoted(value: object) -> str:
    return escape(str(value), {"'": "&apos;", '"': "&quot;"})


def _any(form: str, values, word: str = "or") -> str:
    parts = [f"({form.format(quoted(v))})" for v in values]
    return f" {word} ".join(parts) if len(parts) > 1 else parts[0][1:-1]


def _named(wanted: dict[str, tuple[str, ...]], exclude: bool) -> str:
    items = []
    for key, values in wanted.items():
        name = f"Data[@Name='{quoted(key)}']"
        sign, word = ("!=", "and") if exclude else ("=", "or")
        items.append(_any(name + f" {sign} '{{0}}'", values, word) if values else name)
    return " or ".join(f"({i})" for i in items) if len(items) > 1 else items[0]


def build_xpath(spec: FilterSpec, now: datetime | None = None) -> str:
    """The bare XPath of a specification; "*" for an empty one. Clauses join as (all before) and (next)."""
    clauses: list[str] = []
    if spec.event_ids:
        clauses.append(f"*[System[{_any('EventID={0}', spec.event_ids)}]]")
    if spec.record_ids:
        clauses.append(f"*[System[{_any('EventRecordID={0}', spec.record_ids)}]]")
    if spec.exclude_ids:
        clauses.append(f"*[System[{_any('EventID!={0}', spec.exclude_ids)}]]")
    for bound, sign in ((spec.start, "&lt;="), (spec.end, "&gt;=")):
        if bound is not None:
            reach = max(0, round(((now or datetime.now()) - bound).total_seconds() * 1000))
            clauses.append(f"*[System[TimeCreated[timediff(@SystemTime) {sign} {reach}]]]")
    if spec.data_values:
        clauses.append(f"*[EventData[{_any("Data='{0}'", spec.data_values)}]]")
    if spec.providers:
        clauses.append(f"*[System[Provider[{_any("@Name='{0}'", spec.providers)}]]]")
    if spec.levels:
        clauses.append(f"*[System[{_any('Level={0}', level_numbers(spec.levels))}]]")
    if spec.keywords:
        clauses.append(f"*[System[band(Keywords,{keyword_mask(spec.keywords)})]]")
    if spec.users:
        clauses.append(f"*[System[Security[{_any("@UserID='{0}'", spec.users)}]]]")
    if spec.named_data:
        clauses.append(f"*[EventData[{_named(spec.named_data, False)}]]")
    if spec.named_data_exclude:
        clauses.append(f"*[EventData[{_named(spec.named_data_exclude, True)}]]")
    text = ""
    for clause in clauses:
        text = f"({text}) and ({clause})" if text else clause
    return text or "*"


def build_query_list(spec: FilterSpec, path: str | None = None, now: datetime | None = None) -> str:
    """The QueryList form, for a channel or a file."""
    xpath = build_xpath(spec, now).replace(" and ", " and\n").replace(" or ", " or\n")
    where, select = (f'file://{quoted(path)}', "<Select>") if path else (quoted(spec.log_name or ""), f'<Select Path="{quoted(spec.log_name or "")}">')
    return f'<QueryList><Query Id="0" Path="{where}">{select}{xpath}</Select></Query></QueryList>'


def xpath_column(text: str | None, now: datetime | None = None) -> Column:
    """The predicate of an event XPath, or of a QueryList (its Selects less its Suppresses); blank and "*" select all."""
    from .xpath_reader import query_column

    return query_column(text, now)
