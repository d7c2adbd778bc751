"""Request validation before any plan is made: typed failures, limits and normalised forms."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime

from ..functions import lookups
from ..operators.filters import FilterSpec

KINDS = ("InvalidArgument", "NotFound", "AccessDenied", "IoError", "Timeout", "Cancelled", "Exception")
_RECOVERABLE = {"Timeout", "IoError", "NotFound"}


class QueryFailure(ValueError):
    """A failure of a known kind; raised before planning, or made from an exception of the engine."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind, self.message = kind, message

    def descriptor(self) -> dict:
        code = re.sub(r"(?<!^)([A-Z])", r"_\1", self.kind).lower()
        return {"error_code": code, "category": "validation" if self.kind == "InvalidArgument" else "query", "recoverable": self.kind in _RECOVERABLE, "message": self.message}

    @staticmethod
    def of(error: Exception) -> QueryFailure:
        text = str(error)
        kinds = (("PATH_NOT_FOUND|does not exist|No such file", "NotFound"), ("Permission denied|AccessControl", "AccessDenied"), ("time(d )?out", "Timeout"), ("IOException|I/O", "IoError"))
        return QueryFailure(next((k for p, k in kinds if re.search(p, text, re.I)), "Exception"), text)


def _fail(message: str):
    raise QueryFailure("InvalidArgument", message)


#: Limits of a structured filter.
MAX_IDS, MAX_NAME, MAX_KEYS, MAX_VALUES, MAX_KEY_CHARS, MAX_VALUE_CHARS = 256, 260, 32, 16, 128, 256
_LEVEL_ALIASES = {"info": "Informational", "information": "Informational", "warn": "Warning", "crit": "Critical", "log_always": "LogAlways"}


def _plain(text: str, what: str, most: int) -> str:
    text = text.strip()
    if len(text) > most:
        _fail(f"{what} has more than {most} characters")
    if any(ord(ch) < 32 or ord(ch) == 127 for ch in text):
        _fail(f"{what} has control characters")
    return text


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def _ids(values, what: str) -> tuple[int, ...]:
    found = tuple(dict.fromkeys(int(v) for v in values or ()))
    if len(found) > MAX_IDS:
        _fail(f"more than {MAX_IDS} {what}")
    if any(v <= 0 for v in found):
        _fail(f"{what} must be positive")
    return found


def _token(value, table: dict[str, int], aliases: dict[str, str], what: str) -> int | None:
    text = str(value).strip()
    if text.lower() in ("", "any"):
        return None
    if text[0] in "+-":
        _fail(f"{what} {text!r} is signed")
    if text.isdigit():
        return int(text)
    names = {_snake(k): v for k, v in table.items()} | {k.lower(): v for k, v in table.items()} | {a: table[n] for a, n in aliases.items()}
    if text.lower() not in names:
        _fail(f"{what} {text!r} is unknown")
    return names[text.lower()]


def _named(wanted: dict | None, exclude: bool) -> dict[str, tuple[str, ...]]:
    if wanted and len(wanted) > MAX_KEYS:
        _fail(f"more than {MAX_KEYS} named fields")
    out = {}
    for key, values in (wanted or {}).items():
        name = _plain(str(key), "a field name", MAX_KEY_CHARS) or _fail("a field name is blank")
        values = [values] if isinstance(values, str) else list(values or ())
        found = tuple(dict.fromkeys(_plain(str(v), "a field value", MAX_VALUE_CHARS) for v in values))
        if len(found) > MAX_VALUES:
            _fail(f"more than {MAX_VALUES} values of a field")
        if exclude and not found:
            _fail("an exclusion needs values")
        out[name] = found
    return out


def structured_filter(event_ids=None, record_ids=None, provider: str | None = None, level=None, keywords=None, start: datetime | None = None, end: datetime | None = None, user: str | None = None, named_data=None, named_data_exclude=None) -> FilterSpec:
    """A checked specification; order of ids is kept, doubles go. A zero keyword mask filters nothing."""
    if start and end and start > end:
        _fail("the range starts after its end")
    mask = _token(keywords, lookups.KEYWORDS, {}, "keyword") if keywords is not None else None
    number = _token(level, lookups.LEVELS, _LEVEL_ALIASES, "level") if level is not None else None
    if number is not None and number > 255:
        _fail("a level is at most 255")
    provider, user = (_plain(x, what, MAX_NAME) if x else "" for x, what in ((provider, "the provider"), (user, "the user")))
    return FilterSpec(
        event_ids=_ids(event_ids, "event ids"), record_ids=_ids(record_ids, "record ids"), providers=(provider,) if provider else (), levels=() if number is None else (number,),
        keywords=(mask,) if mask else (), start=start, end=end, users=(user,) if user else (), named_data=_named(named_data, False), named_data_exclude=_named(named_data_exclude, True),
    )


@dataclass(frozen=True)
class SecurityRequest:
    path: str
    start: datetime | None = None
    end: datetime | None = None
    max_scanned: int = 5000
    top: int = 20
    include_samples: bool = False
    sample_size: int = 20


def security_request(path: str, start=None, end=None, max_scanned: int = 0, top: int = 0, include_samples: bool = False, sample_size: int = 0) -> SecurityRequest:
    """Defaults for values below 1; values above 200000, 100 and 200 are lowered to these."""
    if not path or not path.strip():
        _fail("a path is needed")
    if start and end and start > end:
        _fail("the range starts after its end")
    clamp = lambda v, default, most: min(most, v if v >= 1 else default)
    return SecurityRequest(path.strip(), start, end, clamp(max_scanned, 5000, 200_000), clamp(top, 20, 100), include_samples, clamp(sample_size, 20, 200))


@dataclass(frozen=True)
class TimelineRequest:
    named_events: tuple[str, ...]
    max_events: int = 500
    max_groups: int = 250
    bucket_minutes: int = 15
    keys: tuple[str, ...] = ("who", "object_affected", "computer")
    include_uncorrelated: bool = True


def timeline_request(request: TimelineRequest, known: set[str]) -> TimelineRequest:
    from .profiles import resolve_keys

    if not request.named_events:
        _fail("named events are needed")
    if unknown := [n for n in request.named_events if n not in known]:
        _fail(f"unknown named events {', '.join(unknown)}")
    if request.max_events < 0 or request.max_groups < 0:
        _fail("caps are not negative")
    try:
        keys = resolve_keys(list(request.keys))
    except ValueError as e:
        raise QueryFailure("InvalidArgument", str(e)) from e
    return replace(request, named_events=tuple(dict.fromkeys(request.named_events)), keys=keys, max_groups=min(request.max_groups, 2000), bucket_minutes=max(1, min(1440, request.bucket_minutes)))
