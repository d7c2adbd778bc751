"""Correlation keys and profiles, and the name forms that requests may use."""

from __future__ import annotations

import re

KEYS = ("who", "object_affected", "computer", "action", "named_event", "event_id", "gathered_from", "gathered_log_name")
DEFAULT_KEYS = ("who", "object_affected", "computer")
PROFILES = {
    "identity": ("who", "object_affected", "computer"),
    "actor_activity": ("who", "action"),
    "object_activity": ("object_affected", "action"),
    "host_activity": ("computer", "action"),
    "rule_activity": ("named_event", "computer"),
}


def snake_case(name: str) -> str:
    """Words parted where letter case or kind (letter, digit) changes, lower-cased, joined by _."""
    return "_".join(w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name))


def resolve_profile(name: str) -> tuple[str, ...]:
    folded = re.sub(r"[\s_-]+", "_", name.strip().lower()).strip("_")
    if not folded or folded not in PROFILES:
        raise ValueError(f"unknown correlation profile {name!r}")
    return PROFILES[folded]


def resolve_keys(names: list[str]) -> tuple[str, ...]:
    found = tuple(dict.fromkeys(snake_case(n) if not n.islower() else n for n in names))
    if not found or len(found) > len(KEYS) or set(found) - set(KEYS):
        raise ValueError(f"correlation keys are among {', '.join(KEYS)}")
    return found
