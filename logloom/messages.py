"""Messages of running work for whoever listens: verbose, debug, information, progress, warning and error."""

from __future__ import annotations

import contextlib
import sys
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

KINDS = ("verbose", "debug", "information", "progress", "warning", "error")


@dataclass(frozen=True)
class Message:
    """percent and step belong to progress; step counts from 1 to steps."""

    kind: str
    text: str
    operation: str | None = None
    percent: int | None = None
    step: int | None = None
    steps: int | None = None


class Messages:
    """Listeners by kind. A listener that fails hinders neither the work nor the others. Kinds in `shown` also go to stderr."""

    def __init__(self, shown: tuple[str, ...] = ()):
        self.shown = set(shown)
        self._lock, self._listeners = threading.Lock(), {k: [] for k in KINDS}

    def listen(self, kind: str, listener: Callable[[Message], None]) -> Callable[[], None]:
        """Adds a listener; what it returns removes it."""
        if kind not in self._listeners:
            raise ValueError(f"{kind!r} is not one of {', '.join(KINDS)}")
        with self._lock:
            self._listeners[kind].append(listener)

        def remove() -> None:
            with self._lock, contextlib.suppress(ValueError):
                self._listeners[kind].remove(listener)

        return remove

    def _send(self, message: Message) -> None:
        with self._lock:
            listeners = list(self._listeners[message.kind])
        for listener in listeners:
            with contextlib.suppress(Exception):
                listener(message)
        if message.kind in self.shown:
            print(f"[{message.kind}] {message.text}", file=sys.stderr)

    def write(self, kind: str, text: str) -> None:
        if kind not in self._listeners:
            raise ValueError(f"{kind!r} is not one of {', '.join(KINDS)}")
        self._send(Message(kind, text))

    def progress(self, activity: str, operation: str | None = None, step: int | None = None, steps: int | None = None) -> None:
        percent = None if not steps or step is None else min(100, 100 * step // steps)
        self._send(Message("progress", activity, operation, percent, step, steps))

    @contextlib.contextmanager
    def gathered(self, *kinds: str) -> Iterator[list[Message]]:
        """The messages of some kinds (all, if none is named) while the block runs."""
        found: list[Message] = []
        removers = [self.listen(k, found.append) for k in kinds or KINDS]
        try:
            yield found
        finally:
            for remove in removers:
                remove()


#: What the library's own work writes to.
MESSAGES = Messages()
