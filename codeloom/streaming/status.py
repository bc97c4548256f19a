"""What an engine is doing, told to listeners, and one full scan at a time."""

from __future__ import annotations

import threading
from collections.abc import Callable

# The states, and which may follow each.
STATES = {
    "idle": ("scanning", "ready", "error"),
    "scanning": ("analyzing", "error"),
    "analyzing": ("ready", "error"),
    "ready": ("scanning", "updating", "error"),
    "updating": ("ready", "error"),
    "error": ("scanning", "idle"),
}


class Status:
    """The current state; listeners hear of each change. A change that the table does not allow raises ValueError."""

    def __init__(self):
        self.state, self._listeners, self._lock = "idle", [], threading.Lock()

    def listen(self, hear: Callable[[str, str], None]) -> Callable[[], None]:
        """Call `hear` with (old, new) at each change; the result ends that."""
        self._listeners.append(hear)
        return lambda: self._listeners.remove(hear) if hear in self._listeners else None

    def become(self, state: str) -> None:
        with self._lock:
            old = self.state
            if state not in STATES[old]:
                raise ValueError(f"{state} does not follow {old}")
            self.state = state
        for hear in list(self._listeners):
            hear(old, state)


class SingleFlight:
    """Runs a job once for all who ask for it while it runs; they share its result or its error."""

    def __init__(self):
        self._lock, self._running = threading.Lock(), None

    def run(self, job: Callable):
        with self._lock:
            mine = self._running is None
            if mine:
                self._running = {"done": threading.Event(), "value": None, "error": None}
            flight = self._running
        if not mine:
            flight["done"].wait()
        else:
            try:
                flight["value"] = job()
            except BaseException as e:
                flight["error"] = e
            finally:
                with self._lock:
                    self._running = None
                flight["done"].set()
        if flight["error"] is not None:
            raise flight["error"]
        return flight["value"]
