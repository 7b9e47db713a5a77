"""One background job at a time, with its state: idle, running, succeeded or failed."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import UTC, datetime


class SingleFlight:
    """Runs a function in a thread unless it runs already; state() says how the last run went."""

    def __init__(self):
        self._lock, self._state, self._thread = threading.Lock(), {"status": "idle"}, None

    def state(self) -> dict:
        with self._lock:
            return dict(self._state)

    def start(self, work: Callable[[], dict]) -> bool:
        """False if a run is on; else it begins, and what work returns becomes part of the state."""
        with self._lock:
            if self._state["status"] == "running":
                return False
            self._state = {"status": "running", "started_at": _now()}
        self._thread = threading.Thread(target=self._run, args=(work,), daemon=True)
        self._thread.start()
        return True

    def _run(self, work: Callable[[], dict]) -> None:
        try:
            end = {"status": "succeeded"} | work()
        except Exception as e:  # the state has to say so, whatever went wrong
            end = {"status": "failed", "message": str(e)}
        with self._lock:
            self._state |= end | {"finished_at": _now()}

    def join(self, timeout: float | None = None) -> None:
        if self._thread:
            self._thread.join(timeout)


def retried(call: Callable, transient: Callable[[Exception], bool], attempts: int = 6, first: float = 1.0, sleep: Callable[[float], None] | None = None):
    """call() with waits of first, twice that, and so on between attempts while its errors are transient."""
    import time

    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n + 1 == attempts or not transient(e):
                raise
            (sleep or time.sleep)(first * 2**n)


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
