"""Events of an engine: a ring of the last ones, spans, a JSON-lines sink."""

from __future__ import annotations

import time
from collections import deque
from contextlib import contextmanager

KEPT = 1000


class Recorder:
    def __init__(self, enabled: bool = True, clock=time.time):
        self.enabled, self.clock = enabled, clock
        self.events: deque = deque(maxlen=KEPT)
        self.unwritten: list[dict] = []

    def record(self, name: str, **fields) -> None:
        if self.enabled:
            event = {"name": name, "at": int(self.clock() * 1000), **fields}
            self.events.append(event)
            self.unwritten.append(event)

    @contextmanager
    def span(self, name: str, **fields):
        began = self.clock()
        try:
            yield
        finally:
            self.record(name, duration_ms=(self.clock() - began) * 1000, **fields)

    def summary(self) -> dict[str, dict]:
        """By name: count, total and maximum of the durations, and their average over all events of the name."""
        out: dict[str, dict] = {}
        for e in self.events:
            row = out.setdefault(e["name"], {"count": 0, "total_ms": 0.0, "max_ms": 0.0})
            row["count"] += 1
            d = e.get("duration_ms")
            if isinstance(d, (int, float)):
                row["total_ms"] += d
                row["max_ms"] = max(row["max_ms"], d)
        for row in out.values():
            row["avg_ms"] = row["total_ms"] / row["count"]
        return out

    def flush(self, store, name: str = "telemetry") -> int:
        """Append what is new to a JSON-lines folder of a store."""
        n = len(self.unwritten)
        if n:
            rows = [(e["name"], e["at"], {k: str(v) for k, v in e.items() if k not in ("name", "at")}) for e in self.unwritten]
            store.append_json(store.spark.createDataFrame(rows, "name string, at long, fields map<string,string>"), name)
            self.unwritten.clear()
        return n
