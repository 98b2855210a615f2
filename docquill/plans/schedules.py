"""Cron expressions, intervals, and a loop that runs what is due."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from typing import Any

from docquill.errors import InvalidQuery

_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))


def _field(text: str, low: int, high: int) -> frozenset[int]:
    out: set[int] = set()
    for part in text.split(","):
        m = re.fullmatch(r"(\*|\d+(?:-\d+)?)(?:/(\d+))?", part)
        if not m:
            raise InvalidQuery(f"bad cron field {text}")
        step = int(m[2] or 1)
        a, b = (low, high) if m[1] == "*" else (int(m[1].split("-")[0]), int(m[1].split("-")[-1]))
        if m[2] and m[1] != "*" and "-" not in m[1]:
            b = high
        if not (low <= a <= b <= high) or step < 1:
            raise InvalidQuery(f"bad cron field {text}")
        out.update(range(a, b + 1, step))
    return frozenset(out)


class Cron:
    """minute hour day-of-month month weekday (0 is Sunday); both day fields must match."""

    def __init__(self, text: str):
        parts = text.split()
        if len(parts) != 5:
            raise InvalidQuery("a cron expression has five fields")
        self.fields = [_field(p, *r) for p, r in zip(parts, _RANGES, strict=True)]

    def matches(self, at: datetime) -> bool:
        now = (at.minute, at.hour, at.day, at.month, (at.weekday() + 1) % 7)
        return all(v in f for v, f in zip(now, self.fields, strict=True))


def interval(text: str) -> timedelta:
    m = re.fullmatch(r"(\d+)([smh])", text.strip())
    if not m or int(m[1]) == 0:
        raise InvalidQuery(f"bad interval {text}")
    return timedelta(seconds=int(m[1]) * {"s": 1, "m": 60, "h": 3600}[m[2]])


def validated(schedule: dict[str, Any]) -> dict[str, Any]:
    if bool(schedule.get("cron")) == bool(schedule.get("every")):
        raise InvalidQuery("a schedule has either cron or every")
    Cron(schedule["cron"]) if schedule.get("cron") else interval(schedule["every"])
    return schedule


def due(schedule: dict[str, Any], now: datetime) -> bool:
    """Whether it is time; a cron schedule doesn't run twice within a minute."""
    if not schedule.get("enabled", True):
        return False
    last = datetime.fromisoformat(schedule["last_run"]) if schedule.get("last_run") else None
    if schedule.get("cron"):
        return Cron(schedule["cron"]).matches(now) and (last is None or now - last >= timedelta(seconds=60))
    return last is None or now - last >= interval(schedule["every"])


class Scheduler:
    """A driver thread that looks once a tick for schedules that are due."""

    def __init__(self, schedules: Callable[[], list[dict[str, Any]]], run: Callable[[dict[str, Any]], None], tick: float = 1.0):
        self.schedules, self.run, self.tick, self._stop = schedules, run, tick, threading.Event()
        self._thread: threading.Thread | None = None

    def once(self, now: datetime | None = None) -> list[str]:
        now, ran = now or datetime.now(timezone.utc), []
        for s in self.schedules():
            if due(s, now):
                self.run(s)
                ran.append(s["name"])
        return ran

    def start(self) -> None:
        def loop() -> None:
            while not self._stop.wait(self.tick):
                self.once()

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
