"""Roll-ups of tasks from a live stream of metric events: state while a task runs, one row when it ends."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.operators.metrics import RATES, SUMMARIES, WORST

FINAL = "task.final"
_RATES = ", ".join(f"p{p}_{name} double" for name in RATES for p in (50, 95))
SCHEMA = f"task_id {{task}}, {_RATES}, total_wall_ms_by_stage map<string,bigint>, " + ", ".join(f"{name} array<{{segment}}>" for name in WORST)


def _percentile(counts: list[tuple[float, int]], p: float) -> float | None:
    """Linear interpolation over sorted (value, times), rounded half even to four digits."""
    n = sum(k for _, k in counts)
    if not n:
        return None

    def at(place: int) -> float:
        for value, k in counts:
            if place < k:
                return value
            place -= k
        raise IndexError(place)

    place = p * (n - 1)
    low, high = int(place), min(int(place) + (place != int(place)), n - 1)
    value = at(low) if low == high else (high - place) * at(low) + (place - low) * at(high)
    return round(value * 1e4) / 1e4 if math.isfinite(value * 1e4) else value  # as numbers.round_even


def _some(value) -> bool:
    return value is not None and not pd.isna(value)


class _Rollup(StatefulProcessor):
    """Wall sums by stage, counts of rates by value, the worst segments, and when the task ended."""

    def __init__(self, segment: str, n: int, grace: float, idle: float):
        self.segment, self.n, self.grace, self.idle = segment, n, grace, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.walls = handle.getMapState("walls", "stage string", "ms bigint")
        self.rates = handle.getMapState("rates", "name string, value double", "n bigint")
        self.worst = handle.getMapState("worst", "name string, place int", f"key double, pos bigint, segment {self.segment}")
        self.timer = handle.getValueState("timer", "ms bigint, ended boolean")

    def handleInputRows(self, key, rows, timerValues):
        walls: dict = {}
        rates: dict = {}
        tops: dict = {name: [] for name in WORST}
        ended, latest, final = False, None, None
        for pdf in rows:
            for e in pdf.to_dict("records"):
                at = int(e["ts"].timestamp() * 1000)
                latest = at if latest is None else max(latest, at)
                stage, wall = e["stage"], e["t_wall_ms"]
                if stage == FINAL:
                    ended, final = True, at if final is None else max(final, at)
                elif _some(stage) and _some(wall):
                    walls[stage] = walls.get(stage, 0) + int(wall)
                for name in RATES:
                    if (stage == "transcribe.segment" if name == "rtf" else stage in SUMMARIES) and _some(e[name]):
                        rates[name, float(e[name])] = rates.get((name, float(e[name])), 0) + 1
                for name, by in WORST.items():
                    if stage in SUMMARIES and _some(e[by]):
                        tops[name].append((-float(e[by]), int(e["event_pos"]), e["segment_id"]))
        for stage, ms in walls.items():
            self.walls.updateValue((stage,), ((self.walls.getValue((stage,))[0] if self.walls.containsKey((stage,)) else 0) + ms,))
        for k, n in rates.items():
            self.rates.updateValue(k, ((self.rates.getValue(k)[0] if self.rates.containsKey(k) else 0) + n,))
        for name, new in tops.items():
            held = [(-v[0], v[1], v[2]) for v in (self.worst.getValue((name, i)) for i in range(self.n) if self.worst.containsKey((name, i)))] if new else []
            for i, (bad, pos, segment) in enumerate(sorted(held + new, key=lambda x: x[:2])[: self.n] if new else []):
                self.worst.updateValue((name, i), (-bad, pos, segment))
        if ended and self.grace <= 0:
            yield self._finish(key)
            return
        before, was_ended = self.timer.get() if self.timer.exists() else (None, False)
        due = final + self.grace * 1000 if ended else latest + self.idle * 1000
        if was_ended and not ended:
            return  # the end is known and its timer set
        if before is not None and (not ended or was_ended):
            due = max(due, before)
        if before is not None and before != int(due):
            self.handle.deleteTimer(before)
        self.timer.update((int(due), ended or was_ended))
        if before != int(due):
            self.handle.registerTimer(int(due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._finish(key)

    def _finish(self, key) -> pd.DataFrame:
        by_rate: dict = {name: [] for name in RATES}
        for (name, value), (n,) in self.rates.iterator():
            by_rate[name].append((value, n))
        row = {"task_id": key[0]}
        for name in RATES:
            counts = sorted(by_rate[name])
            row |= {f"p{p}_{name}": _percentile(counts, p / 100) for p in (50, 95)}
        row["total_wall_ms_by_stage"] = {k[0]: v[0] for k, v in self.walls.iterator()} or None
        for name in WORST:
            row[name] = [self.worst.getValue((name, i))[2] for i in range(self.n) if self.worst.containsKey((name, i))] or None
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        for state in (self.walls, self.rates, self.worst, self.timer):
            state.clear()
        return pd.DataFrame([row])

    def close(self) -> None:
        pass


def rollup_stream(events: DataFrame, n: int = 3, grace: float = 0.0, idle: float = 3600.0, late: str = "1 hour") -> DataFrame:
    """The rows of ``metrics.rollup`` from a stream: one a task, when it ends; then its state is cleared.

    ``events`` are those of the batch form with their time ``ts``. A task ends with its ``task.final`` event: at once,
    or, with a ``grace``, when the watermark (the latest time less ``late``) has passed that event by so many seconds,
    so that events which arrive after it still count. A task that falls silent for ``idle`` seconds ends without one.
    What arrives after the end begins a new row; events without a task or a time, or more than ``late`` behind the
    latest, are left out. State: one number a
    stage and a distinct rate, n segments a list. Needs the RocksDB state store.
    """
    segment = events.schema["segment_id"].dataType.simpleString()
    schema = SCHEMA.format(task=events.schema["task_id"].dataType.simpleString(), segment=segment)
    columns = ["task_id", "ts", "stage", "t_wall_ms", "segment_id", "event_pos", *RATES, *(k for k in WORST.values() if k not in RATES)]
    known = events.filter("task_id is not null and ts is not null").select(columns)
    known = known.withColumns({c: F.col(c).cast("double") for c in columns[6:]}).withWatermark("ts", late)
    return known.groupBy("task_id").transformWithStateInPandas(_Rollup(segment, n, grace, idle), schema, "append", "EventTime")
