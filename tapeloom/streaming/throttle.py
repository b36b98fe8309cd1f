"""Throttling of live events: per task and key, an event passes if an interval has gone by since the last that passed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ["task_id", "throttle_key"]
FEW = 65536


def _place(cuts: Column, t: Column, most: int) -> Column:
    """How many of the sorted ``cuts`` (at most ``most``) are not above t, by binary search."""
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(max(1, most).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= t), at + step).otherwise(at))


def _cuts(keyed: DataFrame, few: int) -> tuple[DataFrame, int]:
    """(task, key, cuts) of the keys with more events than a fair share, and how many cuts a key has at most.

    With N events and P shuffle partitions a key of n events is hot if n > max(few, N / P); it gets ceil(n P / N)
    ranges, of like sizes by approximate percentiles of its times. So there are at most P hot keys and 2 P ranges.
    """
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = keyed.groupBy(*KEY).agg(F.count("*").alias("_n"))
    share = max(few, -(-(keyed.count()) // parts))
    hot = sizes.filter(F.col("_n") > share).select(*KEY, F.ceil(F.col("_n") / share).cast("int").alias("_k"))
    most = hot.agg(F.max("_k")).head()[0] or 0
    if not most:
        return hot, 0
    grid = F.array(*(F.lit(i / most) for i in range(1, most)))
    quantiles = keyed.join(F.broadcast(hot), KEY).groupBy(*KEY, "_k").agg(F.percentile_approx("mono_ts", grid, F.lit(100 * most)).alias("_q"))
    picked = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_k") - 1), lambda i: F.get("_q", F.floor(i * most / F.col("_k")).cast("int") - 1))))
    return quantiles.select(*KEY, picked.alias("_cuts")), most


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """Sorted batches cut where a key ends: (key, rows, whether the key begins here)."""
    last = None
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        of = list(zip(*cols, strict=True))
        start = 0
        for i in range(1, len(of) + 1):
            if i == len(of) or of[i] != of[start]:
                yield of[start], batch.slice(start, i - start), of[start] != last
                last, start = of[start], i


def _times(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(rows.schema.get_field_index("mono_ts")).to_numpy(zero_copy_only=False)


def transfer(times: np.ndarray, interval: float) -> tuple[list[float], list[float]]:
    """What a range of sorted times does to a chain that enters it, as steps (upto, leaves).

    A chain enters at the first event not before the time at which it may pass again; where that is at or before
    ``upto`` (and after the step before), the last event that passes is ``leaves``. Beyond the last step none passes.
    The time it may pass again is at most an interval after the range begins, so only the events until then are entries.
    """
    n = len(times)
    follows = np.searchsorted(times, times + interval, "left")
    end = np.where(follows < n, follows, np.arange(n))
    while True:  # each round doubles the length of the jumps
        further = end[end]
        if (further == end).all():
            break
        end = further
    entries = min(n, int(np.searchsorted(times, times[0] + interval, "right")) + 1)
    leaves = times[end[:entries]]
    last = np.append(leaves[1:] != leaves[:-1], True)
    return times[:entries][last].tolist(), leaves[last].tolist()


def _passing(times: np.ndarray, interval: float, last: float | None) -> tuple[np.ndarray, float | None]:
    keep = np.zeros(len(times), bool)
    at = 0 if last is None else int(np.searchsorted(times, last + interval, "left"))
    while at < len(times):
        keep[at], last = True, float(times[at])
        at = max(at + 1, int(np.searchsorted(times, last + interval, "left")))
    return keep, last


def _greedy(events: DataFrame, keys: list[str], interval: float, entry: str | None = None) -> DataFrame:
    """Events that pass, key by key; ``entry`` names the column with the time that last passed before a key's rows."""
    order = [*keys, "mono_ts"]
    names = [c for c in events.columns if c not in (*order, entry)]
    dealt = events.repartition(*keys).sortWithinPartitions(*order, *names)

    def run(batches):
        last = None
        for _, rows, begins in _runs(batches, keys):
            if begins:
                last = rows.column(rows.schema.get_field_index(entry))[0].as_py() if entry else None
            keep, last = _passing(_times(rows), interval, last)
            yield rows.filter(pa.array(keep))

    return dealt.mapInArrow(run, events.schema)


def throttle(events: DataFrame, interval: float, few: int = FEW) -> DataFrame:
    """Batch form: events (task_id, throttle_key, mono_ts, ...) that pass. Events without a key or a time always pass.

    Of events at one time that which is first by its other columns passes. Keys are dealt to tasks and streamed
    through, sorted by time. A hot key's time is cut into ranges, each a task's: a range's step function tells for every
    way in which time its last event passes, a fold over the ranges' functions gives the time at which each is entered,
    and then all ranges are filtered at once. Only the functions of one key meet in one task.
    """
    free = F.col("throttle_key").isNull() | F.col("mono_ts").isNull()
    keyed = events.filter(~free).withColumn("mono_ts", F.col("mono_ts").cast("double"))
    if interval <= 0:
        return events
    cuts, most = _cuts(keyed, few)
    kinds = {f.name: f.dataType for f in events.schema.fields}
    rest = events.filter(free)
    if not most:
        return _greedy(keyed, KEY, interval).withColumn("mono_ts", F.col("mono_ts").cast(kinds["mono_ts"])).unionByName(rest)
    marked = keyed.join(F.broadcast(cuts), KEY, "left")  # at most 2 P cuts
    cold = _greedy(marked.filter("_cuts is null").drop("_cuts"), KEY, interval)
    ranged = marked.filter("_cuts is not null").withColumn("_range", _place(F.col("_cuts"), F.col("mono_ts"), most)).drop("_cuts")
    spot = [*KEY, "_range"]

    def functions(batches):
        held: list[pa.RecordBatch] = []
        for _, rows, begins in _runs(batches, spot):
            if begins and held:
                yield steps_of(held)
                held = []
            held.append(rows)
        if held:
            yield steps_of(held)

    def steps_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        upto, leaves = transfer(np.concatenate([_times(r) for r in held]), interval)
        key = [held[0].column(held[0].schema.get_field_index(c))[:1] for c in spot]
        floats = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays([*key, pa.array([upto], floats), pa.array([leaves], floats)], names=[*spot, "_upto", "_leaves"])

    def fold(batches):
        last = None
        for _, rows, begins in _runs(batches, KEY):
            if begins:
                last = None
            out = []
            for r in rows.to_pylist():
                out.append({**{c: r[c] for c in spot}, "_entry": last})
                at = 0 if last is None else int(np.searchsorted(r["_upto"], last + interval, "left"))
                last = r["_leaves"][at] if at < len(r["_leaves"]) else last
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*(rows.schema.field(c) for c in spot), pa.field("_entry", pa.float64())]))

    named = ", ".join(f"{c} {keyed.schema[c].dataType.simpleString()}" for c in KEY) + ", _range int"
    steps = ranged.select(*spot, "mono_ts").repartition(*spot).sortWithinPartitions(*spot, "mono_ts").mapInArrow(functions, f"{named}, _upto array<double>, _leaves array<double>")
    entries = steps.repartition(*KEY).sortWithinPartitions(*spot).mapInArrow(fold, f"{named}, _entry double")
    hot = _greedy(ranged.join(F.broadcast(entries), spot), spot, interval, "_entry").drop("_range", "_entry")
    out = cold.unionByName(hot).withColumn("mono_ts", F.col("mono_ts").cast(kinds["mono_ts"]))
    return out.select(events.columns).unionByName(rest)


class _Throttle(StatefulProcessor):
    def __init__(self, interval: float):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        # state of keys that fell silent goes by itself, as its time to live is twenty intervals
        self.last = handle.getValueState("last", "ts double", ttlDurationMs=max(1000, int(20_000 * self.interval)))

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        for pdf in rows:
            pdf = pdf.sort_values("mono_ts", kind="stable")
            keep = []
            for t in pdf["mono_ts"]:
                passes = last is None or t - last >= self.interval
                if passes:
                    last = float(t)
                keep.append(passes)
            yield pdf[pd.Series(keep, index=pdf.index)]
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, interval: float) -> DataFrame:
    """Streaming form, with the last time that passed as state per task and key; needs the RocksDB state store. Events without a key or a time pass."""
    keyed = events.filter("throttle_key is not null and mono_ts is not null").groupBy("task_id", "throttle_key").transformWithStateInPandas(_Throttle(interval), events.schema, "append", "ProcessingTime")
    return keyed.unionByName(events.filter("throttle_key is null or mono_ts is null"))


def for_user(events: DataFrame, user_id) -> DataFrame:
    return events.filter(F.col("user_id") == user_id)
