"""Throttling of hot keys, roll-ups of a stream against the batch form, and donors against brute force."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import metrics as mt
from tapeloom.operators import tasks as tk
from tapeloom.streaming import throttle as th
from tapeloom.streaming.rollup import rollup_stream

EVENTS = "event_id long, task_id long, throttle_key string, mono_ts double"


def passing(rows, interval):
    last, out = {}, []
    for event, task, key, t in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, r[0])):
        if key is None or t is None:
            out.append(event)
        elif (task, key) not in last or t - last[task, key] >= interval:
            last[task, key] = t
            out.append(event)
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 40.0, 4000.0])
def test_one_key_in_all_rows_is_dealt_to_several_tasks(spark, spread):
    rng = random.Random(1)
    rows = [(i, 1, "k", rng.choice([rng.random() * spread, rng.randint(0, 9) * spread / 10])) for i in range(3000)]
    rows += [(9000 + i, 2, "x", rng.random() * 9) for i in range(40)] + [(9100, None, "x", 1.0), (9101, None, "x", 1.1), (9200, 1, None, 2.0), (9201, 1, None, 2.0), (9300, 1, "k", None), (9301, 1, "k", None)]
    df = spark.createDataFrame(rows, EVENTS)
    got = th.throttle(df, 0.75, few=50)
    assert got.columns == df.columns
    assert sorted(r.event_id for r in got.collect()) == passing(rows, 0.75)  # those of a null task are a key of their own
    cuts, most = th._cuts(df.filter("throttle_key is not null and mono_ts is not null"), 50)
    assert most == 4 and len(cuts.head()["_cuts"]) == 3 and cuts.count() == 1  # the hot key has a task's share for each of 4 partitions
    assert th.throttle(df.limit(0), 0.75).count() == 0 and th.throttle(df, 0.0).count() == len(rows)


def test_step_functions_of_ranges():
    rng = np.random.default_rng(3)
    for _ in range(200):
        times = np.sort(rng.integers(0, 60, rng.integers(1, 40)) / 4.0)
        interval = float(rng.choice([0.3, 1.0, 2.5, 50.0]))
        upto, leaves = th.transfer(times, interval)
        for last in np.unique(np.append(times[0] - rng.random(5) * 2 * interval, times[0] - 1e-9)):
            _, want = th._passing(times, interval, float(last))
            at = int(np.searchsorted(upto, last + interval, "left"))
            assert (leaves[at] if at < len(leaves) else float(last)) == want


def metric_rows(rng, tasks, n):
    start, rows = datetime(2024, 1, 1), []
    for task in range(tasks):
        for i in range(n):
            stage = rng.choice(["transcribe.segment", "summarize.segment", "summarize.global", "download"])
            pick = lambda *v: rng.choice([None, *v])
            rows.append((task, i, f"s{i}", stage, pick(12.9, 7.0, 3.2), pick(0.5, 0.25, 1.0), pick(9.0, 11.125), pick(0.1, 0.3), pick(0.2, 0.7, 0.9), pick(1, 2, 3), start + timedelta(seconds=i)))
        rows.append((task, n, None, "task.final", 99.0, None, None, None, None, None, start + timedelta(seconds=n)))
    return rows


METRICS = "task_id long, event_pos long, segment_id string, stage string, t_wall_ms double, rtf double, llm_tok_per_s double, compression_ratio double, redundancy_dup_sentence_ratio double, number_mismatch_count int, ts timestamp"


def plain(df):
    columns = sorted(df.columns)
    return sorted((tuple(tuple(sorted(v.items())) if isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(columns).collect()), key=repr)


def test_stream_of_shuffled_batches_equals_the_batch_form(spark, tmp_path):
    """Events in any order over many micro-batches, and a restart from the checkpoint in the middle."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(5)
    rows = metric_rows(rng, 6, 25)
    late = [(77, 0, None, "download", 1.0, None, None, None, None, None, datetime(2024, 1, 1, 5))]  # moves the watermark
    silent = [(50, 0, "s", "download", 5.0, None, None, None, None, None, datetime(2024, 1, 1))]  # has no end
    shuffled = rows + silent
    rng.shuffle(shuffled)
    parts = [shuffled[i::4] for i in range(4)]
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run():
        stream = spark.readStream.schema(METRICS).option("maxFilesPerTrigger", 1).parquet(folder)
        query = rollup_stream(stream, grace=600.0, idle=900.0, late="1 hour").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(out)
        query.awaitTermination()

    for i, part in enumerate(parts):
        spark.createDataFrame(part, METRICS).coalesce(1).write.mode("append").parquet(folder)
        if i % 2:
            run()
    assert spark.read.parquet(out).count() == 0  # the watermark hasn't passed
    spark.createDataFrame(late, METRICS).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert plain(spark.read.parquet(out)) == plain(mt.rollup(spark.createDataFrame(rows + silent, METRICS)))


def test_stream_without_grace_ends_at_the_final_event(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = metric_rows(random.Random(7), 3, 10)
    again = [(0, 99, "z", "summarize.global", 4.0, None, 2.0, None, None, 5, datetime(2024, 1, 2)), (0, 100, None, "task.final", 1.0, None, None, None, None, None, datetime(2024, 1, 2))]
    for part in (rows[:20], rows[20:], again):
        spark.createDataFrame(part, METRICS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(METRICS).parquet(f"{tmp_path}/in")
        query = rollup_stream(stream, late="2 days").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
    want = plain(mt.rollup(spark.createDataFrame(rows, METRICS))) + plain(mt.rollup(spark.createDataFrame(again, METRICS)))
    assert plain(spark.read.parquet(f"{tmp_path}/out")) == sorted(want, key=repr)


def test_canonical_json(spark):
    same = ['{"b": [1, {"y": 2.50, "x": "1.0, {}"}], "a": null}', ' {"a":null,"b":[1.00,{"x":"1.0, {}","y":2.5}]} ']
    other = ['{"b": [1, {"y": 2.51, "x": "1.0, {}"}], "a": null}', '{"b": [{"y": 2.50, "x": "1.0, {}"}, 1], "a": null}', '{"a": 1, "a": 2}', "{oops", "", None, "null", '"a\\"1.0"', "[1.0, -2.0]"]
    rows = spark.createDataFrame([(x,) for x in same + other], "x string").select("x", tk.canonical_json(F.col("x")).alias("c")).collect()
    form = {r.x: r.c for r in rows}
    assert form[same[0]] == form[same[1]] and form[None] == form["null"]
    assert len(set(form.values())) == len(set(same + other)) - 2
    assert json.loads(form["[1.0, -2.0]"]) == [1, -2] and form["[1.0, -2.0]"] == "[1,-2]"


def test_donors(spark):
    rng = random.Random(11)
    spell = [lambda k: json.dumps({"a": {"n": k, "l": [k, 1]}, "b": True}), lambda k: '{"b":true, "a":{"l":[%d.0,1.00],"n":%d}}' % (k, k)]
    start, rows = datetime(2024, 1, 1), []
    for i in range(900):
        k = rng.randint(0, 6)
        rows.append((i, rng.choice([1, 1, 1, 2, 3, 4]), rng.choice(["hot", "hot", f"u{rng.randint(0, 30)}", None]), start + timedelta(seconds=rng.randint(0, 300)), rng.choice(["completed", "queued"]), rng.choice(spell)(k), k))
    df = spark.createDataFrame(rows, "task_id long, user_id long, url string, created_at timestamp, status string, options string, k int")
    done = sorted((r for r in rows if r[4] == "completed"), key=lambda r: (r[3], r[0]), reverse=True)
    want = {}
    for r in rows:
        near = [c for c in done if r[2] is not None and c[2] == r[2] and c[1] != r[1]][:5]
        want[r[0]] = next((c[0] for c in near if c[6] == r[6]), None)
    assert {r.task_id: r.donor_id for r in tk.donors(df, df, newest_of=5).collect()} == want and any(want.values())
    assert tk.donors(df.limit(0), df).count() == 0 and {r.donor_id for r in tk.donors(df, df.limit(0)).collect()} == {None}
