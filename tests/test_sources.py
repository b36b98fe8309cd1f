"""Readers, writers and extension points on temporary folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import state
from tapeloom.plans import hooks
from tapeloom.sources import artifacts


def test_entries_missing_and_malformed(spark, tmp_path):
    assert artifacts.read_entries(spark, f"{tmp_path}/none/*.json").count() == 0
    (tmp_path / "a.json").write_text(json.dumps([{"start": 0, "end": 1.5, "text": "x"}, {"text": None}, {"text": "y", "speaker": "S"}]))
    (tmp_path / "b.json").write_text("{ not json")
    rows = artifacts.read_entries(spark, f"{tmp_path}/*.json").orderBy("pos").collect()
    assert [(r.pos, r.text, r.speaker) for r in rows] == [(0, "x", None), (2, "y", "S")]


def test_raw_payloads(spark, tmp_path):
    assert artifacts.read_raw(spark, f"{tmp_path}/none/*.json").count() == 0
    chunk = {"segment_index": 2, "start": 300, "end": 310.5, "raw_json": {"segments": [{"start": 0.5, "end": 1, "text": "x", "more": 1}]}}
    for name, payload in {"a": json.dumps({"segments": [chunk, None]}), "b": "{ not json", "c": json.dumps({"segments": 5}), "d": json.dumps([1])}.items():
        (tmp_path / f"{name}.json").write_text(payload)
    rows = artifacts.read_raw(spark, f"{tmp_path}/*.json").collect()
    assert [(r.path[-6:], r.segment_index, r.start, r.end, [tuple(x) for x in r.raw_json.segments]) for r in rows] == [("a.json", 2, 300.0, 310.5, [(0.5, 1.0, "x")])]


def test_windows_fill_gaps(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"idx": 1, "text": "p1"}, {"idx": 9, "text": "out"}, {"idx": 0, "text": "out"}]))
    (tmp_path / "m.json").write_text(json.dumps([{"idx": 1, "text": "m1"}, {"idx": 2, "text": "m2"}]))
    got = artifacts.read_windows(spark, f"{tmp_path}/p.json", f"{tmp_path}/m.json", 3).orderBy("idx").collect()
    assert [(r.idx, r.text) for r in got] == [(1, "p1"), (2, "m2")]


def test_slices_of_large_files(spark, tmp_path):
    """A file in many splits, with characters of several bytes; equal to plain slices."""
    text = "".join(f"Zeile {i} – über {'ß𝄞' * (i % 7)}\r\n" if i % 3 else f"{i}\n" for i in range(60_000)) + "ohne Ende"
    files = {"a.txt": text, "b.txt": "kurz\n", "c.txt": "x"}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body.encode())
    asked = [("a.txt", o, n) for o, n in ((0, 10), (len(text) - 5, 100), (len(text), 5), (len(text) + 9, 5), (123_456, 5000), (77, 300_000), (len(text) // 2, 1), (5, 0))]
    asked += [("b.txt", 0, 5), ("b.txt", 3, 100), ("b.txt", 0, 4), ("c.txt", 0, 1), ("c.txt", 0, 9), ("d.txt", 0, 9)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        requests = spark.createDataFrame([(f"file:{tmp_path}/{f}", o, n) for f, o, n in asked], "path string, offset long, limit long")
        assert spark.read.text(f"{tmp_path}/*.txt").rdd.getNumPartitions() > 8
        rows = artifacts.file_slices(spark, f"{tmp_path}/*.txt", requests, cap=200_000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {(r.path.rsplit("/", 1)[1], r.offset, r.limit): (r.text, r.is_end) for r in rows}
    want = {(f, o, n): (files[f][o : o + min(n, 200_000)], o + min(n, 200_000) >= len(files[f])) for f, o, n in asked if f in files}
    assert got == want


def test_windows_of_a_killed_run(spark, tmp_path):
    one, two = tmp_path / "t1", tmp_path / "t2"
    for folder in (one, two):
        folder.mkdir()
    (one / "windows.json").write_text(json.dumps({"windows": [{"window_index": 1, "summary": {"a": 1}, "path": " "}, {"window_index": "2", "summary": "two", "path": "/x/2"}, 5, {"window_index": "no"}, {"window_index": 0}, {"window_index": 9, "summary": "high"}]}))
    (one / "window_02.txt").write_text("ignored")
    (one / "window_03.txt").write_text('say "3"')
    (one / "window_04.txt").write_text('{"b": 2}')
    (one / "window_x.txt").write_text("no")
    (two / "windows.json").write_text("{ broken")
    (two / "window_12.txt").write_text("[1]")
    totals = spark.createDataFrame([(f"file://{one}", 4), (f"file://{two}", 12)], "folder string, total int")
    rows = artifacts.restore_windows(spark, f"{tmp_path}/t*", totals).orderBy("folder", "window_index").collect()
    assert [(r.folder[-2:], r.window_index, json.loads(r.summary), r.path.rsplit("/", 2)[1:]) for r in rows] == [
        ("t1", 1, {"a": 1}, ["t1", "window_01.txt"]), ("t1", 2, "two", ["x", "2"]), ("t1", 3, 'say "3"', ["t1", "window_03.txt"]), ("t1", 4, {"b": 2}, ["t1", "window_04.txt"]), ("t2", 12, "[1]", ["t2", "window_12.txt"])]
    assert artifacts.restore_windows(spark, f"{tmp_path}/none*", totals).count() == 0


def test_events_write_and_read(spark, tmp_path):
    df = spark.createDataFrame([("download", 5.0), ("task.final", 1.0)], "stage string, t_wall_ms double")
    for _ in range(2):
        artifacts.append_events(df, f"{tmp_path}/ev", "t1", "r1")
    back = artifacts.read_events(spark, f"{tmp_path}/ev")
    assert back.count() == 4 and {r.task_id for r in back.collect()} == {"t1"}
    artifacts.append_events(df.withColumn("prompt_version", F.when(F.col("stage") == "download", "own")), f"{tmp_path}/ev", "t2", "r1", prompt_version="v7")
    assert {(r.stage, r.prompt_version) for r in artifacts.read_events(spark, f"{tmp_path}/ev").filter("task_id = 't2'").collect()} == {("download", "own"), ("task.final", "v7")}
    for k in (1, 2):
        artifacts.write_atomic(df.limit(k), f"{tmp_path}/atomic")
        assert spark.read.json(f"{tmp_path}/atomic").count() == k
    assert not [p for p in os.listdir(tmp_path) if p.endswith(".tmp")]


def test_listing_and_media(spark, tmp_path):
    for n in ("t1/audio.wav", "t1/video.mp4", "t2/audio.wav"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"123")
    files = artifacts.listing(spark, f"{tmp_path}/*/*").withColumn("task", F.element_at(F.split("path", "/"), -2))
    got = {r.task: r.path.rsplit("/", 1)[1] for r in artifacts.pick_media(files, "task", [r"\.mp4$", r"\.wav$"]).collect()}
    assert got == {"t1": "video.mp4", "t2": "audio.wav"}
    live = spark.createDataFrame([("t1",)], "task string")
    later = F.expr("current_timestamp() + interval 2 hours")
    assert [r.task for r in artifacts.abandoned(files, live, "task", later, 1).collect()] == ["t2"]
    assert artifacts.abandoned(files, live, "task", F.current_timestamp(), 1).count() == 0


def test_stream_to_two_sinks(spark, tmp_path):
    artifacts.append_events(spark.createDataFrame([("a", 1.0)], "stage string, t_wall_ms double"), f"{tmp_path}/in", "t", "r")
    q = artifacts.stream_events(spark, f"{tmp_path}/in").writeStream.foreachBatch(artifacts.mirror_batches(f"{tmp_path}/x", f"{tmp_path}/y")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/x").count() == spark.read.parquet(f"{tmp_path}/y").count() == 1


def test_adapters_and_outcomes(spark):
    seen = []
    known = hooks.Adapters()
    known.register(hooks.Adapter("good", lambda df: seen.extend(r.attempt_id for r in df.collect())))
    known.register(hooks.Adapter("bad", lambda df: (_ for _ in ()).throw(RuntimeError("down"))))
    with pytest.raises(ValueError):
        known.register(hooks.Adapter("new", print, (2, 0)))
    claimed = spark.createDataFrame([(1, "good", 1), (2, "bad", 1), (3, "gone", 1), (4, "bad", 5)], "attempt_id int, adapter string, attempts int")
    outcomes = known.deliver(claimed)
    table = claimed.withColumns({"status": F.lit("delivering"), "max_attempts": F.lit(5), "next_attempt_at": F.lit("2024-01-01").cast("timestamp")})
    got = {r.attempt_id: (r.status, r.attempts) for r in state.apply_outcomes(table, outcomes, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {1: ("delivered", 1), 2: ("pending", 1), 3: ("waiting_adapter", 0), 4: ("dead", 5)} and seen == [1]


def test_stages_and_models(spark):
    hooks.STAGES.pop("twice", None)
    hooks.stage("twice")(lambda df: df.withColumn("n", F.col("n") * 2))
    shout = hooks.model_column(lambda: lambda s: s.str.upper(), "string")
    df = hooks.run_stages(spark.createDataFrame([(1, "a b ")], "n int, t string"), ["twice", "twice"])
    r = df.select("n", shout("t").alias("up"), hooks.white_space_tokens(F.col("t")).alias("w")).first()
    assert (r.n, r.up, r.w) == (4, "A B ", ["a", "b"])
