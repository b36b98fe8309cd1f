"""Resume judgements and abandoned uploads on real folders."""

import json
import uuid

from pyspark.sql import functions as F

from tapeloom.operators import resume
from tapeloom.sources import artifacts


def lay(root, task, files):
    for name, text in files.items():
        path = root / task / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_artifacts_of_folders(spark, tmp_path):
    two = json.dumps({"segments": [{"segment_index": 1}, {"segment_index": 2}]})
    lay(tmp_path, "whole", {"outputs/segments_manifest.json": two, "outputs/transcript.json": "{}", "outputs/transcript.txt": "x", "outputs/speaker_matches.json": "{}", "summary/chunks.json": '{"diarized": null}', "summary/windows.json": '{"windows": []}'})
    lay(tmp_path, "part", {"outputs/segments_manifest.json": two, "outputs/transcript.json": "{}", "summary/chunks.json": '{"chunks": []}', "summary/windows.json": '{"windows": 5}'})
    lay(tmp_path, "none", {"outputs/other.json": "{}", "outputs/speaker_matches.json": ""})
    lay(tmp_path, "merged", {"outputs/transcript.json": "oops", "summary/chunks.json": "[", "summary/windows.json": "[]"})
    lay(tmp_path, "empty", {"outputs/segments_manifest.json": "{}"})
    lay(tmp_path, "broken", {"outputs/segments_manifest.json": '{"segments": [', "outputs/transcript.json": "{}"})
    lay(tmp_path, "odd", {"outputs/segments_manifest.json": '{"segments": [{"segment_index": "x"}]}'})
    names = ["whole", "part", "none", "merged", "empty", "broken", "odd", "gone"]
    tasks = spark.createDataFrame([(n,) for n in names], "task_id string")
    done = [("whole", 1, '{"a": 1}'), ("whole", 2, '{"b": 0}'), ("part", 1, '{"a": 1}'), ("part", 2, "{}"), ("part", 2, None), ("part", 2, "[1]")]
    segments = spark.createDataFrame(done, "task_id string, segment_index int, raw_json string")
    files = artifacts.task_files(spark, f"{tmp_path}/*")
    judged = resume.artifact_done(tasks, files, segments)
    got = {n: {} for n in names}
    for r in judged.collect():
        got[r.task_id][r.name] = r.artifact
    order = resume.STEPS
    assert {n: [got[n][s] for s in order] for n in names} == {
        "whole": [True, True, True, True, True], "part": [False, False, False, False, False], "none": [False] * 5, "merged": [True, False, False, False, False],
        "empty": [True, False, False, False, False], "broken": [False] * 5, "odd": [False] * 5, "gone": [False] * 5}
    dag = tasks.select("task_id", F.posexplode(F.array(*map(F.lit, order))).alias("ord", "name")).withColumn("enabled", F.col("name") != "match_speakers")
    steps = dag.select("task_id", "name", F.lit("completed").alias("status"))
    points = {r.task_id: (r.next_step, r.redo) for r in resume.resume_points(steps, dag, judged).collect()}
    assert points["whole"] == (None, []) and points["merged"] == ("merge_transcript", ["merge_transcript", "prepare_summary_chunks", "summarize_windows"]) and points["part"][0] == "transcribe_segments"
    assert artifacts.task_files(spark, f"{tmp_path}/nothing*").count() == 0


def test_every_doubt_keeps_a_session(spark, tmp_path):
    ids = [str(uuid.UUID(int=i + 1)) for i in range(12)]
    meta = lambda at: json.dumps({"created_at": at})
    old = "2024-01-01T00:00:00+00:00"
    cases = {
        f"a/{ids[0]}": meta(old), f"a/{ids[1]}": meta("2024-01-01T00:00:00"), f"a/{ids[2]}": "{", f"a/{ids[3]}": meta("soon"), f"a/{ids[4]}": json.dumps({}), f"a/{ids[5]}": "[]",
        "a/not-an-id": meta(old), f"a/{ids[6]}": meta(old), f"b/{uuid.UUID(ids[6]).hex}": meta(old), f"a/{ids[7]}": meta(old), f"a/{ids[8]}": meta("2024-01-09T23:00:00Z"), f"a/{ids[9]}": meta("2024-01-09T23:00:00-05:00"),
        f"a/{ids[10]}": json.dumps({"created_at": 20240101}), f"a/{ids[11]}": meta("2024-01-01"),
    }
    for folder, text in cases.items():
        lay(tmp_path, folder, {"upload.json": text})
    lay(tmp_path, f"a/{uuid.UUID(int=99)}", {"media.mp4": "finalized: no sidecar"})
    sidecars = artifacts.upload_sidecars(spark, f"{tmp_path}/*/*")
    assert sidecars.count() == len(cases)
    live = spark.createDataFrame([(ids[7].upper(),)], "task_id string")
    now = F.lit("2024-01-10 23:30:00").cast("timestamp")
    got = {r.upload_id: r.folder for r in resume.abandoned_sessions(sidecars, live, now, 86_400).collect()}
    assert sorted(got) == sorted([ids[0], ids[1], ids[8], ids[11]]) and got[ids[0]].endswith(f"/a/{ids[0]}")
    assert artifacts.upload_sidecars(spark, f"{tmp_path}/none/*").count() == 0


def test_orphaned_jobs(spark):
    jobs = spark.createDataFrame([("j1", 1), ("j2", 2), ("j3", None), ("j4", 9)], "job_id string, task_id long")
    tasks = spark.createDataFrame([(1, "running"), (2, "queued")], "task_id long, status string")
    assert {r.job_id for r in resume.orphaned_jobs(jobs, tasks).collect()} == {"j2", "j3", "j4"}


def test_rows_that_repeat_a_key(spark):
    from tapeloom.operators import state

    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, at int")
    rows = spark.createDataFrame([(2, "x", 5), (2, "y", 4), (3, "z", 1), (3, "w", 2), (None, "n", 1)], "id int, v string, at int")
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert plain(state.upsert(table, rows, ["id"], "at")) == [(1, "a", 0), (2, "x", 5), (3, "w", 2), (None, "n", 1)]
    assert plain(state.upsert(table, rows, ["id"])) == [(1, "a", 0), (2, "y", 4), (3, "z", 1), (None, "n", 1)]
    assert plain(state.insert_if_absent(table, rows, ["id"], "at")) == [(1, "a", 0), (2, "b", 0), (3, "z", 1), (None, "n", 1)]
    assert plain(state.upsert(table.select("id"), rows.select("id"), ["id"])) == [(1,), (2,), (3,), (None,)]


def test_resume_points_deal_tables_once(spark):
    from tapeloom.plans import tasks

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tasks.QUERIES["resume_points"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_steps_that_repeat_or_lack_a_name(spark):
    dag = spark.createDataFrame([(1, 0, "a", True), (1, 1, "b", None), (1, 2, "c", False), (1, 3, "d", True), (2, 0, "a", True), (3, 0, None, True)], "task_id long, ord int, name string, enabled boolean")
    steps = spark.createDataFrame([(1, "a", "completed"), (1, "a", "skipped"), (1, "b", "completed"), (1, "b", "completed"), (1, "c", "completed"), (2, "a", "completed"), (2, "a", "failed"), (3, None, "completed"), (9, "a", "failed")], "task_id long, name string, status string")
    artifacts = spark.createDataFrame([(1, "b", False), (1, "c", False), (2, "a", True), (3, None, False)], "task_id long, name string, artifact boolean")
    got = {r.task_id: (r.next_step, r.redo) for r in resume.resume_points(steps, dag, artifacts).collect()}
    assert got == {1: ("b", ["b", "b"]), 2: ("a", []), 3: (None, [])}
