"""What a restart finds: steps whose artifacts are whole, the step to go on with, abandoned uploads, orphaned jobs.

The judgements are joins and JSON functions over a table of the files of all tasks, so any number of tasks is judged at
once; ``sources.artifacts.task_files`` reads that table from any store that Spark can open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The files that tell whether a step is done, by a short name; those whose content counts; the judged steps.
FILES = {
    "manifest": "outputs/segments_manifest.json",
    "json": "outputs/transcript.json",
    "txt": "outputs/transcript.txt",
    "matches": "outputs/speaker_matches.json",
    "chunks": "summary/chunks.json",
    "windows": "summary/windows.json",
}
READ = ("manifest", "chunks", "windows")
STEPS = ("transcribe_segments", "merge_transcript", "match_speakers", "prepare_summary_chunks", "summarize_windows")


def _is(kind: str, value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _object(value: Column) -> Column:
    """An object's own keys and values; null for all else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def artifact_done(tasks: DataFrame, files: DataFrame, segments: DataFrame) -> DataFrame:
    """(task_id, name, artifact): whether each of the judged steps left what a later run can go on with.

    ``files``: task_id, name (below the task's folder), text (null if it isn't read or can't be). ``segments``: task_id,
    segment_index, raw_json. Segments are transcribed if every one of the manifest has a payload that isn't empty (an
    empty manifest has none to do); without a manifest, if the transcript exists. Chunks must be an object that says
    whether they are diarized, windows one with a list; the other steps' files need only exist. What can't be parsed, a
    manifest too, isn't done. Other steps have no row. Repeated files count once.
    """
    there = [F.max(F.when(F.col("name") == path, F.struct(F.lit(True).alias("is"), "text"))).alias(k) for k, path in FILES.items()]
    own = tasks.select("task_id").distinct().join(files.filter(F.col("name").isin(*FILES.values())).groupBy("task_id").agg(*there), "task_id", "left")
    own = own.withColumns({f"_{k}": F.try_parse_json(F.col(f"{k}.text")) for k in READ})
    listed = F.try_variant_get("_manifest", "$.segments", "array<variant>")
    planned = F.transform(listed, lambda s: F.try_variant_get(s, "$.segment_index", "int"))
    full = segments.filter("segment_index is not null").filter(F.size(_object(F.try_parse_json(F.col("raw_json")))) > 0)
    own = own.join(full.groupBy("task_id").agg(F.collect_set("segment_index").alias("_full")), "task_id", "left")
    none = F.array().cast("array<int>")
    lacks = F.size(F.array_except(F.coalesce(planned, none), F.coalesce("_full", none))) > 0
    exists = lambda k: F.col(f"{k}.is").isNotNull()
    segments_key = F.try_variant_get("_manifest", "$.segments", "variant")
    whole = _object(F.col("_manifest")).isNotNull() & (segments_key.isNull() | listed.isNotNull()) & ~lacks
    judged = {
        "transcribe_segments": F.when(exists("manifest"), whole).otherwise(exists("json")),
        "merge_transcript": exists("json") & exists("txt"),
        "match_speakers": exists("matches"),
        "prepare_summary_chunks": F.coalesce(F.array_contains(F.json_object_keys(F.col("chunks.text")), "diarized"), F.lit(False)),
        "summarize_windows": F.try_variant_get("_windows", "$.windows", "array<variant>").isNotNull(),
    }
    pairs = F.array(*(F.struct(F.lit(name).alias("name"), done.alias("artifact")) for name, done in judged.items()))
    return own.select("task_id", F.inline(pairs))


def resume_points(steps: DataFrame, dag: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(task_id, next_step, redo): the step each task goes on with; null if none is left.

    ``steps``: task_id, name, status; ``dag``: task_id, ord, name, enabled. A step is behind a task if it is disabled or
    skipped, or completed with a whole artifact (of steps that aren't judged the status alone counts). ``redo`` are the
    steps that say completed but lost their artifact, in order.
    """
    # Counted by step instead of joined, so tables that were dealt by task aren't dealt again, and nothing is sorted.
    zero, status = F.lit(0).cast("long"), F.coalesce("status", F.lit(""))
    flag = lambda c: c.cast("long")
    dags = dag.select("task_id", "name", "ord", F.coalesce("enabled", F.lit(True)).alias("on"), F.lit(1).cast("long").alias("dags"), zero.alias("said"), zero.alias("skipped"), zero.alias("completed"), zero.alias("lost"))
    none = [F.lit(None).cast(dags.schema["ord"].dataType).alias("ord"), F.lit(None).cast("boolean").alias("on"), zero.alias("dags")]
    said = steps.filter("name is not null and task_id is not null").select("task_id", "name", *none, F.lit(1).cast("long").alias("said"), flag(status == "skipped").alias("skipped"), flag(status == "completed").alias("completed"), zero.alias("lost"))
    lost = artifacts.filter("not artifact and name is not null and task_id is not null").select("task_id", "name", *none, zero.alias("said"), zero.alias("skipped"), zero.alias("completed"), F.lit(1).cast("long").alias("lost"))
    counts = [F.sum(c).alias(c) for c in ("dags", "said", "skipped", "completed", "lost")]
    each = dags.unionByName(said).unionByName(lost).groupBy("task_id", "name").agg(F.min("ord").alias("ord"), F.max("on").alias("on"), *counts).filter("dags > 0")
    to_do = F.col("on") & ((F.col("said") == 0) | (F.col("said") > F.col("skipped") + F.when(F.col("lost") == 0, F.col("completed")).otherwise(0)))
    times = F.when(F.col("on"), F.col("dags") * F.col("completed") * F.col("lost")).otherwise(0).cast("int")
    told = F.struct("ord", "name", to_do.alias("to_do"), times.alias("times"))
    own = each.groupBy("task_id").agg(F.collect_list(F.when(to_do | (times > 0), told)).alias("_told"))
    step = lambda x: F.struct(x["ord"].alias("ord"), x["name"].alias("name"))
    first = F.array_min(F.transform(F.filter("_told", lambda x: x["to_do"] & x["ord"].isNotNull()), step))
    redo = F.array_sort(F.flatten(F.transform(F.filter("_told", lambda x: x["times"] > 0), lambda x: F.array_repeat(step(x), x["times"]))))
    return own.select("task_id", first["name"].alias("next_step"), F.transform(redo, lambda x: x["name"]).alias("redo"))


def abandoned_sessions(sidecars: DataFrame, live: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """(upload_id, folder) of uploads that nobody will finish: those may be deleted, so every doubt speaks against it.

    ``sidecars``: folder, text of each upload.json; its folder's last name is the upload's id. Not listed are: names that
    are no UUID; sidecars that can't be read, aren't an object, or have no ISO time ``created_at`` (times without a
    zone are UTC); an id that has several sidecars, in whatever spelling; ids of ``live`` tasks (task_id); and sessions younger than the limit.
    """
    bare = F.regexp_replace(F.lower(F.element_at(F.split("folder", "/"), -1)), r"^urn:uuid:|^\{|\}$|-", "")
    meta = F.try_parse_json("text")
    at = F.when(_is("STRING", F.try_variant_get(meta, "$.created_at", "variant")), F.try_variant_get(meta, "$.created_at", "string"))
    day, clock, zone = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?", r"(Z|[+-][0-9]{2}:[0-9]{2})"
    stated = F.when(at.rlike(f"{day}$"), F.concat(at, F.lit("T00:00:00Z"))).when(at.rlike(f"{day}{clock}$"), F.concat(at, F.lit("Z"))).when(at.rlike(f"{day}{clock}{zone}$"), at)
    own = sidecars.select(F.when(bare.rlike("^[0-9a-f]{32}$"), bare).alias("_id"), "folder", F.when(_is("OBJECT", meta), F.try_to_timestamp(stated)).alias("created"))
    single = own.filter("_id is not null").groupBy("_id").agg(F.count("*").alias("_n"), F.max("folder").alias("folder"), F.max("created").alias("created")).filter("_n = 1")
    old = single.filter(F.unix_micros(now) - F.unix_micros("created") >= ttl_seconds * 1_000_000)
    kept = live.select(F.regexp_replace(F.lower(F.col("task_id").cast("string")), r"^urn:uuid:|^\{|\}$|-", "").alias("_id"))
    upload = F.regexp_replace("_id", "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return old.join(kept, "_id", "left_anti").select(upload.alias("upload_id"), "folder")


def orphaned_jobs(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Jobs (job_id, task_id) that no running or waiting task owns; after a restart has queued all of them, that is every job."""
    return jobs.join(tasks.filter(F.col("status").isin("running", "waiting")).select("task_id").distinct(), "task_id", "left_anti")
