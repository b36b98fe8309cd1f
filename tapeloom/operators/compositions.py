"""Whole operations of the service, composed of the other operators: splitting, projections, restarts, resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import text as tx
from tapeloom.operators import intervals as iv
from tapeloom.operators import metrics as mt
from tapeloom.operators import sequences as sq
from tapeloom.operators import tasks as tk
from tapeloom.sources.shared import shared_folder

# Steps that a new summary runs again, and the last step's name.
SUMMARY_STEPS = ["prepare_llama_model", "prepare_summary_chunks", "summarize_windows", "pack_window_notes", "summarize_final"]
FINAL = "summarize_final"
# How a run ends. Its kind, the status then (null: as it is), whether an event, a push and the deliveries go out.
OUTCOMES = [
    ("done", "completed", True, True, True),
    ("paused", "paused", True, False, False),
    ("awaiting_input", "awaiting_input", True, False, False),
    ("gone", None, False, False, False),
    ("diarization_cancelled", None, False, False, False),
    ("download_cancelled", None, False, False, False),
    ("interrupted", None, False, False, False),
    ("skipped", None, False, False, False),
    ("failed", "failed", True, True, False),
]


def split_entries(entries: DataFrame, words: DataFrame, turns: DataFrame, min_words: int, min_seconds: float, by: str = "task_id") -> DataFrame:
    """Entries (task, pos, speaker, start, end, text) cut where the speaker changes: (task, pos, part, speaker, start, end, text).

    ``words`` (task, pos, word_pos, word, start, end) carry their entry's clock. A word that overlaps no turn goes to the
    nearest one, so a change of speaker lies where the sound changes. Entries whose words lack times, or have no words
    inside them, stay whole with the speaker of greatest overlap; so do those whose words leave one group, with that
    group's speaker if there is one.
    """
    key = [by, "pos"]
    frame = entries.select(*key, F.col("start").alias("_s"), F.col("end").alias("_e"))
    glued = sq.glue_subwords(sq.usable_words(words, key), key).join(frame, key)
    moved = glued.withColumns({"start": F.col("start") + F.col("_s"), "end": F.col("end") + F.col("_s")}).filter("`end` > _s and start < _e")
    spans = moved.withColumn("span_id", F.struct("pos", "word_no")).drop("_s", "_e")
    spoken = iv.nearest_speaker(spans, turns, by).withColumnRenamed("word_no", "word_pos")
    groups = sq.absorb_small(sq.group_words(spoken, key), key, min_words, min_seconds)
    n = F.count("*").over(Window.partitionBy(*key))
    part = F.row_number().over(Window.partitionBy(*key).orderBy("island")) - 1
    groups = groups.withColumns({"_n": n, "part": part})
    cut = groups.select(*key, "_n", "part", *(F.col(c).alias(f"_{c}") for c in ("speaker", "start", "end", "text")))
    whole = iv.speaker_at(entries.drop("speaker").withColumn("span_id", F.col("pos")), turns, by).join(cut, key, "left")
    many = F.coalesce(F.col("_n") > 1, F.lit(False))
    own = {c: F.when(many, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("start", "end", "text")}
    speaker = F.when(many, F.col("_speaker")).otherwise(F.coalesce("_speaker", "speaker")).alias("speaker")
    return whole.select(*key, F.when(many, F.col("part")).otherwise(0).alias("part"), speaker, *own.values())


def diarized(entries: DataFrame, words: DataFrame, turns: DataFrame, names: DataFrame, min_words: int, min_seconds: float, min_share: float, word: str = "Speaker") -> tuple[DataFrame, DataFrame]:
    """(entries, rendered text): entries split by speaker and numbered anew, without repeats at their edges and marginal speakers; then rendered."""
    parts = split_entries(entries, words, turns, min_words, min_seconds)
    order = Window.partitionBy("task_id").orderBy("pos", "part")
    flat = parts.withColumn("pos", F.row_number().over(order).cast("long") - 1).drop("part")
    cleaned = iv.drop_marginal(sq.trim_entries(_cut(flat)), min_share)
    return cleaned, sq.render_dialogue(cleaned, sq.label_map(cleaned, names, word))


def capabilities(status: Column, refs: Column, steps: Column, has_matches: Column) -> Column:
    """What a task offers: a new summary, a new final part, the dialog on its speakers.

    ``refs`` is an array of (source, id), ``steps`` one of (name, status).
    """
    summary = F.exists(refs, lambda r: (r["source"] == "system") & (r["id"] == "summary"))
    failed = F.exists(steps, lambda s: s["name"].isin(SUMMARY_STEPS) & (s["status"] == "failed"))
    windows = F.exists(steps, lambda s: (s["name"] == "summarize_windows") & (s["status"] == "completed"))
    final = F.exists(steps, lambda s: (s["name"] == FINAL) & (s["status"] == "failed"))
    again = summary & (status.isin("completed", "running", "waiting", "paused") | ((status == "failed") & failed))
    tail = (F.size(refs) > 0) & windows & ((status == "completed") | ((status == "failed") & final))
    return F.struct(
        F.coalesce(again, F.lit(False)).alias("can_restart_summary"),
        F.coalesce(tail, F.lit(False)).alias("can_restart_final_summary"),
        (~status.isin("archived", "canceled") & has_matches).alias("can_resolve_speakers"),
    )


def task_rows(tasks: DataFrame, positions: DataFrame, lanes: DataFrame, asr: DataFrame, summary: DataFrame, stats: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """The rows of a task list, or with ``steps`` the full ones.

    A waiting task shows its place in its lane, others theirs in the queue. Progress without a source is 0 of 0; the
    measures of ``stats`` are null where unknown. Each source has one row a task.
    """
    out = tasks.join(positions.select("task_id", F.col("position").alias("_q")), "task_id", "left")
    out = out.join(lanes.select("task_id", F.col("lane").alias("_lane"), F.col("position").alias("_lp")), "task_id", "left")
    out = out.join(asr.select("task_id", F.col("done").alias("transcribe_current"), F.col("total").alias("transcribe_total")), "task_id", "left")
    out = out.join(summary.select("task_id", F.col("done").alias("summary_current"), F.col("total").alias("summary_total")), "task_id", "left")
    measures = [c for c in stats.columns if c != "task_id"]
    out = out.join(stats, "task_id", "left")
    in_lane = (F.col("status") == "waiting") & F.col("_lane").isNotNull()
    progress = ["transcribe_current", "transcribe_total", "summary_current", "summary_total"]
    rows = out.select(
        "task_id", "url", "title", "status", "created_at",
        F.when(in_lane, F.col("_lane")).alias("queue"),
        F.when(in_lane, F.col("_lp")).otherwise(F.col("_q")).alias("queue_position"),
        tx.classify_failure(F.col("error")).alias("failure_code"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in progress),
        *measures,
        *(["options", "error"] if steps is not None else []),
    )
    if steps is None:
        return rows
    own = steps.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("name", *[c for c in steps.columns if c not in ("task_id", "name")]))).alias("steps"))
    return rows.join(own, "task_id", "left")


def task_outcomes(runs: DataFrame) -> DataFrame:
    """How each run (task_id, status, raised, message, pause_requested) ends: its kind, the task's status, what goes out.

    ``raised`` is null for a run that came to its end; a name that isn't an outcome's is a failure. A task that can't
    start is skipped. An interrupted run is a pause if one was requested; else it leaves the task as it is.
    """
    known = [kind for kind, *_ in OUTCOMES if kind not in ("done", "skipped", "failed")]
    kind = (
        F.when(F.col("status").isin(*tk.GROUPS["skippable_on_start"]), "skipped")
        .when(F.col("raised").isNull(), "done")
        .when((F.col("raised") == "interrupted") & F.col("pause_requested"), "paused")
        .when(F.col("raised").isin(known), F.col("raised"))
        .otherwise("failed")
    )
    table = runs.sparkSession.createDataFrame(OUTCOMES, "kind string, ends string, event boolean, push boolean, deliver boolean")
    out = runs.withColumn("kind", kind).join(F.broadcast(table), "kind")  # nine rows
    error = F.when(F.col("kind") == "failed", F.col("message"))
    return out.select("task_id", "kind", F.coalesce("ends", "status").alias("status"), "event", "push", "deliver", error.alias("error"), tx.classify_failure(error).alias("failure_code"))


def wrong_ends(outcomes: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, status, expected) of the tasks whose recorded status isn't their run's."""
    both = tasks.select("task_id", "status").join(outcomes.select("task_id", F.col("status").alias("expected")), "task_id")
    return both.filter("not (status <=> expected)")


def count_tasks(tasks: DataFrame) -> DataFrame:
    """How many rows a filtered list has; give it what ``filter_tasks`` returns, so both share their filters."""
    return tasks.agg(F.count("*").alias("n"))


def samples_of(samples: DataFrame, speakers: DataFrame, user_id) -> DataFrame:
    """The voice samples that belong to a user's speakers."""
    return samples.join(speakers.filter(F.col("user_id") == user_id).select("speaker_id"), "speaker_id", "left_semi")


def merge_speakers(speakers: DataFrame, samples: DataFrame, decisions: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(speakers, samples, decisions) after merging source into target, per (user_id, source, target).

    A merge counts if both speakers are that user's and differ. Samples and decisions move before the source goes, so
    no decision loses its speaker. A source has one target, and no target is a source.
    """
    mine = speakers.select("user_id", "speaker_id")
    good = merges.filter("source <> target").join(mine.withColumnRenamed("speaker_id", "source"), ["user_id", "source"], "left_semi")
    good = good.join(mine.withColumnRenamed("speaker_id", "target"), ["user_id", "target"], "left_semi").select(F.col("source").alias("speaker_id"), "target")

    def moved(table: DataFrame) -> DataFrame:
        return table.join(good, "speaker_id", "left").withColumn("speaker_id", F.coalesce("target", "speaker_id")).select(table.columns)

    return speakers.join(good, "speaker_id", "left_anti").select(speakers.columns), moved(samples), moved(decisions)


def reset_steps(steps: DataFrame, ids: DataFrame, which: Column) -> DataFrame:
    """Steps of the given tasks for which ``which`` holds, as if they had never run."""
    hit = steps.join(ids.select("task_id", F.lit(True).alias("_hit")).distinct(), "task_id", "left")
    again = F.coalesce("_hit", F.lit(False)) & which
    return hit.withColumns(
        {
            "status": F.when(again, "pending").otherwise(F.col("status")),
            "attempt": F.when(again, 0).otherwise(F.col("attempt")),
            **{c: F.when(~again, F.col(c)) for c in ("started_at", "finished_at", "message") if c in steps.columns},
        }
    ).select(steps.columns)


def is_summary_step(name: Column) -> Column:
    return name.isin(SUMMARY_STEPS) | name.startswith("finalize:")


def restart_summaries(tasks: DataFrame, steps: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, steps): the given tasks queued for a new summary, their results pending, their summary steps reset."""
    hit = tasks.join(ids.select("task_id", F.lit(True).alias("_hit")).distinct(), "task_id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    pending = F.transform("results", lambda r: F.struct(r["key"].alias("key"), F.when(r["status"] == "completed", "pending").otherwise(r["status"]).alias("status")))
    changed = {"status": F.lit("queued"), "summary_path": F.lit(None), "summary_current": F.lit(0), "summary_total": F.lit(0), "results": pending}
    out = hit.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in changed.items()}).select(tasks.columns)
    return out, reset_steps(steps, ids, is_summary_step(F.col("name")))


def clear_results(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """The given tasks without results and summary."""
    hit = tasks.join(ids.select("task_id", F.lit(True).alias("_hit")).distinct(), "task_id", "left")
    kept = F.col("_hit").isNull()
    return hit.withColumns({"results": F.when(kept, F.col("results")).otherwise(F.slice("results", 1, 0)), "summary_path": F.when(kept, F.col("summary_path"))}).select(tasks.columns)


def rebuild_tail(steps: DataFrame, tail: DataFrame) -> DataFrame:
    """Steps of the tasks in ``tail`` (task_id, name): final steps that it lacks go, those that it has are pending."""
    final = (F.col("name") == FINAL) | F.col("name").startswith("finalize:")
    flagged = steps.join(tail.select("task_id").distinct().withColumn("_touched", F.lit(True)), "task_id", "left")
    kept = flagged.filter(F.col("_touched").isNull() | ~final).drop("_touched").join(tail, ["task_id", "name"], "left_anti").select(steps.columns)
    types = {f.name: f.dataType for f in steps.schema.fields}
    fresh = {"status": F.lit("pending"), "attempt": F.lit(0)}
    new = tail.distinct().select(*(F.col(c) if c in ("task_id", "name") else fresh.get(c, F.lit(None)).cast(types[c]).alias(c) for c in steps.columns))
    return kept.unionByName(new)


def batch_notes(sizes: Column, budget: int) -> Column:
    """The batch of each note, in order: a note that would exceed the budget opens a new batch, whatever its own size."""
    start = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("empty"))

    def step(a: Column, s: Column) -> tuple[Column, Column, Column]:
        opens = ~a["empty"] & (a["n"] + s > budget)
        k = F.when(opens, a["k"] + 1).otherwise(a["k"])
        new = F.struct(k.alias("k"), F.when(opens, s.cast("long")).otherwise(a["n"] + s).alias("n"), F.lit(False).alias("empty"))
        return new, F.lit(True), k

    return tx.fold(sizes, start, step, "int")


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def pack_until_fits(notes: DataFrame, budget: int, batch: int, shorten: Callable[[Column], Column], size: Callable[[Column], Column] = tx.estimate_tokens) -> DataFrame:
    """Notes (id, pos, text, fits) of each id, batched and shortened until they fit the budget together or are one note.

    ``shorten`` is the model: a batch's text to a shorter one. One pass over all ids at a time; those that fit are
    left alone. An id whose last pass left neither fewer notes nor fewer tokens can't get shorter and stays as it is;
    ``fits`` tells which ids ended within the budget. So the passes end by themselves, however many they are.
    """
    order, own = Window.partitionBy("id").orderBy("pos"), Window.partitionBy("id")
    never = F.lit(None).cast("long")
    now, first = notes.select("id", "pos", "text", never.alias("_was_n"), never.alias("_was_k")), True
    while True:
        total = now.withColumn("_n", size(F.col("text"))).withColumns({"_t": F.sum("_n").over(own), "_k": F.count("*").over(own)})
        shorter = F.col("_was_k").isNull() | (F.col("_k") < F.col("_was_k")) | (F.col("_t") < F.col("_was_n"))
        over = (F.col("_t") > budget) & shorter & (F.lit(first) | (F.col("_k") > 1))
        total = _cut(total.withColumn("_over", F.coalesce(over, F.lit(False))))
        if total.filter("_over").isEmpty():
            return total.select("id", "pos", "text", (F.col("_t") <= budget).alias("fits"))
        rest = total.filter("not _over").select(now.columns)
        many = total.filter("_over").withColumn("_i", F.row_number().over(order) - 1)
        arrays = many.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_i", "_n", "text"))).alias("_all"), F.max("_t").cast("long").alias("_was_n"), F.max("_k").alias("_was_k"))
        arrays = arrays.withColumn("_of", batch_notes(F.transform("_all", lambda x: x["_n"]), batch))
        flat = arrays.select("id", "_was_n", "_was_k", F.explode(F.arrays_zip("_all", "_of")).alias("x")).select("id", "_was_n", "_was_k", F.col("x._of").cast("long").alias("pos"), "x._all.*")
        packed = flat.groupBy("id", "pos", "_was_n", "_was_k").agg(sq.ordered_texts("text", "_i", sep="\n\n").alias("text"))
        now, first = rest.unionByName(packed.withColumn("text", shorten(F.col("text"))).select(now.columns)), False


def preview_spans(turns: DataFrame, by: str, seconds: float, n: int, least: float) -> DataFrame:
    """Up to n clips of each speaker: the middles of the longest turns; too few, then free tiles of the longest one."""
    length = F.col("end") - F.col("start")
    own = Window.partitionBy(by, "speaker")
    ranked = turns.filter(length >= least).withColumn("_r", F.row_number().over(own.orderBy(F.desc(length), "seg_pos")))
    top = ranked.filter(F.col("_r") <= n)
    clip = F.least(F.lit(seconds), length)
    mid = F.round(F.col("start") + (length - clip) / 2, 3)
    placed = top.select(by, "speaker", (F.col("_r") - 1).alias("k"), mid.alias("clip_start"), F.round(F.col("start") + (length - clip) / 2 + clip, 3).alias("clip_end"))
    held = placed.groupBy(by, "speaker").agg(F.collect_list(F.struct("clip_start", "clip_end")).alias("_held"), F.count("*").alias("_n"))
    tiles = F.sequence(F.lit(0), F.floor(length / seconds).cast("int") - 1)
    longest = top.filter((F.col("_r") == 1) & (length >= seconds)).join(held, [by, "speaker"]).filter(F.col("_n") < n)
    tile = longest.select(by, "speaker", "start", "_held", "_n", F.explode(tiles).alias("_t"))
    tile = tile.withColumns({"clip_start": F.round(F.col("start") + F.col("_t") * seconds, 3), "clip_end": F.round(F.col("start") + (F.col("_t") + 1) * seconds, 3)})
    free = tile.filter(~F.exists("_held", lambda h: (F.col("clip_start") < h["clip_end"]) & (h["clip_start"] < F.col("clip_end"))))
    free = free.withColumn("k", F.col("_n") + F.row_number().over(own.orderBy("_t")) - 1).filter(F.col("k") < n)
    return placed.select(by, "speaker", F.col("k").cast("int").alias("k"), "clip_start", "clip_end").unionByName(free.select(by, "speaker", F.col("k").cast("int").alias("k"), "clip_start", "clip_end"))


def valid_refs(refs: DataFrame, prompts: DataFrame) -> DataFrame:
    """References (task_id, pos, source, id): the system's, and a user's whose prompt exists."""
    known = prompts.select(F.lit("user").alias("source"), F.col("prompt_id").cast("string").alias("id")).distinct()
    return refs.filter("source = 'system'").unionByName(refs.filter("source = 'user'").join(known, ["source", "id"], "left_semi").select(refs.columns))


def delivery_refs(delivery: Column) -> Column:
    """Entries (deliver_to, variant) with a target; all else in an entry, or an empty variant, is dropped."""
    good = F.filter(delivery, lambda d: d["deliver_to"].isNotNull() & (d["deliver_to"] != ""))
    return F.coalesce(F.transform(good, lambda d: F.struct(d["deliver_to"].alias("deliver_to"), F.nullif(d["variant"], F.lit("")).alias("variant"))), F.expr("cast(array() as array<struct<deliver_to:string,variant:string>>)"))


def prompt_refs(prompts: Column, valid: Column) -> Column:
    """References (source, id) of a preset: the system's, and a user's whose id is in the array ``valid``; others go."""
    known = F.coalesce(valid, F.expr("cast(array() as array<string>)"))
    good = F.filter(prompts, lambda r: (r["source"] == "system") | ((r["source"] == "user") & F.array_contains(known, r["id"])))
    return F.coalesce(F.transform(good, lambda r: F.struct(r["source"].alias("source"), r["id"].alias("id"))), F.expr("cast(array() as array<struct<source:string,id:string>>)"))


def expand_options(options: Column, valid: Column) -> Column:
    """A preset's options, an allow-list with defaults; ``options`` is a struct of them, null where absent.

    ``valid`` are the ids of the user's prompts, as strings.
    """
    flag = lambda c, d: F.coalesce(options[c], F.lit(d)).alias(c)
    return F.struct(
        options["language"].alias("language"), flag("audio_only", False), flag("transcript", True), flag("diarize", False),
        prompt_refs(options["prompts"], valid).alias("prompts"), delivery_refs(options["delivery"]).alias("delivery"),
    )


def resolve_preset(refs: DataFrame, system: DataFrame, own: DataFrame) -> DataFrame:
    """References (source, id) with the options of the preset: a system's by key, a user's by id, else null."""
    presets = system.select(F.lit("system").alias("source"), F.col("key").alias("id"), "options").unionByName(own.select(F.lit("user").alias("source"), F.col("preset_id").cast("string").alias("id"), "options"))
    return refs.join(presets, ["source", "id"], "left")


def _stated(value: Column) -> Column:
    """A variant value as text; null where it is missing or says nothing: null, false, 0, an empty text, list or object."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    says = F.when(kind.isin("VOID"), False).when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").when(kind.rlike("^(OBJECT|ARRAY)"), ~text.isin("{}", "[]")).otherwise(number != 0)
    return F.when(F.coalesce(says, F.lit(False)), text)


def parse_delivery(raw: Column) -> Column:
    """(entries, error) of a delivery list in JSON: anything but a list of objects with a target and a known variant is an error.

    The first wrong entry tells the error. A target of 0, false, null, or an empty text, list or object is none. JSON
    that has a key twice counts as broken. Null and the empty text are an empty list.
    """
    whole = F.try_parse_json(raw)

    def judged(x: Column) -> Column:
        to, variant = (_stated(F.try_variant_get(x, f"$.{c}", "variant")) for c in ("deliver_to", "variant"))
        odd = variant.isNotNull() & ~variant.isin("raw", "redacted", "summary") & tx.parse_ref(variant).isNull()
        is_object = F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))
        return F.struct(to.alias("deliver_to"), variant.alias("variant"), F.when(~is_object, "not an object").when(to.isNull(), "no target").when(odd, "unknown variant").alias("error"))

    def result(entries: Column) -> Column:
        wrong = F.get(F.filter(entries, lambda e: e["error"].isNotNull()), F.lit(0))["error"]
        good = F.transform(entries, lambda e: F.struct(e["deliver_to"].alias("deliver_to"), e["variant"].alias("variant")))
        return F.struct(F.when(wrong.isNull(), good).otherwise(F.slice(good, 1, 0)).alias("entries"), wrong.alias("error"))

    none = F.expr("cast(array() as array<struct<deliver_to:string,variant:string>>)")
    failed = lambda why: F.struct(none.alias("entries"), F.lit(why).cast("string").alias("error"))
    is_list = F.coalesce(F.schema_of_variant(whole).startswith("ARRAY"), F.lit(False))
    listed = tx.let(F.transform(F.try_variant_get(whole, "$", "array<variant>"), judged), result)
    return F.when(F.coalesce(raw, F.lit("")) == "", failed(None)).when(whole.isNull(), failed("not JSON")).when(~is_list, failed("not a list")).otherwise(listed)


def parse_prompts(raw: Column) -> Column:
    """(refs, error) of a list of "source:id" in JSON; no list at all means the system's summary."""
    rows = F.from_json(raw, "array<string>")
    refs = F.transform(rows, tx.parse_ref)
    summary = F.array(F.struct(F.lit("system").alias("source"), F.lit("summary").alias("id")))
    error = F.when(raw.isNull(), F.lit(None)).when(F.try_parse_json(raw).isNull(), "not JSON").when(F.substring(F.ltrim(raw), 1, 1) != "[", "not a list").when(F.exists(refs, lambda r: r.isNull()), "invalid reference")
    return F.struct(F.when(raw.isNull(), summary).when(error.isNull(), refs).alias("refs"), error.alias("error"))


def accepted_trim(input_seconds: Column, output_seconds: Column, most: float) -> Column:
    """Seconds of silence cut at the start; 0 if all would go or more than ``most`` (then the original stays)."""
    cut = F.greatest(F.lit(0.0), input_seconds - output_seconds)
    return F.when((output_seconds <= 0) | (cut > most), 0.0).otherwise(cut)


def voice_vectors(labels: Column, vectors: Column) -> Column:
    """Label to vector, by position; labels beyond the vectors, and null vectors, are left out."""
    pairs = F.arrays_zip(labels.alias("l"), F.slice(vectors, 1, F.greatest(F.lit(0), F.size(labels))).alias("v"))
    return F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["l"].isNotNull() & p["v"].isNotNull()), lambda p: F.struct(p["l"], p["v"])))


def replace_manifest(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Segments after loading manifests (task_id, segment_index, start, end): old rows of those tasks go, empty ones come."""
    types = {f.name: f.dataType for f in segments.schema.fields}
    new = spans.select(*(F.col(c) if c in spans.columns else F.lit(None).cast(types[c]).alias(c) for c in segments.columns))
    return segments.join(spans.select("task_id").distinct(), "task_id", "left_anti").unionByName(new)


def resolve_voices(actions: DataFrame, speakers: DataFrame, prior: DataFrame, clips: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(decisions, new speakers, doomed samples, new samples) of a dialog's answers; a task with any error gives none of them.

    ``actions``: task_id, user_id, label, action, new_name, speaker_id, voice_sample_id, distance, is_noise, add_fragment. ``prior``:
    the last decision's sample of each (task_id, label). A sample that an earlier save added goes unless this one
    refers to it. New speakers are known by their task and label; so are new samples, and a decision whose label has one
    refers to it (``adds_sample``) instead of the given sample. A label's new sample is its first clip (``clips``: task_id, label, pos,
    path, start, end, embedding; a null embedding: the file is missing) under the task's model (``models``: task_id,
    embedding_model); a task without a model, or a label without such a clip, is an error. Anonymous labels add none.
    """
    named = F.coalesce(tx.strip(F.col("new_name")), F.lit("")) != ""
    alive = actions.join(speakers.select("user_id", "speaker_id", F.lit(True).alias("_alive")), ["user_id", "speaker_id"], "left")
    first = clips.groupBy("task_id", "label").agg(F.min_by(F.struct("path", "start", "end", "embedding"), "pos").alias("_clip"))
    alive = alive.join(models.select("task_id", "embedding_model"), "task_id", "left").join(first, ["task_id", "label"], "left")
    binds = F.col("action").isin("bind_existing", "accept_auto")
    adds = F.coalesce("add_fragment", F.lit(False)) & (binds | (F.col("action") == "bind_new"))
    error = (
        F.when(~F.col("action").isin("bind_new", "bind_existing", "accept_auto", "leave_anonymous"), "unknown action")
        .when((F.col("action") == "bind_new") & ~named, "no name")
        .when(binds & F.col("speaker_id").isNull(), "no speaker")
        .when(binds & F.col("_alive").isNull(), "speaker not found")
        .when(adds & (F.coalesce("embedding_model", F.lit("")) == ""), "no embedding model")
        .when(adds & F.col("_clip").isNull(), "no fragment")
        .when(adds & F.col("_clip.embedding").isNull(), "fragment missing")
    )
    judged = alive.withColumns({"_adds": adds, "_error": error}).withColumn("_bad", F.max(F.col("_error").isNotNull().cast("int")).over(Window.partitionBy("task_id")))
    good = judged.filter("_bad = 0")
    bound = F.when(binds, F.col("speaker_id"))
    sample = F.when(~F.col("_adds"), F.col("voice_sample_id"))
    decisions = good.select("task_id", "label", bound.alias("speaker_id"), (F.col("action") == "bind_new").alias("is_new"), sample.alias("voice_sample_id"), F.col("_adds").alias("adds_sample"), "distance", "is_noise")
    created = good.filter("action = 'bind_new'").select("task_id", "label", "user_id", tx.strip(F.col("new_name")).alias("name"))
    doomed = good.join(prior.withColumnRenamed("voice_sample_id", "_prior"), ["task_id", "label"]).filter("_prior is not null and not (_prior <=> voice_sample_id)")
    samples = good.filter("_adds").select("task_id", "label", bound.alias("speaker_id"), "_clip.path", (F.col("_clip.end") - F.col("_clip.start")).alias("duration_sec"), "_clip.embedding", "embedding_model", F.col("task_id").alias("source_task_id"))
    return decisions, created, doomed.select("task_id", "label", F.col("_prior").alias("voice_sample_id")), samples


MEASURES = ["processing_seconds", "transcript_chars", "summary_chars", "redacted_chars", "media_seconds", "media_bytes", "speaker_count"]


def text_chars(raw: Column, is_json: Column) -> Column:
    """Length of a stripped text; of a JSON object its ``text`` member, if that is a text; null for anything else."""
    whole = F.when(is_json, F.try_parse_json(raw))
    member = F.try_variant_get(whole, "$.text", "variant")
    inner = F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(member, "$", "string"))
    return F.length(tx.strip(F.when(is_json, inner).otherwise(raw)))


def counted_speakers(matches: Column) -> Column:
    """How many labels of a match file are people: objects not flagged as noise. Null if it isn't a JSON object."""
    whole = F.try_parse_json(matches)
    own = F.map_values(F.try_variant_get(whole, "$", "map<string,variant>"))
    noise = lambda x: F.coalesce(_stated(F.try_variant_get(x, "$.noise", "variant")).isNotNull(), F.lit(False))
    people = F.filter(own, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)) & ~noise(x))
    return F.when(F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False)), F.size(people))


def task_measures(tasks: DataFrame, steps: DataFrame, texts: DataFrame, media: DataFrame, matches: DataFrame) -> DataFrame:
    """(task_id, the seven measures of a task's row): null where the artifact is missing or unreadable.

    ``texts``: task_id, kind (transcript, summary, redacted), path, text; a transcript in a .json file counts its text member.
    ``media``: task_id, size, seconds (whole ones count, none below 0); ``matches``: task_id, raw JSON. One artifact a task and kind.
    """
    is_json = (F.col("kind") == "transcript") & F.lower("path").endswith(".json")
    own = texts.select("task_id", "kind", text_chars(F.col("text"), F.coalesce(is_json, F.lit(False))).alias("n"))
    chars = own.groupBy("task_id").agg(*(F.max(F.when(F.col("kind") == k, F.col("n"))).alias(f"{k}_chars") for k in ("transcript", "summary", "redacted")))
    out = tasks.select("task_id").join(mt.processing_seconds(steps).withColumnRenamed("seconds", "processing_seconds"), "task_id", "left").join(chars, "task_id", "left")
    seconds = F.when(F.col("seconds").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("seconds").cast("long")))
    out = out.join(media.select("task_id", seconds.alias("media_seconds"), F.col("size").alias("media_bytes")), "task_id", "left")
    return out.join(matches.select("task_id", counted_speakers(F.col("raw")).alias("speaker_count")), "task_id", "left").select("task_id", *MEASURES)


def finalize(tasks: DataFrame, refs: DataFrame, prompts: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """(task_id, ref, result): each selected prompt, filled with the task's text, through the model; unknown prompts fail."""
    asked = tasks.join(refs, "task_id").join(prompts, "ref", "left")
    filled = tx.render_template(F.col("template"), text=F.col("text"))
    return asked.select("task_id", "ref", F.when(F.col("template").isNotNull(), model(filled)).alias("result"), F.when(F.col("template").isNull(), "failed").otherwise("completed").alias("status"))


def window_report(durations: DataFrame, windowed: str = "summarize_windows") -> DataFrame:
    """Median seconds of each step over all users; for windowed steps those per window times the median number of windows."""
    ok = durations.filter((F.col("name") != windowed) | (F.col("window_total") >= 1))
    per = F.when(F.col("name") == windowed, F.col("duration_sec") / F.col("window_total")).otherwise(F.col("duration_sec"))
    steps = ok.groupBy("name").agg(F.percentile(per, F.lit(0.5)).alias("_w"), F.count("*").alias("n"))
    typical = durations.filter("window_total >= 1").agg(F.floor(F.percentile("window_total", F.lit(0.5))).alias("_t"))
    both = steps.join(F.broadcast(typical))  # one row
    return both.select("name", F.round(F.when(F.col("name") == windowed, F.col("_w") * F.col("_t")).otherwise(F.col("_w")), 1).alias("seconds"), "n")


def live_totals(events: DataFrame) -> DataFrame:
    """Running totals of metric events by task and stage; a batch table or a stream (in update or complete mode)."""
    return events.groupBy("task_id", "stage").agg(F.count("*").alias("n"), F.sum("t_wall_ms").alias("wall_ms"), F.max("t_wall_ms").alias("longest_ms"))
