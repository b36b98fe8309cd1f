"""Projections and lookups of the query surface: children, options, results, notes, orders, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import text as tx

DAG = "download extract_audio trim_initial_silence segment_audio detect_language transcribe_segments diarize match_speakers merge_transcript prepare_summary_chunks summarize_windows pack_window_notes final_summary".split()


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, name: str = "children") -> DataFrame:
    """Parents with their children as an ordered array; without any, an empty one."""
    rest = [c for c in children.columns if c not in (key, order)]
    own = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))
    return parents.join(own, key, "left").withColumn(name, F.coalesce(name, F.expr("array()")))


def prompt_refs(refs: Column, legacy: Column) -> Column:
    """The valid "source:id" references of a list; without a list the legacy flag stands for the system prompt."""
    good = F.filter(F.transform(refs, tx.parse_ref), lambda r: r.isNotNull())
    system = F.array(F.struct(F.lit("system").alias("source"), F.lit("system").alias("id")))
    return F.when(refs.isNotNull(), good).when(legacy, system).otherwise(F.slice(system, 1, 0))


def delivery_targets(specs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per entry of a task's delivery list whose target id is a number and exists."""
    flat = specs.select("task_id", F.explode("delivery").alias("d")).select("task_id", F.expr("try_cast(d.target AS bigint)").alias("target_id"), "d.variant")
    return flat.filter("target_id is not null").join(targets, "target_id")


def step_lists(tasks: DataFrame) -> DataFrame:
    """(task_id, steps): a task's steps in order: diarization steps by their flag, summary steps by theirs, one final step per prompt."""
    base = F.array(*[F.lit(s) for s in DAG[:-1]])
    voices, summaries = ["diarize", "match_speakers"], ["prepare_summary_chunks", "summarize_windows", "pack_window_notes"]
    kept = F.filter(base, lambda s: (~s.isin(voices) | F.col("diarize")) & (~s.isin(summaries) | F.col("summarize")))
    tail = F.when(F.col("summarize"), F.transform("prompts", lambda p: F.concat(F.lit("finalize:"), p))).otherwise(F.expr("cast(array() as array<string>)"))
    return tasks.select("task_id", F.concat(kept, tail).alias("steps"))


def enabled_steps(tasks: DataFrame) -> DataFrame:
    """The steps of ``step_lists``, one a row; what is asked of each task needs no grouping of these rows, but its list."""
    return step_lists(tasks).select("task_id", F.posexplode("steps").alias("ord", "name"))


def can_restart_summary(status: Column, steps: Column) -> Column:
    """A finished task may summarise again if its transcript was merged."""
    return status.isin("completed", "failed", "canceled") & F.exists(steps, lambda s: (s["name"] == "merge_transcript") & (s["status"] == "completed"))


def normalize_turns(raw: DataFrame) -> DataFrame:
    """Turns whose times are numbers in order and whose speaker isn't blank; the rest is dropped."""
    out = raw.withColumns({"start": F.expr("try_cast(start AS double)"), "end": F.expr("try_cast(`end` AS double)"), "speaker": F.nullif(tx.strip(F.col("speaker")), F.lit(""))})
    return out.filter("start is not null and `end` is not null and `end` >= start and speaker is not null")


def soft_revoke(tokens: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Stamp tokens as revoked; a second time changes nothing."""
    hit = tokens.join(ids.select("token_id", F.lit(True).alias("_hit")).distinct(), "token_id", "left")
    return hit.withColumn("revoked_at", F.when(F.col("_hit") & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at"))).drop("_hit")


def refresh_untouched(prompts: DataFrame, shipped: Column) -> DataFrame:
    """Vendor prompts that nobody edited get the shipped text; ``refreshed`` tells which."""
    untouched = F.col("is_system") & F.col("updated_at").isNull()
    return prompts.withColumn("refreshed", untouched & (F.col("body") != shipped)).withColumn("body", F.when(untouched, shipped).otherwise(F.col("body")))


def prompt_overrides(files: DataFrame, defaults: DataFrame) -> DataFrame:
    """Each shipped default as missing, identical or overridden."""
    both = defaults.withColumnRenamed("body", "_d").join(files.withColumnRenamed("body", "_f"), "name", "left")
    return both.select("name", F.when(F.col("_f").isNull(), "missing").when(F.col("_f") == F.col("_d"), "identical").otherwise("overridden").alias("state"))


def downgrade_results(results: Column) -> Column:
    """Completed results as pending."""
    return F.transform(results, lambda r: F.struct(r["key"].alias("key"), F.when(r["status"] == "completed", "pending").otherwise(r["status"]).alias("status")))


def result_for(results: Column, ref: Column, legacy: Column) -> Column:
    """The result of a reference, or the legacy summary for the system prompt."""
    return F.coalesce(F.get(F.filter(results, lambda r: r["key"] == ref), F.lit(0))["path"], F.when(ref == "system:system", legacy))


def delete_with_default(table: DataFrame, owners: DataFrame, doomed: DataFrame, key: str, pointer: str) -> tuple[DataFrame, DataFrame]:
    """Delete rows and clear the owners' pointers to them."""
    gone = doomed.select(key).distinct()
    cleared = owners.join(gone.select(F.col(key).alias(pointer), F.lit(True).alias("_gone")), pointer, "left")
    cleared = cleared.withColumn(pointer, F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(pointer))).select(owners.columns)
    return table.join(gone, key, "left_anti"), cleared


def cut_long_units(units: DataFrame, budget: int) -> DataFrame:
    """Units of more than ``budget`` tokens in pieces; a leading "label: " is repeated and its tokens are paid for."""
    label = F.regexp_extract("text", r"(?U)^([^\n:]{1,64}: )", 1)
    body = F.split(F.substring("text", F.length("label") + 1, F.length("text")), " ")
    room = F.greatest(F.lit(1), F.lit(budget) - F.when(F.col("label") == "", 0).otherwise(F.size(F.split(F.trim("label"), " "))))
    out = units.withColumn("label", label).withColumn("_b", body).withColumn("_n", room)
    out = out.withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("_b") / F.col("_n")).cast("int") - 1))))
    return out.select("id", F.col("_k").alias("piece"), F.concat("label", F.array_join(F.slice("_b", F.col("_k") * F.col("_n") + 1, F.col("_n")), " ")).alias("text"))


def note_text(raw: Column) -> Column:
    """The text of a note that is plain, {"text": ...} or the older {"summary": ...}."""
    return F.coalesce(F.get_json_object(raw, "$.text"), F.get_json_object(raw, "$.summary"), raw)


def set_kinds(files: DataFrame, by: str, name: str, video: list[str], audio: list[str]) -> DataFrame:
    """Kind of each upload set; mixed or unsupported sets are errors."""
    kind = tx.suffix_kind(F.col(name), video, audio)
    out = files.groupBy(by).agg(F.array_sort(F.collect_set(kind)).alias("_k"))
    return out.select(by, F.when(F.size("_k") > 1, F.lit("error: mixed")).when(F.get("_k", F.lit(0)) == "unsupported", F.lit("error: unsupported")).otherwise(F.get("_k", F.lit(0))).alias("kind"))


def probe_mismatches(probes: DataFrame, by: str, order: str, fields: list[str]) -> DataFrame:
    """Parts of a set whose signature differs from the first part's."""
    first = probes.groupBy(by).agg(F.min_by(F.struct(*fields), order).alias("_first"))
    return probes.join(first, by).filter(~F.struct(*fields).eqNullSafe(F.col("_first"))).drop("_first")


def parse_time(c: Column) -> Column:
    """A time with or without zone (then UTC); null if it is none."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(F.regexp_replace(c, "Z$", "")))


def upload_order(parts: DataFrame, by: str) -> DataFrame:
    """Parts in order by creation time if all have one and no two agree, else by modification time likewise, else by name."""
    whole = parts.groupBy(by).agg(
        (F.count("*") == F.count_distinct("creation_time")).alias("_c"),
        (F.count("*") == F.count_distinct("last_modified")).alias("_m"),
    )
    keyed = parts.join(whole, by).withColumn("rule", F.when(F.col("_c"), "creation_time").when(F.col("_m"), "last_modified").otherwise("filename"))
    order = [F.when(F.col("rule") == "creation_time", F.col("creation_time")), F.when(F.col("rule") == "last_modified", F.col("last_modified")), tx.natural_key(F.col("filename")), F.col("filename")]
    return keyed.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).drop("_c", "_m")


def inner_sentences(chunks: DataFrame) -> DataFrame:
    """Timed sentences inside raw chunks, moved by their chunk's start; blank and untimed ones are dropped."""
    flat = chunks.select("task_id", "segment_index", F.col("start").alias("_s"), F.posexplode("raw_json.segments").alias("_i", "x"))
    flat = flat.filter("x.start is not null and x.end is not null").withColumn("text", tx.strip(F.col("x.text"))).filter("text <> ''")
    return flat.select("task_id", "segment_index", "_i", (F.col("x.start") + F.col("_s")).alias("start"), (F.col("x.end") + F.col("_s")).alias("end"), "text")


def summary_progress(enabled: Column, current: Column, total: Column) -> Column:
    zero = F.lit(0)
    good = enabled & current.isNotNull() & total.isNotNull()
    return F.struct(F.when(good, F.greatest(zero, current)).otherwise(zero).alias("current"), F.when(good, F.greatest(zero, total)).otherwise(zero).alias("total"))


def stage_progress(steps: DataFrame, by: str = "task_id", order: str = "ord") -> DataFrame:
    """The first running step of each task."""
    return steps.filter("status = 'running'").groupBy(by).agg(F.min_by("name", order).alias("stage"))


def first_appearance(sources: list[DataFrame], by: str = "task_id") -> DataFrame:
    """Speakers in order of appearance, from the first source that has any for a recording."""
    both = None
    for rank, s in enumerate(sources):
        s = s.filter("speaker is not null").groupBy(by, "speaker").agg(F.min("pos").alias("pos")).withColumn("_rank", F.lit(rank))
        both = s if both is None else both.unionByName(s)
    best = both.groupBy(by).agg(F.min("_rank").alias("_rank"))
    return both.join(best, [by, "_rank"]).withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("pos", "speaker")).cast("long")).select(by, "speaker", "position")


def model_variants(name: Column) -> Column:
    """Distinct spellings of a model's name, in order: as given, without tag, without path, lower-cased."""
    bare = F.regexp_replace(name, ":[^:/]*$", "")
    last = F.element_at(F.split(bare, "/"), -1)
    return F.array_distinct(F.array(name, bare, last, F.lower(last)))


def detected_probability(payload: Column, language: Column) -> Column:
    """A detector's probability under any of its keys, or from its map of languages."""
    keys = [F.get_json_object(payload, f"$.{k}").cast("double") for k in ("probability", "language_probability", "confidence")]
    every = F.from_json(F.get_json_object(payload, "$.probabilities"), "map<string,double>")
    return F.coalesce(*keys, F.try_element_at(every, language))


def length_stats(c: Column) -> Column:
    return F.length(tx.strip(c))
