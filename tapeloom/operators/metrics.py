"""Aggregates of metric events, step weights and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.numbers import round_even

SUMMARIES = ["summarize.segment", "summarize.global"]


def percentile_or_zero(value: Column, p: float) -> Column:
    """Linear interpolation; 0.0 of nothing."""
    return F.coalesce(F.percentile(value, F.lit(p / 100)), F.lit(0.0))


def percentile_or_null(value: Column, p: float, digits: int = 4) -> Column:
    return round_even(F.percentile(value, F.lit(p / 100)), digits)


def worst(events: DataFrame, by: list[str], key: str, n: int = 3, order: str = "event_pos") -> DataFrame:
    """The n rows of greatest key in each group; null keys don't count; ties keep their order."""
    rank = Window.partitionBy(*by).orderBy(F.desc(key), order)
    return events.filter(F.col(key).isNotNull()).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n)


RATES = ["rtf", "llm_tok_per_s", "compression_ratio", "redundancy_dup_sentence_ratio"]
WORST = {"worst3_number_mismatch": "number_mismatch_count", "worst3_redundancy": "redundancy_dup_sentence_ratio"}


def rollup(events: DataFrame, n: int = 3) -> DataFrame:
    """One row per task: wall time per stage, percentiles of rates, and the n worst segments two ways.

    An event becomes facets: its stage's wall time and each rate that counts at its stage. One grouping by task and
    facet, with partial sums and percentiles, reduces them; the worst segments are kept by a window that holds n rows a
    task and list already before its shuffle. Only these few rows are dealt by task, so a task with most of the events
    is spread over its facets and nothing is joined. A measure without a value is null.
    """
    asr, summary = F.col("stage") == "transcribe.segment", F.col("stage").isin(SUMMARIES)
    wall = F.when(F.col("stage") != "task.final", F.col("t_wall_ms").cast("long"))
    none, some = F.lit(None).cast("double"), lambda c: F.col(c).cast("double")
    facets = [F.struct(F.lit("wall").alias("facet"), F.col("stage").alias("of"), wall.alias("ms"), none.alias("value"))]
    for name in RATES:
        counts = (asr if name == "rtf" else summary) & F.col(name).isNotNull()
        facets.append(F.when(counts, F.struct(F.lit("rate").alias("facet"), F.lit(name).alias("of"), F.lit(None).cast("long").alias("ms"), some(name).alias("value"))))
    flat = events.select("task_id", F.inline(F.array_compact(F.array(*facets))))
    sums = flat.groupBy("task_id", "facet", "of").agg(F.sum("ms").alias("ms"), F.percentile("value", F.array(F.lit(0.5), F.lit(0.95))).alias("p"))
    keys = [F.when(F.col(key).isNotNull(), F.struct(F.lit(name).alias("of"), some(key).alias("key"))) for name, key in WORST.items()]
    ranked = events.filter(summary).select("task_id", "segment_id", "event_pos", F.inline(F.array_compact(F.array(*keys))))
    rank = F.row_number().over(Window.partitionBy("task_id", "of").orderBy(F.desc("key"), "event_pos"))
    tops = ranked.withColumn("rank", rank).filter(F.col("rank") <= n)
    segment = events.schema["segment_id"].dataType
    rows = sums.select("task_id", "facet", "of", "ms", "p", F.lit(None).cast("int").alias("rank"), F.lit(None).cast(segment).alias("segment_id"))
    rows = rows.unionByName(tops.select("task_id", F.lit("top").alias("facet"), "of", F.lit(None).cast("long").alias("ms"), F.lit(None).cast("array<double>").alias("p"), "rank", "segment_id"))

    def rate(name: str, i: int) -> Column:
        return round_even(F.max(F.when((F.col("facet") == "rate") & (F.col("of") == name), F.get("p", F.lit(i)))), 4)

    def listed(kind: Column, item: Column) -> Column:
        every = F.array_sort(F.collect_list(F.when(kind, item)))
        return F.when(F.size(every) > 0, every)

    measures = [rate(name, i).alias(f"p{p}_{name}") for name in RATES for i, p in enumerate((50, 95))]
    walls = listed((F.col("facet") == "wall") & F.col("ms").isNotNull() & F.col("of").isNotNull(), F.struct("of", "ms"))
    worsts = [F.transform(listed((F.col("facet") == "top") & (F.col("of") == name), F.struct("rank", "segment_id")), lambda x: x["segment_id"]).alias(name) for name in WORST]
    return rows.groupBy("task_id").agg(*measures, F.map_from_entries(walls).alias("total_wall_ms_by_stage"), *worsts)


def wall_by_stage(events: DataFrame) -> DataFrame:
    return events.filter(F.col("stage") != "task.final").groupBy("task_id", "stage").agg(F.sum(F.col("t_wall_ms").cast("long")).alias("wall_ms"))


def user_durations(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """The durations of ``step_durations`` with their task's user; steps of unknown tasks don't count."""
    return step_durations(steps).join(tasks.select("task_id", "user_id"), "task_id")


def step_durations(steps: DataFrame) -> DataFrame:
    """Seconds of completed steps with both times and no negative length; a window total under 1 is null."""
    sec = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    ok = (F.col("status") == "completed") & F.col("started_at").isNotNull() & F.col("finished_at").isNotNull()
    out = steps.filter(ok).withColumn("duration_sec", sec).filter("duration_sec >= 0")
    return out.withColumn("window_total", F.when(F.col("window_total") >= 1, F.col("window_total")))


def _normalised(durations: DataFrame, offset: int) -> DataFrame:
    """Seconds per window for windowed steps; rows whose divisor is under 1 are left out."""
    windows = F.col("window_total") - offset
    sec = F.when(F.col("name") != "summarize_windows", F.col("duration_sec")).when(windows >= 1, F.col("duration_sec") / windows)
    return durations.withColumn("seconds", sec).filter("seconds is not null")


def step_weights(durations: DataFrame, offset: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Median seconds and number of samples of each step, for all or per ``by``."""
    return _normalised(durations, offset).groupBy(*by, "name").agg(round_even(F.median("seconds"), 1).alias("weight"), F.count("*").alias("samples"))


def merge_with_seed(weights: DataFrame, seed: DataFrame, least: int) -> DataFrame:
    """Seed steps only: the computed weight if it has enough samples, else the seed."""
    both = seed.join(weights, "name", "left")
    return both.select("name", F.when(F.col("samples") >= least, F.col("weight")).otherwise(F.col("seed")).alias("weight"))


def final_fallback(seconds: DataFrame, least: int, seed: float) -> DataFrame:
    return seconds.agg(F.when(F.count("duration_sec") >= least, F.median("duration_sec")).otherwise(F.lit(seed)).alias("fallback"))


def processing_seconds(steps: DataFrame) -> DataFrame:
    """Whole seconds of each task's steps; idle gaps and negative lengths don't count; null without any."""
    sec = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return steps.groupBy("task_id").agg(F.sum(F.when(sec >= 0, sec)).cast("long").alias("seconds"))


def overall_progress(steps: DataFrame, weights: DataFrame) -> DataFrame:
    """Done weight over enabled weight; a running step counts by its fraction, at least 0.05 if that is unknown."""
    w = F.coalesce("weight", F.lit(1.0))
    part = F.when(F.col("status") == "completed", 1.0).when(F.col("status") == "running", F.coalesce("fraction", F.lit(0.05))).otherwise(0.0)
    both = steps.filter("enabled").join(weights, "name", "left")
    share = F.try_divide(F.sum(w * part), F.sum(w))
    return both.groupBy("task_id").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(share, F.lit(0.0)))).alias("progress"))


def part_offsets(parts: DataFrame, by: str, order: str, seconds: str) -> DataFrame:
    """Where each part of a concatenation begins: the seconds of the parts before it."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.bround(F.coalesce(F.sum(seconds).over(before), F.lit(0.0)), 3))


def token_ratios(tokens: DataFrame) -> DataFrame:
    """Per id: tokens, distinct tokens, share of distinct ones, and share of the most frequent one; pre-aggregated by token."""
    each = tokens.groupBy("id", "token").agg(F.count("*").alias("n"))
    total = F.sum("n")
    return each.groupBy("id").agg(total.alias("tokens"), F.count("*").alias("distinct"), F.bround(F.count("*") / total, 4).alias("unique_ratio"), F.bround(F.max("n") / total, 4).alias("top_ratio"))
