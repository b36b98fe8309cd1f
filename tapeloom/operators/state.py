"""State tables as pure rewrites, DataFrame in and out: inserts, upserts, guarded transitions, deliveries, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.numbers import backoff_seconds


def one_per_key(rows: DataFrame, keys: list[str], order: str | None = None, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``; without one, the least (or greatest) by its other columns, so a rerun picks the same."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    by = [order] if order else []
    pick = (F.max if last else F.min)(F.struct(*by, *(c for c in rest if c not in by)))
    return rows.groupBy(*keys).agg(pick.alias("_row")).select(*(F.col(c) if c in keys else F.col(f"_row.{c}") for c in rows.columns))


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Append the rows whose key the table lacks; of rows that repeat a key, the first (``one_per_key``)."""
    return table.unionByName(one_per_key(rows, keys, order).join(table.select(keys), keys, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Replace the rows whose key comes again, append the others; of new rows that repeat a key, the last (``one_per_key``)."""
    return table.join(rows.select(keys), keys, "left_anti").unionByName(one_per_key(rows, keys, order, last=True))


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(on), on, "left_anti")


def update_where(table: DataFrame, when: Column, **values: Column) -> DataFrame:
    return table.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in values.items()})


def transition(table: DataFrame, keys: DataFrame, on: str, allowed: list[str], to: str, status: str = "status") -> DataFrame:
    """Set a status for the keys whose status allows it; ``changed`` tells which rows that were."""
    hit = table.join(keys.select(on, F.lit(True).alias("_hit")).distinct(), on, "left")
    changed = F.coalesce("_hit", F.lit(False)) & F.col(status).isin(allowed)
    return hit.withColumn("changed", changed).withColumn(status, F.when(F.col("changed"), to).otherwise(F.col(status))).drop("_hit")


def step_status(steps: DataFrame, to: Column, now: Column) -> DataFrame:
    """Set a step's status: running starts an attempt, a final status ends it."""
    final = to.isin("completed", "failed", "skipped", "canceled")
    return steps.withColumns(
        {
            "started_at": F.when(to == "running", now).otherwise(F.col("started_at")),
            "attempt": F.when(to == "running", F.col("attempt") + 1).otherwise(F.col("attempt")),
            "finished_at": F.when(final, now).otherwise(F.col("finished_at")),
            "status": F.coalesce(to, F.col("status")),
        }
    )


def clone_rows(table: DataFrame, source, target, key: str = "task_id") -> DataFrame:
    """The rows of one key once more under another."""
    return table.unionByName(table.filter(F.col(key) == source).withColumn(key, F.lit(target).cast(table.schema[key].dataType)))


def merge_keys(table: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Rewrite a key by a mapping (old, new); keys without one stay, and old = new changes nothing."""
    return table.join(mapping.select(F.col("old").alias(key), "new").filter(F.col(key) != F.col("new")), key, "left").withColumn(key, F.coalesce("new", key)).drop("new").select(table.columns)


def claim_due(attempts: DataFrame, now: Column, limit: int) -> DataFrame:
    """Claim the deliveries that are due, the longest due first: they become delivering, with an attempt more."""
    due = attempts.filter(F.col("status").isin("pending", "waiting_adapter") & (F.col("next_attempt_at") <= now))
    first = due.orderBy("next_attempt_at", "attempt_id").limit(limit).select("attempt_id", F.lit(True).alias("_due"))
    out = attempts.join(first, "attempt_id", "left").withColumn("claimed", F.coalesce("_due", F.lit(False))).drop("_due")
    return out.withColumns({"attempts": F.col("attempts") + F.col("claimed").cast("int"), "status": F.when(F.col("claimed"), "delivering").otherwise(F.col("status"))})


def apply_outcomes(attempts: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """What a delivery becomes: delivered; parked without its attempt if the adapter is gone; dead at the last attempt; else pending after a pause."""
    out = attempts.join(outcomes, "attempt_id", "left")
    spent = F.col("attempts") >= F.col("max_attempts")
    status = (
        F.when(F.col("outcome") == "ok", "delivered")
        .when(F.col("outcome") == "no_adapter", "waiting_adapter")
        .when(F.col("outcome") == "error", F.when(spent, "dead").otherwise("pending"))
        .otherwise(F.col("status"))
    )
    later = F.timestamp_micros(F.unix_micros(now) + (backoff_seconds(F.col("attempts")) * 1e6).cast("long"))
    return out.withColumns(
        {
            "next_attempt_at": F.when((F.col("outcome") == "error") & ~spent | (F.col("outcome") == "no_adapter"), later).otherwise(F.col("next_attempt_at")),
            "attempts": F.when(F.col("outcome") == "no_adapter", F.greatest(F.lit(0), F.col("attempts") - 1)).otherwise(F.col("attempts")),
            "status": status,
        }
    ).drop("outcome")


def reap_stuck(attempts: DataFrame, cutoff: Column) -> DataFrame:
    return update_where(attempts, (F.col("status") == "delivering") & (F.col("updated_at") < cutoff), status=F.lit("pending"))


def revive_dead(attempts: DataFrame, now: Column) -> DataFrame:
    dead = F.col("status") == "dead"
    return attempts.withColumns({"attempts": F.when(dead, 0).otherwise(F.col("attempts")), "next_attempt_at": F.when(dead, now).otherwise(F.col("next_attempt_at")), "status": F.when(dead, "pending").otherwise(F.col("status"))})


def dequeue(tasks: DataFrame, n: int = 1) -> DataFrame:
    """The oldest queued tasks."""
    return tasks.filter(F.col("status") == "queued").orderBy("created_at", "task_id").limit(n)


def requeue_active(tasks: DataFrame) -> DataFrame:
    active = F.col("status").isin("running", "waiting")
    return tasks.withColumns({"error": F.when(active, F.lit(None).cast("string")).otherwise(F.col("error")), "status": F.when(active, "queued").otherwise(F.col("status"))})


def next_step(steps: DataFrame, dag: DataFrame) -> DataFrame:
    """The first step of each task's list that isn't completed with its artifact present, or skipped."""
    done = (F.col("status") == "completed") & F.col("artifact") | (F.col("status") == "skipped")
    each = dag.join(steps, ["task_id", "name"], "left").filter(~F.coalesce(done, F.lit(False)))
    return each.groupBy("task_id").agg(F.min_by("name", "ord").alias("next_step"))


def missing_segments(manifest: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return manifest.join(done, keys, "left_anti")


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a unique constraint would refuse."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Rows whose foreign key leads nowhere."""
    return child.filter(F.col(on).isNotNull()).join(parent.select(on).distinct(), on, "left_anti")


def fill_gaps(primary: DataFrame, fallback: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """Union of two sources by key: the primary wins, the fallback fills gaps, keys out of range are dropped."""
    both = primary.withColumn("_o", F.lit(0)).unionByName(fallback.withColumn("_o", F.lit(1)))
    both = both.filter(F.col(key) >= 1) if total is None else both.filter(F.col(key).between(1, total))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_o"))
    return both.withColumn("_r", rank).filter("_r = 1").drop("_r", "_o")


def upsert_result(results: Column, key: Column, value: Column) -> Column:
    """A list of (key, value) with one entry replaced or appended."""
    return F.concat(F.filter(results, lambda r: r["key"] != key), F.array(F.struct(key.alias("key"), value.alias("value"))))


def live_flags(flags: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Control flags that haven't expired; the last one of a task and kind."""
    fresh = flags.filter(F.unix_micros(now) - F.unix_micros("ts") < ttl_seconds * 1_000_000)
    return fresh.groupBy("task_id", "kind").agg(F.max("ts").alias("ts"))


def retained_files(files: DataFrame, keep: DataFrame, now: Column, ttl_hours: float) -> DataFrame:
    """Files that a clean-up leaves: those to keep, and those younger than the limit (a limit of 0 or less keeps none)."""
    old = F.lit(ttl_hours <= 0) | (F.unix_micros(now) - F.unix_micros("mtime") >= int(ttl_hours * 3.6e9))
    named = files.join(keep.select("path", F.lit(True).alias("_keep")).distinct(), "path", "left")
    return named.filter(F.coalesce("_keep", F.lit(False)) | ~old).drop("_keep")
