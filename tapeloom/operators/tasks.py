"""Task queries: filters, sorting, paging, queue positions, counts, status flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The statuses of tasks and deliveries and their groups.
STATUSES = "queued running waiting paused awaiting_input completed failed canceled archived".split()
GROUPS = {
    "is_active": {"running", "waiting"},
    "is_pending": {"queued", "waiting"},
    "is_finished": {"completed", "failed", "canceled", "archived"},
    "shows_progress": {"running", "waiting", "completed", "failed"},
    "can_pause": {"queued", "running", "waiting"},
    "can_resume": {"paused", "failed", "awaiting_input"},
    "can_archive": {"completed", "failed", "awaiting_input"},
    "skippable_on_start": {"canceled", "completed", "archived"},
    "terminal_for_wait": {"completed", "failed", "canceled", "archived"},
    "needs_input": {"awaiting_input"},
}
DELIVERY_GROUPS = {
    "is_terminal": {"delivered", "dead"},
    "is_in_flight": {"pending", "delivering", "waiting_adapter"},
    "is_claimable": {"pending", "waiting_adapter"},
    "can_retry": {"dead"},
    "is_error": {"dead"},
    "is_waiting_for_adapter": {"waiting_adapter"},
}
SORTS = {"created": "created_at", "updated": "updated_at", "title": "title", "status": "status"}


def in_group(status: Column, name: str) -> Column:
    return status.isin(sorted((GROUPS | DELIVERY_GROUPS)[name]))


def with_status_flags(df: DataFrame, status: str = "status", groups: dict[str, set[str]] = GROUPS) -> DataFrame:
    return df.withColumns({name: F.coalesce(df[status].isin(sorted(own)), F.lit(False)) for name, own in groups.items()})


def status_flags(spark: SparkSession) -> DataFrame:
    """The dimension of statuses and their flags."""
    return with_status_flags(spark.createDataFrame([(s,) for s in STATUSES], "status string"))


def filter_tasks(tasks: DataFrame, q: str | None = None, status: list[str] | None = None, created_from=None, created_to=None, source_type: str | None = None, user_id=None) -> DataFrame:
    """Literal case-insensitive search in title or URL, status membership, inclusive time range, file or URL source."""
    if created_from is not None and created_to is not None and created_from > created_to:
        raise ValueError("created_from is after created_to")
    if source_type not in (None, "file", "url"):
        raise ValueError(f"unknown source type {source_type!r}")
    out = tasks
    if user_id is not None:
        out = out.filter(F.col("user_id") == user_id)
    if q:
        needle = F.lower(F.lit(q))
        out = out.filter(F.contains(F.lower("title"), needle) | F.contains(F.lower("url"), needle))
    if status:
        out = out.filter(F.col("status").isin(status))
    if created_from is not None:
        out = out.filter(F.col("created_at") >= F.lit(created_from))
    if created_to is not None:
        out = out.filter(F.col("created_at") <= F.lit(created_to))
    if source_type:
        is_file = F.col("url").startswith("file://")
        out = out.filter(is_file if source_type == "file" else ~is_file)
    return out


def page(tasks: DataFrame, limit: int, after: tuple | None = None, before: tuple | None = None, ascending: bool = False) -> DataFrame:
    """Keyset page by (created_at, task_id), both bounds exclusive."""
    if not 0 < limit <= 500:
        raise ValueError("limit must be 1 to 500")
    if after is not None and before is not None and after >= before:
        raise ValueError("after must come before before")
    key = F.struct("created_at", "task_id")
    out = tasks
    for bound, keep in ((after, lambda b: key > b), (before, lambda b: key < b)):
        if bound is not None:
            out = out.filter(keep(F.struct(F.lit(bound[0]).cast("timestamp").alias("created_at"), F.lit(bound[1]).cast(tasks.schema["task_id"].dataType).alias("task_id"))))
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in ("created_at", "task_id")]
    return out.orderBy(*order).limit(limit)


def page_with_more(tasks: DataFrame, limit: int, **bounds) -> DataFrame:
    """A page and whether more rows follow: one row more is fetched and dropped."""
    ascending = bounds.get("ascending", False)
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in ("created_at", "task_id")]
    over = page(tasks, limit + 1, **bounds).withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # limit + 1 rows
    return over.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit).filter(F.col("_n") <= limit).drop("_n")


def newest(tasks: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return tasks.orderBy(F.desc("created_at"), F.desc("task_id")).offset(offset).limit(limit)


def sort_by(tasks: DataFrame, column: str, limit: int, ascending: bool = True) -> DataFrame:
    if column not in SORTS:
        raise ValueError(f"cannot sort by {column!r}")
    c = F.col(SORTS[column])
    return tasks.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), "task_id").limit(limit)


def encode_cursor(created_at: Column, task_id: Column) -> Column:
    """An opaque URL-safe cursor of a row's key, without padding."""
    raw = F.concat_ws("|", F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), task_id.cast("string"))
    return F.rtrim(F.translate(F.base64(raw.cast("binary")), "+/=", "-_ "))


def decode_cursor(cursor: Column) -> Column:
    """(created_at, task_id) of a cursor; null if it isn't one."""
    raw = F.try_to_binary(F.translate(cursor, "-_", "+/"), F.lit("base64")).cast("string")
    at = F.try_to_timestamp(F.substring_index(raw, "|", 1))
    return F.when(at.isNotNull() & raw.contains("|"), F.struct(at.alias("created_at"), F.regexp_replace(raw, r"^[^|]*\|", "").alias("task_id")))


def queue_positions(tasks: DataFrame) -> DataFrame:
    """1-based position of each queued task by (created_at, task_id).

    The order is global, but no single task sorts it: rows are range-partitioned by the key, ranked inside their
    range and shifted by the sizes of the ranges before, of which there are as many as partitions. Their number is
    given, so that adaptive execution leaves the two uses of the ranges alike.
    """
    queued = tasks.filter(F.col("status") == "queued").select("task_id", "created_at")
    ranged = queued.repartitionByRange(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "created_at", "task_id").withColumn("_p", F.spark_partition_id())
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    shift = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("created_at", "task_id")))
    return own.join(F.broadcast(shift), "_p").select("task_id", (F.col("_r") + F.col("_before")).alias("position"))


def asr_progress(segments: DataFrame) -> DataFrame:
    """Done and all segments of each task; a segment is done if its payload isn't empty."""
    done = ~F.col("raw_json").isin("{}", "null")
    return segments.groupBy("task_id").agg(F.count_if(done).alias("done"), F.count("*").alias("total"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def users_with(tasks: DataFrame, status: str = "completed") -> DataFrame:
    return tasks.filter(F.col("status") == status).select("user_id").distinct()


def canonical_json(raw: Column) -> Column:
    """One text for all spellings of a JSON value: keys sorted at every depth, no spaces, 1.0 and 1.00 as 1.

    Null counts as JSON's null. A text that isn't JSON, or has a key twice, stands for itself. Numbers with an exponent
    are doubles, which equal only each other.
    """
    plain = F.to_json(F.try_parse_json(raw))
    whole = F.regexp_replace(plain, r'("(?:[^"\\]|\\.)*")|(-?\d+)\.0(?=[,\]}]|$)', "$1$2")
    return F.when(raw.isNull(), "null").otherwise(F.coalesce(whole, F.concat(F.lit("raw:"), raw)))


def donor(tasks: DataFrame, url: str, user_id, options: str, newest_of: int = 20) -> DataFrame:
    """The newest completed task of another user for a URL whose options equal the given JSON."""
    near = tasks.filter((F.col("url") == url) & (F.col("status") == "completed") & (F.col("user_id") != user_id))
    near = near.orderBy(F.desc("created_at"), F.desc("task_id")).limit(newest_of)
    return near.filter(same_json(F.col("options"), F.lit(options))).orderBy(F.desc("created_at"), F.desc("task_id")).limit(1)


def same_json(a: Column, b: Column) -> Column:
    """Deep equality of two JSON values."""
    return canonical_json(a) == canonical_json(b)


def donors(asked: DataFrame, tasks: DataFrame, newest_of: int = 20) -> DataFrame:
    """(task_id, donor_id): for each asking task (task_id, user_id, url, options) the task to copy; null if none.

    A donor is completed, has the URL and equal options, belongs to another user, and is among the ``newest_of`` newest
    of those for the asker, whatever their options; the newest counts. A URL's candidates are its 2 k newest tasks,
    at most k a user: whoever asks, the k newest of the others are among them. Both limits hold before the shuffles
    (by window group limits), so a URL with most of the tasks costs each task 2 k rows, and askers meet one small row a
    URL by an equi-join. Options are compared by a digest of their canonical form.
    """
    digest = F.sha2(canonical_json(F.col("options")), 256)
    newest = [F.desc("created_at"), F.desc("task_id")]
    done = tasks.filter("status = 'completed' and url is not null and user_id is not null").select("url", "user_id", "created_at", "task_id", digest.alias("_as"))
    own = done.withColumn("_r", F.row_number().over(Window.partitionBy("url", "user_id").orderBy(*newest))).filter(F.col("_r") <= newest_of)
    top = own.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy(*newest))).filter(F.col("_r") <= 2 * newest_of)
    found = top.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("_r", "user_id", "task_id", "_as"))).alias("_all"))
    own_id = F.col("user_id")
    met = asked.select("task_id", "user_id", "url", digest.alias("_own")).join(found, "url", "left")
    others = F.slice(F.filter("_all", lambda c: c["user_id"] != own_id), 1, newest_of)
    fits = F.filter(others, lambda c: c["_as"] == F.col("_own"))
    return met.select("task_id", F.get(fits, F.lit(0))["task_id"].alias("donor_id"))


def public_lane_positions(queue: DataFrame) -> DataFrame:
    """Position per public lane: a task counts once in it (its first entry), classes of higher priority first."""
    first = Window.partitionBy("lane", "task_id").orderBy("priority", "pos")
    once = queue.withColumn("_f", F.row_number().over(first)).filter("_f = 1").drop("_f")
    return once.withColumn("position", F.row_number().over(Window.partitionBy("lane").orderBy("priority", "pos", "task_id")).cast("long"))


def wait_until(events: DataFrame, deadline: Column, done: Column) -> DataFrame:
    """For each task the first event that ends a wait before the deadline, else a timeout."""
    hit = F.min_by("event", F.when(done & (F.col("ts") <= deadline), F.struct("ts", "event_id")))
    return events.groupBy("task_id").agg(F.coalesce(hit, F.lit("timeout")).alias("outcome"))
