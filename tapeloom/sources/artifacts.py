"""Readers and writers of recordings' artifacts: JSON documents, JSON lines, listings, text slices.

All files are reached through Spark's readers and the Hadoop file system, so any store that Spark can open works.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators.resume import FILES, READ
from tapeloom.operators.state import fill_gaps

ENTRIES = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("speaker", T.StringType())])
_SPAN = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType())])
RAW = T.StructType(
    [
        T.StructField("segment_index", T.IntegerType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("raw_json", T.StructType([T.StructField("segments", T.ArrayType(_SPAN))])),
    ]
)
WINDOWS = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("text", T.StringType())])
_RATES = "t_wall_ms rtf llm_tok_per_s compression_ratio redundancy_dup_sentence_ratio".split()
EVENTS = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("task_id", "run_id", "prompt_version", "stage")),
        T.StructField("ts", T.TimestampType()),
        T.StructField("segment_id", T.IntegerType()),
        *(T.StructField(c, T.DoubleType()) for c in _RATES),
        T.StructField("number_mismatch_count", T.IntegerType()),
        T.StructField("event_pos", T.LongType()),
    ]
)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """JSON documents or lines by an explicit schema; a missing path is an empty table, malformed records are dropped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", multi_line).json(path)
    return df.filter(F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in schema.names], F.lit(False)))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Transcript entries with the file they come from and their position in it."""
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("path", T.StringType()), T.StructField("pos", T.IntegerType()), *ENTRIES.fields]))
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", T.ArrayType(ENTRIES)).alias("e"))
    return whole.select("path", F.posexplode("e").alias("pos", "x")).select("path", "pos", "x.*").filter("text is not null")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw ASR chunks with the file they come from; a missing or malformed file, or one without a list, has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("path", T.StringType()), *RAW.fields]))
    payload = T.StructType([T.StructField("segments", T.ArrayType(RAW))])
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", payload)["segments"].alias("s"))
    return whole.select("path", F.explode("s").alias("x")).filter("x is not null").select("path", "x.*")


def read_windows(spark: SparkSession, primary: str, mirror: str, total: int) -> DataFrame:
    """Window notes: the primary file first, gaps filled from the mirror, indices outside 1..total dropped."""
    return fill_gaps(read_json(spark, primary, WINDOWS).filter("text is not null"), read_json(spark, mirror, WINDOWS).filter("text is not null"), "idx", total)


def restore_windows(spark: SparkSession, pattern: str, totals: DataFrame) -> DataFrame:
    """(folder, window_index, summary, path): the windows that each summary folder of a glob has done.

    A folder's ``windows.json`` comes first; a ``window_NN.txt`` fills a gap, as a killed run may have written it without its line.
    Malformed files and entries are skipped, indices outside 1..total (``totals``: folder, total) dropped, and a folder
    without a total has none. ``summary`` is the note's JSON, or its text as a JSON string; a path that is missing is
    the file's own.
    """
    empty = spark.createDataFrame([], "folder string, window_index int, summary string, path string")
    if not _exists(spark, pattern):
        return empty
    load = lambda name: spark.read.text(pattern, wholetext=True, pathGlobFilter=name).select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("folder"), F.input_file_name().alias("path"), "value")
    own = F.concat("folder", F.lit("/window_"), F.when(F.col("window_index") < 10, F.lpad(F.col("window_index").cast("string"), 2, "0")).otherwise(F.col("window_index").cast("string")), F.lit(".txt"))
    items = load("windows.json").select("folder", F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$.windows", "array<variant>")).alias("_i", "x"))
    index = F.try_variant_get("x", "$.window_index", "int")
    given = F.try_variant_get("x", "$.path", "string")
    stated = items.select("folder", "_i", index.alias("window_index"), F.to_json(F.try_variant_get("x", "$.summary", "variant")).alias("summary"), given.alias("_path")).filter("window_index >= 1")
    stated = stated.withColumn("path", F.when(F.coalesce(F.trim("_path"), F.lit("")) != "", F.col("_path")).otherwise(own))
    stated = stated.groupBy("folder", "window_index").agg(F.max_by(F.struct("summary", "path"), "_i").alias("w"), F.lit(0).alias("_rank"))  # the last of equals
    parsed = F.try_parse_json("value")
    quoted = F.regexp_replace(F.to_json(F.array("value")), r"(?s)^\[(.*)\]$", "$1")
    note = F.when(F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), F.to_json(parsed)).otherwise(quoted)
    files = load("window_*.txt").withColumn("window_index", F.regexp_extract("path", r"/window_(\d+)\.txt$", 1).try_cast("int")).filter("window_index is not null")
    files = files.select("folder", "window_index", F.struct(note.alias("summary"), "path").alias("w"), F.lit(1).alias("_rank"))
    both = stated.unionByName(files).groupBy("folder", "window_index").agg(F.min_by("w", F.struct("_rank", "w.path")).alias("w"))
    return both.join(totals, "folder").filter("window_index <= total").select("folder", "window_index", "w.summary", "w.path")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, EVENTS, multi_line=False)


def stream_events(spark: SparkSession, path: str, user_filter: Column | None = None) -> DataFrame:
    df = spark.readStream.schema(EVENTS).json(path)
    return df if user_filter is None else df.filter(user_filter)


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, name, size, mtime) of the files of a glob, contents unread."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(pattern)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def task_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(task_id, name, text) of the files two levels below the task folders of a glob, for ``operators.resume``.

    Names are ``outputs/...`` or ``summary/...``; only the small JSON files that are judged by their content are read.
    Empty files aren't listed, as a killed run leaves them; their steps count as not done.
    """
    shape = "task_id string, name string, text string"
    spots = [f"{pattern.rstrip('/')}/{d}" for d in ("outputs", "summary")]
    spots = [p for p in spots if _exists(spark, p)]
    if not spots:
        return spark.createDataFrame([], shape)
    parts = lambda c: (F.element_at(F.split(c, "/"), -3).alias("task_id"), F.concat_ws("/", F.element_at(F.split(c, "/"), -2), F.element_at(F.split(c, "/"), -1)).alias("name"))
    listed = spark.read.format("binaryFile").load(spots).select(F.col("path")).select(*parts(F.col("path"))).filter(F.col("name").isin(list(FILES.values())))
    judged = "{" + ",".join(FILES[k].split("/")[1] for k in READ) + "}"
    read = spark.read.text(spots, wholetext=True, pathGlobFilter=judged).select(*parts(F.input_file_name()), F.col("value").alias("text"))
    return listed.join(read, ["task_id", "name"], "left").select("task_id", "name", "text")


def upload_sidecars(spark: SparkSession, pattern: str) -> DataFrame:
    """(folder, text) of the upload.json files in the folders of a glob, for ``resume.abandoned_sessions``."""
    where = f"{pattern.rstrip('/')}/upload.json"
    if not _exists(spark, where):
        return spark.createDataFrame([], "folder string, text string")
    return spark.read.text(where, wholetext=True).select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("folder"), F.col("value").alias("text"))


def file_slices(spark: SparkSession, path: str, requests: DataFrame, cap: int = 200_000) -> DataFrame:
    """(path, offset, limit, text, is_end): parts of text files, in characters, without any task or row that holds a whole file.

    ``requests``: path (as ``_metadata.file_path`` gives it), offset, limit (at most ``cap`` counts). Files are read in the
    splits that Spark cuts at line ends, whatever their size. Splits count their characters; only the lines of those
    splits that a request touches are numbered and cut. An offset beyond the end gives an empty text; requests for other
    files are left out. A single line isn't split.
    """
    m = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(m["file_path"].alias("path"), m["file_size"].alias("_size"), m["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    chars, octets = F.length("value").cast("long") + 1, F.octet_length("value").cast("long") + 1  # with the line's end
    blocks = lines.groupBy("path", "_block").agg(F.sum(chars).alias("_n"), F.sum(octets).alias("_bytes"), F.max("_size").alias("_size"))
    order, whole = Window.partitionBy("path").orderBy("_block"), Window.partitionBy("path")
    missing = F.greatest(F.lit(0), F.sum("_bytes").over(whole) - F.col("_size"))  # 1 where the last line has no end
    blocks = blocks.withColumns({"_from": F.sum("_n").over(order) - F.col("_n"), "_total": F.sum("_n").over(whole) - missing})
    asked = requests.select("path", F.col("offset").cast("long").alias("offset"), F.col("limit").cast("long").alias("limit"), F.least("limit", F.lit(cap)).cast("long").alias("_take")).distinct()
    spans = asked.join(blocks.select("path", "_block", "_from", "_n", "_total"), "path")
    touched = (F.col("_from") < F.col("offset") + F.col("_take")) & (F.col("offset") < F.col("_from") + F.col("_n"))
    needed = spans.filter(touched).select("path", "_block", "_from").distinct()
    held = lines.join(F.broadcast(needed), ["path", "_block"])  # few: a request touches the splits of ``cap`` characters
    start = F.col("_from") + F.sum(chars).over(Window.partitionBy("path", "_block").orderBy("_id")) - chars
    placed = held.select("path", start.alias("_start"), F.concat("value", F.lit("\n")).alias("_line"))
    met = placed.join(asked, "path").filter((F.col("_start") < F.col("offset") + F.col("_take")) & (F.col("offset") < F.col("_start") + F.length("_line")))
    skip = F.greatest(F.lit(0).cast("long"), F.col("offset") - F.col("_start"))
    piece = F.substring("_line", (skip + 1).cast("int"), (F.col("offset") + F.col("_take") - F.col("_start") - skip).cast("int"))
    own = met.groupBy("path", "offset", "limit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", piece.alias("_p")))), lambda x: x["_p"]), "").alias("_text"))
    totals = spans.groupBy("path", "offset", "limit").agg(F.max("_total").alias("_total"), F.max("_take").alias("_take"))
    room = F.greatest(F.lit(0).cast("long"), F.least("_take", F.col("_total") - F.col("offset"))).cast("int")
    out = totals.join(own, ["path", "offset", "limit"], "left")
    return out.select("path", "offset", "limit", F.substring(F.coalesce("_text", F.lit("")), F.lit(1), room).alias("text"), (F.col("offset") + F.col("_take") >= F.col("_total")).alias("is_end"))


def pick_media(files: DataFrame, by: str, patterns: list[str]) -> DataFrame:
    """Of each group the file whose name matches the earliest pattern; of equals the first name."""
    rank = F.coalesce(*[F.when(F.col("name").rlike(p), F.lit(i)) for i, p in enumerate(patterns)])
    ranked = files.withColumn("_rank", rank).filter("_rank is not null")
    return ranked.groupBy(by).agg(F.min_by("path", F.struct("_rank", "name")).alias("path"))


def abandoned(files: DataFrame, live: DataFrame, key: str, now: Column, hours: float) -> DataFrame:
    """Keys of directories without a live task whose newest file is older than a limit."""
    newest = files.groupBy(key).agg(F.max("mtime").alias("newest"))
    return newest.filter(F.unix_micros(now) - F.unix_micros("newest") >= int(hours * 3.6e9)).join(live.select(key), key, "left_anti").select(key)


def manifest(spans: DataFrame, key: str) -> DataFrame:
    """Segments of a recording's planned spans, numbered from 1, with their file names."""
    out = spans.select(key, F.posexplode("spans").alias("_i", "span"))
    return out.select(key, (F.col("_i") + 1).alias("segment_index"), F.concat(F.lpad((F.col("_i") + 1).cast("string"), 4, "0"), F.lit(".wav")).alias("file"), "span.start", F.col("span.end").alias("end"))


def write_atomic(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write beside the target, then put it in place: no reader ever sees half a table.

    The old table is set aside by one rename and the new one put in place by the next; between the two the target is
    missing for a moment. If the second fails the old table comes back; if the job dies in between, the next write finds it
    beside the target (``<path>.old``) and restores it first.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, aside, staging = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.old", f"{path}.{uuid.uuid4().hex}.tmp"))
    fs = target.getFileSystem(conf)
    if fs.exists(aside):
        if fs.exists(target):
            fs.delete(aside, True)
        elif not fs.rename(aside, target):
            raise OSError(f"can't restore {path}")
    df.write.format(fmt).save(staging.toString())
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"can't set {path} aside")
    if not fs.rename(staging, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"can't put {path} in place")
    if had:
        fs.delete(aside, True)


def append_events(events: DataFrame, path: str, task_id: str, run_id: str, prompt_version: str = "") -> None:
    """Append metric events as JSON lines, stamped with time, task, run and the prompts' version.

    An event's own ``prompt_version``, where it has one, stands.
    """
    own = F.coalesce("prompt_version", F.lit(prompt_version)) if "prompt_version" in events.columns else F.lit(prompt_version)
    events.withColumns({"ts": F.current_timestamp(), "task_id": F.lit(task_id), "run_id": F.lit(run_id), "prompt_version": own}).write.mode("append").json(path)


def mirror_batches(primary: str, mirror: str, fmt: str = "parquet"):
    """A foreachBatch function that writes each micro-batch to two places, once each even if it is replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        for where in (primary, mirror):
            batch.write.format(fmt).mode("overwrite").save(f"{where}/batch={batch_id}")

    return write
