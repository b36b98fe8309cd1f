"""Views of the driver's tables in the shapes that the operators take; each is a table and a list of SQL expressions.

The expressions are plain SQL, so the same text defines the view for the comparison SQL (``cte``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_STATUS = "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'completed' WHEN 'purchase' THEN 'running' WHEN 'signup' THEN 'failed' ELSE 'waiting' END"
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_STAGE = "CASE event_type WHEN 'click' THEN 'transcribe.segment' WHEN 'view' THEN 'summarize.segment' WHEN 'purchase' THEN 'summarize.global' WHEN 'signup' THEN 'task.final' ELSE 'download' END"
_STEP = "CASE event_type WHEN 'click' THEN 'download' WHEN 'view' THEN 'summarize_windows' WHEN 'purchase' THEN 'transcribe_segments' WHEN 'signup' THEN 'final_summary' ELSE 'diarize' END"
_END = "CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)"
_DELIVERY = "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'delivering' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'waiting_adapter' ELSE 'dead' END END"

VIEWS: dict[str, tuple[str, list[str]]] = {
    "tasks": (
        "events",
        ["event_id AS task_id", "user_id", "ts AS created_at", f"{_STATUS} AS status", "concat(event_type, ' ', props) AS title", "concat(CASE WHEN event_id % 3 = 0 THEN 'file://rec/' ELSE 'https://host.example/' END, CAST(event_id % 40 AS VARCHAR(20))) AS url", "props AS options", "CASE WHEN event_id % 2 = 0 THEN 'boom' END AS error"],
    ),
    "metrics": (
        "events",
        ["user_id % 50 AS task_id", "event_id AS event_pos", "event_id AS segment_id", f"{_STAGE} AS stage", "value * 10 AS t_wall_ms", "value / 100 AS rtf", f"CASE WHEN {_K} % 5 > 0 THEN value / 7 END AS llm_tok_per_s", f"{_K} / 100.0E0 AS compression_ratio", f"CASE WHEN {_K} % 3 > 0 THEN {_K} / 100.0E0 END AS redundancy_dup_sentence_ratio", f"CASE WHEN {_K} % 4 > 0 THEN {_K} % 10 END AS number_mismatch_count"],
    ),
    "durations": ("events", ["user_id", f"{_STEP} AS name", "value AS duration_sec", f"CASE WHEN {_K} % 7 > 0 THEN {_K} % 7 END AS window_total"]),
    "segments": ("lineitem", ["l_orderkey AS task_id", "l_linenumber AS segment_index", "CASE l_returnflag WHEN 'N' THEN '{}' WHEN 'R' THEN 'null' ELSE '{\"text\": 1}' END AS raw_json"]),
    "queue": ("orders", ["o_orderstatus AS lane", "o_custkey AS task_id", "CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority", "o_orderkey AS pos"]),
    "turns": ("conversations", ["conv_id AS task_id", "turn AS seg_pos", "role AS speaker", f"{_END} - length(text) AS start", f"{_END} - conv_id % 9 AS end"]),
    "entries": ("conversations", ["conv_id AS task_id", "turn AS pos", "CASE WHEN (conv_id + turn) % 11 > 0 THEN role END AS speaker", f"{_END} - length(text) AS start", f"{_END} AS end", "text"]),
    "spans": ("conversations", ["conv_id AS task_id", "turn AS span_id", f"{_END} - conv_id % 5 * 40.0E0 AS start", f"{_END} - conv_id % 5 * 40.0E0 + turn % 3 * 25.0E0 AS end"]),
    "samples": ("embeddings", ["vec_id AS sample_id", "label AS speaker_id", "vec_id % 2 AS model", "embedding AS vector"]),
    "speakers": ("nation", ["n_nationkey AS speaker_id", "n_name AS name"]),
    "decisions": ("events", ["event_id AS decision_id", "user_id AS task_id", "event_type AS label", f"CASE WHEN {_K} % 3 > 0 THEN {_K} END AS speaker_id", f"{_K} % 10 = 0 AS is_noise", "ts AS created_at"]),
    "attempts": ("orders", ["o_orderkey AS attempt_id", f"{_DELIVERY} AS status", "CAST(o_orderkey % 6 AS INT) AS attempts", "5 AS max_attempts", "o_orderdate AS next_attempt_at", "o_orderdate AS updated_at"]),
    "steps": ("events", ["user_id AS task_id", f"{_STEP} AS name", "CASE WHEN event_id % 4 = 0 THEN 'running' WHEN event_id % 9 = 0 THEN 'skipped' ELSE 'completed' END AS status", "ts AS started_at", f"CASE WHEN {_K} % 6 > 0 THEN ts END AS finished_at", f"{_K} % 8 > 0 AS artifact", "event_id"]),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; its zoneless times count as UTC, which the session is set to."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.withColumns({c: df[c].cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as the session shuffles to, where a table's few row groups give fewer; else as they are."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def dealt(df: DataFrame, *keys: str, rows: int = 500_000) -> DataFrame:
    """A table's rows dealt by key to as many tasks as hold about ``rows`` each, at least as many as the session shuffles to.

    Groupings, joins and windows by these keys (and more) then stay in the tasks, whose memory doesn't grow with the table.
    """
    return df.repartition(deals(df, rows), *keys)


def deals(df: DataFrame, rows: int = 500_000) -> int:
    """How many tasks hold about ``rows`` of a table's rows each, at least as many as the session shuffles to."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, -(-df.count() // rows))  # the count comes from the files' footers


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, exprs = VIEWS[name]
    return read(spark, sf_dir, table).selectExpr(*exprs)


def cte(*names: str) -> str:
    """WITH clause that defines the views for the comparison SQL; more definitions and the query follow."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(_quoted(e) for e in VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names)


def _quoted(e: str) -> str:
    return e.removesuffix(" AS end") + ' AS "end"' if e.endswith(" AS end") else e
