"""Queries on metric events, step weights, progress and budgets, with their comparison SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapeloom.functions import numbers as nm
from tapeloom.functions import text as tx
from tapeloom.operators import metrics as mt
from tapeloom.plans.adapters import VIEWS, cte, read, view
from tapeloom.sources.shared import shared_folder
from tapeloom.streaming.rollup import rollup_stream

# Seconds of each step before there are measurements.
SEED = [
    ("download", 5.5), ("extract_audio", 2.0), ("trim_initial_silence", 0.3), ("segment_audio", 1.2), ("detect_language", 2.6),
    ("transcribe_segments", 174.8), ("merge_transcript", 0.1), ("prepare_llama_model", 6.3), ("prepare_summary_chunks", 0.1), ("summarize_windows", 74.8),
]


def task_rollup(s, d):
    return _flat(mt.rollup(view(s, d, "metrics")))


def _final_rollups(s, d):
    """The roll-ups of the tasks that have ended, from the events as a stream: all files there are, then the stream ends."""
    exprs = ["CAST(ts AS timestamp) AS ts", *VIEWS["metrics"][1]]
    read(s, d, "events")  # sets the session's zone
    stream = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/event[s].parquet").selectExpr(*exprs)
    where, store = f"{shared_folder(s)}/rollups-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    old = s.conf.get(store)
    s.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = rollup_stream(stream, late="36500 days").writeStream.format("parquet").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start(f"{where}/rows")
        query.awaitTermination()
    finally:
        s.conf.set(store, old)
    return _flat(s.read.parquet(f"{where}/rows"))


def _flat(out):
    stages = F.array_join(F.transform(F.array_sort(F.map_entries("total_wall_ms_by_stage")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.withColumns({"total_wall_ms_by_stage": stages, **{c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("worst3_number_mismatch", "worst3_redundancy")}})


def _pcts():
    out = []
    for name, when in (("rtf", "stage = 'transcribe.segment'"), *((n, "stage IN ('summarize.segment', 'summarize.global')") for n in ("llm_tok_per_s", "compression_ratio", "redundancy_dup_sentence_ratio"))):
        out += [f"round_even(quantile_cont({name}, {p / 100}) FILTER ({when}), 4) AS p{p}_{name}" for p in (50, 95)]
    return ", ".join(out)


ROLLUP_SQL = (
    cte("metrics")
    + """, w AS (SELECT task_id, stage, sum(CAST(trunc(t_wall_ms) AS BIGINT)) AS ms FROM metrics WHERE stage <> 'task.final' GROUP BY ALL),
 ws AS (SELECT task_id, string_agg(stage || '=' || ms, ';' ORDER BY stage) AS total_wall_ms_by_stage FROM w GROUP BY 1),
 u AS (SELECT * FROM metrics WHERE stage IN ('summarize.segment', 'summarize.global')),
 n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY number_mismatch_count DESC, event_pos) AS r FROM u WHERE number_mismatch_count IS NOT NULL),
 nn AS (SELECT task_id, string_agg(segment_id, ',' ORDER BY r) AS worst3_number_mismatch FROM n WHERE r <= 3 GROUP BY 1),
 q AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY redundancy_dup_sentence_ratio DESC, event_pos) AS r FROM u WHERE redundancy_dup_sentence_ratio IS NOT NULL),
 qq AS (SELECT task_id, string_agg(segment_id, ',' ORDER BY r) AS worst3_redundancy FROM q WHERE r <= 3 GROUP BY 1),
 p AS (SELECT task_id, """
    + _pcts()
    + " FROM metrics GROUP BY 1) SELECT * FROM p LEFT JOIN ws USING (task_id) LEFT JOIN nn USING (task_id) LEFT JOIN qq USING (task_id)"
)


def _progress(s, d):
    steps = view(s, d, "steps").select("task_id", "name", "status", F.when(F.col("event_id") % 3 == 0, F.lit(0.5)).alias("fraction"), (F.col("event_id") % 13 > 0).alias("enabled"))
    out = mt.overall_progress(steps, s.createDataFrame(SEED, "name string, weight double"))
    return out.select("task_id", F.bround("progress", 6).alias("progress"))


def _seeded(s, d):
    return mt.merge_with_seed(mt.step_weights(view(s, d, "durations")), s.createDataFrame(SEED, "name string, seed double"), 5)


def _tokens(s, d):
    t = read(s, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.explode(F.split(F.lower("text"), " ")).alias("token"))
    return mt.token_ratios(t.filter("token <> ''"))


def _budgets(s, d):
    n = F.length("text").cast("int")
    out = read(s, d, "documents").select("doc_id", nm.segment_budget(n).alias("a"), nm.pack_budget(n).alias("b"), nm.final_budget(n).alias("c"))
    return out.select("doc_id", *(F.col(f"{x}.{y}").alias(f"{x}_{y}") for x in "abc" for y in ("target", "low", "high")))


def _fits(s, d):
    n, ctx = F.length("text").cast("int"), F.lit(8192)
    p = (F.col("doc_id") % 9 * 300).cast("int")
    fits, possible = nm.fits_whole(n, p, ctx, 256), nm.whole_possible(n, p, ctx, 256)
    mode = F.element_at(F.array(F.lit("auto"), F.lit("never"), F.lit("always")), (F.col("doc_id") % 3 + 1).cast("int"))
    return read(s, d, "documents").select("doc_id", fits.alias("fits"), possible.alias("possible"), nm.final_fits(n, p, ctx, 256).alias("final_fits"), nm.segmentation_mode(mode, fits, possible).alias("mode"), nm.window_tokens(p, ctx, 256, F.lit(3000)).alias("window"), nm.uncapped(n, F.lit(1800)).alias("cap"))


_M, _D, _S = cte("metrics"), cte("durations"), cte("steps")
_NORM = _D + ", n AS (SELECT *, CASE WHEN name <> 'summarize_windows' THEN duration_sec WHEN window_total - 1 >= 1 THEN duration_sec / (window_total - 1) END AS sec FROM durations)"
QUERIES = {
    "task_rollup": (task_rollup, ROLLUP_SQL),
    "final_rollups": (_final_rollups, ROLLUP_SQL + " WHERE task_id IN (SELECT task_id FROM metrics WHERE stage = 'task.final')"),
    "wall_by_stage": (lambda s, d: mt.wall_by_stage(view(s, d, "metrics")), _M + " SELECT task_id, stage, CAST(sum(CAST(trunc(t_wall_ms) AS BIGINT)) AS BIGINT) AS wall_ms FROM metrics WHERE stage <> 'task.final' GROUP BY ALL"),
    "worst_n": (lambda s, d: mt.worst(view(s, d, "metrics"), ["task_id"], "number_mismatch_count", 3).select("task_id", "rank", "segment_id"), _M + " SELECT task_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY number_mismatch_count DESC, event_pos) AS INT) AS rank, segment_id FROM metrics WHERE number_mismatch_count IS NOT NULL QUALIFY rank <= 3"),
    "percentiles": (
        lambda s, d: view(s, d, "metrics").groupBy("task_id").agg(F.bround(mt.percentile_or_zero(F.when(F.col("stage") == "none", F.col("rtf")), 50), 6).alias("empty"), F.bround(mt.percentile_or_zero(F.col("rtf"), 37.5), 8).alias("p37")),
        _M + " SELECT task_id, 0.0::DOUBLE AS empty, round_even(quantile_cont(rtf, 0.375), 8) AS p37 FROM metrics GROUP BY 1",
    ),
    "step_weights": (lambda s, d: mt.step_weights(view(s, d, "durations")), _NORM + " SELECT name, round_even(median(sec), 1) AS weight, count(*) AS samples FROM n WHERE sec IS NOT NULL GROUP BY 1"),
    "step_weights_by_user": (lambda s, d: mt.step_weights(view(s, d, "durations"), by=("user_id",)), _NORM + " SELECT user_id, name, round_even(median(sec), 1) AS weight, count(*) AS samples FROM n WHERE sec IS NOT NULL GROUP BY ALL"),
    "seeded_weights": (_seeded, _NORM + ", c AS (SELECT name, round_even(median(sec), 1) AS weight, count(*) AS samples FROM n WHERE sec IS NOT NULL GROUP BY 1), seed(name, seed) AS (VALUES " + ", ".join(f"('{n}', {w}::DOUBLE)" for n, w in SEED) + ") SELECT name, CASE WHEN samples >= 5 THEN weight ELSE seed END AS weight FROM seed LEFT JOIN c USING (name)"),
    "final_fallback": (lambda s, d: mt.final_fallback(view(s, d, "durations").filter("name = 'final_summary'"), 5, 514.4), _D + " SELECT CASE WHEN count(duration_sec) >= 5 THEN median(duration_sec) ELSE 514.4 END AS fallback FROM durations WHERE name = 'final_summary'"),
    "step_durations": (
        lambda s, d: mt.step_durations(view(s, d, "steps").withColumns({"started_at": F.expr("timestampadd(SECOND, -CAST(event_id % 50 - 5 AS INT), started_at)"), "window_total": (F.col("event_id") % 4).cast("int")})).select("event_id", "duration_sec", "window_total"),
        _S + " SELECT event_id, CAST(event_id % 50 - 5 AS DOUBLE) AS duration_sec, CASE WHEN event_id % 4 >= 1 THEN CAST(event_id % 4 AS INT) END AS window_total FROM steps WHERE status = 'completed' AND finished_at IS NOT NULL AND event_id % 50 >= 5",
    ),
    "user_durations": (
        lambda s, d: mt.user_durations(view(s, d, "steps").withColumns({"task_id": F.col("event_id") * 2, "started_at": F.expr("timestampadd(SECOND, -CAST(event_id % 50 - 5 AS INT), started_at)"), "window_total": F.lit(None).cast("int")}), view(s, d, "tasks")).select("event_id", "user_id", "name", "duration_sec"),
        cte("steps", "tasks") + " SELECT event_id, t.user_id, name, CAST(event_id % 50 - 5 AS DOUBLE) AS duration_sec FROM steps s JOIN tasks t ON t.task_id = s.event_id * 2 WHERE s.status = 'completed' AND finished_at IS NOT NULL AND event_id % 50 >= 5",
    ),
    "processing_seconds": (
        lambda s, d: mt.processing_seconds(view(s, d, "steps").withColumn("started_at", F.expr("timestampadd(SECOND, -CAST(event_id % 50 - 5 AS INT), started_at)"))),
        _S + " SELECT task_id, CAST(sum(event_id % 50 - 5) FILTER (finished_at IS NOT NULL AND event_id % 50 >= 5) AS BIGINT) AS seconds FROM steps GROUP BY 1",
    ),
    "overall_progress": (
        _progress,
        _S
        + """, x AS (SELECT task_id, CASE name WHEN 'download' THEN 5.5 WHEN 'transcribe_segments' THEN 174.8 WHEN 'summarize_windows' THEN 74.8 ELSE 1.0 END::DOUBLE AS w,
 CASE status WHEN 'completed' THEN 1.0 WHEN 'running' THEN CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0.05 END ELSE 0.0 END::DOUBLE AS p FROM steps WHERE event_id % 13 > 0) SELECT task_id, round_even(sum(w * p) / sum(w), 6) AS progress FROM x GROUP BY 1""",
    ),
    "part_offsets": (
        lambda s, d: mt.part_offsets(read(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q")), "l_orderkey", "l_linenumber", "q").select("l_orderkey", "l_linenumber", "offset"),
        "WITH p AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_linenumber, coalesce(sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS \"offset\" FROM p",
    ),
    "token_ratios": (
        _tokens,
        "WITH t AS (SELECT conv_id || '/' || turn AS id, unnest(string_split(lower(text), ' ')) AS token FROM conversations), g AS (SELECT id, token, count(*) AS n FROM t WHERE token <> '' GROUP BY ALL) SELECT id, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS \"distinct\", round_even(count(*) / sum(n), 4) AS unique_ratio, round_even(max(n) / sum(n), 4) AS top_ratio FROM g GROUP BY 1",
    ),
    "token_budgets": (
        _budgets,
        """WITH n AS (SELECT doc_id, CAST(length(text) AS INT) AS n FROM documents), b AS (SELECT doc_id, n, greatest(ceil(n * 0.65::DOUBLE), 200)::INT AS a_low, least(floor(n * 0.90::DOUBLE), 1800)::INT AS a_high, greatest(ceil(n * 0.80::DOUBLE), 400)::INT AS b_low,
 floor(n * 0.95::DOUBLE)::INT AS b_high, ceil(n * 0.60::DOUBLE)::INT AS c_low, floor(n * 0.80::DOUBLE)::INT AS c_high FROM n) SELECT doc_id, a_low, a_high, b_low, b_high, c_low, c_high, trunc(greatest(a_low, least(n * 0.78::DOUBLE, a_high)))::INT AS a_target,
 trunc(greatest(b_low, least(n * 0.90::DOUBLE, b_high)))::INT AS b_target, trunc(greatest(c_low, least(n * 0.70::DOUBLE, c_high)))::INT AS c_target FROM b""",
    ),
    "context_fit": (
        _fits,
        """WITH n AS (SELECT doc_id, CAST(length(text) AS INT) AS n, CAST(doc_id % 9 * 300 AS INT) AS p FROM documents), f AS (SELECT *, p + 2 * n + 256 <= 8192 AS fits, p + n + ceil(n * 0.65::DOUBLE) + 256 <= 8192 AS possible FROM n)
 SELECT doc_id, fits, possible, p + n + floor(n * 0.80::DOUBLE) + 256 <= 8192 AS final_fits, CASE doc_id % 3 WHEN 2 THEN 'segmented' WHEN 1 THEN CASE WHEN possible THEN 'whole' ELSE 'error' END ELSE CASE WHEN fits THEN 'whole' ELSE 'segmented' END END AS mode,
 greatest(2000, least(floor((8192 - p - 256) / 2), 3000))::INT AS "window", greatest(1800, ceil(n * 0.90::DOUBLE))::INT AS cap FROM f""",
    ),
    "rates": (
        lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", nm.ratio(F.col("l_extendedprice"), F.col("l_quantity") - 10, 9).alias("rate"), nm.backoff_seconds(F.col("l_linenumber")).alias("backoff"), nm.stream_ceiling(F.col("l_quantity") * 100, 9.0, 1.5, 60.0, 600.0).alias("ceiling"), tx.tokens_to_words(F.col("l_quantity")).alias("words")),
        "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 10 THEN round_even(l_extendedprice / (l_quantity - 10), 9) END AS rate, least(60 * pow(2, greatest(0, l_linenumber - 1)), 3600) AS backoff, greatest(60, least(l_quantity * 100 / 9::DOUBLE * 1.5::DOUBLE, 600)) AS ceiling, greatest(1, round_even(l_quantity * 0.75, 0)::INT) AS words FROM lineitem",
    ),
}
