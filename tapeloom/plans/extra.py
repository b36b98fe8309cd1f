"""Queries on projections, options, results and uploads, with their comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import text as tx
from tapeloom.operators import projections as pj
from tapeloom.operators import state
from tapeloom.plans.adapters import cte, dealt, read, view


def _children(s, d):
    kids = read(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q")).withColumnRenamed("l_orderkey", "o_orderkey")
    out = pj.with_children(read(s, d, "orders").select("o_orderkey"), kids, "o_orderkey", "l_linenumber")
    return out.select("o_orderkey", F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["l_linenumber"], c["q"])), ",").alias("children"))


def _refs(s, d):
    e = read(s, d, "events")
    refs = F.when(F.col("event_id") % 3 > 0, F.array(F.concat(F.lit("user:"), "user_id"), F.lit("broken"), F.concat_ws(":", "event_type", F.lit("1"))))
    out = e.select("event_id", pj.prompt_refs(refs, F.col("event_id") % 2 == 0).alias("r"))
    return out.select("event_id", F.array_join(F.transform("r", lambda x: F.concat_ws("/", x["source"], x["id"])), ",").alias("refs"))


def _targets(s, d):
    spec = F.array(F.struct(F.col("c_nationkey").cast("string").alias("target"), F.lit("raw").alias("variant")), F.struct(F.lit("x").alias("target"), F.lit("raw").alias("variant")), F.struct((F.col("c_nationkey") + 20).cast("string").alias("target"), F.lit("summary").alias("variant")))
    return pj.delivery_targets(read(s, d, "customer").select(F.col("c_custkey").alias("task_id"), spec.alias("delivery")), read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("target_id"), F.col("n_name").alias("name")))


def _steps(s, d):
    t = read(s, d, "customer").select(F.col("c_custkey").alias("task_id"), (F.col("c_custkey") % 2 == 0).alias("diarize"), (F.col("c_custkey") % 3 > 0).alias("summarize"), F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("prompts"))
    return pj.step_lists(t).select("task_id", F.size("steps").cast("long").alias("n"), F.element_at("steps", -1).alias("last"))


def _restart(s, d):
    steps = F.array(F.struct(F.lit("merge_transcript").alias("name"), F.when(F.col("task_id") % 4 > 0, "completed").otherwise("failed").alias("status")))
    return view(s, d, "tasks").select("task_id", pj.can_restart_summary(F.col("status"), steps).alias("can"))


def _turns(s, d):
    raw = read(s, d, "events").select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("value").cast("string")).otherwise("n/a").alias("start"), (F.col("value") + (F.col("user_id") % 3 - 1)).cast("string").alias("end"), F.when(F.col("event_id") % 7 > 0, F.concat(F.lit(" "), "event_type")).otherwise("  ").alias("speaker"))
    return pj.normalize_turns(raw).select("event_id", "start", "speaker")


def _revoked(s, d):
    t = read(s, d, "orders").select(F.col("o_orderkey").alias("token_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("revoked_at"))
    out = pj.soft_revoke(t, t.filter("token_id % 2 = 0"), F.lit("2024-01-01").cast("timestamp"))
    return out.select("token_id", F.unix_micros("revoked_at").alias("at"))


def _refreshed(s, d):
    p = read(s, d, "part").select("p_partkey", F.col("p_brand").alias("body"), (F.col("p_size") % 2 == 0).alias("is_system"), F.when(F.col("p_partkey") % 3 == 0, F.lit(1)).alias("updated_at"))
    return pj.refresh_untouched(p, F.lit("Brand#11")).groupBy("body", "refreshed").agg(F.count("*").alias("n"))


def _overrides(s, d):
    defaults = read(s, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("body"))
    files = read(s, d, "part").filter("p_partkey % 4 > 0").select(F.col("p_partkey").alias("name"), F.when(F.col("p_partkey") % 4 == 1, F.col("p_brand")).otherwise("mine").alias("body"))
    return pj.prompt_overrides(files, defaults)


def _results(s, d):
    r = F.array(F.struct(F.lit("system:system").alias("key"), F.col("event_type").alias("value")), F.struct(F.lit("user:7").alias("key"), F.col("props").alias("value")))
    up = state.upsert_result(r, F.when(F.col("event_id") % 2 == 0, "user:7").otherwise("user:9"), F.lit("new"))
    st = pj.downgrade_results(F.transform(r, lambda x: F.struct(x["key"].alias("key"), F.when(x["value"] == "view", "completed").otherwise("failed").alias("status"))))
    paths = F.transform(r, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("path")))
    found = pj.result_for(F.filter(paths, lambda x: x["path"] != "view"), F.lit("system:system"), F.lit("legacy.md"))
    return read(s, d, "events").select("event_id", F.array_join(F.transform(up, lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("results"), F.array_join(F.transform(st, lambda x: x["status"]), ",").alias("statuses"), found.alias("path"))


def _deleted(s, d):
    rows, owners = pj.delete_with_default(read(s, d, "nation").select("n_nationkey"), read(s, d, "customer").select("c_custkey", "c_nationkey"), read(s, d, "nation").filter("n_regionkey = 2").select("n_nationkey"), "n_nationkey", "c_nationkey")
    return owners.groupBy("c_nationkey").agg(F.count("*").alias("n")).unionByName(rows.select(F.col("n_nationkey").alias("c_nationkey"), F.lit(-1).cast("long").alias("n")))


def _long(s, d):
    u = read(s, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.concat("role", F.lit(": "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("text"))
    return pj.cut_long_units(u, 20).groupBy("id").agg(F.count("*").alias("pieces"), F.max("text").alias("last"))


def _notes(s, d):
    raw = F.element_at(F.array(F.concat(F.lit('{"text": "'), "event_type", F.lit('"}')), F.concat(F.lit('{"summary": "'), "event_type", F.lit('"}')), F.col("event_type")), (F.col("event_id") % 3 + 1).cast("int"))
    det = F.element_at(F.array(F.lit('{"probability": 0.5}'), F.lit('{"probabilities": {"click": 0.25, "view": 0.75}}'), F.lit("{}")), (F.col("event_id") % 3 + 1).cast("int"))
    prog = pj.summary_progress(F.col("event_id") % 2 == 0, (F.col("event_id") % 5 - 1).cast("int"), F.when(F.col("event_id") % 4 > 0, F.lit(7)))
    return read(s, d, "events").select("event_id", pj.note_text(raw).alias("note"), pj.detected_probability(det, F.col("event_type")).alias("probability"), prog["current"].alias("current"), prog["total"].alias("total"), F.array_join(pj.model_variants(F.concat(F.lit("Hub/"), F.initcap("event_type"), F.lit(":7b"))), "|").alias("models"))


def _kinds(s, d):
    f = read(s, d, "lineitem").select("l_orderkey", F.concat(F.lit("part."), F.when(F.col("l_returnflag") == "N", "MP4").when(F.col("l_returnflag") == "R", "mkv").otherwise("wav")).alias("name"))
    return pj.set_kinds(f, "l_orderkey", "name", [".mp4", ".mkv"], [".wav"])


def _probes(s, d):
    p = read(s, d, "conversations").select("conv_id", "turn", "role", (F.col("turn") % 4 > 2).alias("stereo"))
    return pj.probe_mismatches(p, "conv_id", "turn", ["role", "stereo"]).select("conv_id", "turn")


def _order(s, d):
    lines = dealt(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey"), "l_orderkey")
    parts = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("x"), F.max("l_partkey").alias("last_modified"))
    parts = parts.select("l_orderkey", "l_linenumber", F.when((F.col("l_orderkey") % 3 > 0) | (F.col("l_linenumber") > 1), F.unix_micros("x")).alias("creation_time"), F.when(F.col("l_orderkey") % 6 > 0, F.col("last_modified")).alias("last_modified"), F.concat(F.lit("rec_"), 20 - F.col("l_linenumber")).alias("filename"))
    return pj.upload_order(parts, "l_orderkey").select("l_orderkey", "l_linenumber", "rule", "position")


def _times(s, d):
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(t, F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.concat(t, F.lit("+02:00"))).when(F.col("event_id") % 4 == 2, t).otherwise("soon")
    return read(s, d, "events").select("event_id", F.unix_micros(pj.parse_time(raw)).alias("at"))


def _inner(s, d):
    seg = F.array(F.struct(F.lit(0.5).alias("start"), F.lit(1.5).alias("end"), F.concat(F.lit(" "), "role").alias("text")), F.struct(F.lit(None).cast("double").alias("start"), F.lit(2.0).alias("end"), F.lit("x").alias("text")), F.struct(F.lit(2.0).alias("start"), F.lit(3.0).alias("end"), F.lit("  ").alias("text")))
    c = read(s, d, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("segment_index"), (F.col("turn") * 300.0).alias("start"), F.struct(seg.alias("segments")).alias("raw_json"))
    return pj.inner_sentences(c).drop("_i")


def _appear(s, d):
    e = view(s, d, "entries").select("task_id", "pos", "speaker")
    return pj.first_appearance([e.filter("task_id % 2 = 0"), e.withColumn("speaker", F.upper("speaker"))])


def _stage(s, d):
    return pj.stage_progress(view(s, d, "steps").withColumnRenamed("event_id", "ord"))


_ENTRIES = cte("entries")
QUERIES = {
    "task_children": (_children, "WITH k AS (SELECT l_orderkey, l_linenumber, CAST(trunc(max(l_quantity)) AS INT) AS q FROM lineitem GROUP BY ALL), g AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || q, ',' ORDER BY l_linenumber) AS c FROM k GROUP BY 1) SELECT o_orderkey, coalesce(c, '') AS children FROM orders LEFT JOIN g ON l_orderkey = o_orderkey"),
    "prompt_refs": (_refs, "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'user/' || user_id || ',' || event_type || '/1' WHEN event_id % 2 = 0 THEN 'system/system' ELSE '' END AS refs FROM events"),
    "delivery_targets": (_targets, "SELECT n_nationkey::BIGINT AS target_id, c_custkey AS task_id, 'raw' AS variant, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_nationkey::BIGINT, c_custkey, 'summary', n_name FROM customer JOIN nation ON c_nationkey + 20 = n_nationkey"),
    "enabled_steps": (
        _steps,
        "SELECT c_custkey AS task_id, 7::BIGINT + CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN c_custkey % 3 > 0 THEN 3 + CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END ELSE 0 END AS n, CASE WHEN c_custkey % 3 = 0 THEN 'merge_transcript' WHEN c_custkey % 5 = 0 THEN 'finalize:b' ELSE 'finalize:a' END AS last FROM customer",
    ),
    "can_restart": (_restart, cte("tasks") + " SELECT task_id, status IN ('completed', 'failed', 'canceled') AND task_id % 4 > 0 AS can FROM tasks"),
    "normalized_turns": (_turns, "SELECT event_id, value AS start, event_type AS speaker FROM events WHERE event_id % 5 > 0 AND event_id % 7 > 0 AND user_id % 3 >= 1"),
    "soft_revoke": (_revoked, "SELECT o_orderkey AS token_id, CASE WHEN o_orderkey % 3 = 0 THEN epoch_us(o_orderdate) WHEN o_orderkey % 2 = 0 THEN epoch_us(TIMESTAMP '2024-01-01') END AS at FROM orders"),
    "refresh_prompts": (_refreshed, "WITH p AS (SELECT p_brand, p_size % 2 = 0 AND p_partkey % 3 > 0 AS u FROM part) SELECT CASE WHEN u THEN 'Brand#11' ELSE p_brand END AS body, u AND p_brand <> 'Brand#11' AS refreshed, count(*) AS n FROM p GROUP BY ALL"),
    "prompt_overrides": (_overrides, "SELECT p_partkey AS name, CASE p_partkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'identical' ELSE 'overridden' END AS state FROM part"),
    "prompt_results": (
        _results,
        """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'system:system=' || event_type || ';user:7=new' ELSE 'system:system=' || event_type || ';user:7=' || props || ';user:9=new' END AS results,
 CASE WHEN event_type = 'view' THEN 'pending,failed' ELSE 'failed,failed' END AS statuses, CASE WHEN event_type = 'view' THEN 'legacy.md' ELSE event_type END AS path FROM events""",
    ),
    "delete_with_default": (_deleted, "WITH c AS (SELECT CASE WHEN n_regionkey = 2 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_nationkey, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT n_nationkey, -1 FROM nation WHERE n_regionkey <> 2"),
    "long_units": (
        _long,
        """WITH u AS (SELECT conv_id || '/' || turn AS id, role, string_split(replace(text, chr(10), ' '), ' ') AS w FROM conversations), k AS (SELECT id, role, w, unnest(range(greatest(1, ceil(len(w) / 19)::INT))) AS k FROM u)
 SELECT id, count(*) AS pieces, max(role || ': ' || array_to_string(w[k * 19 + 1:k * 19 + 19], ' ')) AS last FROM k GROUP BY id""",
    ),
    "notes": (
        _notes,
        """SELECT event_id, event_type AS note, CASE event_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN CASE event_type WHEN 'click' THEN 0.25 WHEN 'view' THEN 0.75 END END::DOUBLE AS probability, CASE WHEN event_id % 2 = 0 AND event_id % 4 > 0 THEN greatest(0, event_id % 5 - 1) ELSE 0 END::INT AS current,
 CASE WHEN event_id % 2 = 0 AND event_id % 4 > 0 THEN 7 ELSE 0 END AS total, 'Hub/' || upper(event_type[1]) || event_type[2:] || ':7b|Hub/' || upper(event_type[1]) || event_type[2:] || '|' || upper(event_type[1]) || event_type[2:] || '|' || event_type AS models FROM events""",
    ),
    "upload_kinds": (_kinds, "SELECT l_orderkey, CASE WHEN bool_and(l_returnflag IN ('N', 'R')) THEN 'video' WHEN bool_or(l_returnflag IN ('N', 'R')) THEN 'error: mixed' ELSE 'audio' END AS kind FROM lineitem GROUP BY 1"),
    "probe_mismatches": (_probes, "WITH f AS (SELECT *, first_value(role) OVER w AS r, first_value(turn % 4 > 2) OVER w AS x FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn FROM f WHERE role <> r OR (turn % 4 > 2) <> x"),
    "upload_order": (
        _order,
        """WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 > 0 OR l_linenumber > 1 THEN epoch_us(max(l_shipdate)) END AS c, CASE WHEN l_orderkey % 6 > 0 THEN max(l_partkey) END AS m FROM lineitem GROUP BY l_orderkey, l_linenumber),
 g AS (SELECT l_orderkey, count(*) = count(DISTINCT c) AS cu, count(*) = count(DISTINCT m) AS mu FROM p GROUP BY 1), r AS (SELECT * FROM p JOIN g USING (l_orderkey)),
 q AS (SELECT *, CASE WHEN cu THEN 'creation_time' WHEN mu THEN 'last_modified' ELSE 'filename' END AS rule FROM r)
 SELECT l_orderkey, l_linenumber, rule, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN cu THEN c END, CASE WHEN rule = 'last_modified' THEN m END, 20 - l_linenumber) AS position FROM q""",
    ),
    "tolerant_times": (_times, "SELECT event_id, CASE event_id % 4 WHEN 1 THEN epoch_us(ts) - 7200000000 WHEN 3 THEN NULL ELSE epoch_us(ts) END AS at FROM events"),
    "inner_sentences": (_inner, 'SELECT conv_id AS task_id, turn AS segment_index, turn * 300.0::DOUBLE + 0.5 AS start, turn * 300.0::DOUBLE + 1.5 AS "end", role AS text FROM conversations'),
    "speaker_order": (
        _appear,
        _ENTRIES + ", f AS (SELECT task_id, CASE WHEN task_id % 2 = 0 THEN speaker ELSE upper(speaker) END AS speaker, min(pos) AS p FROM entries WHERE speaker IS NOT NULL GROUP BY ALL) SELECT task_id, speaker, row_number() OVER (PARTITION BY task_id ORDER BY p, speaker) AS position FROM f",
    ),
    "running_stage": (_stage, cte("steps") + " SELECT task_id, min_by(name, event_id) AS stage FROM steps WHERE status = 'running' GROUP BY 1"),
    "text_lengths": (lambda s, d: read(s, d, "documents").select("doc_id", pj.length_stats(F.concat(F.lit(" \n"), "text", F.lit("\t"))).alias("chars"), tx.render_template(F.lit("${N} of ${S}"), N=F.col("n_chars"), S=F.col("source")).alias("line")), "SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))::INT AS chars, n_chars || ' of ' || source AS line FROM documents"),
}
