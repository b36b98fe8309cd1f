"""Queries on tasks, state tables and deliveries, with their comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import text as tx
from tapeloom.operators import resume, state, tasks
from tapeloom.plans.adapters import cte, deals, read, view

NOW, CUT = "2024-01-20 00:00:00", "1998-06-01 00:00:00"


def _now(s: str = NOW):
    return F.lit(s).cast("timestamp")


def _micros(*cols: str):
    return [F.unix_micros(c).alias(c) for c in cols]


def _counted(df, *keys):
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def _flags(s, d):
    return tasks.with_status_flags(view(s, d, "tasks").select("task_id", "status")).drop("skippable_on_start", "terminal_for_wait")


def _transition(s, d):
    t = view(s, d, "tasks").select("task_id", "status")
    return state.transition(t, t.filter("task_id % 2 = 0"), "task_id", ["queued", "waiting"], "running")


def _step_status(s, d):
    steps = view(s, d, "steps").withColumn("attempt", F.lit(1))
    out = state.step_status(steps, F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "failed"), _now())
    return out.select("event_id", "status", "attempt", *_micros("started_at", "finished_at"))


def _claim(s, d):
    return state.claim_due(view(s, d, "attempts"), _now(CUT), 200).select("attempt_id", "status", "attempts", "claimed")


def _outcomes(s, d):
    a = view(s, d, "attempts")
    what = a.select("attempt_id", F.when(F.col("attempt_id") % 4 == 0, "ok").when(F.col("attempt_id") % 4 == 1, "error").when(F.col("attempt_id") % 4 == 2, "no_adapter").alias("outcome"))
    return state.apply_outcomes(a, what.filter("outcome is not null"), _now()).select("attempt_id", "status", "attempts", *_micros("next_attempt_at"))


def _next_step(s, d):
    steps = view(s, d, "steps")
    last = steps.groupBy("task_id", "name").agg(F.max_by("status", "event_id").alias("status"), F.max_by("artifact", "event_id").alias("artifact"))
    dag = steps.select("task_id").distinct().select("task_id", F.posexplode(F.array(*map(F.lit, ["download", "transcribe_segments", "diarize", "summarize_windows", "final_summary"]))).alias("ord", "name"))
    return state.next_step(last, dag)


# The manifest of an order's lines, and how it is spoilt; both engines build it alike.
_PLANNED = "concat('{\"segments\": [', l, ']}')"
_MANIFEST = f"CASE o_orderkey % 9 WHEN 1 THEN substring({_PLANNED}, 1, 20) WHEN 2 THEN '{{}}' WHEN 3 THEN '[]' WHEN 4 THEN '{{\"segments\": 5}}' WHEN 5 THEN replace({_PLANNED}, '}}]', ', \"more\": 1}}]') ELSE {_PLANNED} END"
_CHUNKS = "CASE o_orderkey % 5 WHEN 0 THEN '{\"diarized\": false}' WHEN 1 THEN '{\"chunks\": []}' WHEN 2 THEN '[\"diarized\"]' WHEN 3 THEN '{\"diarized\"' ELSE concat('{\"diarized\": true, \"n\": ', o_custkey, '}') END"
_WINDOWS = "CASE o_custkey % 4 WHEN 0 THEN '{\"windows\": []}' WHEN 1 THEN '{\"windows\": {}}' WHEN 2 THEN '[[]]' ELSE '{\"windows\": [{\"a\": 1}]}' END"


def _resumed(s, d):
    # Both tables are dealt by task once; all that follows is by task and stays where it is.
    n = deals(read(s, d, "lineitem"))
    o = read(s, d, "orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey")
    lines = view(s, d, "segments").repartition(n, "task_id")
    item = F.concat(F.lit('{"segment_index": '), F.col("segment_index").cast("string"), F.lit("}"))
    listed = lines.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set(item)), ", ").alias("l"))
    all_ = o.join(listed, F.col("task_id") == F.col("o_orderkey"), "left").withColumn("l", F.coalesce("l", F.lit("")))
    file = lambda rows, name, text: rows.selectExpr("o_orderkey AS task_id", f"'{name}' AS name", f"{text} AS text")
    files = file(all_.filter("o_orderkey % 4 > 0"), "outputs/segments_manifest.json", _MANIFEST)
    files = files.unionByName(file(o.filter("o_orderkey % 3 > 0"), "outputs/transcript.json", "NULL")).unionByName(file(o.filter("o_orderkey % 5 > 1"), "outputs/transcript.txt", "NULL"))
    files = files.unionByName(file(o.filter("o_custkey % 3 > 0"), "outputs/speaker_matches.json", "NULL")).unionByName(file(o.filter("o_custkey % 6 > 0"), "summary/chunks.json", _CHUNKS))
    files = files.unionByName(file(o.filter("o_custkey % 7 > 0"), "summary/windows.json", _WINDOWS))
    names = [*resume.STEPS, "summarize_final"]
    dag = o.select(F.col("o_orderkey").alias("task_id"), F.posexplode(F.array(*map(F.lit, names))).alias("ord", "name")).withColumn("enabled", (F.col("task_id") + F.col("ord")) % 8 > 0)
    steps = dag.filter("(task_id + ord) % 11 > 0").select("task_id", "name", F.when((F.col("task_id") * 3 + F.col("ord")) % 7 == 0, "failed").when((F.col("task_id") + F.col("ord")) % 6 == 0, "skipped").otherwise("completed").alias("status"))
    points = resume.resume_points(steps, dag, resume.artifact_done(o.select(F.col("o_orderkey").alias("task_id")), files, lines))
    return points.select("task_id", "next_step", F.array_join("redo", ",").alias("redo"))


_RESUMED_SQL = (
    cte("segments")
    + f""", g AS (SELECT task_id, string_agg('{{"segment_index": ' || segment_index || '}}', ', ' ORDER BY segment_index) AS l FROM (SELECT DISTINCT task_id, segment_index FROM segments) GROUP BY 1),
 o AS (SELECT orders.*, coalesce(l, '') AS l FROM orders LEFT JOIN g ON task_id = o_orderkey),
 f AS (SELECT o_orderkey AS t, CASE WHEN o_orderkey % 4 > 0 THEN {_MANIFEST} END AS m, o_orderkey % 3 > 0 AS j, o_orderkey % 5 > 1 AS x, o_custkey % 3 > 0 AS k, CASE WHEN o_custkey % 6 > 0 THEN {_CHUNKS} END AS c, CASE WHEN o_custkey % 7 > 0 THEN {_WINDOWS} END AS w FROM o),
 v AS (SELECT *, CASE WHEN json_valid(m) THEN m END AS mj, CASE WHEN json_valid(c) THEN c END AS cj, CASE WHEN json_valid(w) THEN w END AS wj FROM f),
 p AS (SELECT t, unnest(json_extract(mj, '$.segments[*].segment_index'))::INT AS i FROM v),
 u AS (SELECT t, count(*) FILTER (NOT EXISTS (SELECT 1 FROM segments s WHERE s.task_id = t AND s.segment_index = i AND s.raw_json = '{{"text": 1}}')) AS lacks FROM p GROUP BY 1),
 a AS (SELECT t, [CASE WHEN m IS NULL THEN j ELSE coalesce(json_type(mj) = 'OBJECT' AND coalesce(json_type(json_extract(mj, '$.segments')), 'ARRAY') = 'ARRAY' AND coalesce(lacks, 0) = 0, false) END, j AND x, k,
  coalesce(json_type(cj) = 'OBJECT' AND list_contains(json_keys(cj), 'diarized'), false), coalesce(json_type(wj) = 'OBJECT' AND json_type(json_extract(wj, '$.windows')) = 'ARRAY', false), true] AS a FROM v f LEFT JOIN u USING (t)),
 e AS (SELECT t, unnest(range(6)) AS ord, a FROM a),
 s AS (SELECT t, ord, a[ord + 1] AS whole, (t + ord) % 8 > 0 AS enabled, CASE WHEN (t + ord) % 11 = 0 THEN NULL WHEN (t * 3 + ord) % 7 = 0 THEN 'failed' WHEN (t + ord) % 6 = 0 THEN 'skipped' ELSE 'completed' END AS status FROM e),
 n AS (SELECT *, ['transcribe_segments', 'merge_transcript', 'match_speakers', 'prepare_summary_chunks', 'summarize_windows', 'summarize_final'][ord + 1] AS name, NOT enabled OR coalesce(status = 'skipped', false) AS off, coalesce(status = 'completed', false) AS done FROM s)
 SELECT t AS task_id, min_by(name, ord) FILTER (NOT off AND NOT (done AND whole)) AS next_step, coalesce(string_agg(name, ',' ORDER BY ord) FILTER (NOT off AND done AND NOT whole), '') AS redo FROM n GROUP BY 1"""
)

# A session's folder and sidecar for each event, and how they are spoilt.
_FOLDER = "concat('/u', user_id, '/', CASE event_id % 13 WHEN 1 THEN md5(CAST(event_id AS VARCHAR(20))) WHEN 2 THEN upper(md5(CAST(event_id AS VARCHAR(20)))) WHEN 3 THEN substring(md5(CAST(event_id AS VARCHAR(20))), 1, 31) ELSE regexp_replace(md5(CAST(event_id - event_id % 26 % 2 AS VARCHAR(20))), '^(.{8})(.{4})(.{4})(.{4})', '{1}-{2}-{3}-{4}-') END)"
_TIME = "CASE event_id % 5 WHEN 0 THEN 'T00:00:00+00:00' WHEN 1 THEN ' 12:30:00' WHEN 2 THEN '' WHEN 3 THEN 'T23:59:59.5Z' ELSE 'T05:00:00-05:00' END"
_SIDECAR = f"CASE event_id % 17 WHEN 1 THEN NULL WHEN 2 THEN '{{' WHEN 3 THEN '[]' WHEN 4 THEN '{{\"created_at\": 5}}' WHEN 5 THEN '{{\"created_at\": \"soon\"}}' WHEN 6 THEN props ELSE concat('{{\"created_at\": \"', day, {_TIME}, '\", \"n\": ', event_id, '}}') END"


def _spark_groups(sql: str) -> str:
    return sql.replace("'{1}-{2}-{3}-{4}-'", "'$1-$2-$3-$4-'")


def _abandoned(s, d):
    e = read(s, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).selectExpr(f"{_spark_groups(_FOLDER)} AS folder", f"{_SIDECAR} AS text")
    live = read(s, d, "events").filter("event_id % 10 = 7").select(F.md5(F.col("event_id").cast("string").cast("binary")).alias("task_id"))
    return resume.abandoned_sessions(e, live, _now("2024-01-15 00:00:00"), 5 * 86400)


_ABANDONED_SQL = f"""WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events), c AS (SELECT {_FOLDER.replace("'{1}-{2}-{3}-{4}-'", chr(39) + chr(92) + "1-" + chr(92) + "2-" + chr(92) + "3-" + chr(92) + "4-" + chr(39))} AS folder, {_SIDECAR} AS text FROM e),
 j AS (SELECT folder, CASE WHEN json_valid(text) THEN text END AS text FROM c),
 n AS (SELECT folder, replace(lower(split_part(folder, '/', 3)), '-', '') AS id, CASE WHEN json_type(text) = 'OBJECT' AND json_type(json_extract(text, '$.created_at')) = 'VARCHAR' THEN json_extract_string(text, '$.created_at') END AS made FROM j),
 t AS (SELECT folder, id, CASE WHEN regexp_matches(made, '[Z0-9]$') AND NOT regexp_matches(made, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN TRY_CAST(made || CASE WHEN length(made) = 10 THEN ' 00:00:00' ELSE '' END || '+00' AS TIMESTAMPTZ) ELSE TRY_CAST(made AS TIMESTAMPTZ) END AS made FROM n WHERE regexp_full_match(id, '[0-9a-f]{{32}}')),
 o AS (SELECT id, count(*) AS k, max(folder) AS folder, max(made) AS made FROM t GROUP BY id)
 SELECT regexp_replace(id, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '\\1-\\2-\\3-\\4-') AS upload_id, folder FROM o WHERE k = 1 AND made <= TIMESTAMPTZ '2024-01-10 00:00:00+00' AND id NOT IN (SELECT md5(event_id::VARCHAR) FROM events WHERE event_id % 10 = 7)"""


def _orphaned(s, d):
    jobs = read(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("job_id"), F.col("l_partkey").alias("task_id"))
    return resume.orphaned_jobs(jobs, view(s, d, "tasks")).groupBy("task_id").agg(F.count("*").alias("jobs"), F.min("job_id").alias("first"))


def _merge_keys(s, d):
    names = read(s, d, "nation").select(F.col("n_nationkey").alias("old"), F.col("n_regionkey").alias("new"))
    return state.merge_keys(read(s, d, "supplier").select("s_suppkey", "s_nationkey"), names, "s_nationkey")


def _fill(s, d):
    p = read(s, d, "part").select(F.col("p_size").alias("idx"), "p_partkey").groupBy("idx").agg(F.min("p_partkey").alias("v"))
    f = read(s, d, "supplier").select((F.col("s_suppkey") % 80).cast("int").alias("idx"), F.col("s_suppkey").alias("v")).groupBy("idx").agg(F.max("v").alias("v"))
    return state.fill_gaps(p.filter("idx % 3 > 0"), f, "idx", 60)


def _upsert(s, d):
    base = read(s, d, "customer").select("c_custkey", "c_nationkey")
    new = base.filter("c_custkey % 5 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit(-1).alias("c_nationkey"))
    return state.upsert(base, new, ["c_custkey"])


def _insert(s, d):
    base = read(s, d, "customer").select("c_custkey", "c_nationkey")
    new = base.select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit(-1).alias("c_nationkey"))
    return state.insert_if_absent(base, new, ["c_custkey"])


def _donor(s, d):
    return tasks.donor(view(s, d, "tasks"), "https://host.example/7", 3, '{ "k":48}').unionByName(tasks.donor(view(s, d, "tasks"), "file://rec/9", 5, '{"k" : 11}')).select("task_id", "url")


def _spelled(s, d):
    """Tasks with nested options; the askers spell theirs in another key order and with other numbers."""
    base = read(s, d, "events").select(
        F.col("event_id").alias("task_id"), (F.col("user_id") % 7).alias("user_id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 4 > 0, "completed").otherwise("queued").alias("status"),
        F.concat(F.lit("u"), F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("event_id") % 40).cast("string")).alias("url"), (F.col("event_id") % 5).cast("string").alias("k"))
    one = F.concat(F.lit('{"lang": "de", "steps": {"n": '), "k", F.lit(', "list": [1, {"a": 1.50, "b": "1.0"}]}}'))
    two = F.concat(F.lit('{"steps":{"list":[1.0,{"b":"1.0","a":1.5}],"n":'), "k", F.lit('.0},"lang":"de"}'))
    return base.withColumn("options", F.when(F.col("status") == "completed", one).otherwise(F.when(F.col("task_id") % 8 == 0, two).otherwise(F.concat(F.lit("{"), "k"))))


def _donors(s, d):
    t = _spelled(s, d)
    return tasks.donors(t.filter("status = 'queued'"), t)


_DONORS_SQL = """WITH t AS (SELECT event_id AS task_id, user_id % 7 AS user_id, ts AS created_at, event_id % 4 > 0 AS done, 'u' || CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 40 END AS url, event_id % 5 AS k FROM events),
 p AS (SELECT a.task_id, c.task_id AS donor_id, c.k = a.k AND a.task_id % 8 = 0 AS same, row_number() OVER (PARTITION BY a.task_id ORDER BY c.created_at DESC, c.task_id DESC) AS r
  FROM t a JOIN t c ON c.url = a.url AND c.done AND NOT a.done AND c.user_id <> a.user_id),
 b AS (SELECT task_id, min_by(donor_id, r) AS donor_id FROM p WHERE r <= 20 AND same GROUP BY 1)
 SELECT t.task_id, donor_id FROM t LEFT JOIN b ON b.task_id = t.task_id WHERE NOT done"""


def _wait(s, d):
    e = read(s, d, "events").select(F.col("user_id").alias("task_id"), "ts", "event_id", F.col("event_type").alias("event"))
    return tasks.wait_until(e, _now("2024-01-02 00:00:00"), F.col("event").isin("purchase", "error"))


def _resolved(s, d):
    t = view(s, d, "tasks").select("task_id", F.concat(F.element_at(F.array(*map(F.lit, ["raw", "summary", "source:7", "bad"])), (F.col("task_id") % 4 + 1).cast("int"))).alias("variant"))
    ref = tx.parse_ref(F.col("variant"))
    kind = F.when(F.col("variant") == "raw", "transcript.txt").when(F.col("variant") == "summary", "summary.md").when(ref.isNotNull(), F.concat(ref["source"], F.lit("/"), ref["id"]))
    return t.select("task_id", kind.alias("artifact"), kind.isNull().alias("missing"))


def _retained(s, d):
    files = read(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("mtime"))
    keep = read(s, d, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").cast("string").alias("path"))
    return state.retained_files(files, keep, _now(CUT), 240).select("path")


_T = cte("tasks")
_A = cte("attempts")
QUERIES = {
    "flt_search": (lambda s, d: tasks.filter_tasks(view(s, d, "tasks"), q='VIEW {"k": 8').select("task_id", "title"), _T + """ SELECT task_id, title FROM tasks WHERE contains(lower(title), 'view {"k": 8') OR contains(lower(url), 'view {"k": 8')"""),
    "flt_range_source": (
        lambda s, d: _counted(tasks.filter_tasks(view(s, d, "tasks"), created_from="2024-01-05", created_to="2024-01-12", source_type="url", status=["queued", "failed"]), "user_id", "status"),
        _T + " SELECT user_id, status, count(*) AS n FROM tasks WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-12' AND NOT starts_with(url, 'file://') AND status IN ('queued', 'failed') GROUP BY ALL",
    ),
    "flt_file_source": (lambda s, d: _counted(tasks.filter_tasks(view(s, d, "tasks"), source_type="file"), "status"), _T + " SELECT status, count(*) AS n FROM tasks WHERE starts_with(url, 'file://') GROUP BY ALL"),
    "status_flags": (
        _flags,
        _T + " SELECT task_id, status, " + ", ".join(f"status IN ({', '.join(repr(x) for x in sorted(v))}) AS {k}" for k, v in tasks.GROUPS.items() if k not in ("skippable_on_start", "terminal_for_wait")) + " FROM tasks",
    ),
    "delivery_flags": (lambda s, d: tasks.with_status_flags(view(s, d, "attempts").select("attempt_id", "status"), groups=tasks.DELIVERY_GROUPS), _A + " SELECT attempt_id, status, " + ", ".join(f"status IN ({', '.join(repr(x) for x in sorted(v))}) AS {k}" for k, v in tasks.DELIVERY_GROUPS.items()) + " FROM attempts"),
    "keyset_page": (lambda s, d: tasks.page(view(s, d, "tasks"), 50, before=("2024-01-15 00:00:00", 500)).select("task_id", "status"), _T + " SELECT task_id, status FROM tasks WHERE (created_at, task_id) < (TIMESTAMP '2024-01-15', 500) ORDER BY created_at DESC, task_id DESC LIMIT 50"),
    "page_with_more": (lambda s, d: tasks.page_with_more(view(s, d, "tasks"), 20, after=("2024-01-10 00:00:00", 7), ascending=True).select("task_id", "has_more"), _T + " SELECT task_id, true AS has_more FROM tasks WHERE (created_at, task_id) > (TIMESTAMP '2024-01-10', 7) ORDER BY created_at, task_id LIMIT 20"),
    "newest_offset": (lambda s, d: tasks.newest(view(s, d, "tasks"), 30, 10).select("task_id"), _T + " SELECT task_id FROM tasks ORDER BY created_at DESC, task_id DESC LIMIT 30 OFFSET 10"),
    "sort_title": (lambda s, d: tasks.sort_by(view(s, d, "tasks"), "title", 40).select("task_id", "title"), _T + " SELECT task_id, title FROM tasks ORDER BY title, task_id LIMIT 40"),
    "cursor_codec": (
        lambda s, d: view(s, d, "tasks").select("task_id", tasks.encode_cursor(F.col("created_at"), F.col("task_id")).alias("cursor")).withColumn("back", tasks.decode_cursor(F.col("cursor"))).select("task_id", "cursor", F.unix_micros("back.created_at").alias("at"), F.col("back.task_id").alias("id")),
        _T + " SELECT task_id, rtrim(translate(base64(encode(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '|' || task_id)), '+/=', '-_ ')) AS cursor, epoch_us(created_at) AS at, CAST(task_id AS VARCHAR) AS id FROM tasks",
    ),
    "queue_positions": (lambda s, d: tasks.queue_positions(view(s, d, "tasks")), _T + " SELECT task_id, row_number() OVER (ORDER BY created_at, task_id) AS position FROM tasks WHERE status = 'queued'"),
    "asr_progress": (lambda s, d: tasks.asr_progress(view(s, d, "segments")), cte("segments") + " SELECT task_id, count(*) FILTER (raw_json NOT IN ('{}', 'null')) AS done, count(*) AS total FROM segments GROUP BY task_id"),
    "count_by_status": (lambda s, d: tasks.count_by(view(s, d, "tasks"), "user_id", "status"), _T + " SELECT user_id, status, count(*) AS n FROM tasks GROUP BY ALL"),
    "users_completed": (lambda s, d: tasks.users_with(view(s, d, "tasks")), _T + " SELECT DISTINCT user_id FROM tasks WHERE status = 'completed'"),
    "donor": (
        _donor,
        _T
        + """, c AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY created_at DESC, task_id DESC) AS r FROM tasks WHERE status = 'completed' AND (url = 'https://host.example/7' AND user_id <> 3 OR url = 'file://rec/9' AND user_id <> 5)),
 m AS (SELECT * FROM c WHERE r <= 20 AND options = CASE url WHEN 'file://rec/9' THEN '{"k": 11}' ELSE '{"k": 48}' END) SELECT task_id, url FROM m QUALIFY row_number() OVER (PARTITION BY url ORDER BY r) = 1""",
    ),
    "donors": (_donors, _DONORS_SQL),
    "resume_points": (_resumed, _RESUMED_SQL),
    "abandoned_sessions": (_abandoned, _ABANDONED_SQL),
    "orphaned_jobs": (_orphaned, _T + " SELECT l_partkey AS task_id, count(*) AS jobs, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem WHERE l_partkey NOT IN (SELECT task_id FROM tasks WHERE status IN ('running', 'waiting')) GROUP BY 1"),
    "lane_positions": (
        lambda s, d: tasks.public_lane_positions(view(s, d, "queue")).select("lane", "task_id", "position"),
        cte("queue") + ", f AS (SELECT * FROM queue QUALIFY row_number() OVER (PARTITION BY lane, task_id ORDER BY priority, pos) = 1) SELECT lane, task_id, row_number() OVER (PARTITION BY lane ORDER BY priority, pos, task_id) AS position FROM f",
    ),
    "wait_until": (_wait, "SELECT user_id AS task_id, coalesce(min_by(event_type, (ts, event_id)) FILTER (event_type IN ('purchase', 'error') AND ts <= TIMESTAMP '2024-01-02'), 'timeout') AS outcome FROM events GROUP BY user_id"),
    "resolve_variant": (_resolved, _T + ", v AS (SELECT task_id, CASE task_id % 4 WHEN 0 THEN 'transcript.txt' WHEN 1 THEN 'summary.md' WHEN 2 THEN 'source/7' END AS artifact FROM tasks) SELECT task_id, artifact, artifact IS NULL AS missing FROM v"),
    "dml_insert_if_absent": (_insert, "SELECT c_custkey, c_nationkey FROM customer UNION ALL SELECT 2 * c_custkey, -1 FROM customer WHERE 2 * c_custkey NOT IN (SELECT c_custkey FROM customer)"),
    "dml_upsert": (_upsert, "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT 2 * c_custkey FROM customer WHERE c_custkey % 5 = 0) UNION ALL SELECT 2 * c_custkey, -1 FROM customer WHERE c_custkey % 5 = 0"),
    "dml_delete": (lambda s, d: state.delete(read(s, d, "customer").select("c_custkey", "c_nationkey"), read(s, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), ["c_nationkey"]), "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "dml_transition": (_transition, _T + " SELECT task_id, task_id % 2 = 0 AND status IN ('queued', 'waiting') AS changed, CASE WHEN task_id % 2 = 0 AND status IN ('queued', 'waiting') THEN 'running' ELSE status END AS status FROM tasks"),
    "dml_step_status": (
        _step_status,
        cte("steps")
        + f" SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE status END AS status, CASE event_id % 3 WHEN 0 THEN 2 ELSE 1 END AS attempt, epoch_us(CASE event_id % 3 WHEN 0 THEN TIMESTAMP '{NOW}' ELSE started_at END) AS started_at, epoch_us(CASE event_id % 3 WHEN 1 THEN TIMESTAMP '{NOW}' ELSE finished_at END) AS finished_at FROM steps",
    ),
    "dml_clone": (lambda s, d: state.clone_rows(read(s, d, "customer").select("c_custkey", "c_nationkey"), 3, 99, "c_nationkey"), "SELECT c_custkey, c_nationkey FROM customer UNION ALL SELECT c_custkey, 99 FROM customer WHERE c_nationkey = 3"),
    "dml_merge_keys": (_merge_keys, "SELECT s_suppkey, n_regionkey AS s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "dml_requeue_active": (lambda s, d: state.requeue_active(view(s, d, "tasks")).select("task_id", "status", "error"), _T + " SELECT task_id, CASE WHEN status IN ('running', 'waiting') THEN 'queued' ELSE status END AS status, CASE WHEN status NOT IN ('running', 'waiting') THEN error END AS error FROM tasks"),
    "dml_dequeue": (lambda s, d: state.dequeue(view(s, d, "tasks"), 5).select("task_id"), _T + " SELECT task_id FROM tasks WHERE status = 'queued' ORDER BY created_at, task_id LIMIT 5"),
    "delivery_claim": (
        _claim,
        _A + f", c AS (SELECT attempt_id FROM attempts WHERE status IN ('pending', 'waiting_adapter') AND next_attempt_at <= TIMESTAMP '{CUT}' ORDER BY next_attempt_at, attempt_id LIMIT 200) SELECT attempt_id, CASE WHEN c.attempt_id IS NULL THEN status ELSE 'delivering' END AS status, attempts + (c.attempt_id IS NOT NULL)::INT AS attempts, c.attempt_id IS NOT NULL AS claimed FROM attempts LEFT JOIN c USING (attempt_id)",
    ),
    "delivery_outcomes": (
        _outcomes,
        _A
        + f""" SELECT attempt_id, CASE attempt_id % 4 WHEN 0 THEN 'delivered' WHEN 1 THEN CASE WHEN attempts >= 5 THEN 'dead' ELSE 'pending' END WHEN 2 THEN 'waiting_adapter' ELSE status END AS status,
 CASE attempt_id % 4 WHEN 2 THEN greatest(0, attempts - 1) ELSE attempts END AS attempts,
 CASE WHEN attempt_id % 4 = 2 OR attempt_id % 4 = 1 AND attempts < 5 THEN epoch_us(TIMESTAMP '{NOW}') + CAST(least(60 * pow(2, greatest(0, attempts - 1)), 3600) * 1000000 AS BIGINT) ELSE epoch_us(next_attempt_at) END AS next_attempt_at FROM attempts""",
    ),
    "delivery_reap": (lambda s, d: state.reap_stuck(view(s, d, "attempts"), _now(CUT)).select("attempt_id", "status"), _A + f" SELECT attempt_id, CASE WHEN status = 'delivering' AND updated_at < TIMESTAMP '{CUT}' THEN 'pending' ELSE status END AS status FROM attempts"),
    "delivery_revive": (lambda s, d: state.revive_dead(view(s, d, "attempts"), _now()).select("attempt_id", "status", "attempts"), _A + " SELECT attempt_id, CASE status WHEN 'dead' THEN 'pending' ELSE status END AS status, CASE status WHEN 'dead' THEN 0 ELSE attempts END AS attempts FROM attempts"),
    "next_step": (
        _next_step,
        cte("steps")
        + """, l AS (SELECT task_id, name, max_by(status, event_id) AS status, max_by(artifact, event_id) AS artifact FROM steps GROUP BY ALL),
 d AS (SELECT task_id, unnest([0, 1, 2, 3, 4]) AS ord, unnest(['download', 'transcribe_segments', 'diarize', 'summarize_windows', 'final_summary']) AS name FROM (SELECT DISTINCT task_id FROM steps))
 SELECT task_id, min_by(name, ord) AS next_step FROM d LEFT JOIN l USING (task_id, name) WHERE NOT coalesce(status = 'completed' AND artifact OR status = 'skipped', false) GROUP BY task_id""",
    ),
    "missing_segments": (
        lambda s, d: state.missing_segments(read(s, d, "orders").select(F.col("o_orderkey").alias("k")), read(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), ["k"]),
        "SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    ),
    "duplicate_keys": (lambda s, d: state.duplicate_keys(view(s, d, "segments"), ["task_id", "segment_index"]), cte("segments") + " SELECT task_id, segment_index, count(*) AS n FROM segments GROUP BY ALL HAVING count(*) > 1"),
    "orphans": (lambda s, d: state.orphans(read(s, d, "documents").select("doc_id"), read(s, d, "labels"), "doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "fill_gaps": (
        _fill,
        """WITH p AS (SELECT p_size AS idx, min(p_partkey) AS v FROM part GROUP BY 1), f AS (SELECT CAST(s_suppkey % 80 AS INT) AS idx, max(s_suppkey) AS v FROM supplier GROUP BY 1),
 q AS (SELECT * FROM p WHERE idx % 3 > 0) SELECT idx, coalesce(q.v, f.v) AS v FROM q FULL JOIN f USING (idx) WHERE idx BETWEEN 1 AND 60""",
    ),
    "retained_files": (_retained, f"SELECT CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE o_orderkey % 10 = 0 OR epoch_us(TIMESTAMP '{CUT}') - epoch_us(o_orderdate) < 240 * 3600000000"),
    "live_flags": (
        lambda s, d: state.live_flags(read(s, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("kind"), "ts").filter("ts <= timestamp'2024-01-20'"), _now()).select("task_id", "kind", *_micros("ts")),
        f"SELECT user_id AS task_id, event_type AS kind, epoch_us(max(ts)) AS ts FROM events WHERE ts <= TIMESTAMP '{NOW}' AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) < 3600000000 GROUP BY ALL",
    ),
}
