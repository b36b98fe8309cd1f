"""Queries on whole operations, with their comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import text as tx
from tapeloom.operators import compositions as co
from tapeloom.operators import tasks as tk
from tapeloom.plans.adapters import cte, read, view
from tapeloom.plans.transcripts import _runs_cut, _SAID, _SENT, _strip

_SHIFT, _SILENCE, _MIN_WORDS, _MIN_SECONDS, _MIN_SHARE = 80, 15, 3, 8.0, 0.2


def _local_words(s, d):
    """Words of each entry on its own clock, four seconds apart; the first of some entries has no time.

    In every other recording they are subwords: a leading space marks where a word begins, and some tokens are blank.
    """
    w = read(s, d, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("pos"), F.posexplode(F.split("text", " ")).alias("word_pos", "word"))
    lost = (F.col("task_id") % 4 == 0) & (F.col("pos") % 3 == 0) & (F.col("word_pos") == 0)
    part = (F.col("task_id") % 2 == 0) & (F.col("word_pos") % 3 > 0)
    w = w.withColumn("word", F.when(F.col("word_pos") % 17 == 5, " ").when(part, F.concat(F.lit(" "), "word")).otherwise(F.col("word")))
    return w.withColumns({"start": F.when(~lost, F.col("word_pos") * 4.0), "end": F.col("word_pos") * 4.0 + 3.5})


def _shifted_turns(s, d):
    """Turns with silence between them, so that some words overlap none."""
    return view(s, d, "turns").withColumns({"start": F.col("start") + _SHIFT, "end": F.greatest("start", F.col("end") - _SILENCE) + _SHIFT})


def _split(s, d):
    return co.split_entries(view(s, d, "entries"), _local_words(s, d), _shifted_turns(s, d), _MIN_WORDS, _MIN_SECONDS)


def _people(s, d):
    return read(s, d, "conversations").select(F.col("conv_id").alias("task_id"), F.col("role").alias("speaker")).distinct().filter("task_id % 3 = 0 and speaker = 'user'").withColumn("name", F.concat(F.lit("Person "), F.col("task_id")))


def _dialogue(s, d):
    entries = view(s, d, "entries").withColumn("text", F.when(F.col("task_id") % 3 == 0, F.concat(F.repeat(F.lit("Thank you. "), 7), "text")).otherwise(F.col("text")))
    return co.diarized(entries, _local_words(s, d), _shifted_turns(s, d), _people(s, d), _MIN_WORDS, _MIN_SECONDS, _MIN_SHARE)


def _split_sql(entries: str) -> str:
    return (
        cte("turns")
        + f""", {entries}, t AS (SELECT task_id, seg_pos, speaker, start + {_SHIFT} AS start, greatest(start, "end" - {_SILENCE}) + {_SHIFT} AS "end" FROM turns),
 lx AS (SELECT conv_id AS task_id, turn AS pos, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM conversations),
 lw AS (SELECT task_id, pos, i, CASE WHEN i % 17 = 5 THEN ' ' WHEN task_id % 2 = 0 AND i % 3 > 0 THEN ' ' || x ELSE x END AS word FROM lx),
 ti AS (SELECT *, task_id % 4 = 0 AND pos % 3 = 0 AND i = 0 AS lost, i * 4.0::DOUBLE AS start, i * 4.0::DOUBLE + 3.5 AS "end" FROM lw),
 us AS (SELECT * FROM ti QUALIFY NOT bool_or(lost) OVER (PARTITION BY task_id, pos)),
 mk AS (SELECT *, bool_or(starts_with(word, ' ')) OVER (PARTITION BY task_id, pos) AS mk FROM us),
 op AS (SELECT *, (NOT mk OR starts_with(word, ' ') OR row_number() OVER (PARTITION BY task_id, pos ORDER BY i) = 1)::INT AS op FROM mk WHERE regexp_replace(word, '\\s', '', 'g') <> ''),
 wn AS (SELECT *, sum(op) OVER (PARTITION BY task_id, pos ORDER BY i ROWS UNBOUNDED PRECEDING) AS wn FROM op),
 gl AS (SELECT task_id, pos, wn AS i, string_agg(regexp_replace(word, '^\\s+|\\s+$', '', 'g'), '' ORDER BY i) AS word, min_by(start, i) AS start, max_by("end", i) AS "end" FROM wn GROUP BY ALL),
 sh AS (SELECT u.task_id, u.pos, i, word, u.start + e.start AS start, u."end" + e.start AS "end" FROM gl u JOIN entries e ON e.task_id = u.task_id AND e.pos = u.pos WHERE u."end" > 0 AND u.start + e.start < e."end"),
 me AS (SELECT s.task_id, s.pos, s.i, t.speaker, t.seg_pos, least(s."end", t."end") - greatest(s.start, t.start) AS ov FROM sh s JOIN t ON t.task_id = s.task_id),
 be AS (SELECT task_id, pos, i, max_by(speaker, (ov, -seg_pos)) AS speaker FROM me WHERE ov > 0 GROUP BY ALL),
 ne AS (SELECT s.task_id, s.pos, s.i, min_by(t.speaker, (least(abs((s.start + s."end") / 2 - t.start), abs((s.start + s."end") / 2 - t."end")), t.seg_pos)) AS near FROM sh s JOIN t ON t.task_id = s.task_id GROUP BY ALL),
 aw AS (SELECT sh.*, coalesce(speaker, near) AS speaker FROM sh LEFT JOIN be USING (task_id, pos, i) LEFT JOIN ne USING (task_id, pos, i)),
 f AS (SELECT *, last_value(speaker IGNORE NULLS) OVER (PARTITION BY task_id, pos ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM aw),
 c AS (SELECT *, (row_number() OVER p = 1 OR k IS DISTINCT FROM lag(k) OVER p)::INT AS ch FROM f WINDOW p AS (PARTITION BY task_id, pos ORDER BY i)),
 il AS (SELECT *, sum(ch) OVER (PARTITION BY task_id, pos ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM c),
 g AS (SELECT task_id, pos, island, any_value(k) AS speaker, count(*) AS n_words, min_by(start, i) AS start, max_by("end", i) AS "end", string_agg(word, ' ' ORDER BY i) AS text FROM il GROUP BY ALL),
 z AS (SELECT *, n_words >= {_MIN_WORDS} AND "end" - start >= {_MIN_SECONDS} AND speaker IS NOT NULL AS big FROM g),
 y AS (SELECT *, coalesce(bool_or(big) OVER b, false) AS bb, coalesce(bool_or(speaker IS NULL) OVER b, false) AS nb FROM z WINDOW b AS (PARTITION BY task_id, pos ORDER BY island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 a AS (SELECT *, CASE WHEN big OR speaker IS NULL AND NOT bb AND NOT nb THEN island END AS anchor FROM y),
 q AS (SELECT *, coalesce(last_value(anchor IGNORE NULLS) OVER (PARTITION BY task_id, pos ORDER BY island ROWS UNBOUNDED PRECEDING), first_value(anchor IGNORE NULLS) OVER (PARTITION BY task_id, pos ORDER BY island ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM a),
 u AS (SELECT task_id, pos, q, max(CASE WHEN island = q THEN speaker END) AS speaker, min_by(start, island) AS start, max_by("end", island) AS "end", string_agg(text, ' ' ORDER BY island) AS text FROM q WHERE q IS NOT NULL GROUP BY ALL),
 v AS (SELECT *, (row_number() OVER p = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER p)::INT AS ch FROM u WINDOW p AS (PARTITION BY task_id, pos ORDER BY q)),
 m AS (SELECT *, sum(ch) OVER (PARTITION BY task_id, pos ORDER BY q ROWS UNBOUNDED PRECEDING) AS run FROM v),
 gr AS (SELECT task_id, pos, run, any_value(speaker) AS speaker, min_by(start, q) AS start, max_by("end", q) AS "end", string_agg(text, ' ' ORDER BY q) AS text FROM m GROUP BY ALL),
 n AS (SELECT task_id, pos, count(*) AS n, any_value(speaker) AS own FROM gr GROUP BY ALL),
 eo AS (SELECT e.task_id, e.pos, max_by(t.speaker, (least(e."end", t."end") - greatest(e.start, t.start), -t.seg_pos)) AS sp FROM entries e JOIN t ON t.task_id = e.task_id
  WHERE least(e."end", t."end") - greatest(e.start, t.start) > 0 OR e.start = e."end" AND e.start BETWEEN t.start AND t."end" GROUP BY ALL)
 SELECT task_id, pos, CAST(row_number() OVER (PARTITION BY task_id, pos ORDER BY run) - 1 AS INT) AS part, speaker, start, "end", text FROM gr JOIN n USING (task_id, pos) WHERE n > 1
 UNION ALL SELECT e.task_id, e.pos, 0, coalesce(own, sp), e.start, e."end", e.text FROM entries e LEFT JOIN n ON n.task_id = e.task_id AND n.pos = e.pos LEFT JOIN eo ON eo.task_id = e.task_id AND eo.pos = e.pos WHERE coalesce(n, 0) <= 1"""
    )


def _entries_sql(extra: str = "text") -> str:
    return cte("entries").removeprefix("WITH ").replace("AS (SELECT ", "AS (SELECT * REPLACE (" + extra + " AS text) FROM (SELECT ", 1) + ")"


_SPLIT_SQL = _split_sql(_entries_sql())
_CLEAN_SQL = (
    "WITH es AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY pos, part) - 1 AS pos, speaker, start, \"end\", text FROM ("
    + _split_sql(_entries_sql("CASE WHEN task_id % 3 = 0 THEN repeat('Thank you. ', 7) || text ELSE text END"))
    + ")), ff AS (SELECT task_id, pos, unnest(l) AS s, generate_subscripts(l, 1) AS j FROM (SELECT task_id, pos, "
    + _SAID
    + " AS l FROM es)), "
    + _runs_cut("SELECT task_id AS id, pos * 1000000 + j AS i, s FROM ff")
    + """, own AS (SELECT id AS task_id, i // 1000000 AS pos, string_agg(s, ' ' ORDER BY i) AS t FROM kept GROUP BY ALL),
 tr AS (SELECT es.task_id, es.pos, es.speaker, es.start, es."end", coalesce(t, es.text) AS text FROM es LEFT JOIN own ON own.task_id = es.task_id AND own.pos = es.pos WHERE t IS NOT NULL OR es.task_id NOT IN (SELECT task_id FROM own)),
 sp AS (SELECT task_id, speaker, sum("end" - start) AS x, min(pos) AS p FROM tr WHERE speaker IS NOT NULL GROUP BY ALL),
 mg AS (SELECT task_id, speaker, x / sum(x) OVER (PARTITION BY task_id) AS share, first_value(speaker) OVER (PARTITION BY task_id ORDER BY x DESC, p) AS top FROM sp),
 cl AS (SELECT tr.task_id, tr.pos, CASE WHEN share < """
    + str(_MIN_SHARE)
    + """ THEN top ELSE tr.speaker END AS speaker, tr.start, tr."end", tr.text FROM tr LEFT JOIN mg ON mg.task_id = tr.task_id AND mg.speaker = tr.speaker)"""
)
_RENDER_SQL = (
    _CLEAN_SQL
    + """, names AS (SELECT DISTINCT conv_id AS task_id, role AS speaker, 'Person ' || conv_id AS name FROM conversations WHERE conv_id % 3 = 0 AND role = 'user'),
 fi AS (SELECT task_id, speaker, min(pos) AS p FROM cl WHERE speaker IS NOT NULL GROUP BY ALL), lb AS (SELECT fi.task_id, fi.speaker, coalesce(name, 'Speaker ' || row_number() OVER (PARTITION BY fi.task_id ORDER BY p, fi.speaker)) AS label FROM fi LEFT JOIN names n ON n.task_id = fi.task_id AND n.speaker = fi.speaker),
 tt AS (SELECT cl.task_id, pos, cl.speaker, label, """
    + _strip("text")
    + """ AS text FROM cl LEFT JOIN lb ON lb.task_id = cl.task_id AND lb.speaker = cl.speaker),
 ch AS (SELECT *, (row_number() OVER p = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER p)::INT AS ch FROM tt WHERE text <> '' WINDOW p AS (PARTITION BY task_id ORDER BY pos)), ru AS (SELECT *, sum(ch) OVER (PARTITION BY task_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ru FROM ch),
 bl AS (SELECT task_id, ru, any_value(label) AS label, string_agg(text, ' ' ORDER BY pos) AS t FROM ru GROUP BY ALL)
 SELECT task_id, md5(CASE WHEN count(DISTINCT label) > 1 THEN string_agg(CASE WHEN label IS NULL THEN t ELSE label || ': ' || t END, chr(10) || chr(10) ORDER BY ru) ELSE string_agg(t, ' ' ORDER BY ru) END) AS h FROM bl GROUP BY 1"""
)


def _stats(s, d):
    return read(s, d, "documents").select(F.col("doc_id").alias("task_id"), F.length("text").alias("transcript_chars"), F.when(F.col("doc_id") % 2 == 0, F.octet_length("text")).alias("media_bytes"))


def _rows(s, d):
    tasks = view(s, d, "tasks").withColumn("error", F.when(F.col("task_id") % 7 == 0, "Premieres in 3 hours").otherwise(F.col("error")))
    done = read(s, d, "events").select(F.col("event_id").alias("task_id"), F.lit(3).alias("done"), F.lit(4).alias("total")).filter("task_id % 3 = 0")
    lanes = view(s, d, "tasks").filter("task_id % 2 = 0").select("task_id", F.lit("llm").alias("lane"), F.lit(5).alias("position"))
    return co.task_rows(tasks, tk.queue_positions(tasks), lanes, tk.asr_progress(view(s, d, "segments")), done, _stats(s, d)).drop("created_at")


_ROWS_SQL = (
    cte("tasks", "segments")
    + """, q AS (SELECT task_id, row_number() OVER (ORDER BY created_at, task_id) AS p FROM tasks WHERE status = 'queued'),
 a AS (SELECT task_id, count(*) FILTER (raw_json NOT IN ('', '{}', 'null')) AS done, count(*) AS total FROM segments GROUP BY 1)
 SELECT t.task_id, url, title, status, CASE WHEN status = 'waiting' AND t.task_id % 2 = 0 THEN 'llm' END AS queue, CASE WHEN status = 'waiting' AND t.task_id % 2 = 0 THEN 5 ELSE p END AS queue_position,
 CASE WHEN t.task_id % 7 = 0 THEN 'download_live_not_started' END AS failure_code, coalesce(a.done, 0) AS transcribe_current, coalesce(a.total, 0) AS transcribe_total,
 CASE WHEN t.task_id % 3 = 0 THEN 3 ELSE 0 END AS summary_current, CASE WHEN t.task_id % 3 = 0 THEN 4 ELSE 0 END AS summary_total, length(text) AS transcript_chars, CASE WHEN doc_id % 2 = 0 THEN strlen(text) END AS media_bytes
 FROM tasks t LEFT JOIN q USING (task_id) LEFT JOIN a USING (task_id) LEFT JOIN documents ON doc_id = t.task_id"""
)


# The artifacts of a task: its events' values as times, each turn's text as one of its files, a match file per task.
_FILE = "CASE turn % 4 WHEN 0 THEN 'transcript' WHEN 1 THEN 'summary' WHEN 2 THEN 'redacted' ELSE 'other' END"
_PATH = "concat('t', conv_id, CASE WHEN conv_id % 2 = 0 THEN '.JSON' ELSE '.txt' END)"
_BODY = "CASE WHEN conv_id % 2 = 1 OR turn % 4 > 0 THEN concat(' ', text, '  ') WHEN conv_id % 8 = 0 THEN text WHEN conv_id % 8 = 2 THEN '{\"text\": 5}' WHEN conv_id % 8 = 4 THEN '[1]' ELSE concat('{\"text\": \"  ', regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' \"}') END"
_MATCH = "CASE conv_id % 6 WHEN 0 THEN '[]' WHEN 1 THEN '{' ELSE concat('{\"A\": {\"noise\": ', CASE WHEN conv_id % 4 = 0 THEN 'true' WHEN conv_id % 4 = 1 THEN '0' ELSE 'false' END, '}, \"B', length(text), '\": {}, \"C\": ', turn, '}') END"


def _measured(s, d):
    turns = read(s, d, "conversations")
    tasks = turns.select(F.col("conv_id").alias("task_id")).distinct()
    steps = view(s, d, "steps").withColumns({"task_id": F.col("event_id") % 300, "started_at": F.expr("timestampadd(SECOND, -CAST(event_id % 50 - 5 AS INT), started_at)")})
    texts = turns.filter("turn < 4").selectExpr("conv_id AS task_id", f"{_FILE} AS kind", f"{_PATH} AS path", _BODY.replace(", 'g')", ")") + " AS text")
    media = turns.filter("turn = 0 AND conv_id % 3 > 0").selectExpr("conv_id AS task_id", "octet_length(text) AS size", "length(text) / 7.0E0 - 3 AS seconds")
    matches = turns.filter("turn = 0 AND conv_id % 5 > 0").selectExpr("conv_id AS task_id", f"{_MATCH} AS raw")
    return co.task_measures(tasks, steps, texts, media, matches)


_MEASURED_SQL = (
    cte("steps")
    + f""", p AS (SELECT event_id % 300 AS task_id, CAST(sum(event_id % 50 - 5) FILTER (finished_at IS NOT NULL AND event_id % 50 >= 5) AS BIGINT) AS processing_seconds FROM steps GROUP BY 1),
 b AS (SELECT conv_id, turn, text, {_BODY} AS body, {_MATCH} AS match FROM conversations),
 n AS (SELECT conv_id, turn, length(regexp_replace(CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' AND json_type(json_extract(body, '$.text')) = 'VARCHAR' THEN json_extract_string(body, '$.text') END ELSE body END, '^\\s+|\\s+$', '', 'g'))::INT AS n FROM b WHERE turn < 3),
 w AS (SELECT conv_id, max(n) FILTER (turn = 0) AS transcript_chars, max(n) FILTER (turn = 1) AS summary_chars, max(n) FILTER (turn = 2) AS redacted_chars FROM n GROUP BY 1),
 m AS (SELECT conv_id, strlen(text)::INT AS media_bytes, greatest(0, trunc(length(text) / 7.0::DOUBLE - 3)::BIGINT) AS media_seconds FROM b WHERE turn = 0 AND conv_id % 3 > 0),
 o AS (SELECT conv_id, CASE WHEN json_valid(match) AND json_type(match) = 'OBJECT' THEN len(list_filter(json_extract(match, '$.*'), lambda x: json_type(x) = 'OBJECT' AND coalesce(x ->> '$.noise', 'false') NOT IN ('true')))::INT END AS speaker_count FROM b WHERE turn = 0 AND conv_id % 5 > 0)
 SELECT t.task_id, processing_seconds, transcript_chars, summary_chars, redacted_chars, media_seconds, media_bytes, speaker_count FROM (SELECT DISTINCT conv_id AS task_id FROM conversations) t
 LEFT JOIN p ON p.task_id = t.task_id LEFT JOIN w ON w.conv_id = t.task_id LEFT JOIN m ON m.conv_id = t.task_id LEFT JOIN o ON o.conv_id = t.task_id"""
)


def _abilities(s, d):
    steps = view(s, d, "steps").groupBy("task_id").agg(F.collect_list(F.struct(F.when(F.col("name") == "final_summary", "summarize_final").otherwise(F.col("name")).alias("name"), F.when(F.col("event_id") % 5 == 0, "failed").otherwise(F.col("status")).alias("status"))).alias("steps"))
    status = F.element_at(F.array(*map(F.lit, ("completed", "failed", "running", "archived"))), (F.col("task_id") % 4 + 1).cast("int"))
    ref = F.array(F.struct(F.when(F.col("task_id") % 3 > 0, "system").otherwise("user").alias("source"), F.lit("summary").alias("id")))
    return steps.select("task_id", co.capabilities(status, ref, F.col("steps"), F.col("task_id") % 2 == 0).alias("c")).select("task_id", "c.*")


_ABILITIES_SQL = (
    cte("steps")
    + """, s AS (SELECT task_id, CASE WHEN name = 'final_summary' THEN 'summarize_final' ELSE name END AS name, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE status END AS st FROM steps),
 g AS (SELECT task_id, bool_or(name IN ('summarize_windows', 'summarize_final') AND st = 'failed') AS f, bool_or(name = 'summarize_windows' AND st = 'completed') AS w, bool_or(name = 'summarize_final' AND st = 'failed') AS x FROM s GROUP BY 1)
 SELECT task_id, task_id % 3 > 0 AND (task_id % 4 IN (0, 2) OR task_id % 4 = 1 AND f) AS can_restart_summary, w AND (task_id % 4 = 0 OR task_id % 4 = 1 AND x) AS can_restart_final_summary, task_id % 4 < 3 AND task_id % 2 = 0 AS can_resolve_speakers FROM g"""
)


def _merged(s, d):
    """All three tables after the merges, as counts by speaker."""
    speakers = read(s, d, "customer").select((F.col("c_nationkey") % 5).alias("user_id"), F.col("c_custkey").alias("speaker_id"))
    samples = read(s, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("speaker_id"))
    decisions = read(s, d, "lineitem").select((F.col("l_partkey") % 97 + 1).alias("speaker_id"), F.col("l_orderkey").alias("decision_id"))
    merges = speakers.filter("speaker_id % 3 = 0").select("user_id", F.col("speaker_id").alias("source"), (F.col("speaker_id") + F.when(F.col("speaker_id") % 6 == 0, 1).otherwise(0)).alias("target"))
    tables = co.merge_speakers(speakers, samples, decisions, merges)
    parts = [t.groupBy("speaker_id").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "speaker_id", "n") for k, t in zip(("speakers", "samples", "decisions"), tables, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_MERGED_SQL = """WITH sp AS (SELECT c_nationkey % 5 AS user_id, c_custkey AS speaker_id FROM customer),
 m AS (SELECT a.speaker_id AS source, b.speaker_id AS target FROM sp a JOIN sp b ON a.user_id = b.user_id AND a.speaker_id % 6 = 0 AND b.speaker_id = a.speaker_id + 1),
 x AS (SELECT 'speakers' AS kind, speaker_id FROM sp WHERE speaker_id NOT IN (SELECT source FROM m) UNION ALL SELECT 'samples', coalesce(target, o_custkey) FROM orders LEFT JOIN m ON o_custkey = source
  UNION ALL SELECT 'decisions', coalesce(target, l_partkey % 97 + 1) FROM lineitem LEFT JOIN m ON l_partkey % 97 + 1 = source)
 SELECT kind, speaker_id, count(*) AS n FROM x GROUP BY ALL"""


def _restart(s, d):
    """Steps after a restart of the failed tasks and a new tail for some, as counts by task, name and status."""
    steps = view(s, d, "steps").select("task_id", F.when(F.col("name") == "final_summary", F.concat(F.lit("finalize:"), F.col("event_id") % 3)).otherwise(F.col("name")).alias("name"), "status", F.lit(2).alias("attempt"), "started_at", "finished_at", F.lit("old").alias("message"))
    users = steps.select("task_id").distinct()
    tasks = users.select("task_id", F.lit("failed").alias("status"), F.lit("a.md").alias("summary_path"), F.lit(4).alias("summary_current"), F.lit(5).alias("summary_total"), F.array(F.struct(F.lit("k").alias("key"), F.lit("completed").alias("status"))).alias("results"))
    tasks, steps = co.restart_summaries(tasks, steps, users.filter("task_id % 3 = 0"))
    tasks = co.clear_results(tasks, users.filter("task_id % 5 = 0"))
    steps = co.rebuild_tail(steps, users.filter("task_id % 4 = 0").select("task_id", F.lit("finalize:1").alias("name")))
    own = steps.groupBy("task_id", "name", "status", "attempt").agg(F.count("*").alias("n"), F.count("started_at").alias("started"), F.count("message").alias("messages"))
    return own.join(tasks.select("task_id", F.col("status").alias("task_status"), "summary_path", "summary_current", F.array_join(F.transform("results", lambda r: r["status"]), ",").alias("results")), "task_id")


_RESTART_SQL = (
    cte("steps")
    + """, s AS (SELECT task_id, CASE WHEN name = 'final_summary' THEN 'finalize:' || event_id % 3 ELSE name END AS name, status, started_at FROM steps),
 r AS (SELECT *, task_id % 3 = 0 AND (name IN ('summarize_windows', 'summarize_final') OR starts_with(name, 'finalize:')) AS again FROM s),
 k AS (SELECT task_id, name, CASE WHEN again THEN 'pending' ELSE status END AS status, CASE WHEN again THEN 0 ELSE 2 END AS attempt, CASE WHEN NOT again THEN started_at END AS started_at, CASE WHEN NOT again THEN 'old' END AS message FROM r WHERE task_id % 4 > 0 OR NOT starts_with(name, 'finalize:')
  UNION ALL SELECT DISTINCT task_id, 'finalize:1', 'pending', 0, NULL::TIMESTAMP, NULL FROM s WHERE task_id % 4 = 0)
 SELECT task_id, name, status, attempt, count(*) AS n, count(started_at) AS started, count(message) AS messages, CASE WHEN task_id % 3 = 0 THEN 'queued' ELSE 'failed' END AS task_status, CASE WHEN task_id % 3 > 0 AND task_id % 5 > 0 THEN 'a.md' END AS summary_path,
 CASE WHEN task_id % 3 = 0 THEN 0 ELSE 4 END AS summary_current, CASE WHEN task_id % 5 = 0 THEN '' WHEN task_id % 3 = 0 THEN 'pending' ELSE 'completed' END AS results FROM k GROUP BY ALL"""
)


def _batches(s, d):
    t = read(s, d, "documents").withColumn("u", tx.split_sentences(F.col("text")))
    of = co.batch_notes(F.transform("u", tx.estimate_tokens), 120)
    return t.select("doc_id", F.posexplode(of).alias("i", "batch")).groupBy("doc_id", "batch").agg(F.count("*").alias("n"), F.min("i").alias("first"))


def _batches_sql() -> str:
    return f"""WITH RECURSIVE l AS (SELECT doc_id, {_SENT} AS l FROM documents), s AS (SELECT doc_id, greatest(1, length(unnest(l)) // 4) AS n, generate_subscripts(l, 1) AS i FROM l),
 p AS (SELECT doc_id, i, 0 AS batch, n AS total FROM s WHERE i = 1 UNION ALL SELECT s.doc_id, s.i, batch + (total + s.n > 120)::INT, CASE WHEN total + s.n > 120 THEN s.n ELSE total + s.n END FROM p JOIN s ON s.doc_id = p.doc_id AND s.i = p.i + 1)
 SELECT doc_id, batch, count(*) AS n, (min(i) - 1)::INT AS first FROM p GROUP BY ALL"""


def _previews(s, d):
    return co.preview_spans(view(s, d, "turns"), "task_id", 60.0, 3, 30.0)


_PREVIEWS_SQL = (
    cte("turns")
    + """, r AS (SELECT *, "end" - start AS len, row_number() OVER (PARTITION BY task_id, speaker ORDER BY "end" - start DESC, seg_pos) AS r FROM turns WHERE "end" - start >= 30),
 p AS (SELECT task_id, speaker, r - 1 AS k, round(start + (len - least(60, len)) / 2, 3) AS a, round(start + (len - least(60, len)) / 2 + least(60, len), 3) AS z, start, len FROM r WHERE r <= 3),
 c AS (SELECT task_id, speaker, count(*) AS n, max(len) AS len, min_by(start, k) AS start FROM p GROUP BY ALL),
 t AS (SELECT task_id, speaker, n, start, unnest(range(0, floor(len / 60)::BIGINT)) AS j FROM c WHERE n < 3 AND len >= 60),
 u AS (SELECT *, round(start + j * 60, 3) AS a, round(start + (j + 1) * 60, 3) AS z FROM t),
 v AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.task_id = u.task_id AND p.speaker IS NOT DISTINCT FROM u.speaker AND u.a < p.z AND p.a < u.z)),
 w AS (SELECT *, n + row_number() OVER (PARTITION BY task_id, speaker ORDER BY j) - 1 AS k FROM v)
 SELECT task_id, speaker, k::INT AS k, a AS clip_start, z AS clip_end FROM p UNION ALL SELECT task_id, speaker, k::INT, a, z FROM w WHERE k < 3"""
)


def _refs(s, d):
    e = read(s, d, "events").select(F.col("event_id").alias("task_id"), F.lit(0).alias("pos"), F.element_at(F.array(F.lit("system"), F.lit("user"), F.lit("x")), (F.col("event_id") % 3 + 1).cast("int")).alias("source"), F.col("user_id").cast("string").alias("id"))
    return co.valid_refs(e, read(s, d, "nation").select(F.col("n_nationkey").alias("prompt_id")))


# A delivery list in JSON around each turn's text, and how it is spoilt; both engines build it by the same expression.
_CLEAN = "regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g')"
_TARGET = "CASE conv_id % 7 WHEN 1 THEN CASE turn % 7 WHEN 0 THEN '0' WHEN 1 THEN 'false' WHEN 2 THEN 'null' WHEN 3 THEN '[]' WHEN 4 THEN '\"\"' WHEN 5 THEN '0.0' ELSE 'true' END WHEN 2 THEN CAST(turn AS VARCHAR(9)) ELSE concat('\"', role, turn, '\"') END"
_VARIANT = "CASE WHEN turn % 3 = 0 THEN 'raw' WHEN turn % 3 = 1 THEN concat('user:', conv_id) WHEN conv_id % 11 = 3 THEN role WHEN conv_id % 2 = 0 THEN '' ELSE 'summary' END"
_LIST = f"concat('[{{\"deliver_to\": ', {_TARGET}, ', \"variant\": \"', {_VARIANT}, '\", \"note\": \"', c, '\"}}', CASE WHEN turn % 4 = 1 THEN ', {{\"deliver_to\": \"b\"}}' WHEN turn % 4 = 2 THEN concat(', \"', c, '\"') ELSE '' END, ']')"
_SPOILT = "CASE conv_id * 3 + turn WHEN 0 THEN NULL ELSE CASE (conv_id * 3 + turn) % 10 WHEN 4 THEN substring(j, 1, CAST(length(j) * 0.8 AS INT)) WHEN 5 THEN concat('{\"list\": ', j, '}') WHEN 6 THEN concat('[null, ', substring(j, 2, length(j))) WHEN 7 THEN CASE WHEN turn % 2 = 0 THEN '' ELSE c END ELSE j END END"


def _deliveries(s, d):
    t = read(s, d, "conversations").selectExpr("conv_id", "turn", "role", _CLEAN.replace(", 'g')", ")") + " AS c").selectExpr("conv_id", "turn", "c", f"{_LIST} AS j")
    p = t.selectExpr("conv_id", "turn", f"{_SPOILT} AS raw").select("conv_id", "turn", co.parse_delivery(F.col("raw")).alias("p"))
    return p.select("conv_id", "turn", "p.error", F.array_join(F.transform("p.entries", lambda x: F.concat_ws("/", x["deliver_to"], x["variant"])), ",").alias("entries"))


def _says_sql(j: str) -> str:
    return f"CASE json_type({j}) WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN {j} ->> '$' = 'true' WHEN 'VARCHAR' THEN {j} ->> '$' <> '' WHEN 'ARRAY' THEN json_array_length({j}) > 0 WHEN 'OBJECT' THEN len(json_keys({j})) > 0 ELSE ({j} ->> '$')::DOUBLE <> 0 END"


_DELIVERIES_SQL = f"""WITH t AS (SELECT conv_id, turn, role, {_CLEAN} AS c FROM conversations), l AS (SELECT *, {_LIST} AS j FROM t), r AS (SELECT conv_id, turn, {_SPOILT} AS raw FROM l),
 k AS (SELECT *, CASE WHEN coalesce(raw, '') = '' THEN 'none' WHEN NOT json_valid(raw) THEN 'not JSON' WHEN json_type(raw) <> 'ARRAY' THEN 'not a list' ELSE 'list' END AS kind FROM r),
 e AS (SELECT conv_id, turn, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM (SELECT conv_id, turn, json_extract(raw, '$[*]') AS x FROM k WHERE kind = 'list')),
 f AS (SELECT conv_id, turn, i, json_type(e) AS t, json_extract(e, '$.deliver_to') AS d, json_extract(e, '$.variant') AS v FROM e),
 g AS (SELECT conv_id, turn, i, t, CASE WHEN {_says_sql("d")} THEN d ->> '$' END AS d, CASE WHEN {_says_sql("v")} THEN v ->> '$' END AS v FROM f),
 h AS (SELECT *, CASE WHEN t <> 'OBJECT' THEN 'not an object' WHEN d IS NULL THEN 'no target' WHEN v IS NOT NULL AND v NOT IN ('raw', 'redacted', 'summary') AND NOT regexp_matches(v, '^[^:]+:.+$') THEN 'unknown variant' END AS error FROM g),
 a AS (SELECT conv_id, turn, first(error ORDER BY i) FILTER (error IS NOT NULL) AS error, string_agg(d || coalesce('/' || v, ''), ',' ORDER BY i) AS entries FROM h GROUP BY 1, 2)
 SELECT conv_id, turn, CASE WHEN kind = 'list' THEN error WHEN kind <> 'none' THEN kind END AS error, CASE WHEN kind = 'list' AND error IS NULL THEN coalesce(entries, '') ELSE '' END AS entries FROM k LEFT JOIN a USING (conv_id, turn)"""


def _voices(s, d):
    action = F.element_at(F.array(*map(F.lit, ("bind_new", "bind_existing", "accept_auto", "leave_anonymous"))), (F.col("event_id") % 4 + 1).cast("int"))
    action = F.when(F.col("event_id") % 997 == 0, "odd").otherwise(action)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    a = read(s, d, "events").select((F.col("event_id") / 4).cast("long").alias("task_id"), F.lit(1).alias("user_id"), (F.col("event_id") % 4).cast("string").alias("label"), action.alias("action"), F.when(k > 1, " Ann ").otherwise(" ").alias("new_name"), k.alias("speaker_id"), F.when(F.col("event_id") % 5 == 0, F.col("event_id")).alias("voice_sample_id"), F.lit(0.5).alias("distance"), F.lit(False).alias("is_noise"))
    speakers = read(s, d, "customer").filter("c_custkey <= 95").select(F.lit(1).alias("user_id"), F.col("c_custkey").cast("int").alias("speaker_id"))
    a = a.withColumn("add_fragment", F.col("speaker_id") % 3 == 0)
    task, label = (F.col("event_id") / 4).cast("long"), (F.col("event_id") % 4).cast("string")
    clip = read(s, d, "events").filter("event_id % 71 > 0").select(task.alias("task_id"), label.alias("label"), F.explode(F.array(F.lit(1), F.lit(0))).alias("pos"), "value", "event_id")
    clips = clip.select("task_id", "label", "pos", F.concat_ws("/", "label", "pos").alias("path"), F.col("pos").cast("double").alias("start"), (F.col("pos") + F.col("value")).alias("end"), F.when(F.col("event_id") % 31 > 0, F.array("value")).alias("embedding"))
    models = read(s, d, "events").select(task.alias("task_id")).distinct().filter("task_id % 5 > 0").withColumn("embedding_model", F.when(F.col("task_id") % 7 > 0, "m").otherwise(""))
    prior = read(s, d, "events").filter("event_id % 3 = 0").select(task.alias("task_id"), label.alias("label"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("voice_sample_id"))
    decisions, created, doomed, samples = co.resolve_voices(a, speakers, prior, clips, models)
    given = F.when(F.col("adds_sample"), "new").otherwise(F.coalesce(F.col("voice_sample_id").cast("string"), F.lit("none")))
    out = decisions.select("task_id", "label", F.lit("decision").alias("kind"), F.concat_ws("/", F.col("speaker_id").cast("string"), given).alias("value"))
    out = out.unionByName(created.select("task_id", "label", F.lit("speaker").alias("kind"), F.col("name").alias("value")))
    out = out.unionByName(samples.select("task_id", "label", F.lit("sample").alias("kind"), F.concat_ws("|", "path", F.round("duration_sec", 2).cast("string"), "embedding_model").alias("value")))
    return out.unionByName(doomed.select("task_id", "label", F.lit("doomed").alias("kind"), F.col("voice_sample_id").cast("string").alias("value")))


_VOICES_SQL = """WITH a AS (SELECT event_id, event_id // 4 AS task_id, (event_id % 4)::VARCHAR AS label, event_id % 4 AS act, regexp_extract(props, '([0-9]+)', 1)::INT AS k, value FROM events),
 b AS (SELECT *, k % 3 = 0 AND act < 3 AS adds, event_id % 997 = 0 OR act = 0 AND k <= 1 OR act IN (1, 2) AND k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey <= 95)
  OR k % 3 = 0 AND act < 3 AND (task_id % 5 = 0 OR task_id % 7 = 0 OR event_id % 71 = 0 OR event_id % 31 = 0) AS wrong FROM a), g AS (SELECT * FROM b QUALIFY NOT bool_or(wrong) OVER (PARTITION BY task_id))
 SELECT task_id, label, 'decision' AS kind, coalesce(CASE WHEN act IN (1, 2) THEN k || '/' END, '') || CASE WHEN adds THEN 'new' WHEN event_id % 5 = 0 THEN event_id::VARCHAR ELSE 'none' END AS value FROM g UNION ALL SELECT task_id, label, 'speaker', 'Ann' FROM g WHERE act = 0
 UNION ALL SELECT task_id, label, 'sample', label || '/0|' || round(value, 2)::VARCHAR || '|m' FROM g WHERE adds
 UNION ALL SELECT task_id, label, 'doomed', event_id::VARCHAR FROM g WHERE event_id % 6 = 0 AND event_id % 5 > 0"""


def _finalized(s, d):
    tasks = read(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("task_id"), "text")
    refs = tasks.select("task_id", F.explode(F.array(F.lit("system:summary"), F.concat(F.lit("user:"), F.col("task_id") % 3))).alias("ref"))
    prompts = s.createDataFrame([("system:summary", "Sum up: ${text}"), ("user:1", "${text} -- in one word"), ("user:2", "${other}${text}")], "ref string, template string")
    return co.finalize(tasks, refs, prompts, lambda c: F.md5(c.cast("binary")))


_FINALIZED_SQL = """WITH t AS (SELECT conv_id * 1000 + turn AS task_id, text FROM conversations), r AS (SELECT task_id, text, unnest(['system:summary', 'user:' || task_id % 3]) AS ref FROM t)
 SELECT task_id, ref, CASE ref WHEN 'system:summary' THEN md5('Sum up: ' || text) WHEN 'user:1' THEN md5(text || ' -- in one word') WHEN 'user:2' THEN md5('${other}' || text) END AS result, CASE WHEN ref = 'user:0' THEN 'failed' ELSE 'completed' END AS status FROM r"""


def _manifests(s, d):
    o = read(s, d, "orders").filter("o_orderkey % 2 = 0")
    spans = o.select(F.col("o_orderkey").alias("task_id"), F.explode(F.sequence(F.lit(1), (F.col("o_custkey") % 3 + 1).cast("int"))).alias("segment_index"))
    old = read(s, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("segment_index"), F.col("l_returnflag").alias("text"))
    return co.replace_manifest(old, spans)


_MANIFESTS_SQL = """SELECT l_orderkey AS task_id, l_linenumber AS segment_index, l_returnflag AS text FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)
 UNION ALL SELECT o_orderkey, unnest(range(1, o_custkey % 3 + 2))::INT, NULL FROM orders WHERE o_orderkey % 2 = 0"""


def _trims(s, d):
    """Labels with fewer or more vectors than they are, one of them null at times."""
    o = read(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") % 100).alias("a"), (F.col("o_totalprice") % 70 - 5).alias("b"))
    labels = F.slice(F.array(F.lit("A"), F.lit("B"), F.lit("C")), 1, (F.col("o_orderkey") % 4).cast("int"))
    vectors = F.slice(F.array(F.array("a"), F.when(F.col("o_orderkey") % 5 > 0, F.array("b")), F.array(F.col("a") + F.col("b"))), 1, (F.col("o_orderkey") % 3 + 1).cast("int"))
    o = o.withColumn("v", F.transform_values(co.voice_vectors(labels, vectors), lambda k, x: F.get(x, F.lit(0))))
    joined = F.array_join(F.transform(F.array_sort(F.map_keys("v")), lambda k: F.concat(k, F.round(F.col("v")[k], 2).cast("string"))), ",")
    return o.select("o_orderkey", co.accepted_trim(F.col("a"), F.col("b"), 30.0).alias("trimmed"), F.size("v").alias("n"), joined.alias("voices"))


_TRIMS_SQL = """WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS l, o_orderkey % 3 + 1 AS m, o_totalprice % 100 AS a, o_totalprice % 70 - 5 AS b FROM orders),
 v AS (SELECT *, list_filter([CASE WHEN l >= 1 THEN 'A' || round(a, 2)::VARCHAR END, CASE WHEN l >= 2 AND m >= 2 AND o_orderkey % 5 > 0 THEN 'B' || round(b, 2)::VARCHAR END, CASE WHEN l >= 3 AND m >= 3 THEN 'C' || round(a + b, 2)::VARCHAR END], lambda x: x IS NOT NULL) AS v FROM o)
 SELECT o_orderkey, CASE WHEN b <= 0 OR greatest(0, a - b) > 30 THEN 0 ELSE greatest(0, a - b) END::DOUBLE AS trimmed, len(v)::INT AS n, array_to_string(v, ',') AS voices FROM v"""


_RAISED = (None, "paused", "awaiting_input", "gone", "diarization_cancelled", "download_cancelled", "interrupted", "ValueError")


def _outcomes(s, d):
    raised = F.element_at(F.array(*map(F.lit, _RAISED)), (F.col("task_id") % len(_RAISED) + 1).cast("int"))
    message = F.when(F.col("user_id") % 3 == 0, "Premieres in 3 hours").otherwise(F.concat(F.lit("boom "), "user_id"))
    return co.task_outcomes(view(s, d, "tasks").select("task_id", "status", raised.alias("raised"), message.alias("message"), (F.col("user_id") % 2 == 0).alias("pause_requested")))


_OUTCOMES_SQL = (
    cte("tasks")
    + """, k AS (SELECT *, CASE WHEN status = 'completed' THEN 'skipped' ELSE CASE task_id % 8 WHEN 0 THEN 'done' WHEN 1 THEN 'paused' WHEN 2 THEN 'awaiting_input' WHEN 3 THEN 'gone' WHEN 4 THEN 'diarization_cancelled'
   WHEN 5 THEN 'download_cancelled' WHEN 6 THEN CASE WHEN user_id % 2 = 0 THEN 'paused' ELSE 'interrupted' END ELSE 'failed' END END AS kind FROM tasks),
 o AS (SELECT task_id, kind, CASE kind WHEN 'done' THEN 'completed' WHEN 'paused' THEN 'paused' WHEN 'awaiting_input' THEN 'awaiting_input' WHEN 'failed' THEN 'failed' ELSE status END AS status,
   kind IN ('done', 'paused', 'awaiting_input', 'failed') AS event, kind IN ('done', 'failed') AS push, kind = 'done' AS deliver,
   CASE WHEN kind = 'failed' THEN CASE WHEN user_id % 3 = 0 THEN 'Premieres in 3 hours' ELSE 'boom ' || user_id END END AS error,
   CASE WHEN kind = 'failed' AND user_id % 3 = 0 THEN 'download_live_not_started' END AS failure_code FROM k)
"""
)


def _options(s, d):
    o = read(s, d, "orders").withColumn("k", F.col("o_orderkey") % 5)
    flag = lambda n: F.when(F.col("k") != n, F.col("o_custkey") % 2 == n % 2)
    entry = lambda to, v: F.struct(to.alias("deliver_to"), v.alias("variant"), F.lit("s").alias("secret"))
    delivery = F.when(F.col("k") > 0, F.array(entry(F.col("o_custkey").cast("string"), F.when(F.col("k") == 1, "").otherwise("raw")), entry(F.when(F.col("k") == 2, ""), F.lit("raw"))))
    ref = lambda source, i: F.struct(F.lit(source).alias("source"), i.cast("string").alias("id"), F.lit("s").alias("secret"))
    prompts = F.when(F.col("k") > 0, F.array(ref("system", F.col("o_orderstatus")), ref("user", F.col("o_custkey")), ref("other", F.col("o_custkey")), ref("user", F.col("k"))))
    valid = F.when(F.col("k") != 3, F.array(F.col("k").cast("string"), F.lit("x")))
    options = F.struct(F.when(F.col("k") < 3, F.col("o_orderstatus")).alias("language"), flag(1).alias("audio_only"), flag(2).alias("transcript"), flag(3).alias("diarize"), delivery.alias("delivery"), prompts.alias("prompts"))
    x = o.withColumns({"options": options, "valid": valid}).select("o_orderkey", co.expand_options(F.col("options"), F.col("valid")).alias("x")).select("o_orderkey", "x.*")
    joined = lambda c, *names: F.array_join(F.transform(c, lambda e: F.concat_ws("/", *(e[n] for n in names))), ",")
    return x.withColumns({"delivery": joined("delivery", "deliver_to", "variant"), "prompts": joined("prompts", "source", "id")})


_OPTIONS_SQL = """WITH k AS (SELECT *, o_orderkey % 5 AS k FROM orders)
 SELECT o_orderkey, CASE WHEN k < 3 THEN o_orderstatus END AS language, CASE WHEN k = 1 THEN false ELSE o_custkey % 2 = 1 END AS audio_only, CASE WHEN k = 2 THEN true ELSE o_custkey % 2 = 0 END AS transcript,
 CASE WHEN k = 3 THEN false ELSE o_custkey % 2 = 1 END AS diarize, CASE k WHEN 0 THEN '' WHEN 1 THEN o_custkey::VARCHAR ELSE o_custkey || '/raw' END AS delivery,
 CASE WHEN k = 0 THEN '' ELSE 'system/' || o_orderstatus || CASE WHEN k <> 3 AND o_custkey = k THEN ',user/' || o_custkey ELSE '' END || CASE WHEN k <> 3 THEN ',user/' || k ELSE '' END END AS prompts FROM k"""


def _presets(s, d):
    source = F.element_at(F.array(F.lit("system"), F.lit("user"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int"))
    refs = read(s, d, "events").select("event_id", source.alias("source"), F.col("user_id").cast("string").alias("id"))
    system = read(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("options"))
    return co.resolve_preset(refs, system, read(s, d, "customer").select(F.col("c_custkey").alias("preset_id"), F.col("c_name").alias("options")))


_PRESETS_SQL = """WITH r AS (SELECT event_id, ['system', 'user', 'other'][event_id % 3 + 1] AS source, user_id FROM events)
 SELECT event_id, source, user_id::VARCHAR AS id, coalesce(n_name, c_name) AS options FROM r LEFT JOIN nation ON source = 'system' AND n_nationkey = user_id LEFT JOIN customer ON source = 'user' AND c_custkey = user_id"""


# A list of references around each event's names, and how it is spoilt.
_REFS = "concat('[\"', event_type, ':', user_id, '\", \"system:', event_type, '\"', CASE WHEN user_id % 3 = 0 THEN concat(', \"', event_type, '\"') ELSE '' END, ']')"
_REFS_SPOILT = "CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN substring(j, 1, length(j) - CAST(user_id % 4 AS INT) - 1) WHEN event_id % 9 = 2 THEN concat('{\"a\": ', j, '}') WHEN event_id % 9 = 3 THEN props WHEN event_id % 9 = 4 THEN replace(j, ':', CASE WHEN user_id % 2 = 0 THEN '' ELSE '::' END) WHEN event_id % 9 = 5 THEN '[]' ELSE j END"


def _prompts(s, d):
    raw = read(s, d, "events").selectExpr("event_id", "user_id", "props", f"{_REFS} AS j").selectExpr("event_id", f"{_REFS_SPOILT} AS raw")
    p = raw.select("event_id", co.parse_prompts(F.col("raw")).alias("p"))
    return p.select("event_id", "p.error", F.array_join(F.transform("p.refs", lambda r: F.concat_ws("=", r["source"], r["id"])), ",").alias("refs"))


_PROMPTS_SQL = f"""WITH j AS (SELECT *, {_REFS} AS j FROM events), r AS (SELECT event_id, {_REFS_SPOILT} AS raw FROM j),
 k AS (SELECT *, CASE WHEN raw IS NULL THEN 'none' WHEN NOT json_valid(raw) THEN 'not JSON' WHEN json_type(raw) <> 'ARRAY' THEN 'not a list' ELSE 'list' END AS kind FROM r),
 e AS (SELECT event_id, list_transform(json_extract(raw, '$[*]'), lambda x: x ->> '$') AS x FROM k WHERE kind = 'list'),
 b AS (SELECT event_id, x, len(list_filter(x, lambda y: NOT regexp_matches(y, '^[^:]+:.+$'))) > 0 AS bad FROM e)
 SELECT event_id, CASE WHEN kind = 'list' THEN CASE WHEN bad THEN 'invalid reference' END WHEN kind <> 'none' THEN kind END AS error,
 CASE WHEN kind = 'none' THEN 'system=summary' WHEN kind = 'list' AND NOT bad THEN array_to_string(list_transform(x, lambda y: split_part(y, ':', 1) || '=' || y[length(split_part(y, ':', 1)) + 2:]), ',') END AS refs FROM k LEFT JOIN b USING (event_id)"""


def _fitted(s, d):
    """Sentences of each document as notes; the model's stand-in is a digest of the batch."""
    t = read(s, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(tx.split_sentences(F.col("text"))).alias("pos", "text"))
    return co.pack_until_fits(t.withColumn("pos", F.col("pos").cast("long")), 60, 40, lambda c: F.md5(c.cast("binary"))).groupBy("id").agg(F.count("*").alias("n"), F.bool_and("fits").alias("fits"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "|").cast("binary")).alias("h"))


def _fitted_sql(passes: int = 6) -> str:
    """The passes one by one; each numbers its notes, batches those of the ids that don't fit, and digests the batches."""
    out = [f"WITH RECURSIVE l AS (SELECT doc_id AS id, {_SENT} AS l FROM documents), t0 AS (SELECT id, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM l)"]
    for k in range(passes):
        out.append(f"n{k} AS (SELECT *, greatest(1, length(text) // 4) AS n FROM t{k}), o{k} AS (SELECT *, sum(n) OVER (PARTITION BY id) > 60 AND ({k} = 0 OR count(*) OVER (PARTITION BY id) > 1) AS over FROM n{k}), s{k} AS (SELECT * FROM o{k} WHERE over)")
        out.append(f"p{k} AS (SELECT id, i, 1 AS batch, n AS total FROM s{k} WHERE i = 1 UNION ALL SELECT s.id, s.i, batch + (total + s.n > 40)::INT, CASE WHEN total + s.n > 40 THEN s.n ELSE total + s.n END FROM p{k} p JOIN s{k} s ON s.id = p.id AND s.i = p.i + 1)")
        out.append(f"t{k + 1} AS (SELECT id, text, i FROM o{k} WHERE NOT over UNION ALL SELECT id, md5(string_agg(text, chr(10) || chr(10) ORDER BY i)), batch FROM p{k} JOIN s{k} USING (id, i) GROUP BY id, batch)")
    return ", ".join(out) + f" SELECT id, count(*) AS n, sum(greatest(1, length(text) // 4)) <= 60 AS fits, md5(string_agg(text, '|' ORDER BY i)) AS h FROM t{passes} GROUP BY id"


QUERIES = {
    "split_entries": (_split, _SPLIT_SQL),
    "diarized_entries": (lambda s, d: _dialogue(s, d)[0], _CLEAN_SQL + ' SELECT task_id, pos, speaker, start, "end", text FROM cl'),
    "diarized_text": (lambda s, d: _dialogue(s, d)[1].select("task_id", F.md5("rendered").alias("h")), _RENDER_SQL),
    "task_rows": (_rows, _ROWS_SQL),
    "task_measures": (_measured, _MEASURED_SQL),
    "task_abilities": (_abilities, _ABILITIES_SQL),
    "task_outcomes": (_outcomes, _OUTCOMES_SQL + " SELECT * FROM o"),
    "wrong_ends": (lambda s, d: co.wrong_ends(_outcomes(s, d), view(s, d, "tasks")), _OUTCOMES_SQL + " SELECT task_id, t.status, o.status AS expected FROM tasks t JOIN o USING (task_id) WHERE t.status <> o.status"),
    "expand_options": (_options, _OPTIONS_SQL),
    "resolve_preset": (_presets, _PRESETS_SQL),
    "parse_prompts": (_prompts, _PROMPTS_SQL),
    "fitted_notes": (_fitted, _fitted_sql()),
    "count_tasks": (lambda s, d: co.count_tasks(tk.filter_tasks(view(s, d, "tasks"), q="VIEW", source_type="file")), cte("tasks") + " SELECT count(*) AS n FROM tasks WHERE (contains(lower(title), 'view') OR contains(lower(url), 'view')) AND starts_with(url, 'file://')"),
    "samples_of": (lambda s, d: co.samples_of(view(s, d, "samples"), read(s, d, "nation").select(F.col("n_nationkey").alias("speaker_id"), F.col("n_regionkey").alias("user_id")), 2).select("sample_id", "speaker_id"), cte("samples") + " SELECT sample_id, speaker_id FROM samples WHERE speaker_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "merge_speakers": (_merged, _MERGED_SQL),
    "restart_summaries": (_restart, _RESTART_SQL),
    "batch_notes": (_batches, _batches_sql()),
    "preview_spans": (_previews, _PREVIEWS_SQL),
    "valid_refs": (_refs, "SELECT event_id AS task_id, 0 AS pos, CASE event_id % 3 WHEN 0 THEN 'system' ELSE 'user' END AS source, user_id::VARCHAR AS id FROM events WHERE event_id % 3 = 0 OR event_id % 3 = 1 AND user_id IN (SELECT n_nationkey FROM nation)"),
    "parse_delivery": (_deliveries, _DELIVERIES_SQL),
    "resolve_voices": (_voices, _VOICES_SQL),
    "finalize": (_finalized, _FINALIZED_SQL),
    "replace_manifest": (_manifests, _MANIFESTS_SQL),
    "accepted_trim": (_trims, _TRIMS_SQL),
    "window_report": (
        lambda s, d: co.window_report(view(s, d, "durations")),
        cte("durations") + ", t AS (SELECT floor(median(window_total)) AS t FROM durations WHERE window_total >= 1) SELECT name, round(CASE WHEN name = 'summarize_windows' THEN median(duration_sec / window_total) * any_value(t) ELSE median(duration_sec) END, 1) AS seconds, count(*) AS n FROM durations, t WHERE name <> 'summarize_windows' OR window_total >= 1 GROUP BY name",
    ),
    "live_totals": (lambda s, d: co.live_totals(view(s, d, "metrics")).withColumn("wall_ms", F.round("wall_ms", 4)), cte("metrics") + " SELECT task_id, stage, count(*) AS n, round(sum(t_wall_ms), 4) AS wall_ms, max(t_wall_ms) AS longest_ms FROM metrics GROUP BY ALL"),
}
