"""Queries on turns, words, entries and texts, with their comparison SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import text as tx
from tapeloom.operators import intervals as iv
from tapeloom.operators import sequences as sq
from tapeloom.plans.adapters import cte, read, spread, view
from tapeloom.streaming.throttle import throttle


def _words(s, d):
    """Words of each turn with their offsets as times, and the speaker that spoke them (some unknown)."""
    w = read(s, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "word"))
    return w.select(F.col("conv_id").alias("task_id"), (F.col("turn") * 100_000 + F.col("i")).alias("word_pos"), "word", F.when((F.col("i") + F.col("turn")) % 7 > 0, F.when(F.col("i") % 50 < 30, "A").otherwise("B")).alias("speaker"), (F.col("turn") * 1000.0 + F.col("i")).alias("start"), (F.col("turn") * 1000.0 + F.col("i") + 1).alias("end"))


_WORDS = """WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM conversations),
 words AS (SELECT conv_id AS task_id, turn * 100000 + i AS word_pos, word, CASE WHEN (i + turn) % 7 > 0 THEN CASE WHEN i % 50 < 30 THEN 'A' ELSE 'B' END END AS speaker, (turn * 1000 + i)::DOUBLE AS start, (turn * 1000 + i + 1)::DOUBLE AS "end" FROM w)"""
_GROUPS = (
    _WORDS
    + """, f AS (SELECT *, last_value(speaker IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY word_pos ROWS UNBOUNDED PRECEDING) AS k FROM words),
 c AS (SELECT *, (row_number() OVER p = 1 OR k IS DISTINCT FROM lag(k) OVER p)::INT AS ch FROM f WINDOW p AS (PARTITION BY task_id ORDER BY word_pos)),
 i AS (SELECT *, sum(ch) OVER (PARTITION BY task_id ORDER BY word_pos ROWS UNBOUNDED PRECEDING) AS island FROM c),
 g AS (SELECT task_id, CAST(island AS BIGINT) AS island, any_value(k) AS speaker, count(*)::INT AS n_words, min_by(start, word_pos) AS start, max_by("end", word_pos) AS "end", string_agg(word, ' ' ORDER BY word_pos) AS text FROM i GROUP BY ALL)"""
)


def _names(s, d):
    return read(s, d, "conversations").select(F.col("conv_id").alias("task_id"), F.col("role").alias("speaker")).distinct().filter("task_id % 3 = 0 and speaker = 'user'").withColumn("name", F.concat(F.lit("Person "), F.col("task_id")))


_E = cte("entries")
_NAMES = ", names AS (SELECT DISTINCT conv_id AS task_id, role AS speaker, 'Person ' || conv_id AS name FROM conversations WHERE conv_id % 3 = 0 AND role = 'user')"
_LABELS = (
    _E
    + _NAMES
    + ", f AS (SELECT task_id, speaker, min(pos) AS p FROM entries WHERE speaker IS NOT NULL GROUP BY ALL), l AS (SELECT f.task_id, f.speaker, coalesce(name, 'Speaker ' || row_number() OVER (PARTITION BY f.task_id ORDER BY p, f.speaker)) AS label FROM f LEFT JOIN names n ON n.task_id = f.task_id AND n.speaker = f.speaker)"
)
_TS = cte("turns", "spans")
_MEET = (
    _TS
    + """, m AS (SELECT s.task_id, s.span_id, t.speaker, t.seg_pos, greatest(0, least(s."end", t."end") - greatest(s.start, t.start)) AS ov, s.start = s."end" AND s.start BETWEEN t.start AND t."end" AS pt FROM spans s JOIN turns t ON s.task_id = t.task_id),
 b AS (SELECT task_id, span_id, max_by(speaker, (ov, -seg_pos)) AS speaker FROM m WHERE ov > 0 OR pt GROUP BY ALL)"""
)


def _marginal(s, d):
    return iv.drop_marginal(view(s, d, "entries"), 0.3).select("task_id", "pos", "speaker")


def _blocks(s, d):
    blocks = view(s, d, "entries").select("task_id", F.col("pos").alias("block_id"), "start", "end", F.concat(F.lit("block "), F.col("pos")).alias("text"))
    sent = view(s, d, "turns").select("task_id", F.col("seg_pos").alias("sent_id"), F.col("start") + 150, (F.col("end") + 150).alias("end"), F.concat(F.lit("s"), F.col("seg_pos")).alias("text")).toDF("task_id", "sent_id", "start", "end", "text")
    return iv.midpoint_blocks(blocks, sent).select("task_id", "block_id", F.array_join("sentences", "|").alias("sentences"))


def _in_entry(s, d):
    w = _words(s, d).withColumns({"offset": F.lit(0.5), "entry_start": F.col("start") - F.col("word_pos") % 5, "entry_end": F.col("start") + F.col("word_pos") % 3 - 1})
    return iv.words_in_entry(w).groupBy("task_id").agg(F.count("*").alias("n"), F.sum("start").alias("sum_start"))


def _glued(s, d):
    t = _words(s, d).withColumn("word", F.when(F.col("word_pos") % 17 == 5, "  ").when((F.col("task_id") % 2 == 0) & (F.col("word_pos") % 3 > 0), F.concat(F.lit(" "), "word")).otherwise(F.col("word")))
    t = t.withColumn("word", F.when((F.col("task_id") % 4 != 1) | (F.col("word_pos") % 17 != 5), F.col("word")).otherwise(""))
    return sq.glue_subwords(t, ["task_id"]).groupBy("task_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.md5(sq.ordered_texts("word", "word_no", sep="|")).alias("h"))


def _chunks(s, d):
    return spread(read(s, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(sq.chunk_sentences(F.col("text"))).alias("pos", "chunk"))


def _packed(s, d):
    t = read(s, d, "documents").withColumn("u", tx.split_sentences(F.col("text")))
    packs = sq.pack_units(F.col("u"), F.transform("u", tx.estimate_tokens), 200)
    return t.select("doc_id", F.posexplode(packs).alias("pack", "units")).select("doc_id", "pack", F.size("units").alias("n_units"), F.array_join("units", " ").alias("text"))


def _plan(s, d):
    r = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_extendedprice") % 1000)).alias("points"), F.max(F.col("l_extendedprice") % 1500).alias("duration"))
    r = r.withColumn("thin", sq.thin_points(F.col("points"), 60.0))
    return r.select("l_orderkey", F.posexplode(sq.plan_segments(F.col("duration"), F.col("thin"), 300.0, 60.0, 3.0)).alias("segment", "span")).select("l_orderkey", "segment", "span.start", F.col("span.end").alias("stop"))


def _quality(s, d):
    n = int(s.conf.get("spark.sql.shuffle.partitions"))  # much work per row: few row groups or small joins else end in one task
    table = read(s, d, "documents").filter("doc_id is not null")
    text = F.col("text")
    # Each text is measured where it was dealt to, so the join meets what was measured, not the texts.
    known = F.when(text.isNotNull(), F.coalesce(sq.repeat_share(text), F.lit(0.0)))
    summary = table.select("doc_id", "text").repartition(n, "doc_id").select("doc_id", tx.measured(text).alias("summary"), known.alias("repeats"), tx.format_metrics(text).alias("form"))
    source = table.select((F.col("doc_id") - 1).alias("doc_id"), "text").repartition(n, "doc_id").select("doc_id", tx.measured(text).alias("source"))
    q = summary.join(source, "doc_id").select("doc_id", tx.compared(F.col("summary"), F.col("source"), F.lit(True), F.col("repeats"), F.col("form")).alias("q")).select("doc_id", "q.*")
    return q.select("*", "format.paragraph_count", "format.bullet_ratio", "format.heading_count").drop("format")


def _utterances(s, d):
    t = read(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), F.replace(x["text"], F.lit("\n"), F.lit(" ")))), "\n\n").alias("t"))
    return t.select("conv_id", F.posexplode(tx.split_utterances(F.col("t"))).alias("pos", "utterance"))


# Messages around each turn's text, and languages and probabilities of its length; both engines build them alike.
_MESSAGE = "CASE (conv_id + turn) % 6 WHEN 0 THEN concat(substring(text, 1, 40), ' PREMIERES in ', turn, ' hours') WHEN 1 THEN concat('this live event will Begin in a few moments. ', text) WHEN 2 THEN concat('n_ctx ', text, ' too LARGE') WHEN 3 THEN concat('N_CTX is ', length(text)) WHEN 4 THEN concat(text, ' context length exceeded: ', turn) ELSE text END"
_LANGUAGE = "CASE turn % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(' ', upper(substring(role, 1, 2)), ' ') WHEN 2 THEN 'auto' WHEN 3 THEN '' ELSE role END"
_SURE = "CASE WHEN conv_id % 6 > 0 THEN length(text) % 100 / 100.0E0 END"


def _failures(s, d):
    t = read(s, d, "conversations").selectExpr("conv_id", "turn", "role", f"{_MESSAGE} AS m", f"{_LANGUAGE} AS l", f"{_SURE} AS p")
    return t.select("conv_id", "turn", tx.classify_failure(F.col("m")).alias("code"), tx.is_context_overflow(F.col("m")).alias("overflow"), tx.effective_language(F.col("l"), F.col("role")).alias("language"), tx.language_gate(F.col("l"), F.col("p"), 0.5).alias("gate"))


# Pieces of comparison SQL: a token without its signs; sentences of a transcript; the heuristics for ASR texts.
def _token(x: str) -> str:
    return rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{M}}\p{{N}}_]+', '', 'g'))"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _tokens(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda x: {_token('x')}), lambda x: x <> '')"


_SAID = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '')"
_ASR = _tokens(r"regexp_split_to_array(lower(text), '\s+')") + " AS t, " + _tokens("regexp_split_to_array(lower(text), '[.!?…]+')") + " AS s"
_SUSPICIOUS = """coalesce(CASE WHEN len(t) >= 10 THEN (len(list_distinct(t)) / len(t)::DOUBLE < 0.30)::INT + (list_max(map_values(list_histogram(t))) / len(t)::DOUBLE > 0.35)::INT ELSE -9 END
 + (len(s) >= 5 AND (len(list_distinct(s[1:5])) = 1 OR len(list_distinct(s[-5:])) = 1))::INT >= 2, false)"""


def _runs_cut(sentences: str) -> str:
    """SQL: runs of equal sentences of each ``id``, without those of six and more at the edges: (id, i, s) of the kept ones.

    ``sentences`` defines a table of (id, i, s), i in order."""
    return f"""x AS ({sentences}), k AS (SELECT *, {_token('s')} AS k FROM x),
 c AS (SELECT *, (row_number() OVER p = 1 OR k <> lag(k) OVER p)::INT AS ch FROM k WINDOW p AS (PARTITION BY id ORDER BY i)),
 n AS (SELECT *, sum(ch) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c),
 r AS (SELECT id, run, count(*) < 6 OR any_value(k) = '' OR length(any_value(k)) > 64 AS stays FROM n GROUP BY ALL),
 e AS (SELECT id, min(run) FILTER (stays) AS first, max(run) FILTER (stays) AS last FROM r GROUP BY 1),
 kept AS (SELECT n.id, i, s FROM n JOIN e ON n.id = e.id AND run BETWEEN first AND last)"""


_ABSORB = (
    _GROUPS
    + """, z AS (SELECT *, n_words >= 18 AND "end" - start >= 18 AND speaker IS NOT NULL AS big FROM g),
 y AS (SELECT *, coalesce(bool_or(big) OVER b, false) AS bb, coalesce(bool_or(speaker IS NULL) OVER b, false) AS nb FROM z WINDOW b AS (PARTITION BY task_id ORDER BY island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 a AS (SELECT *, CASE WHEN big OR speaker IS NULL AND NOT bb AND NOT nb THEN island END AS anchor FROM y),
 t AS (SELECT *, coalesce(last_value(anchor IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY island ROWS UNBOUNDED PRECEDING), first_value(anchor IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY island ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM a),
 u AS (SELECT task_id, q, max(CASE WHEN island = q THEN speaker END) AS speaker, sum(n_words) AS n_words, min_by(start, island) AS start, max_by("end", island) AS "end", string_agg(text, ' ' ORDER BY island) AS text FROM t WHERE q IS NOT NULL GROUP BY ALL),
 v AS (SELECT *, (row_number() OVER p = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER p)::INT AS ch FROM u WINDOW p AS (PARTITION BY task_id ORDER BY q)),
 m AS (SELECT *, sum(ch) OVER (PARTITION BY task_id ORDER BY q ROWS UNBOUNDED PRECEDING) AS run FROM v)
 SELECT task_id, run::BIGINT AS island, any_value(speaker) AS speaker, sum(n_words)::INT AS n_words, min_by(start, q) AS start, max_by("end", q) AS "end", string_agg(text, ' ' ORDER BY q) AS text FROM m GROUP BY task_id, run"""
)
_TRIM_ENTRIES = (
    _E
    + ", o AS (SELECT task_id, pos, CASE WHEN task_id % 3 = 0 THEN repeat('Thank you. ', 4) || text ELSE text END AS text FROM entries), f AS (SELECT task_id, pos, unnest(l) AS s, generate_subscripts(l, 1) AS j FROM (SELECT task_id, pos, "
    + _SAID
    + " AS l FROM o)), "
    + _runs_cut("SELECT task_id AS id, pos * 1000000 + j AS i, s FROM f")
    + """, own AS (SELECT id AS task_id, i // 1000000 AS pos, string_agg(s, ' ' ORDER BY i) AS t FROM kept GROUP BY ALL)
 SELECT e.task_id, e.pos, e.speaker, e.start, e."end", coalesce(t, o.text) AS text FROM entries e JOIN o ON o.task_id = e.task_id AND o.pos = e.pos LEFT JOIN own ON own.task_id = e.task_id AND own.pos = e.pos WHERE t IS NOT NULL OR e.task_id NOT IN (SELECT task_id FROM own)"""
)
_TRIM_EDGES = (
    "WITH o AS (SELECT doc_id, repeat('Bye. ', 7) || text || ' Ok. Ok. Ok. Ok. Ok. Ok.' AS text FROM documents), l AS (SELECT doc_id, "
    + _SAID
    + " AS l FROM o), "
    + _runs_cut("SELECT doc_id AS id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM l")
    + f", j AS (SELECT id, string_agg(s, ' ' ORDER BY i) AS t FROM kept GROUP BY 1) SELECT doc_id, coalesce(t, {_strip('text')}) AS text FROM o LEFT JOIN j ON id = doc_id"
)
_TAIL = (
    _E
    + f""", q AS (SELECT task_id, pos, {_strip('text')} AS x, {_ASR} FROM entries),
 b AS (SELECT task_id, pos + 1 AS pos, CASE WHEN NOT {_SUSPICIOUS} AND x <> '' THEN right(x, 800) END AS prompt FROM q)
 SELECT e.task_id, e.pos AS segment_index, prompt FROM entries e LEFT JOIN b ON b.task_id = e.task_id AND b.pos = e.pos"""
)
_CHUNK_SQL = (
    r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?…]\s+|\n\n+)', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents WHERE text IS NOT NULL),
 u AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM p), w AS (SELECT *, regexp_replace(piece, '\s+$', '') AS bare FROM u),
 k AS (SELECT *, lower(regexp_extract(bare, '(\S+)$', 1)) AS word FROM w),
 f AS (SELECT *, NOT (bare LIKE '%.' AND (word IN ("""
    + ", ".join(f"'{a}'" for a in tx.ABBREVIATIONS)
    + r""") OR regexp_matches(word, '^\p{L}\.$') OR regexp_matches(word, '^\d+\.$'))) AS cut FROM k),
 g AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM f),
 j AS (SELECT doc_id, no, regexp_replace(string_agg(piece, '' ORDER BY i), '^\s+|\s+$', '', 'g') AS chunk FROM g GROUP BY ALL)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS INT) AS pos, chunk FROM j WHERE chunk <> ''"""
)
_PLAN_SQL = """WITH RECURSIVE r AS (SELECT l_orderkey, list_sort(list_distinct(list(l_extendedprice % 1000))) AS raw, max(l_extendedprice % 1500) AS duration FROM lineitem GROUP BY 1),
 t AS (SELECT l_orderkey, duration, list_reduce(raw, lambda a, p: CASE WHEN len(a) = 0 OR p - a[-1] > 6 THEN list_append(a, p) ELSE a END, []::DOUBLE[]) AS points FROM r WHERE duration > 0),
 c AS (SELECT l_orderkey, duration, points, 0 AS k, 0::DOUBLE AS cut, 300::DOUBLE AS cur FROM t
  UNION ALL SELECT l_orderkey, duration, points, k + 1, x, x + 300 FROM (SELECT *, CASE WHEN ch - cut < 45 THEN least(duration, cut + 300) ELSE ch END AS x FROM (SELECT *, coalesce(
   list_first(list_sort(list_transform(list_filter(points, lambda p: p >= greatest(0, cur - 60) AND p <= least(duration, cur + 60)), lambda p: {'d': abs(p - cur), 'p': p})))['p'], cur) AS ch FROM c WHERE cur < duration))),
 d AS (SELECT l_orderkey, duration, k, cut FROM c UNION ALL SELECT l_orderkey, duration, max(k) + 1, duration FROM c GROUP BY ALL),
 e AS (SELECT *, lead(cut) OVER p AS nxt, k = max(k) OVER (PARTITION BY l_orderkey) - 1 AS final FROM d WINDOW p AS (PARTITION BY l_orderkey ORDER BY k))
 SELECT l_orderkey, k AS segment, greatest(0, cut - CASE WHEN k > 0 THEN 3 ELSE 0 END)::DOUBLE AS start, least(duration, nxt + CASE WHEN final THEN 0 ELSE 3 END) AS stop FROM e WHERE nxt IS NOT NULL"""
_THROTTLE_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id AS task_id, CASE WHEN event_type <> 'error' THEN event_type END AS k, epoch_us(ts) / 1e6 AS t FROM events),
 n AS (SELECT *, row_number() OVER (PARTITION BY task_id, k ORDER BY t, event_id) AS rn FROM e WHERE k IS NOT NULL),
 p AS (SELECT event_id, task_id, k, rn, t AS last, true AS passes FROM n WHERE rn = 1
  UNION ALL SELECT n.event_id, n.task_id, n.k, n.rn, CASE WHEN n.t - p.last >= 7200 THEN n.t ELSE p.last END, n.t - p.last >= 7200 FROM p JOIN n ON n.task_id = p.task_id AND n.k = p.k AND n.rn = p.rn + 1)
 SELECT event_id, task_id FROM p WHERE passes UNION ALL SELECT event_id, task_id FROM e WHERE k IS NULL"""


_FAILURES_SQL = f"""WITH t AS (SELECT conv_id, turn, role, {_MESSAGE} AS m, {_LANGUAGE} AS l, {_SURE} AS p FROM conversations)
 SELECT conv_id, turn, CASE WHEN regexp_matches(m, '(?i){tx.LIVE_NOT_STARTED}') THEN 'download_live_not_started' END AS code, regexp_matches(lower(m), '{tx.OVERFLOW_HINTS}') OR contains(lower(m), 'n_ctx') AND regexp_matches(lower(m), 'exceed|too long|too large') AS overflow,
 CASE WHEN trim(l) IN ('', 'auto') OR l IS NULL THEN role ELSE lower(trim(l)) END AS language, CASE WHEN l IS NULL THEN 'missing_language' WHEN p IS NULL THEN 'missing_probability' WHEN p < 0.5 THEN 'low_confidence' ELSE 'ok' END AS gate FROM t"""


def _facts_sql(text: str) -> str:
    """SQL: (numbers, dates, units) of a text as sorted lists."""
    number = r"""list_reduce(range(1, len(regexp_split_to_array({0}, '[,.]'))), lambda a, i: a || CASE WHEN length(regexp_split_to_array({0}, '[,.]')[i + 1]) = 3 THEN '' ELSE regexp_extract_all({0}, '[,.]')[i] END || regexp_split_to_array({0}, '[,.]')[i + 1], regexp_split_to_array({0}, '[,.]')[1])"""
    plain = r"regexp_replace(x, '\s+', '', 'g')"
    months = "|".join(tx.MONTHS)
    numbers = rf"list_filter(list_transform(list_transform(regexp_extract_all({text}, '-?\b\d+(?:[.,\s]\d+)*\b'), lambda x: {plain}), lambda y: {number.format('y')}), lambda x: x NOT IN ('', '-'))"
    forms = [r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}\.\d{1,2}\.\d{4}\b", r"\b\d{1,2}/\d{1,2}/\d{4}\b"]
    dates = " || ".join(f"regexp_extract_all({text}, '{f}')" for f in forms) + rf" || list_transform(regexp_extract_all({text}, '(?i)\b\d{{1,2}}\s+(?:{months})\b|\b(?:{months})\s+\d{{1,4}}\b'), lambda x: lower(x))"
    form = rf"(?i)(-?\d+(?:[.,]\d+)?)\s*({tx.UNITS})(?:[^\p{{L}}\p{{M}}\p{{N}}_]|$)"
    values = rf"list_transform(regexp_extract_all({text}, '{form}', 1), lambda y: {number.format('y')})"
    units = rf"list_transform(list_zip({values}, regexp_extract_all({text}, '{form}', 2)), lambda z: z[1] || lower(z[2]))"
    return f"list_sort(list_distinct({numbers})) AS numbers, list_sort(list_distinct({dates})) AS dates, list_sort(list_distinct({units})) AS units"


_FACTS_SQL = f"WITH f AS (SELECT doc_id, {_facts_sql('text')} FROM documents) SELECT doc_id, array_to_string(numbers, ';') AS numbers, array_to_string(dates, ';') AS dates, array_to_string(units, ';') AS units FROM f"
_ASR_SQL = f"WITH q AS (SELECT doc_id, {_ASR} FROM documents) SELECT doc_id, {_SUSPICIOUS} AS suspicious, len(list_distinct(t))::DOUBLE AS score FROM q"
_SENT = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(1), 'g'), '\\n\\n+', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"
_PACK_SQL = f"""WITH RECURSIVE l AS (SELECT doc_id, {_SENT} AS l FROM documents), s AS (SELECT doc_id, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM l), z AS (SELECT *, greatest(1, length(u) // 4) AS n FROM s),
 p AS (SELECT doc_id, i, 0 AS pack, n AS total, n > 200 AS shut FROM z WHERE i = 1
  UNION ALL SELECT doc_id, i, pack + opens::INT, CASE WHEN opens THEN n ELSE total + n END, n > 200 FROM (SELECT z.doc_id, z.i, z.n, pack, total, z.n > 200 OR shut OR total + z.n > 200 AS opens FROM p JOIN z ON z.doc_id = p.doc_id AND z.i = p.i + 1))
 SELECT doc_id, pack, count(*)::INT AS n_units, string_agg(u, ' ' ORDER BY i) AS text FROM p JOIN s USING (doc_id, i) GROUP BY ALL"""
_SIGNED = "CASE WHEN coalesce(f, 0) >= 9223372036854775808 THEN coalesce(f, 0)::HUGEINT - 18446744073709551616 ELSE coalesce(f, 0)::HUGEINT END::BIGINT"


def _prints(key: str, texts: str) -> str:
    """SQL: 64-bit SimHash (key, f) over three-word shingles of a table of (key, text), where there are words."""
    return rf"""w AS (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM ({texts})),
 g AS (SELECT {key}, unnest(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS t FROM w),
 h AS (SELECT {key}, ('0x' || md5(t)[1:16])::UBIGINT AS h FROM g), b AS (SELECT {key}, unnest(range(64)) AS b, h FROM h), v AS (SELECT {key}, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM b GROUP BY ALL),
 f AS (SELECT {key}, sum(CASE WHEN v > 0 THEN 1::UBIGINT << b ELSE 0 END)::UBIGINT AS f FROM v GROUP BY ALL)"""


_FINGERPRINTS = "WITH " + _prints("conv_id, turn", "SELECT conv_id, turn, text FROM conversations")


def _fingerprints(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", tx.simhash(tx.word_ngrams(tx.words(F.col("text")), 3)).alias("fingerprint"))


def _redundancy_sql(key: str, table: str) -> str:
    """SQL: (key, share) of sentences that nearly repeat an earlier one, and ``s``, the sentences of each text."""
    return (
        f"WITH l AS (SELECT {key}, {_SENT} AS l FROM {table}), s AS (SELECT {key}, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM l), "
        + _prints(f"{key}, i", f"SELECT {key}, i, text FROM s")
        + f", q AS (SELECT {key}, i, coalesce(f, 0) AS f FROM s LEFT JOIN f USING ({key}, i)), near AS (SELECT DISTINCT {', '.join('a.' + k for k in key.split(', '))}, a.i FROM q a JOIN q b ON {' AND '.join(f'a.{k} = b.{k}' for k in key.split(', '))} AND b.i < a.i AND bit_count(xor(a.f, b.f)) <= 3)"
        + f", share AS (SELECT {key}, CASE WHEN len(l) < 2 THEN 0 ELSE coalesce(n, 0) / len(l)::DOUBLE END AS share FROM l LEFT JOIN (SELECT {key}, count(*) AS n FROM near GROUP BY ALL) USING ({key}))"
    )


def _quality_sql() -> str:
    sides = ", ".join(f"len(a.{x})::INT AS {x}_in_summary, len(b.{x})::INT AS {x}_in_transcript, len(list_filter(a.{x}, lambda v: NOT list_contains(b.{x}, v)))::INT AS {x[:-1]}_mismatch_count" for x in ("numbers", "dates", "units"))
    return (
        _redundancy_sql("doc_id", "documents")
        + rf""", ls AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') END AS ls FROM documents),
 fm AS (SELECT doc_id, len(list_filter(range(1, len(ls) + 1), lambda i: {_strip('ls[i]')} <> '' AND (i = 1 OR {_strip('ls[i - 1]')} = '')))::INT AS paragraph_count,
  CASE WHEN len(ls) = 0 THEN 0 ELSE round_even(len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]\s'))) / len(ls)::DOUBLE, 4) END AS bullet_ratio,
  len(list_filter(ls, lambda x: regexp_matches(x, '^\s*#{{1,6}}\s') OR regexp_matches(x, '^[A-ZА-ЯЁ][A-ZА-ЯЁ0-9 ]{{2,}}:\s*$')))::INT AS heading_count FROM ls),
 fc AS (SELECT doc_id, length(text)::INT AS chars, greatest(1, length(text) // 4)::INT AS tokens, {_facts_sql('text')} FROM documents)
 SELECT a.doc_id, b.tokens AS transcript_tokens, b.chars AS transcript_chars, true AS token_estimate, a.tokens AS summary_tokens, a.chars AS summary_chars, round_even(a.tokens / b.tokens::DOUBLE, 4) AS compression_ratio,
 round_even(share, 4) AS redundancy_dup_sentence_ratio, {sides}, paragraph_count, bullet_ratio, heading_count FROM fc a JOIN fc b ON b.doc_id = a.doc_id + 1 JOIN share ON share.doc_id = a.doc_id JOIN fm ON fm.doc_id = a.doc_id"""
    )


QUERIES = {
    "speaker_at": (lambda s, d: iv.speaker_at(view(s, d, "spans"), view(s, d, "turns")).select("task_id", "span_id", "speaker"), _MEET + " SELECT task_id, span_id, speaker FROM spans LEFT JOIN b USING (task_id, span_id)"),
    "nearest_speaker": (
        lambda s, d: iv.nearest_speaker(view(s, d, "spans"), view(s, d, "turns")).select("task_id", "span_id", "speaker"),
        _MEET
        + """, g AS (SELECT s.task_id, s.span_id, t.speaker, t.seg_pos, (s.start + s."end") / 2 AS mid, t.start AS a, t."end" AS z FROM spans s JOIN turns t USING (task_id)),
 n AS (SELECT task_id, span_id, min_by(speaker, (CASE WHEN mid BETWEEN a AND z THEN 0 ELSE least(abs(mid - a), abs(mid - z)) END, seg_pos)) AS near FROM g GROUP BY ALL)
 SELECT task_id, span_id, coalesce(speaker, near) AS speaker FROM spans LEFT JOIN b USING (task_id, span_id) LEFT JOIN n USING (task_id, span_id)""",
    ),
    "midpoint_blocks": (
        _blocks,
        cte("entries", "turns")
        + """, x AS (SELECT e.task_id, e.pos AS block_id, string_agg('s' || t.seg_pos, '|' ORDER BY (t.start + t."end") / 2 + 150, t.seg_pos) AS s FROM entries e JOIN turns t ON t.task_id = e.task_id AND (t.start + t."end") / 2 + 150 >= e.start AND (t.start + t."end") / 2 + 150 < e."end" GROUP BY ALL)
 SELECT e.task_id, e.pos AS block_id, coalesce(s, 'block ' || e.pos) AS sentences FROM entries e LEFT JOIN x ON x.task_id = e.task_id AND x.block_id = e.pos""",
    ),
    "words_in_entry": (_in_entry, _WORDS + " SELECT task_id, count(*) AS n, sum(start + 0.5::DOUBLE) AS sum_start FROM words WHERE \"end\" + 0.5 > start - word_pos % 5 AND start + 0.5 < start + word_pos % 3 - 1 GROUP BY 1"),
    "labels_without_entries": (lambda s, d: iv.labels_without_entries(view(s, d, "turns"), view(s, d, "entries")), cte("turns", "entries") + " SELECT DISTINCT task_id, speaker FROM turns EXCEPT SELECT task_id, speaker FROM entries"),
    "speaker_seconds": (lambda s, d: iv.speaker_seconds(view(s, d, "entries")), _E + ' SELECT task_id, speaker, sum("end" - start) AS seconds FROM entries WHERE speaker IS NOT NULL GROUP BY ALL'),
    "speaker_shares": (lambda s, d: iv.speaker_shares(view(s, d, "entries")).select("task_id", "speaker", F.round("share", 9).alias("share")), _E + ', g AS (SELECT task_id, speaker, sum("end" - start) AS x FROM entries WHERE speaker IS NOT NULL GROUP BY ALL) SELECT task_id, speaker, round(x / sum(x) OVER (PARTITION BY task_id), 9) AS share FROM g'),
    "drop_marginal": (
        _marginal,
        _E
        + """, g AS (SELECT task_id, speaker, sum("end" - start) AS x, min(pos) AS p FROM entries WHERE speaker IS NOT NULL GROUP BY ALL),
 h AS (SELECT task_id, speaker, x / sum(x) OVER (PARTITION BY task_id) AS share, first_value(speaker) OVER (PARTITION BY task_id ORDER BY x DESC, p) AS top FROM g)
 SELECT e.task_id, e.pos, CASE WHEN share < 0.3 THEN top ELSE e.speaker END AS speaker FROM entries e LEFT JOIN h ON h.task_id = e.task_id AND h.speaker = e.speaker""",
    ),
    "speaker_count": (
        lambda s, d: iv.speaker_count(view(s, d, "entries"), view(s, d, "entries").filter("speaker = 'system'")),
        _E + " SELECT task_id, count(DISTINCT speaker) FILTER (speaker <> 'system') AS speakers FROM entries WHERE speaker IS NOT NULL GROUP BY 1",
    ),
    "participants": (
        lambda s, d: iv.participants(view(s, d, "entries"), _names(s, d)).select("task_id", F.array_join("named", ",").alias("named"), F.array_join("anonymous", ",").alias("anonymous")),
        _E + _NAMES + ", f AS (SELECT task_id, speaker, min(pos) AS p FROM entries WHERE speaker IS NOT NULL GROUP BY ALL) SELECT f.task_id, coalesce(string_agg(name, ',' ORDER BY p), '') AS named, coalesce(string_agg(CASE WHEN name IS NULL THEN f.speaker END, ',' ORDER BY p), '') AS anonymous FROM f LEFT JOIN names n ON n.task_id = f.task_id AND n.speaker = f.speaker GROUP BY 1",
    ),
    "group_words": (lambda s, d: sq.group_words(_words(s, d), ["task_id"]), _GROUPS + " SELECT * FROM g"),
    "absorb_small": (lambda s, d: sq.absorb_small(sq.group_words(_words(s, d), ["task_id"]), ["task_id"], 18, 18.0), _ABSORB),
    "merge_adjacent": (
        lambda s, d: sq.merge_adjacent(sq.group_words(_words(s, d), ["task_id"]).filter("n_words > 19 or speaker = 'A'"), ["task_id"]).select("task_id", "speaker", "n_words", "start"),
        _GROUPS
        + """, k AS (SELECT *, (row_number() OVER p = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER p)::INT AS ch FROM g WHERE n_words > 19 OR speaker = 'A' WINDOW p AS (PARTITION BY task_id ORDER BY island)),
 j AS (SELECT *, sum(ch) OVER (PARTITION BY task_id ORDER BY island ROWS UNBOUNDED PRECEDING) AS q FROM k) SELECT task_id, any_value(speaker) AS speaker, sum(n_words)::INT AS n_words, min_by(start, island) AS start FROM j GROUP BY task_id, q""",
    ),
    "glue_subwords": (
        _glued,
        _WORDS
        + """, t AS (SELECT task_id, word_pos, start, "end", CASE WHEN word_pos % 17 = 5 THEN CASE WHEN task_id % 4 = 1 THEN '' ELSE '  ' END WHEN task_id % 2 = 0 AND word_pos % 3 > 0 THEN ' ' || word ELSE word END AS word FROM words),
 k AS (SELECT *, bool_or(starts_with(word, ' ')) OVER (PARTITION BY task_id) AS k FROM t),
 o AS (SELECT *, (NOT k OR starts_with(word, ' ') OR row_number() OVER (PARTITION BY task_id ORDER BY word_pos) = 1)::INT AS op FROM k WHERE regexp_replace(word, '\\s', '', 'g') <> ''),
 n AS (SELECT *, sum(op) OVER (PARTITION BY task_id ORDER BY word_pos ROWS UNBOUNDED PRECEDING) AS no FROM o),
 g AS (SELECT task_id, no, string_agg(regexp_replace(word, '^\\s+|\\s+$', '', 'g'), '' ORDER BY word_pos) AS word, min_by(start, word_pos) AS start, max_by("end", word_pos) AS "end" FROM n GROUP BY ALL)
 SELECT task_id, count(*) AS n, sum(start) AS starts, sum("end") AS ends, md5(string_agg(word, '|' ORDER BY no)) AS h FROM g GROUP BY 1""",
    ),
    "label_map": (lambda s, d: sq.label_map(view(s, d, "entries"), _names(s, d)), _LABELS + " SELECT task_id, speaker, label FROM l"),
    "render_dialogue": (
        lambda s, d: sq.render_dialogue(view(s, d, "entries"), sq.label_map(view(s, d, "entries"), _names(s, d))).select("task_id", F.md5("rendered").alias("h")),
        _LABELS
        + """, t AS (SELECT e.task_id, pos, e.speaker, label, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM entries e LEFT JOIN l ON l.task_id = e.task_id AND l.speaker = e.speaker),
 c AS (SELECT *, (row_number() OVER p = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER p)::INT AS ch FROM t WHERE text <> '' WINDOW p AS (PARTITION BY task_id ORDER BY pos)), i AS (SELECT *, sum(ch) OVER (PARTITION BY task_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS q FROM c),
 b AS (SELECT task_id, q, any_value(label) AS label, string_agg(text, ' ' ORDER BY pos) AS t FROM i GROUP BY ALL) SELECT task_id, md5(CASE WHEN count(DISTINCT label) > 1 THEN string_agg(CASE WHEN label IS NULL THEN t ELSE label || ': ' || t END, chr(10) || chr(10) ORDER BY q) ELSE string_agg(t, ' ' ORDER BY q) END) AS h FROM b GROUP BY 1""",
    ),
    "flat_text": (lambda s, d: sq.flat_text(view(s, d, "entries")).select("task_id", F.md5("text").alias("h")), _E + ", t AS (SELECT task_id, pos, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM entries) SELECT task_id, md5(string_agg(x, ' ' ORDER BY pos)) AS h FROM t WHERE x <> '' GROUP BY 1"),
    "trim_entries": (lambda s, d: sq.trim_entries(view(s, d, "entries").withColumn("text", F.when(F.col("task_id") % 3 == 0, F.concat(F.repeat(F.lit("Thank you. "), 4), "text")).otherwise(F.col("text")))), _TRIM_ENTRIES),
    "trim_edges": (lambda s, d: read(s, d, "documents").select("doc_id", sq.trim_edges(F.concat(F.repeat(F.lit("Bye. "), 7), "text", F.lit(" Ok. Ok. Ok. Ok. Ok. Ok."))).alias("text")), _TRIM_EDGES),
    "previous_tail": (lambda s, d: sq.previous_tail(view(s, d, "entries").select("task_id", F.col("pos").alias("segment_index"), "text")).select("task_id", "segment_index", "prompt"), _TAIL),
    "chunk_sentences": (_chunks, _CHUNK_SQL),
    "pack_units": (_packed, _PACK_SQL),
    "plan_segments": (_plan, _PLAN_SQL),
    "preview_turns": (
        lambda s, d: sq.preview_turns(view(s, d, "turns"), "task_id", 200.0, 2),
        cte("turns")
        + """, r AS (SELECT *, row_number() OVER (PARTITION BY task_id, speaker ORDER BY "end" - start DESC, seg_pos)::INT AS rank, least(200, "end" - start) AS clip FROM turns)
 SELECT task_id, speaker, rank, (start + "end" - clip) / 2 AS clip_start, (start + "end" + clip) / 2 AS clip_end FROM r WHERE rank <= 2""",
    ),
    "sentences": (lambda s, d: read(s, d, "documents").select("doc_id", F.size(tx.split_sentences(F.col("text"))).alias("n"), F.md5(F.array_join(tx.split_sentences(F.col("text")), "|")).alias("h"), tx.estimate_tokens(F.col("text")).alias("tokens")), f"WITH x AS (SELECT doc_id, text, {_SENT} AS s FROM documents) SELECT doc_id, len(s)::INT AS n, md5(array_to_string(s, '|')) AS h, greatest(1, length(text) // 4)::INT AS tokens FROM x"),
    "simhash60": (
        lambda s, d: _fingerprints(s, d).select("conv_id", "turn", F.shiftrightunsigned("fingerprint", 4).alias("fingerprint")),
        _FINGERPRINTS + " SELECT conv_id, turn, (coalesce(f, 0) >> 4)::BIGINT AS fingerprint FROM conversations LEFT JOIN f USING (conv_id, turn)",
    ),
    "simhash64": (_fingerprints, _FINGERPRINTS + f" SELECT conv_id, turn, {_SIGNED} AS fingerprint FROM conversations LEFT JOIN f USING (conv_id, turn)"),
    "redundancy": (lambda s, d: read(s, d, "conversations").select("conv_id", "turn", F.bround(tx.redundancy(F.col("text")), 4).alias("redundancy")), _redundancy_sql("conv_id, turn", "conversations") + " SELECT conv_id, turn, round_even(share, 4) AS redundancy FROM share"),
    "quality_record": (_quality, _quality_sql()),
    "facts": (lambda s, d: spread(read(s, d, "documents").select("doc_id", "text")).select("doc_id", F.array_join(F.array_sort(tx.extract_numbers(F.col("text"))), ";").alias("numbers"), F.array_join(F.array_sort(tx.extract_dates(F.col("text"))), ";").alias("dates"), F.array_join(F.array_sort(tx.extract_units(F.col("text"))), ";").alias("units")), _FACTS_SQL),
    "hallucinations": (lambda s, d: read(s, d, "documents").select("doc_id", tx.is_probable_hallucination(F.col("text")).alias("suspicious"), tx.transcript_quality(F.col("text")).alias("score")), _ASR_SQL),
    "utterances": (_utterances, "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, regexp_replace(role || ': ' || replace(text, chr(10), ' '), '\\s+$', '') AS utterance FROM conversations"),
    "failures": (_failures, _FAILURES_SQL),
    "timecodes": (
        lambda s, d: read(s, d, "orders").select("o_orderkey", tx.timecode(F.col("o_totalprice") / 10).alias("code"), tx.user_hash(F.col("o_custkey").cast("string")).alias("dir")),
        "SELECT o_orderkey, CASE WHEN x >= 3600 THEN (x // 3600) || ':' || lpad((x // 60 % 60)::VARCHAR, 2, '0') ELSE (x // 60)::VARCHAR END || ':' || lpad((x % 60)::VARCHAR, 2, '0') AS code, sha256(o_custkey::VARCHAR)[1:24] AS dir FROM (SELECT *, floor(o_totalprice / 10)::INT AS x FROM orders)",
    ),
    "natural_sort": (
        lambda s, d: read(s, d, "part").select("p_partkey", tx.natural_key(F.concat(F.lit("Rec_"), F.col("p_partkey"), F.lit(".WAV"))).alias("key"), tx.suffix_kind(F.concat(F.lit("a."), F.element_at(F.array(F.lit("MP4"), F.lit("wav"), F.lit("txt")), (F.col("p_partkey") % 3 + 1).cast("int"))), [".mp4"], [".wav"]).alias("kind")),
        "SELECT p_partkey, 'rec_' || lpad(p_partkey::VARCHAR, 20, '0') || '.wav' AS key, CASE p_partkey % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'unsupported' END AS kind FROM part",
    ),
    "text_slices": (
        lambda s, d: read(s, d, "pages").select("page_id", tx.text_slice(F.col("html"), (F.col("page_id") % 100 * 37).cast("int"), F.lit(250)).alias("x"), tx.parse_range(F.concat(F.lit("bytes="), F.col("page_id") * 11, F.lit("-"), F.when(F.col("page_id") % 2 == 0, (F.col("page_id") * 11 + 99).cast("string")).otherwise("")), F.length("html").cast("long")).alias("r")).select("page_id", F.md5("x.text").alias("h"), "x.is_end", "r.offset", "r.length"),
        """WITH p AS (SELECT page_id, html, length(html) AS n, page_id % 100 * 37 AS o, page_id * 11 AS a FROM pages) SELECT page_id, md5(substring(html, o + 1, 250)) AS h, o + 250 >= n AS is_end, CASE WHEN a < n THEN a END AS "offset", CASE WHEN a < n THEN least(CASE WHEN page_id % 2 = 0 THEN a + 99 ELSE n - 1 END, n - 1) - a + 1 END AS length FROM p""",
    ),
    "references": (
        lambda s, d: read(s, d, "events").select("event_id", tx.parse_ref(F.when(F.col("event_id") % 2 == 0, F.concat_ws(":", "event_type", "user_id")).otherwise(F.col("event_type"))).alias("r"), tx.display_name(F.concat(F.lit(" "), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).otherwise(""))).alias("title"), tx.loose_boolean(F.element_at(F.array(F.lit("Yes"), F.lit("0"), F.lit(None)), (F.col("event_id") % 3 + 1).cast("int")), True).alias("flag")).select("event_id", "r.source", "r.id", "title", "flag"),
        "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS source, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR END AS id, CASE WHEN event_id % 3 > 0 THEN event_type END AS title, event_id % 3 <> 1 AS flag FROM events",
    ),
    "throttle": (lambda s, d: throttle(read(s, d, "events").select("event_id", F.col("user_id").alias("task_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("throttle_key"), (F.unix_micros("ts") / 1e6).alias("mono_ts")), 7200.0).select("event_id", "task_id"), _THROTTLE_SQL),
}
