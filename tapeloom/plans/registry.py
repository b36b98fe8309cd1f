"""Queries on voices, decisions and noise, with their comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import numbers as nm
from tapeloom.operators import registry as rg
from tapeloom.plans.adapters import cte, read, view

_DIST = "CASE WHEN list_dot_product(a.vector::DOUBLE[], a.vector::DOUBLE[]) = 0 OR list_dot_product(b.vector::DOUBLE[], b.vector::DOUBLE[]) = 0 THEN 1.0 ELSE 1 - list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[]) / (sqrt(list_dot_product(a.vector::DOUBLE[], a.vector::DOUBLE[])) * sqrt(list_dot_product(b.vector::DOUBLE[], b.vector::DOUBLE[]))) END"


def _nearest(s, d):
    samples = view(s, d, "samples")
    queries = samples.filter("sample_id % 20 = 0").select(F.col("sample_id").alias("query_id"), "vector", "model")
    return rg.nearest(queries, samples, 3)


_NEAREST = (
    cte("samples")
    + f""", e AS (SELECT a.sample_id AS query_id, b.speaker_id, min({_DIST}) AS distance FROM samples a JOIN samples b ON a.model = b.model AND a.sample_id % 20 = 0 AND a.sample_id <> b.sample_id GROUP BY ALL),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, speaker_id) AS INT) AS rank FROM e QUALIFY rank <= 3)"""
)


def _shares(s, d):
    e = view(s, d, "samples").select((F.col("sample_id") % 50).alias("task_id"), F.col("speaker_id").cast("string").alias("speaker"), "vector", "sample_id")
    g = e.groupBy("task_id", "speaker").agg(F.min_by("vector", "sample_id").alias("vector"), F.count("*").alias("n"))
    return g.select("task_id", "speaker", "vector"), g.select("task_id", "speaker", (F.col("n") / 10.0).alias("share"))


def _noise(s, d):
    vectors, shares = _shares(s, d)
    return rg.auto_noise(shares, vectors, 0.25, 0.9)


_SHARES = cte("samples") + ", g AS (SELECT sample_id % 50 AS task_id, CAST(speaker_id AS VARCHAR) AS speaker, min_by(vector, sample_id) AS vector, count(*) / 10.0::DOUBLE AS share FROM samples GROUP BY ALL)"
_NOISE = _SHARES + f", auto AS (SELECT DISTINCT a.task_id, a.speaker FROM g a JOIN g b ON a.task_id = b.task_id AND a.share < 0.25 AND b.share > a.share WHERE {_DIST} <= 0.9)"


def _decided(s, d):
    """All decisions; the recordings without any are those whose ids the users don't reach."""
    return view(s, d, "decisions").select((F.col("task_id") * 2).alias("task_id"), (F.col("decision_id") % 10).cast("string").alias("speaker"), "is_noise")


_RESOLVED = (
    _NOISE.replace("WITH samples", "WITH decisions AS (SELECT "  + cte("decisions").split("AS (SELECT ", 1)[1].rstrip(")") + "), samples", 1)
    + ", d AS (SELECT task_id * 2 AS task_id, CAST(decision_id % 10 AS VARCHAR) AS speaker, is_noise FROM decisions), n AS (SELECT DISTINCT task_id, speaker FROM d WHERE is_noise UNION ALL SELECT task_id, speaker FROM auto WHERE task_id NOT IN (SELECT task_id FROM d))"
)


def _kept(s, d):
    entries = view(s, d, "samples").select((F.col("sample_id") % 50).alias("task_id"), F.col("speaker_id").cast("string").alias("speaker"), "sample_id")
    return rg.without_noise(entries, rg.resolve_noise(_decided(s, d), _noise(s, d))).select("task_id", "speaker", "sample_id")


def _pause(s, d):
    m = view(s, d, "decisions").select("task_id", nm.bucket(F.col("decision_id") % 100 / 100).alias("bucket"), "is_noise")
    return rg.needs_pause(m)


def _live(s, d):
    m = read(s, d, "supplier").select(F.col("s_suppkey").alias("match_id"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct((F.col("s_nationkey") + i * 7).alias("speaker_id"), F.concat(F.lit("old "), i.cast("string")).alias("name"))).alias("candidates"))
    out = rg.live_names(m, view(s, d, "speakers"))
    return out.select("match_id", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["speaker_id"].cast("string"), c["name"])), ",").alias("candidates"))


_DEC = cte("decisions", "speakers")
_LATEST = "QUALIFY row_number() OVER (PARTITION BY task_id, label ORDER BY created_at DESC, decision_id DESC) = 1"
QUERIES = {
    "nearest_speakers": (lambda s, d: _nearest(s, d).select("query_id", "speaker_id", F.round("distance", 6).alias("distance"), "rank"), _NEAREST + " SELECT query_id, speaker_id, round(distance, 6) AS distance, rank FROM r"),
    "match_buckets": (lambda s, d: rg.bucketed(_nearest(s, d), 0.6, 0.75).groupBy("query_id", "bucket").agg(F.count("*").alias("n")), _NEAREST + " SELECT query_id, CASE WHEN distance <= 0.6 THEN 'auto' WHEN distance <= 0.75 THEN 'grey' ELSE 'miss' END AS bucket, count(*) AS n FROM r GROUP BY ALL"),
    "samples_for_model": (lambda s, d: rg.samples_for(view(s, d, "speakers"), view(s, d, "samples"), 1, 7), cte("speakers", "samples") + " SELECT p.speaker_id, p.name, count(sample_id) AS samples FROM speakers p LEFT JOIN samples x ON x.speaker_id = p.speaker_id AND model = 1 AND sample_id <> 7 GROUP BY ALL"),
    "latest_decisions": (lambda s, d: rg.latest(view(s, d, "decisions"), ["task_id", "label"]).select("task_id", "label", "decision_id"), _DEC + f" SELECT task_id, label, decision_id FROM decisions {_LATEST}"),
    "speaker_names": (lambda s, d: rg.speaker_names(view(s, d, "decisions"), view(s, d, "speakers"), ["task_id", "label"]), _DEC + f" SELECT task_id, label, name FROM decisions JOIN speakers USING (speaker_id) {_LATEST}"),
    "current_decisions": (
        lambda s, d: rg.current_decisions(view(s, d, "decisions"), view(s, d, "speakers"), ["task_id", "label"]),
        _DEC + f", l AS (SELECT * FROM decisions {_LATEST}) SELECT task_id, label, CASE WHEN name IS NOT NULL THEN l.speaker_id END AS speaker_id, name, is_noise FROM l LEFT JOIN speakers p ON p.speaker_id = l.speaker_id",
    ),
    "auto_noise": (_noise, _NOISE + " SELECT task_id, speaker FROM auto"),
    "resolved_noise": (lambda s, d: rg.resolve_noise(_decided(s, d), _noise(s, d)), _RESOLVED + " SELECT task_id, speaker FROM n"),
    "without_noise": (
        _kept,
        _RESOLVED
        + ", e AS (SELECT sample_id % 50 AS task_id, CAST(speaker_id AS VARCHAR) AS speaker, sample_id, (sample_id % 50, CAST(speaker_id AS VARCHAR)) IN (SELECT (task_id, speaker) FROM n) AS bad FROM samples) SELECT task_id, speaker, sample_id FROM e QUALIFY NOT bad OR bool_and(bad) OVER (PARTITION BY task_id)",
    ),
    "needs_pause": (
        _pause,
        cte("decisions") + ", m AS (SELECT task_id, CASE WHEN decision_id % 100 <= 25 THEN 'auto' WHEN decision_id % 100 <= 55 THEN 'grey' ELSE 'miss' END AS bucket, is_noise FROM decisions) SELECT task_id, bool_or(bucket <> 'auto' AND NOT is_noise) AS pause FROM m GROUP BY 1",
    ),
    "live_names": (
        _live,
        cte("speakers") + ", c AS (SELECT s_suppkey AS match_id, unnest([0, 1, 2]) AS i, s_nationkey + unnest([0, 7, 14]) AS k FROM supplier) SELECT match_id, string_agg(k || ':' || coalesce(name, 'old ' || i), ',' ORDER BY i) AS candidates FROM c LEFT JOIN speakers ON speaker_id = k GROUP BY 1",
    ),
}
