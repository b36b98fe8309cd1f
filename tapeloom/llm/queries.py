"""The registered queries of the training-data operators, each over its whole table, and their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import bpe, collocations, embed, htmltext, infill, linededup, media, packing, pii, simhash, suffixes, topk, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(_docs(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_repeated_lines(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op4_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(_docs(spark, sf_dir))
    text = F.make_valid_utf8(F.col("kept").cast("string"))  # a cut may fall inside a character
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"), text.alias("text"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pii_key(spark: SparkSession) -> str:
    """The key of the surrogates: ``spark.tapeloom.pii.key``, a secret of whoever runs the job. The default is for tests only."""
    return spark.conf.get("spark.tapeloom.pii.key", "not a secret: for tests")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_docs(spark, sf_dir), key=pii_key(spark)).select("doc_id", "text", "n_entities")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.fit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(_docs(spark, sf_dir), model).select("doc_id", "held_out", "score", "predicted")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_docs(spark, sf_dir), _tokenizer(), digests=True)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), _tokenizer())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_docs(spark, sf_dir))


def op12_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.transform(_docs(spark, sf_dir))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
bad AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(bad.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN bad.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM lines LEFT JOIN bad ON lines.k = bad.k GROUP BY doc_id
"""

# All pairs of a label: for small tables, as brute force to compare with.
OP6_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
         WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pair GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(low.b, vec_id) AS component_id, vec_id = coalesce(low.b, vec_id) AS kept
FROM embeddings LEFT JOIN links ON links.a = vec_id LEFT JOIN low ON low.a = vec_id
"""

OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, w[i:i + s - 1] AS g FROM places, (SELECT unnest([1, 2, 3, 4]) AS s) WHERE i + s - 1 <= len(w)),
f AS (SELECT lang, g, count(*)::BIGINT AS a FROM grams GROUP BY lang, g HAVING count(*) >= 30),
inner_parts AS (
  SELECT lang, a, g[i:i + s - 1] AS part FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM f WHERE len(g) > 2), (SELECT unnest([2, 3]) AS s)
  WHERE s < len(g) AND i + s - 1 <= len(g)),
carried AS (SELECT lang, part, max(a) AS most FROM inner_parts GROUP BY lang, part),
kept AS (SELECT f.* FROM f LEFT JOIN carried c ON c.lang = f.lang AND c.part = f.g WHERE len(f.g) > 1 AND (most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT)),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM kept),
scored AS (
  SELECT c.*, x.a AS l, y.a AS r, (2000000 * c.a::HUGEINT) // (x.a + y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:len(c.g)]),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM weakest)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

# All queries with all rows: for small tables, as brute force to compare with.
OP12_SQL = """
WITH good AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] * c.v[i])::HUGEINT)), 0)::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.row <> q.row AND len(q.v) = len(c.v))
SELECT query_id, (row_number() OVER best)::INTEGER AS rank, vec_id, score FROM pair
WINDOW best AS (PARTITION BY row ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 5
"""

OP13_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
given AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS p, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS q,
         n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 AS plain,
         ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 AS spm
  FROM drawn),
parts AS (
  SELECT *, least(p, q) AS low, greatest(p, q) AS high, substring(t, 1, least(p, q)) AS pre, substring(t, least(p, q) + 1, greatest(p, q) - least(p, q)) AS mid,
         substring(t, greatest(p, q) + 1, n) AS suf FROM given),
made AS (SELECT *, CASE WHEN plain THEN t WHEN spm THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END AS output FROM parts),
cut AS (
  SELECT *, CASE WHEN plain THEN output WHEN spm THEN split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || split_part(substring(output, 4), '<P>', 1)
                 ELSE split_part(substring(output, 4), '<S>', 1) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1) END AS back FROM made)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN low END::BIGINT AS prefix_chars, CASE WHEN NOT plain THEN high - low END::BIGINT AS middle_chars,
       sha256(output) AS output_sha256, sha256(back) AS restored_sha256
FROM cut
"""

QUERIES = {
    "op1_matroska": op1_matroska,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_min_cut": op4_min_cut,
    "op5_suffix_array": op5_suffix_array,
    "op6_multi_index": op6_multi_index,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_threshold_topk": op12_threshold_topk,
    "op13_infill": op13_infill,
}
SQL = {"op3_line_dedup": OP3_SQL, "op6_multi_index": OP6_SQL, "op11_collocations": OP11_SQL, "op12_threshold_topk": OP12_SQL, "op13_infill": OP13_SQL}
