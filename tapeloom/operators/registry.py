"""The voice registry: nearest speakers, decisions, noise."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.numbers import bucket, cosine_distance


def nearest(queries: DataFrame, samples: DataFrame, k: int, most: int = 64, per_part: int = 256) -> DataFrame:
    """For each query (query_id, vector, model) the k speakers with the least distance of any sample of that model.

    A query that is itself a sample (``query_id`` = ``sample_id``) leaves itself out. Samples and queries of a model meet
    in cells of bounded size, see ``search``; of each cell only the speakers that are among its k nearest (with ties) go
    on, so distances reduce to one per speaker over few rows. Ties go by speaker, a null one last.
    """
    each = _search(queries, samples, k, most, per_part, False)
    return _least(each.withColumnRenamed("d", "distance"), k)


def _least(each: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", F.asc_nulls_last("speaker_id")))
    return each.groupBy("query_id", "speaker_id").agg(F.min("distance").alias("distance")).withColumn("rank", rank).filter(F.col("rank") <= k)


def search(queries: DataFrame, samples: DataFrame, k: int, most: int = 64, per_part: int = 256) -> DataFrame:
    """(query_id, speaker_id, d, skipped) for each query and array of its model: the least distance, or that it was skipped.

    A speaker's samples are dealt to arrays of about ``most``. An array has a pivot, one of its samples, and a radius around
    it. The k least distances of a query to pivots of different speakers bound its k-th result from above. By the
    triangle inequality (of the chords sqrt(2 d) between unit vectors; a zero vector, at distance 1 from all, behaves like
    one at a right angle) no sample of an array is nearer than the query's chord to the pivot less the radius: arrays
    beyond the bound aren't looked into, and the result is exact.

    The few models would be hot keys, so a model's arrays are dealt to parts of about ``per_part``, its queries to parts of
    about 4096, and each cell of this grid is one group: its size is bounded, and their number grows with the work.
    """
    return _search(queries, samples, k, most, per_part, True)


def _search(queries: DataFrame, samples: DataFrame, k: int, most: int, per_part: int, every: bool) -> DataFrame:
    counts = samples.groupBy("model", "speaker_id").agg(F.count("*").alias("_n")).withColumn("_k", F.greatest(F.lit(1), F.ceil(F.col("_n") / most)).cast("int"))
    arrays = counts.select("model", F.col("speaker_id").alias("_speaker"), "_k")
    dealt = samples.alias("s").join(arrays.alias("n"), (F.col("s.model") == F.col("n.model")) & F.col("s.speaker_id").eqNullSafe(F.col("n._speaker")))
    dealt = dealt.select("s.model", "speaker_id", "sample_id", "vector", F.pmod(F.xxhash64("sample_id"), F.col("_k")).cast("int").alias("_b"))
    pivots = dealt.filter("vector is not null").groupBy("model", "speaker_id", "_b").agg(F.min_by(F.struct("sample_id", "vector"), "sample_id").alias("p")).select("model", "speaker_id", "_b", "p.*")
    sizes = counts.groupBy("model").agg(F.sum("_k").alias("_arrays"))
    first = _cells(queries.withColumn("_bound", F.lit(None).cast("double")), pivots, sizes, 16 * per_part, k, False)
    bound = _least(first.withColumnRenamed("d", "distance"), k).filter(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("distance").alias("_bound"))
    bounded = queries.join(bound, F.col("query_id") == F.col("_q"), "left").drop("_q")
    return _cells(bounded, dealt, sizes, per_part, k, every)


def _cells(queries: DataFrame, samples: DataFrame, arrays: DataFrame, per_part: int, k: int, every: bool, per_query_part: int = 4096) -> DataFrame:
    """Queries (query_id, model, vector, _bound) against samples (sample_id, speaker_id, model, vector, _b), cell by cell of a grid."""

    def parts(n: str, most: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col(n) / most)).cast("int")

    grid = arrays.select("model", parts("_arrays", per_part).alias("_ps")).join(queries.groupBy("model").agg(F.count("*").alias("_n")).select("model", parts("_n", per_query_part).alias("_qs")), "model")
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # much work per row: small cells must not end in one task
    cell, model = ["_m", "_p", "_q"], F.col("model").alias("_m")
    rows = samples.join(grid, "model").withColumn("_p", F.pmod(F.xxhash64("speaker_id", "_b"), F.col("_ps")).cast("int"))
    rows = rows.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_qs") - 1))).select(model, "_p", "_q", "speaker_id", "_b", "sample_id", "vector").repartition(tasks, *cell)
    asked = queries.join(grid, "model").withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("_qs")).cast("int"))
    asked = asked.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_ps") - 1))).select(model, "_p", "_q", F.col("query_id").alias("_id"), F.col("vector").alias("_vector"), "_bound").repartition(tasks, *cell)
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("speaker_id", samples.schema["speaker_id"].dataType), T.StructField("d", T.DoubleType()), T.StructField("skipped", T.BooleanType())])
    return asked.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(_search_cell(k, every), schema)


def _search_cell(k: int, every: bool, tile: int = 1024):
    """The function of one cell: each query's least distance to each array, or only its k nearest speakers (with ties)."""

    def search_cell(_, asked: pa.Table, rows: pa.Table) -> pa.Table:
        speakers = rows["speaker_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        speaker, b = speakers.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows["_b"].to_numpy().astype(np.int64)
        sample_ids, query_ids = rows["sample_id"].to_pylist(), asked["_id"].to_pylist()
        places = defaultdict(list)
        for i, q in enumerate(query_ids):
            places[q].append(i)
        bound = asked["_bound"].to_numpy(zero_copy_only=False).astype(float)
        limit = _chord(np.where(np.isnan(bound) & asked["_bound"].is_null().to_numpy(), np.inf, bound)) + 1e-6
        found = []
        asked_vectors = _vectors(asked["_vector"])
        for length, (at, vectors) in _vectors(rows["vector"]).items():
            if length not in asked_vectors:
                continue
            known = np.array([sample_ids[i] is not None for i in at], dtype=bool)
            at, vectors = at[known], vectors[known]
            norms = _norms(vectors)
            order = np.lexsort((b[at], speaker[at]))
            keys = np.stack([speaker[at][order], b[at][order]])
            # Arrays of one speaker each, to be skipped as a whole; pivots come one to an array, and many are looked into at once.
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1 if every or len(order) > len(np.unique(keys, axis=1).T) else np.arange(64, len(order), 64)
            arrays = [a for a in np.split(order, ends) if len(a)]
            whole = [len(np.unique(speaker[at[a]])) == 1 for a in arrays]
            radii = [_chord(_distances(vectors[a], norms[a], vectors[a[:1]].T, norms[a[:1]])).max() for a in arrays]
            q_at, q_vectors = asked_vectors[length]
            for low in range(0, len(q_at), tile):
                mine, qs = q_at[low : low + tile], np.ascontiguousarray(q_vectors[low : low + tile].T)
                q_norms, column = _norms(qs.T), {int(q): i for i, q in enumerate(mine)}
                best = np.full((len(speakers.dictionary), len(mine)), np.inf)
                for a, one, radius in zip(arrays, whole, radii):
                    far = np.zeros(len(mine), dtype=bool)
                    if one and np.isfinite(limit[mine]).any():
                        with np.errstate(invalid="ignore"):
                            far = _chord(_distances(vectors[a[:1]], norms[a[:1]], qs, q_norms)[0]) - radius > limit[mine]
                    near = np.flatnonzero(~far)
                    d = np.full((len(a), len(mine)), np.inf)
                    if len(near) == len(mine):
                        d = _distances(vectors[a], norms[a], qs, q_norms)
                    elif len(near):
                        d[:, near] = _distances(vectors[a], norms[a], qs[:, near], q_norms[near])
                    d[np.isnan(d)] = _NAN
                    for i, x in enumerate(a):
                        for q in places.get(sample_ids[at[x]], ()):
                            if q in column:
                                d[i, column[q]] = np.inf
                    if every:
                        found.append((mine, np.full(len(mine), speaker[at[a[0]]]), d.min(axis=0), far))
                    elif one:
                        s = speaker[at[a[0]]]
                        np.minimum(best[s], d.min(axis=0), out=best[s])
                    else:
                        for i, x in enumerate(a):
                            s = speaker[at[x]]
                            np.minimum(best[s], d[i], out=best[s])
                if not every:
                    kth = np.partition(best, k - 1, axis=0)[k - 1] if len(best) > k else np.full(len(mine), np.inf)
                    s, q = np.nonzero((best <= kth) & (best < np.inf))
                    found.append((mine[q], s, best[s, q], np.zeros(len(q), dtype=bool)))
        q, s, d, far = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
        least = pa.array(np.where(d == _NAN, np.nan, d), mask=np.isinf(d))
        return pa.table({"query_id": asked["_id"].take(pa.array(q)), "speaker_id": speakers.dictionary.take(pa.array(s)), "d": least, "skipped": pa.array(far)})

    return search_cell


_NAN = np.finfo(float).max  # stands for NaN, the greatest distance; infinity stands for none


def _chord(d: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 * d))


def _norms(vectors: np.ndarray) -> np.ndarray:
    total = np.zeros(len(vectors))
    with np.errstate(all="ignore"):
        for j in range(vectors.shape[1]):
            total += vectors[:, j] * vectors[:, j]
    return np.sqrt(total)


def _distances(a: np.ndarray, a_norms: np.ndarray, b: np.ndarray, b_norms: np.ndarray) -> np.ndarray:
    """1 - cosine of each row of ``a`` and column of ``b``; 1 if either is zero. Products are added in the vectors' order."""
    total, product = np.zeros((len(a), b.shape[1])), np.empty((len(a), b.shape[1]))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            np.multiply(a[:, j, None], b[j], out=product)
            total += product
        size = a_norms[:, None] * b_norms
        return np.where(size == 0, 1.0, 1 - total / size)


def _vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the rows of the vectors without any null, and these as a matrix."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    values, nulls = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    out = {}
    for n in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == n)
        spots = starts[at][:, None] + np.arange(n)
        good = ~nulls[spots].any(axis=1)
        out[int(n)] = at[good], values[spots[good]]
    return out


def bucketed(matches: DataFrame, auto: float = 0.25, candidate: float = 0.55) -> DataFrame:
    return matches.withColumn("bucket", bucket(F.col("distance"), auto, candidate))


def samples_for(speakers: DataFrame, samples: DataFrame, model: str, not_sample=None) -> DataFrame:
    """All speakers with the number of their samples of a model, except one sample; speakers without any stay."""
    own = samples.filter(F.col("model") == model) if not_sample is None else samples.filter((F.col("model") == model) & (F.col("sample_id") != not_sample))
    counts = own.groupBy("speaker_id").agg(F.count("*").alias("samples"))
    return speakers.join(counts, "speaker_id", "left").select("speaker_id", "name", F.coalesce("samples", F.lit(0)).alias("samples"))


def latest(decisions: DataFrame, by: list[str]) -> DataFrame:
    """The last decision of each label, by time, then id."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("created_at"), F.desc("decision_id")))
    return decisions.withColumn("_r", rank).filter("_r = 1").drop("_r")


def speaker_names(decisions: DataFrame, speakers: DataFrame, by: list[str]) -> DataFrame:
    """Names by label: decisions without a living speaker don't count, then the last one wins."""
    return latest(decisions.join(speakers, "speaker_id"), by).select(*by, "name")


def current_decisions(decisions: DataFrame, speakers: DataFrame, by: list[str]) -> DataFrame:
    """The last decision by label, be it anonymous; a deleted speaker's id is null."""
    last = latest(decisions, by).join(speakers, "speaker_id", "left")
    return last.select(*by, F.when(F.col("name").isNotNull(), F.col("speaker_id")).alias("speaker_id"), "name", "is_noise")


def auto_noise(shares: DataFrame, vectors: DataFrame, least_share: float, most_distance: float, by: str = "task_id") -> DataFrame:
    """Labels under a share whose voice is near that of a label with a larger share.

    The labels of one recording meet as arrays inside it; only labels under the share are compared.
    """
    both = shares.join(vectors, [by, "speaker"])
    group = both.groupBy(by).agg(F.collect_list(F.struct("speaker", "share", "vector")).alias("_all"))
    near = F.filter("_all", lambda a: (a["share"] < least_share) & F.exists("_all", lambda b: (b["share"] > a["share"]) & (cosine_distance(a["vector"], b["vector"]) <= most_distance)))
    return group.select(by, F.explode(F.transform(near, lambda a: a["speaker"])).alias("speaker"))


def resolve_noise(decided: DataFrame, automatic: DataFrame, by: str = "task_id") -> DataFrame:
    """A recording's decisions on noise where it has any decision, else the automatic labels."""
    has = decided.select(by).distinct()
    return decided.filter("is_noise").select(by, "speaker").distinct().unionByName(automatic.join(has, by, "left_anti").select(by, "speaker").distinct())


def without_noise(entries: DataFrame, noise: DataFrame, by: str = "task_id") -> DataFrame:
    """Entries without those of noise labels; a recording that would lose all keeps all."""
    flagged = entries.join(noise.select(by, "speaker", F.lit(True).alias("_n")).distinct(), [by, "speaker"], "left")
    left = F.max(F.col("_n").isNull().cast("int")).over(Window.partitionBy(by))
    return flagged.withColumn("_left", left).filter("_n is null or _left = 0").select(entries.columns)


def needs_pause(matches: DataFrame, by: str = "task_id") -> DataFrame:
    """Whether a recording must wait for a person: any label that is neither matched by itself nor noise."""
    return matches.groupBy(by).agg(F.bool_or((F.col("bucket") != "auto") & ~F.col("is_noise")).alias("pause"))


def live_names(matches: DataFrame, speakers: DataFrame) -> DataFrame:
    """Stored candidate lists with today's names where the speakers still exist."""
    flat = matches.select("match_id", F.posexplode("candidates").alias("_i", "c")).select("match_id", "_i", "c.*")
    named = flat.join(speakers.withColumnRenamed("name", "_live"), "speaker_id", "left")
    item = F.struct("_i", F.struct("speaker_id", F.coalesce("_live", "name").alias("name")).alias("v"))
    return named.groupBy("match_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("candidates"))
