"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt to blocks. A block's task sorts its candidates once per dimension; a query walks down the lists of
the dimensions where it isn't zero (from the top where it is positive, from the bottom where it is negative), scores the
rows that it meets for the first time, and stops when no unseen row can beat its k-th result: the bound is the sum of
its products with the values at the lists' present depth. Every block but the first starts from the k-th result of the
first, so most of its walk, or all of it, is saved where the data allow. All arithmetic is on whole numbers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import partitions, write_table

BLOCK, FIRST_DEPTH, EXACT = 16384, 8, 2.0**53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integers(x: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python integers, of any size."""
    return np.array([int(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


class Lists:
    """The candidates of a block, sorted by each dimension.

    ``x`` holds whole numbers; ``rows`` numbers each candidate (no query meets its own row), ``ids`` orders ties, null
    ids last.
    """

    def __init__(self, x: np.ndarray, rows: np.ndarray, ids: list[int | None]) -> None:
        by_id = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rows[i]))
        self.x, self.rows, self.ids = x[by_id], rows[by_id], [ids[i] for i in by_id]  # so the smaller place wins a tie
        self.up = np.argsort(self.x, axis=0, kind="stable").astype(np.int32)
        self.value = np.take_along_axis(self.x, self.up.astype(np.int64), axis=0)
        self.top = float(np.abs(self.x).max()) if self.x.size else 0.0
        self.whole = None

    def search(self, q: np.ndarray, k: int, own: int, floor: int | None = None) -> tuple[list[tuple[int | None, int]], int]:
        """The (id, score) of the block that may be among the query's ``k`` best, and how many rows were scored.

        ``floor`` is a k-th score from elsewhere: rows below it are of no use. A bound that equals the k-th score
        doesn't stop the walk, as an unseen row of a smaller id could tie. Where sums of products may pass 2^53 the
        same walk runs on Python integers.
        """
        x, value = self.x, self.value
        if self.top * float(np.abs(q).max(initial=0.0)) * max(1, len(q)) >= EXACT:
            if self.whole is None:
                self.whole = integers(self.x), integers(self.value)
            (x, value), q = self.whole, integers(q)
        n, dims = len(x), np.flatnonzero(q != 0)
        falling = (q[dims] > 0).astype(bool)
        seen = np.zeros(n, bool)
        places, scores = np.zeros(0, np.int64), np.zeros(0, x.dtype)
        depth, step, scored = 0, FIRST_DEPTH, 0
        while depth < n and scored < n:
            bound = (q[dims] * value[np.where(falling, n - 1 - depth, depth), dims]).sum()  # of all rows not met yet
            if (floor is not None and bound < floor) or (len(scores) == k and bound < scores.min()):
                break
            stop = min(n, depth + step) if len(dims) else n
            slots, met = np.arange(depth, stop), ~seen
            if len(dims):
                met = np.zeros(n, bool)
                met[self.up[n - 1 - slots][:, dims[falling]].ravel()] = True
                met[self.up[slots][:, dims[~falling]].ravel()] = True
                met &= ~seen
            seen |= met
            fresh = np.flatnonzero(met)
            scored += len(fresh)
            got = (x @ q)[fresh] if 4 * len(fresh) > n else x[fresh] @ q
            keep = self.rows[fresh] != own
            places, scores = _best(np.concatenate([places, fresh[keep]]), np.concatenate([scores, got[keep]]), k)
            depth, step = stop, step * 2
        return [(self.ids[p], min(max(int(s), LEAST), MOST)) for p, s in zip(places.tolist(), scores.tolist(), strict=True) if floor is None or s >= floor], scored


def _best(places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k of highest score, equal ones by place, in that order."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        places, scores = places[near], scores[near]
    order = np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], places[i]))[:k], dtype=np.int64)
    return places[order], scores[order]


def _search(k: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by block and part, candidates first: one block's candidates are held, its queries stream by."""
        key, held, lists = None, [], None
        for batch in batches:
            out: list[tuple] = []
            block, part, asks, rows, ids, floors = (batch.column(n).to_pylist() for n in ("block", "part", "is_query", "row", "id", "floor"))
            x = batch.column("v").to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                if (block[i], part[i]) != key:
                    key, held, lists = (block[i], part[i]), [], None
                if not asks[i]:
                    held.append((x[i], rows[i], ids[i]))
                    continue
                if lists is None and held:
                    lists = Lists(np.stack([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held])
                    held = []
                if lists is not None:
                    found, scored = lists.search(x[i], k, rows[i], floors[i])
                    out += [(rows[i], ids[i], vec, score, scored) for vec, score in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 5)], names=["row", "query_id", "vec_id", "score", "scored"])

    return each


def _meet(candidates: DataFrame, queries: DataFrame, blocks: tuple[int, int], tasks: int, k: int) -> DataFrame:
    """Queries against the candidates of the blocks from ``blocks[0]`` to before ``blocks[1]``, in ``tasks`` tasks or more.

    Each query goes to every block; where there are fewer blocks than tasks, the queries are dealt to parts, and a
    block's candidates go to each part.
    """
    parts = -(-tasks // (blocks[1] - blocks[0]))
    every = F.sequence(F.lit(blocks[0]), F.lit(blocks[1] - 1))
    held = candidates.filter(F.col("block").between(blocks[0], blocks[1] - 1))
    held = held.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("is_query"), "row", "id", F.lit(None).cast("long").alias("floor"), "v")
    asked = queries.select(F.explode(every).alias("block"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("is_query"), "row", "id", "floor", "v")
    dealt = held.unionByName(asked).repartition(parts * (blocks[1] - blocks[0]), "block", "part").sortWithinPartitions("block", "part", "is_query")
    return dealt.mapInArrow(_search(k), "row long, query_id long, vec_id long, score long, scored long")


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its ``k`` best among all other rows.

    A component x counts as floor(``scale`` * x), x as double; scores are inner products of these whole numbers. Ties
    go to the smaller id, null ids last. Vectors that are null or hold a null or non-finite component (after scaling,
    too) take no part. A query meets only vectors of its own length; empty vectors score 0 with each other. Rows are
    told apart even if they share an id: each is a query of its own, and the others are candidates. Fewer than ``k``
    candidates give fewer rows, an empty table none. Sums are exact at any size; scores beyond 64 bits count as the
    nearest long. Other columns are not read. Blocks hold about ``block`` candidates.
    """
    spark = vectors.sparkSession
    v = vectors[vector_col].cast("array<double>")
    src = vectors.select(vectors[id_col].cast("long").alias("id"), F.transform(v, lambda c: c * F.lit(float(scale))).alias("v"))
    src = src.filter(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    # whole numbers as doubles: floor() to a long would wrap beyond 64 bits
    src = src.select(F.monotonically_increasing_id().alias("row"), "id", F.transform("v", lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c)).alias("v"))
    rows = write_table(src, "scaled")
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = None
    for d, n in sorted(sizes.items()):
        blocks, tasks = -(-n // block), partitions(spark)
        own = rows.filter(F.size("v") == d).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
        asked = own.filter(F.col("id") % every == 0).withColumn("floor", F.lit(None).cast("long"))
        part = write_table(_meet(own, asked, (0, 1), tasks, k), "first")
        if blocks > 1:
            floors = part.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
            # a floor at the limits of a long may stand for a score beyond it
            floors = floors.withColumn("floor", F.when(~F.col("floor").isin(LEAST, MOST), F.col("floor")))
            asked = asked.drop("floor").join(floors, "row", "left")
            part = part.unionByName(_meet(own, asked, (1, blocks), tasks, k))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
