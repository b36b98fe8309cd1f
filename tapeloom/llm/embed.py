"""Embedding near-dedup by an inverted multi-index.

Each unit vector is cut into two halves with a codebook of their own; the pairs of codewords are the cells of a grid
(per label). A vector lives in its nearest cell and, by multi-sequence traversal, visits the next nearest cells; how
many is fitted on a sample against brute force until the target recall. Cosines are then checked in double precision.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import by_group, drop_table, grid, merge_labels, write_table
from tapeloom.llm.graph import connected_components

SAMPLE, RECALL, MOST, ROUNDS = 8192, 0.99, 2048, 8


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """k-means with deterministic starts: rows spread evenly over the sample, then Lloyd rounds."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.argmin((c * c).sum(1)[None, :] - 2 * (x @ c.T), axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (book * book).sum(1)[None, :] - 2 * (x @ book.T), 0)


def traverse(d1: np.ndarray, d2: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """Multi-sequence traversal: the ``visits`` cells (i, j) of least d1[i] + d2[j], nearest first."""
    a, b = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    heap, out, seen = [(d1[a[0]] + d2[b[0]], 0, 0)], [], {(0, 0)}
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append((a[i], b[j]))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (d1[a[x]] + d2[b[y]], x, y))
    return out


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = x.shape[1] // 2
    return x[:, :h], x[:, h:]


def home_ranks(x: np.ndarray, y: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many cells each x visits until the home of its y, in slices of bounded size."""
    (x1, x2), (y1, y2) = _halves(x), _halves(y)
    i, j = distances(y1, books[0]).argmin(1), distances(y2, books[1]).argmin(1)
    d1, d2 = distances(x1, books[0]), distances(x2, books[1])
    out, step = [np.zeros(0, int)], max(1, (1 << 22) // (len(books[0]) * len(books[1])))
    for a in range(0, len(x), step):
        b = min(a + step, len(x))
        sums = d1[a:b, :, None] + d2[a:b, None, :]
        own = sums[np.arange(b - a), i[a:b], j[a:b]]
        out.append((sums < own[:, None, None]).sum((1, 2)) + 1)
    return np.concatenate(out)


def fit(sample: np.ndarray, labels: np.ndarray, threshold: float, n: int, recall: float = RECALL) -> dict:
    """Codebooks and the number of cells to visit, from a bounded sample of unit vectors.

    The codebooks grow with the square root of the table, up to one codeword for every 8 rows of the sample, so cells
    keep a like size (of about 512 vectors, up to 500 million of them with the default sample). Recall is
    that of the sample's linked pairs under the traversal; with no linked pair in the sample, pairs are made by
    moving its vectors by noise to exactly the threshold.
    """
    k = int(np.clip(np.sqrt(n / 512), 8, max(8, len(sample) // 8)))
    first, second = _halves(sample)
    books = codebook(first, k), codebook(second, k)
    pairs = []
    for i in range(0, len(sample), 512):
        a, b = np.nonzero((sample[i : i + 512] @ sample.T >= threshold) & (labels[i : i + 512, None] == labels[None, :]))
        keep = a + i < b
        pairs.append(np.stack([a[keep] + i, b[keep]], axis=1))
    near = np.concatenate(pairs) if pairs else np.zeros((0, 2), int)
    near = near[np.linspace(0, len(near) - 1, min(len(near), 512)).astype(int)] if len(near) else near
    left, right = sample[near[:, 0]], sample[near[:, 1]]
    noise = np.random.default_rng(0).normal(size=sample.shape)[:512]
    base = sample[:512]
    noise -= (noise * base).sum(1)[:, None] * base
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    left = np.concatenate([left, base])
    right = np.concatenate([right, threshold * base + np.sqrt(1 - threshold**2) * noise])
    ranks = np.minimum(*(home_ranks(x, y, books) for x, y in ((left, right), (right, left))))
    visits = int(np.quantile(ranks, recall, method="higher")) if len(ranks) else 1
    return {"books": books, "visits": max(2, visits)}


def _compare(threshold: float):
    def run(g: pa.Table) -> pa.RecordBatch | None:
        """Counts of links and a star of links for each member of a cell; a pair that two cells see counts in one."""
        node, copies = g.column("node").to_numpy(), g.column("copies").to_numpy()
        x = np.stack(g.column("unit").to_numpy())
        homes = np.flatnonzero(g.column("is_home").to_numpy(zero_copy_only=False))
        visitors = np.flatnonzero(g.column("is_visitor").to_numpy(zero_copy_only=False))
        own, cell = g.column("own").to_numpy(), g.column("cell")[0].as_py()
        seen = g.column("seen").to_pylist()
        label, count = np.arange(len(node)), np.zeros(len(node), np.int64)
        kind = np.unique(g.column("label").to_numpy(), return_inverse=True)[1]
        cells = np.unique(own[visitors])
        of = {c: i for i, c in enumerate(cells.tolist())}
        back = np.zeros((len(homes), len(cells)), bool)  # does this home row visit the visitor's own cell, too?
        for i, h in enumerate(homes.tolist()):
            back[i, [of[c] for c in seen[h] if c in of]] = True
        column = np.array([of[c] for c in own[visitors].tolist()], np.int64)
        for i in range(0, len(homes), 256):
            part = homes[i : i + 256]
            near = (x[part] @ x[visitors].T >= threshold) & (node[part][:, None] != node[visitors][None, :]) & (kind[part][:, None] == kind[visitors][None, :])
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                merge_labels(label, np.append(visitors[near[k]], part[k]))
            near &= ~back[i : i + 256][:, column] | (node[part][:, None] < node[visitors][None, :])
            np.add.at(count, part, near @ copies[visitors])
            np.add.at(count, visitors, copies[part] @ near)
        rows = np.flatnonzero((count > 0) | (label != np.arange(len(node))))
        if not len(rows):
            return None
        return pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(node[label[rows]]), pa.array(count[rows])], names=["src", "dst", "n"])

    return run


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    sample: int = SAMPLE,
    recall: float = RECALL,
    most: int = MOST,
) -> DataFrame:
    """(id, n_links, component_id, kept): vectors of one label linked at cosine >= ``threshold``, as components.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id that links reach and
    ``kept`` tells whether that is the row's own. Rows whose vector is null, empty, zero or holds a null or
    non-finite component, or whose label is null, link with nothing; neither do vectors of different lengths. Equal
    vectors of a label collapse first and count by their number. Rows with a null id count as links but have the
    component of their vector's smallest id. An empty table gives an empty one. The index (two codebooks and the
    number of visited cells) is fitted on at most ``sample`` rows; every row is indexed.
    """
    src = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    good = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    src = src.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))  # -0.0 becomes 0.0
    rows = write_table(src.select("id", "good", F.when(F.col("good"), F.xxhash64("label", "v")).alias("h1"), F.when(F.col("good"), F.xxhash64("v", "label", F.lit(1))).alias("h2")), "vectors")
    distinct = src.filter("good").groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("copies")).filter("node is not null")
    distinct = distinct.withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64("v", "label", F.lit(1))})
    top = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda c: c / top)  # so that squares neither overflow nor vanish
    distinct = distinct.withColumn("v", scaled)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    distinct = write_table(distinct.withColumn("v", F.transform("v", lambda c: c / norm)), "distinct")
    n = distinct.count()
    size = distinct.groupBy(F.size("v").alias("d")).count().collect()
    parts, placed = None, []
    for d in sorted(r["d"] for r in size):
        found, table = _links(distinct.filter(F.size("v") == d), n, threshold, sample, recall, most)
        parts = found if parts is None else parts.unionByName(found)
        placed.append(table)
    out = rows.join(distinct.select("h1", "h2", "node", "copies"), ["h1", "h2"], "left")
    if parts is None:
        return out.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    parts = write_table(parts, "pairs")
    for table in placed:
        drop_table(table)
    comp = connected_components(parts.select("src", "dst"))
    named = distinct.select("h1", "h2", "node", "copies").join(comp, "node", "left")
    named = named.join(parts.groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("n")), "node", "left")
    named = named.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _links(unit: DataFrame, n: int, threshold: float, sample: int, recall: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(src, dst, n) for unit vectors of one length: partial link counts of src, and a star link (or src itself).

    The vectors with their cells are written (the second table), as the cells' sizes and the dealing both read them.
    """
    spark = unit.sparkSession
    rows = unit.orderBy(F.xxhash64("node"), "node").select("label", "v").limit(sample).collect()
    index = fit(np.array([r["v"] for r in rows]), np.array([r["label"] for r in rows]), threshold, n, recall)
    sent = spark.sparkContext.broadcast(index)

    def assign(batches):
        (one, two), visits = sent.value["books"], sent.value["visits"]
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, min(1024, batch.num_rows - i))
                x = np.stack(part.column(2).to_numpy(zero_copy_only=False))
                h1, h2 = _halves(x)
                d1, d2 = distances(h1, one), distances(h2, two)
                cells = [[a * len(two) + b for a, b in traverse(d1[r], d2[r], visits)] for r in range(len(x))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.list_(pa.int64()))], names=["label", "node", "unit", "copies", "cells"])

    placed = unit.select("label", "node", "v", "copies").mapInArrow(assign, "label string, node long, unit array<double>, copies long, cells array<long>")
    placed = write_table(placed, "placed")
    # one long names a cell of a label; should two names collide, the labels are still compared in the cell
    each = placed.select("label", "node", "unit", "copies", F.transform("cells", lambda c: F.xxhash64("label", c)).alias("seen"))
    each = each.select("*", F.col("seen")[0].alias("own"), F.explode("seen").alias("cell"))
    dealt = grid(each, "cell", most, F.col("cell") == F.col("own"), F.lit(True))
    return by_group(dealt, ["cell", "gi", "gj"], _compare(threshold), "src long, dst long, n long"), placed
