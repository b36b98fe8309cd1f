"""Connected components over links, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import drop_table, write_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star (or small-star) step: link each node's larger (smaller or equal) neighbours to its smallest one."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = both if large else both.filter("dst < src")
    low = near.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("m", "src"))
    moved = near.join(low, "src")
    if large:
        return moved.filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct()
    out = moved.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(low.select("src", F.col("m").alias("dst")))
    return out.filter("src <> dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected links ``edges`` (src, dst longs).

    Alternates large-star and small-star steps; each round is written to the shared folder, so no lineage grows and
    a lost executor costs one round. ``component`` is the smallest node that can be reached. The links of a large
    component end as a star, and its hub's rows are only ever pre-aggregated or joined (skew joins split them).
    Null ends are dropped; loops and repeated links are allowed; no links give an empty table.
    """
    now = edges.filter("src is not null and dst is not null and src <> dst")
    now = now.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    now = write_table(now, "links")
    seen = _digest(now)
    while seen[0]:
        after = write_table(_star(_star(now, True), False), "links")
        drop_table(now)
        now, before, seen = after, seen, _digest(after)
        if seen == before:
            break
    return now.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component")).unionByName(
        now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).head()
    return row[0], row[1]
