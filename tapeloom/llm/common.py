"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it on a cluster; only where a local session
    has none (tests) a folder of our own is made and remembered there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tapeloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_WRITTEN: set[str] = set()


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back (cuts lineage)."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.add(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``write_table`` made, once nothing reads it any more."""
    _delete(df.sparkSession, df.table_path)


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that ``write_table`` made and that are still there.

    Results are lazy and read some of them: call this once the results are written and nothing is read any more.
    """
    for path in list(_WRITTEN):
        _delete(spark, path)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN.discard(where)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batches: Iterator[pa.RecordBatch], column: str, budget: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches into slices of about ``budget`` bytes of text; yields the slice and its texts as UTF-8 (null: empty)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
        size = np.cumsum(pa.compute.binary_length(col).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + budget, "right")))
            yield batch.slice(start, stop - start), col.slice(start, stop - start).to_pylist()
            start = stop


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Split a stream of batches that is sorted by ``keys`` into one table per key; only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Shuffle by ``keys`` and run ``run`` on each group; like applyInArrow, but without its cost for each tiny group."""

    def each(batches):
        for g in groups(batches, keys):
            out = run(g)
            if out is not None and out.num_rows:
                yield out

    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def grid(df: DataFrame, key: str, most: int, home: Column, visitor: Column) -> DataFrame:
    """Deal the members of each cell ``key`` to a grid of tasks, so that no task gets a hot cell whole.

    A cell with n members gets s = ceil(n / most) salts and s * s grid fields (i, j): a home row goes to one i and
    all j, a visitor row to one j and all i, so each home meets each visitor of its cell exactly once. Cells under
    ``most`` keep one field. The list of hot cells holds at most rows / most entries; it is joined by shuffle
    unless Spark finds it small. Adds columns ``gi``, ``gj``, ``is_home``, ``is_visitor``.
    """
    hot = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    hot = hot.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_s"))
    salted = df.join(hot, key, "left").withColumn("_s", F.coalesce("_s", F.lit(1)))
    salted = salted.withColumn("_own", F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.col("_s")).cast("int"))
    every = F.sequence(F.lit(0), F.col("_s") - 1)
    role = F.when(home & visitor & (F.col("_s") == 1), F.array(F.lit(2)))
    role = role.when(home & visitor, F.array(F.lit(0), F.lit(1))).when(home, F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    salted = salted.withColumn("_role", F.explode(role)).withColumn("_other", F.explode(every))
    return salted.select(
        *df.columns,
        F.when(F.col("_role") == 1, F.col("_other")).otherwise(F.col("_own")).alias("gi"),
        F.when(F.col("_role") == 1, F.col("_own")).otherwise(F.col("_other")).alias("gj"),
        (F.col("_role") != 1).alias("is_home"),
        (F.col("_role") != 0).alias("is_visitor"),
    )


FEW, SHARES = 4096, 10_000


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], by: list[str], how: str = "left_semi", few: int = FEW) -> DataFrame:
    """Join ``rows`` with a table of distinct ``keys`` and ``n``, the key's number of rows; frequent keys are dealt to many tasks.

    A key with n rows of N in all has ceil(n / max(few, N / SHARES)) salts, so at most ``SHARES`` keys have more than
    one: that many rows at most are broadcast, to tell their rows which salts there are. ``by`` are the columns that
    choose a row's salt; equal rows may share it. ``how`` is left_semi or inner; the table's other columns come along.
    """
    total = table.agg(F.sum("n")).head()[0] or 0
    most = max(few, total // SHARES)
    salts = F.ceil(F.col("n") / most).cast("int")
    wide = table.filter(F.col("n") > most).select(*keys, salts.alias("_salts"))
    own = rows.join(F.broadcast(wide), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    every = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    return own.join(every.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def merge_labels(label: np.ndarray, members: np.ndarray) -> None:
    """Give all ``members`` and everything that shares a label with them their smallest label, in place."""
    own = label[members]
    low = own.min()
    if (own != low).any():
        label[np.isin(label, np.unique(own))] = low
