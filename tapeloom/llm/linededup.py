"""Line dedup: sharded minimal perfect hashes index the counts of repeated lines; documents probe arrays, no lines are joined.

The shards are built in parallel and written to the shared folder; ``addFile`` brings them to every executor, also to
one that replaces a lost one. There each becomes one file that the workers map into memory, so the index takes its
size once an executor, on disk, and only the pages that are probed are read.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import by_group, drop_table, texts, write_table

SPACE = b" \t\n\x0b\x0c\r"
GAMMA, LEVELS, SHARD_KEYS = 2.0, 64, 1 << 16


def _mix(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    x = a ^ (b * np.uint64(0x9E3779B97F4A7C15 + 2 * seed))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def build(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> dict:
    """A minimal perfect hash over distinct 128-bit keys (a, b), with the fingerprint and count arrays it indexes.

    Level by level, keys that are alone at their bit set it; the rest go on to the next, smaller level. A key's
    index is the rank of its bit. Counts saturate at 2^32 - 1.
    """
    left, words, sizes = np.arange(len(a)), [], []
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("repeated keys have no perfect hash")
        m = max(64, int(GAMMA * len(left) + 63) // 64 * 64)
        at = (_mix(a[left], b[left], len(sizes)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(m)
        left = left[~alone[at]]
    index = {"words": np.concatenate(words) if words else np.zeros(0, np.uint64), "sizes": sizes}
    where = rank(index, a, b)
    index["prints"], index["counts"] = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint32)
    index["prints"][where] = b
    index["counts"][where] = np.minimum(counts, 0xFFFFFFFF)
    return index


def rank(index: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of each key; for keys that were not built in, -1 or any index."""
    words = index["words"]
    if "before" not in index:
        index["before"] = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)
    out, left, first = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    for level, m in enumerate(index["sizes"]):
        if not len(left):
            break
        at = _mix(a[left], b[left], level) % np.uint64(m)
        w, bit = first + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
        hit = (words[w] & bit) != 0
        out[left[hit]] = index["before"][w[hit]] + np.bitwise_count(words[w[hit]] & (bit[hit] - np.uint64(1)))
        left, first = left[~hit], first + m // 64
    return out


def probe(shards: list[dict], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Document counts of the keys; 0 where the fingerprint shows that a key is not indexed."""
    out = np.zeros(len(a), np.int64)
    if not shards:
        return out
    shard = (a % np.uint64(len(shards))).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(len(shards) + 1))
    for s in np.unique(shard).tolist():
        rows = order[cuts[s] : cuts[s + 1]]
        index = shards[s]
        if len(index["counts"]):
            i = rank(index, a[rows], b[rows])
            good = (i >= 0) & (index["prints"][i] == b[rows])
            out[rows[good]] = index["counts"][i[good]]
    return out


def _keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The lines, and for each its key's 128-bit digest, b'' for an empty key."""
    lines = text.split(b"\n")
    return lines, [xxhash.xxh3_128_digest(k) if (k := x.strip(SPACE).lower()) else b"" for x in lines]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def line_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b, n): 128-bit digests of the non-empty line keys and the number of documents that hold each.

    Counts are summed inside each slice before the shuffle, so a line in a third of all documents costs a row a slice.
    """

    def run(batches):
        for _, raw in texts(batches, "_text"):
            seen: Counter = Counter()
            for text in raw:
                seen.update(set(_keys(text)[1]) - {b""})
            if seen:
                a, b = _halves(list(seen))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(list(seen.values()), pa.int64())], names=["a", "b", "n"])

    part = docs.select(docs[text_col].cast("string").alias("_text")).mapInArrow(run, "a long, b long, n long")
    return part.groupBy("a", "b").agg(F.sum("n").alias("n"))


def build_shards(counts: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """One row per shard of the key space: its perfect hash, fingerprints and counts as binary columns; built in parallel."""
    n_shards = max(1, -(-n_keys // SHARD_KEYS))

    def run(g: pa.Table) -> pa.RecordBatch:
        a, b = (g.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        x = build(a, b, g.column("n").to_numpy())
        cols = [[g.column("shard")[0].as_py()], [x["sizes"]], [x["words"].tobytes()], [x["prints"].tobytes()], [x["counts"].tobytes()]]
        types = [pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["shard", "sizes", "words", "prints", "counts"])

    # unsigned a % n_shards, as in probe()
    high, low = F.shiftrightunsigned("a", 32), F.col("a").bitwiseAND(F.lit(0xFFFFFFFF))
    shard = ((high % n_shards) * F.lit((1 << 32) % n_shards) + low % n_shards) % n_shards
    keyed = counts.select(shard.cast("int").alias("shard"), "a", "b", "n")
    return by_group(keyed, ["shard"], run, "shard int, sizes array<int>, words binary, prints binary, counts binary"), n_shards


FIELDS = {"words": np.uint64, "prints": np.uint64, "counts": np.uint32}


def send_shards(built: DataFrame, n_shards: int):
    """Send the shards to the executors and return a function that opens them in a task: a list of memory-mapped shards.

    The driver handles file names only. The first task on an executor that needs a file's shards unpacks them beside
    it, under a name of its own first, so that tasks that do so at once don't meet.
    """
    spark = built.sparkSession
    table = write_table(built, f"shards-{uuid.uuid4().hex}")
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(table.table_path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".parquet")]
    for f in files:
        spark.sparkContext.addFile(f.toString())
    names = [f.getName() for f in files]
    opened: dict = {}

    def load() -> list[dict]:
        if not opened:
            empty = {"sizes": [], **{k: np.zeros(0, t) for k, t in FIELDS.items()}}
            shards = [empty] * n_shards
            for name in names:
                path = SparkFiles.get(name)
                if not os.path.exists(f"{path}.map"):
                    _unpack(path)
                shards_of(f"{path}.map", shards)
            opened["shards"] = shards
        return opened["shards"]

    return load


def _unpack(path: str) -> None:
    """Write the shards of a Parquet file one after the other: number, sizes, then the arrays, all in 8-byte steps."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        for batch in pq.ParquetFile(path).iter_batches(batch_size=1):
            for r in batch.to_pylist():
                head = [r["shard"], len(r["sizes"]), *r["sizes"], *(len(r[k]) for k in FIELDS)]
                out.write(np.array(head, np.int64).tobytes())
                for k in FIELDS:
                    out.write(r[k].ljust(-(-len(r[k]) // 8) * 8, b"\0"))
    os.replace(own, f"{path}.map")


def shards_of(path: str, shards: list[dict]) -> None:
    """Put the mapped shards of an unpacked file in their places."""
    if not os.path.getsize(path):
        return
    data, at = np.memmap(path, np.int64, "r"), 0
    while at < len(data):
        shard, n = int(data[at]), int(data[at + 1])
        sizes, lengths = data[at + 2 : at + 2 + n].tolist(), data[at + 2 + n : at + 5 + n].tolist()
        at += 5 + n
        index: dict = {"sizes": sizes}
        for (k, t), size in zip(FIELDS.items(), lengths, strict=True):
            step = -(-size // 8)
            index[k] = data[at : at + step].view(t)[: size // np.dtype(t).itemsize]
            at += step
        shards[shard] = index


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10) -> DataFrame:
    """Remove every line whose key is found in at least ``min_docs`` documents.

    Returns all columns of ``docs``, the text cleaned, plus ``n_lines`` and ``n_dropped`` (which replace columns of
    these names). A text splits at each line feed (null or empty: one empty line, and the result is an empty text); a key is the line without ASCII white space
    at its ends, A-Z lower-cased; empty keys are never dropped. Repeated rows count as documents of their own. An
    empty table gives an empty one. A document that loses all its lines stays, with an empty text.

    Digests are 128 bits wide (64 of them kept as fingerprint, 64 choosing shard and bit). Only keys at ``min_docs``
    or more are indexed, at 13 bytes each: a thousand million repeated lines take 13 GB of an executor's disk.
    """
    repeated = write_table(line_counts(docs, text_col).filter(F.col("n") >= min_docs), "lines")
    n_keys = repeated.count()
    docs = docs.drop("n_lines", "n_dropped")
    names, at = docs.columns, docs.columns.index(text_col)
    plain = docs.withColumn(text_col, docs[text_col].cast("string"))
    schema = T.StructType([*plain.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def out_batch(batch: pa.RecordBatch, kept: list[bytes], n: list[int], dropped: list[int]) -> pa.RecordBatch:
        cols = [pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()) if i == at else batch.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    built, n_shards = build_shards(repeated, n_keys)
    load = send_shards(built, n_shards)
    drop_table(repeated)

    def run(batches):
        shards = load()
        for batch, raw in texts(batches, text_col):
            split = [_keys(t) for t in raw]
            flat = [d for _, keys in split for d in keys]
            hit = np.zeros(len(flat), bool)
            real = np.flatnonzero([bool(d) for d in flat])
            if len(real):
                hit[real] = probe(shards, *_halves([flat[i] for i in real.tolist()])) > 0
            kept, n, dropped, i = [], [], [], 0
            for lines, keys in split:
                h = hit[i : i + len(keys)]
                i += len(keys)
                bad = int(h.sum())
                kept.append(b"\n".join(x for x, y in zip(lines, h.tolist(), strict=True) if not y) if bad else b"\n".join(lines))
                n.append(len(lines))
                dropped.append(bad)
            yield out_batch(batch, kept, n, dropped)

    return plain.mapInArrow(run, schema)
