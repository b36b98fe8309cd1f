"""Packing by shortest-pack-first over the length histogram.

Tokenised documents are cut at multiples of the sequence length; the histogram of piece lengths (at most 2048 rows,
whatever the corpus) is packed on the driver, longest length first, always into the pack with the most room. The
result counts packing patterns, not documents; pieces find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.bpe import encoder_for
from tapeloom.llm.common import partitions, texts, write_table

LENGTH, END = 2048, 1


def pack_histogram(histogram: dict[int, int], length: int = LENGTH) -> dict[tuple[int, ...], int]:
    """How often each packing pattern (lengths, longest first) is used: worst fit over lengths in falling order.

    A length that doesn't fit into the pack with the most room fits into none; then new packs open and take as many
    of it as they hold.
    """
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # free tokens: pattern: count
    for size in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left = histogram[size]
        while left:
            most = max((r for r, packs in room.items() if packs), default=-1)
            if most >= size:
                pattern, n = room[most].popitem()
                used = min(n, left)
                if n > used:
                    room[most][pattern] = n - used
                grown = (*pattern, size)
                room[most - size][grown] = room[most - size].get(grown, 0) + used
                left -= used
            else:
                each = length // size
                for k, n in ((each, left // each), (left % each, 1)):
                    if k and n:
                        new = (size,) * k
                        room[length - size * k][new] = room[length - size * k].get(new, 0) + n
                left = 0
    return {p: n for packs in room.values() for p, n in packs.items()}


def slots_of(patterns: dict[tuple[int, ...], int]) -> dict[int, np.ndarray]:
    """For each length its slots, rows (first rank, first sequence, offset): rank r goes to sequence first + r - rank."""
    first, rank, rows = 0, defaultdict(int), defaultdict(list)
    for pattern in sorted(patterns, reverse=True):
        at = 0
        for size in pattern:
            rows[size].append((rank[size], first, at))
            rank[size] += patterns[pattern]
            at += size
        first += patterns[pattern]
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, row, start, length, ids_crc32, doc_tokens): each text's ids and the end id, cut at multiples of ``length``.

    ``row`` is a digest of the text that tells apart rows that repeat an id.
    """
    make = encoder_for(docs, tokenizer, text_col, words=0)  # a text is encoded once here: counting words first costs more than it saves
    end = np.array([END], "<u4").tobytes()
    schema = f"{id_col} long, row long, start long, length long, ids_crc32 long, doc_tokens long"

    def run(batches):
        encoder = make()
        for batch, raw in texts(batches, "_text"):
            rows = []
            for i, (text, ids) in enumerate(zip(raw, encoder.encode(raw), strict=True)):
                ids += end
                view = memoryview(ids)
                for at in range(0, len(ids), 4 * length):
                    part = view[at : at + 4 * length]
                    rows.append((i, zlib.crc32(text), at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
            of, *cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *(pa.array(c, pa.int64()) for c in cols)], names=[id_col, "row", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("_text")).mapInArrow(run, schema)


def ranked(cut: DataFrame, id_col: str) -> DataFrame:
    """Add ``rank``, from 0 without gaps among pieces of a length: first within hashed buckets, then shifted by the buckets before.

    So a length that a third of all pieces have is ranked by many tasks; only (length, bucket) counts meet.
    """
    buckets = max(64, 4 * partitions(cut.sparkSession))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64(id_col, "row", "start"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "bucket").orderBy(id_col, "row", "start")
    own = cut.withColumn("own", F.row_number().over(within) - 1)
    return own.join(shift, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("shift")).drop("own", "shift", "bucket")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` ids.

    One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document is its ids and id 1;
    null and empty texts are that id alone. Pieces of a sequence lie gapless from offset 0. Repeated rows are packed
    each for itself; a null id stays null; other columns are not read; an empty table gives an empty one. Tokenising
    runs once: its result, a few numbers a piece, is written to the shared folder.
    """
    cut = write_table(pieces(docs, tokenizer, id_col, text_col, length), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sent = cut.sparkSession.sparkContext.broadcast(slots_of(pack_histogram(histogram, length)))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches):
        slots = sent.value
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size).tolist():
                rows, own = np.flatnonzero(size == s), slots[s]
                k = np.searchsorted(own[:, 0], rank[rows], "right") - 1
                sequence[rows], offset[rows] = own[k, 1] + rank[rows] - own[k, 0], own[k, 2]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked(cut, id_col).select(*names, "rank").mapInArrow(place, f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
