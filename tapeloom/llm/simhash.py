"""SimHash near-dedup by anchor-point covering.

Fingerprints of 64 bits that differ in at most a threshold of bits are linked. The bits are cut into blocks with
thresholds of their own, so that a pair over all of them would differ in too many bits: two linked fingerprints agree
up to its threshold in some block. A block's anchors are the words of a linear covering code (Golay's, of radius 3, or
a Hamming code, of radius 1, beside bits that are taken as they are): every fingerprint has one home anchor within the
covering radius, and is replicated to all anchors within that radius plus the block's threshold, so that two linked
fingerprints meet at the home anchor of either. Fine codes make small cells but many replicas: the number of
fingerprints decides which blocks and codes cost least. Any choice finds the same links.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import by_group, grid, merge_labels, salted_join, texts, write_table
from tapeloom.llm.graph import connected_components

BITS, SEED, THRESHOLD, SHINGLE = 64, 42, 4, 4
GENERATOR = 0b110001110101  # fixed value: generator polynomial of the binary Golay code, degree 11
MOST, SLICE = 1 << 18, 1 << 21  # members of a cell that one task compares; comparisons that it does at once
REPLICA, COMPARISON, PATTERNS = 3e-6, 1.5e-9, 1 << 16  # seconds that a replica and a comparison cost, as measured; error patterns at most


class Block(NamedTuple):
    """Bits [start, start + size) of a fingerprint; ``code`` is the length of the code over its first bits: 23 Golay, 7, 15 or 31 Hamming, 0 none."""

    start: int
    size: int
    threshold: int
    code: int

    @property
    def reach(self) -> int:
        return self.threshold + (3 if self.code == 23 else 1 if self.code else 0)

    @property
    def patterns(self) -> int:
        return sum(math.comb(self.size, i) for i in range(self.reach + 1))

    @property
    def checks(self) -> int:
        return 11 if self.code == 23 else (self.code + 1).bit_length() - 1

    def cost(self, n: float) -> float:
        """Replicas go to the patterns' share of the anchors; each meets the home members of its cell."""
        return n * self.patterns / 2**self.checks * REPLICA + n * n * self.patterns / 2**self.size * COMPARISON


def plan(n: int, threshold: int) -> list[Block]:
    """Blocks and codes of least cost for n fingerprints; their thresholds plus 1 sum to ``threshold`` + 1.

    Blocks with a threshold of 1 or more have a covering code; there are few enough blocks that one at most has a
    threshold of 0. Cells hold few enough members then, up to millions of fingerprints, for one task each.
    """
    best: tuple[float, list[Block]] | None = None
    for m in range(1, -(-(threshold + 1) // 2) + 1):
        each, more = divmod(threshold + 1, m)
        limits = [each] * more + [each - 1] * (m - more)
        for wide in (0, 23):
            if wide and (m < 2 or wide * sum(t > 0 for t in limits) > BITS or not limits[0]):
                continue
            left, sizes = BITS, []
            for i, t in enumerate(limits):
                sizes.append(wide if wide and t else -(-left // (m - i)))
                left -= sizes[-1]
            if left or min(sizes) < 8:
                continue
            blocks, at = [], 0
            for size, t in zip(sizes, limits, strict=True):
                codes = [c for c in (0, 7, 15, 23, 31) if c <= size and (c > 0) == (t > 0)] or [0]
                fit = [b for b in (Block(at, size, t, c) for c in codes) if b.patterns <= PATTERNS]
                if not fit:
                    break
                blocks.append(min(fit, key=lambda b: b.cost(n)))
                at += size
            else:
                cost = sum(b.cost(n) for b in blocks)
                if best is None or cost < best[0]:
                    best = cost, blocks
    if best is None:
        raise ValueError(f"no blocks for a threshold of {threshold} bits")
    return best[1]


def checks(code: int, size: int) -> np.ndarray:
    """Syndrome of each single bit: Golay's by division, Hamming's by the bit's number; free bits have none."""
    out = list(range(1, code + 1)) if code != 23 else []
    for i in range(23 if code == 23 else 0):
        x = 1 << i
        for k in range(x.bit_length() - 1, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        out.append(x)
    return np.array(out + [0] * (size - len(out)), np.int64)


class Anchors:
    """Anchors near a word of a block, by its syndrome: error patterns up to the reach, listed by their syndrome."""

    def __init__(self, block: Block):
        s = checks(block.code, block.size)
        few = np.arange(1 << 11)
        self.tables = [np.bitwise_xor.reduce(np.where(few[:, None] >> np.arange(len(p)) & 1, p, 0), axis=1) for p in (s[i : i + 11] for i in range(0, len(s), 11))]
        masks = [0]
        ring = [(0, -1)]
        for _ in range(block.reach):
            ring = [(m | 1 << i, i) for m, last in ring for i in range(last + 1, block.size)]
            masks += [m for m, _ in ring]
        errors = np.array(masks, np.int64)  # by weight, so the first of each syndrome is its coset leader
        of = self.syndrome(errors)
        order = np.argsort(of, kind="stable")
        self.errors, self.first = errors[order], np.searchsorted(of[order], np.arange((1 << block.checks) + 1))

    def syndrome(self, word: np.ndarray) -> np.ndarray:
        out = self.tables[0][word & 2047]
        for i, table in enumerate(self.tables[1:], 1):
            out = out ^ table[word >> 11 * i & 2047]
        return out

    def near(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, is home) for all anchors within reach of each word."""
        s = self.syndrome(word)
        n = self.first[s + 1] - self.first[s]
        row = np.repeat(np.arange(len(word)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, word[row] ^ self.errors[self.first[s[row]] + step], step == 0


_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> tuple[int, int]:
    """64-bit SimHash of the shingles, repeats included, and another one of the same shingles, hashed once more.

    Fewer words: the whole sequence; none: 0.
    """
    words = text.translate(_UPPER).split()  # bytes.split() takes exactly the white space [ \t-\r]
    if not words:
        return 0, 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        hashes = [h(join(words), SEED)]
    else:
        hashes = [h(join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
    ones = np.zeros(2 * BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[i : i + (1 << 15)], np.uint64)
        again = (part ^ (part >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        both = np.stack([part, again ^ (again >> np.uint64(29))], axis=1).astype("<u8")
        ones += np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    one, two = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8").tolist()
    return one, two


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp, more): map-only; null and empty texts have fingerprint 0. ``more`` is the second fingerprint."""

    def run(batches):
        for batch, raw in texts(batches, "_text"):
            fp = np.array([fingerprint(t, shingle) for t in raw], np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp[:, 0]), pa.array(fp[:, 1])], names=[id_col, "text_hash", "fp", "more"])

    src = docs.select(docs[id_col].cast("long").alias(id_col), F.xxhash64(docs[text_col].cast("string")).alias("text_hash"), docs[text_col].cast("string").alias("_text"))
    return src.mapInArrow(run, f"{id_col} long, text_hash long, fp long, more long")


def _cells(distinct: DataFrame, blocks: list[Block]) -> DataFrame:
    """Replicate each distinct fingerprint (node, fp, more) to its anchors: (cell, node, fp, more, home)."""

    def run(batches):
        anchors = [Anchors(b) for b in blocks]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                bits = rows.column(1).to_numpy().view(np.uint64)
                parts = []
                for i, b in enumerate(blocks):
                    row, anchor, home = anchors[i].near((bits >> np.uint64(b.start) & np.uint64((1 << b.size) - 1)).astype(np.int64))
                    parts.append((row, anchor | i << 58, home))
                row, cell, home = (np.concatenate(c) for c in zip(*parts, strict=True))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *(c.take(take) for c in rows.columns), pa.array(home)], names=["cell", "node", "fp", "more", "home"])

    return distinct.select("node", "fp", "more").mapInArrow(run, "cell long, node long, fp long, more long, home boolean")


def _compare(threshold: int, total: int | None):
    def run(g: pa.Table) -> pa.RecordBatch | None:
        """Links inside one cell, reduced to a star per local component, so a dense cell emits rows, not pairs."""
        node, fp, more = g.column("node").to_numpy(), g.column("fp").to_numpy().view(np.uint64), g.column("more").to_numpy().view(np.uint64)
        homes = np.flatnonzero(g.column("is_home").to_numpy(zero_copy_only=False))
        visitors = np.flatnonzero(g.column("is_visitor").to_numpy(zero_copy_only=False))
        label, there = np.arange(len(node)), fp[visitors]
        step = max(1, SLICE // max(1, len(visitors)))
        for i in range(0, len(homes), step):
            part = homes[i : i + step]
            home, other = np.nonzero(np.bitwise_count(fp[part][:, None] ^ there[None, :]) <= threshold)
            home, other = part[home], visitors[other]
            good = node[home] != node[other]
            if total is not None:
                good &= np.bitwise_count(fp[home] ^ fp[other]).astype(int) + np.bitwise_count(more[home] ^ more[other]) <= total
            home, other = home[good], other[good]
            if not len(home):
                continue
            cut = np.flatnonzero(np.diff(home, prepend=-1))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(home)], strict=True):
                merge_labels(label, np.append(other[a:b], home[a]))
        moved = np.flatnonzero(label != np.arange(len(node)))
        if not len(moved):
            return None
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["src", "dst"])

    return run


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: int = THRESHOLD,
    total: int | None = None,
    most: int = MOST,
) -> DataFrame:
    """(id, text_hash, fp, component, component_id), one row per row of ``docs``: components of linked fingerprints.

    Fingerprints link if they differ in at most ``threshold`` bits and, where ``total`` is given, with the second
    fingerprint in at most ``total`` of 128. ``component`` names the component, ``component_id`` is its smallest id.
    Equal fingerprints collapse first (one row a value, by partial aggregation), so thousands of copies cost one node;
    rows that share an id but not a text stay apart. Null ids count as no id: a component of such rows alone has a
    null ``component_id``. ``most`` members of a cell at most meet in one task; fuller cells are dealt to several.
    """
    fps = write_table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    key = ["fp", "more"] if total is not None else ["fp"]
    distinct = fps.groupBy(*key).agg(F.min(id_col).alias("low"), F.first("more").alias("more")) if total is None else fps.groupBy(*key).agg(F.min(id_col).alias("low"))
    distinct = write_table(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")  # written, so the numbers stay
    blocks = plan(distinct.count(), threshold)
    dealt = grid(_cells(distinct, blocks), "cell", most, F.col("home"), F.lit(True))
    links = by_group(dealt, ["cell", "gi", "gj"], _compare(threshold, total), "src long, dst long")
    named = distinct.join(connected_components(links), "node", "left").select(*key, "low", F.coalesce("component", "node").alias("component"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    named = salted_join(named, lows, ["component"], ["fp"], "inner").select(*key, "component", "component_id")
    return fps.join(named, key, "left").select(fps[id_col], "text_hash", fps["fp"], "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(id, fingerprint hex, component_id): documents whose fingerprints link at 4 or fewer differing bits, as components.

    ``component_id`` is the smallest id that links reach, the document's own included. Rows with a null id keep
    their fingerprint and have the component of their value's smallest id (null if none). Ties, repeated rows and an
    empty table need no special case; only the id and text columns are read.
    """
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return classes(docs, id_col, text_col, most=most).select(id_col, hexed, "component_id")


def one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: int = 13,
    total: int = 24,
) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near copies: the one of smallest id, then text hash.

    Of 128 bits over 5-word shingles about 20 differ at a Jaccard similarity of 0.8; pairs with 24 or fewer link, of which
    at most 13 lie in the first 64 (the candidates). Measured, 93 % of all pairs with a similarity of 0.8 or more, and
    99.8 % with 0.9 or more, are linked so, and 58 % of those from 0.7 to 0.8, 20 % of those from 0.6 to 0.7; unrelated texts have a
    chance of about 1e-13. Rows that repeat an id with other texts are judged by their
    texts; of rows that repeat both, one stays. Null ids come last. All columns stay; an empty table gives an empty one.
    """
    none = F.lit(-(1 << 63))
    own = classes(docs, id_col, text_col, shingle, threshold, total).select(F.coalesce(id_col, none).alias("_id"), F.col(id_col).isNull().alias("_none"), F.col("text_hash").alias("_hash"), "component")
    own = write_table(own, "classes")
    first = own.groupBy("component").agg(F.min(F.struct("_none", "_id", "_hash")).alias("kept"), F.count("*").alias("n"))
    several = first.filter("n > 1")
    gone = salted_join(own, several, ["component"], ["_id", "_hash"], "inner").filter(F.struct("_none", "_id", "_hash") != F.col("kept")).select("_id", "_none", "_hash").distinct()
    again = own.groupBy("_id", "_none", "_hash").agg(F.count("*").alias("k")).filter("k > 1").drop("k")
    again = write_table(again, "again")
    keyed = docs.withColumns({"_id": F.coalesce(docs[id_col].cast("long"), none), "_none": docs[id_col].isNull(), "_hash": F.xxhash64(docs[text_col].cast("string"))})
    key = ["_id", "_none", "_hash"]
    kept = keyed.join(write_table(gone, "gone"), key, "left_anti")  # few rows on the right: Spark broadcasts them if they are small
    if not again.isEmpty():
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates(key))
    return kept.select(docs.columns)
