"""Phrase collocations from a weighted de Bruijn graph of words.

Only the longest grams are counted from the texts: at every word begins one gram of ``longest`` words, or of what is
left of its piece. A full gram is an edge between two overlapping nodes (its words but the last, and but the first),
weighted by its count. A shorter phrase's count is its node's flow: the sum of the edges that leave it, corrected by the
pieces that end in it, which no edge leaves. So each order follows from the one above over aggregated rows. Unary paths
are compacted: a node with an incident edge that carries (nearly) all its flow is a part of that edge, no phrase.

Most grams of a text are rare, and a phrase can't be frequent if a part of it isn't. So the grams' hashes are counted
first, for two words, then for three, and bitmaps of a fixed size tell which may be frequent; a gram ends where the next
word would make a rare part, and that counts as a piece's end. A bitmap may call a rare gram frequent, never the
reverse, so the counts that matter stay exact at every size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import by_group, drop_table, partitions, salted_join, texts, write_table

SLICE, SLOT_BITS, MAP_BITS, SHARD_BITS = 2 << 20, 40, 27, 19
SCREENS = (2, 3)
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_SPACED = bytes(0x20 if k else c for c, k in enumerate(_KIND.tolist()))
_BREAK = re.compile(rb"[.,;:!?\n-\r]")
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of lower-cased UTF-8 text: their bytes, their hashes, and which share a piece with the next one."""

    def __init__(self, data: bytes, seed: int) -> None:
        raw = np.frombuffer(data, np.uint8)
        kind = _KIND[raw]
        inside = np.concatenate([[False], kind == 0, [False]])
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        self.text = data.translate(_SPACED).split()
        self.n = len(starts)
        piece = np.cumsum(kind == 2)[starts]
        self.goes_on = np.append(piece[1:] == piece[:-1], False)[: self.n]
        if self.n:
            power = np.cumprod(np.full(int((ends - starts).max()) + 1, _BASE))
            began = np.zeros(len(raw), np.int64)
            began[starts] = starts
            place = np.arange(len(raw)) - np.maximum.accumulate(began)  # of a byte in its word
            value = np.where(kind == 0, (raw + np.uint64(1)) * power[np.minimum(place, len(power) - 1)], np.uint64(0))
            total = np.concatenate([[np.uint64(0)], np.cumsum(value)])
            self.hash = _mixed((total[ends] - total[starts]) ^ np.uint64(seed))
        else:
            self.hash = np.zeros(0, np.uint64)

    def screened(self, maps: dict[int, np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(order, where a gram of that many words may begin, its slot) for each order from two words on.

        A gram may begin where it lies in one piece and each of its parts has its bit in the map of its order (orders
        without a map pass).
        """
        may, gram = np.ones(self.n, bool), self.hash
        for order in range(2, longest + 1):
            gram = _mixed(gram * _STEP + np.append(self.hash[order - 1 :], np.zeros(min(order - 1, self.n), np.uint64)))
            may = may & np.append(may[1:], False)[: self.n]
            if order == 2:
                may = may & self.goes_on
            slot = (gram >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            yield order, may, slot
            if order in maps:
                may = may & _marked(maps[order], slot)


def _marked(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether the slots' bits are set: a map of 2^b bits takes a slot's first b bits."""
    bit = slot >> (SLOT_BITS - (len(bits) * 8).bit_length() + 1)
    return ((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """(lang, lower-cased text) in slices of about ``size`` bytes; long texts are cut where a piece ends."""
    for part, raw in texts(batches, "text", size):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(part.column(part.schema.get_field_index("lang")).to_pylist(), raw, strict=True):
            by_lang.setdefault(lang, []).append(text.lower())  # of bytes: A-Z only
        for lang, found in by_lang.items():
            whole, at = b"\n".join(found), 0
            while at < len(whole):
                end = _BREAK.search(whole, at + size)
                stop = end.start() if end else len(whole)
                yield lang, whole[at:stop]
                at = stop


def _seed(lang: str) -> int:
    seed = 1469598103934665603
    for c in lang.encode():
        seed = (seed ^ c) * 1099511628211 % (1 << 64)
    return seed


def _screen(docs: DataFrame, order: int, maps, least: int, map_bits: int, slice_bytes: int) -> np.ndarray:
    """The bitmap of the grams of ``order`` words that may come at least ``least`` times: 2^``map_bits`` bits at any size."""
    shard_bits = min(map_bits, SHARD_BITS)

    def hashes(batches):
        for lang, data in _pieces(batches, slice_bytes):
            words = Words(data, _seed(lang))
            may, slot = next((m, s) for o, m, s in words.screened({k: v.value for k, v in maps.items()}, order) if o == order)
            slots, n = np.unique(slot[may], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n.astype(np.int64))], names=["slot", "n"])

    def pack(g: pa.Table) -> pa.RecordBatch:
        bits = np.zeros(1 << shard_bits, np.uint8)
        bits[g.column("bit").to_numpy()] = 1
        return pa.RecordBatch.from_arrays([g.column("shard").combine_chunks()[:1], pa.array([np.packbits(bits, bitorder="little").tobytes()])], names=["shard", "bits"])

    frequent = docs.mapInArrow(hashes, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    bit = F.shiftright("slot", SLOT_BITS - map_bits)
    bits = frequent.select(F.shiftright(bit, shard_bits).cast("int").alias("shard"), bit.bitwiseAND((1 << shard_bits) - 1).alias("bit"))
    out = np.zeros(1 << (map_bits - 3), np.uint8)
    size = 1 << (shard_bits - 3)
    for row in by_group(bits, ["shard"], pack, "shard int, bits binary").toLocalIterator():
        out[row["shard"] * size : (row["shard"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def edges(docs: DataFrame, longest: int, least: int, map_bits: int = MAP_BITS, slice_bytes: int = SLICE) -> DataFrame:
    """(lang, gram, words, f): at each word the longest gram that may matter, its words joined by a space, counted."""
    context, maps = docs.sparkSession.sparkContext, {}
    for order in SCREENS if least > 1 else ():
        if order <= longest:
            maps[order] = context.broadcast(_screen(docs, order, dict(maps), least, map_bits, slice_bytes))

    def grams(batches):
        for lang, data in _pieces(batches, slice_bytes):
            words = Words(data, _seed(lang))
            reach = np.ones(words.n, np.int64)
            marks = {k: v.value for k, v in maps.items()}
            for order, may, slot in words.screened(marks, longest):
                if order in marks:
                    may = may & _marked(marks[order], slot)
                reach[may] = order
            for size in range(1, longest + 1):
                here = reach == size
                if size == 1:
                    counted = Counter(compress(words.text, here.tolist()))
                else:
                    counted = Counter(b" ".join(words.text[i : i + size]) for i in np.flatnonzero(here).tolist())
                if counted:
                    gram = pa.array(list(counted), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(counted), pa.string()), gram, pa.array([size] * len(counted), pa.int32()), pa.array(list(counted.values()), pa.int64())],
                        names=["lang", "gram", "words", "f"],
                    )

    return docs.mapInArrow(grams, "lang string, gram string, words int, f long").groupBy("lang", "gram", "words").agg(F.sum("f").alias("f"))


def first(gram: Column, words: Column | int) -> Column:
    return F.substring_index(gram, " ", words) if isinstance(words, int) else F.array_join(F.slice(F.split(gram, " "), 1, words), " ")


def last(gram: Column, words: Column, of: Column) -> Column:
    return F.array_join(F.slice(F.split(gram, " "), of - words + 1, words), " ")


def phrases(graph: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, gram, words, a): all phrases of up to ``longest`` words with a count of at least ``least``.

    From the longest down: a node's flow is that of the edges that leave it and of the grams that end in it.
    """
    level = graph.filter(F.col("words") == longest).select("lang", "gram", "f")
    out = []
    for words in range(longest, 0, -1):
        if words < longest:
            ends = graph.filter(F.col("words") == words).select("lang", "gram", "f")
            flow = level.select("lang", first(F.col("gram"), words).alias("gram"), "f")
            level = flow.unionByName(ends).groupBy("lang", "gram").agg(F.sum("f").alias("f"))
        out.append(level.filter(F.col("f") >= least).select("lang", "gram", F.lit(words).alias("words"), F.col("f").alias("a")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def compact(found: DataFrame, share: int) -> DataFrame:
    """Drop the phrases that an edge carries: one of a word more, around it, with at least ``share`` per cent of its count.

    Still longer ones need no look: a phrase's count is at most that of each phrase inside it, so a longer one with
    that share has one of a word more inside it that has it, too.
    """
    wider = found.filter(F.col("words") > 2)
    inner = F.array(first(F.col("gram"), F.col("words") - 1), last(F.col("gram"), F.col("words") - 1, F.col("words")))
    carried = wider.select("lang", F.explode(inner).alias("gram"), "a").groupBy("lang", "gram").agg(F.max("a").alias("_most"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = found.filter(F.col("words") > 1).join(carried, ["lang", "gram"], "left")
    return kept.filter(F.col("_most").isNull() | (100 * wide("_most") < share * wide("a"))).drop("_most")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 4,
    least: int = 30,
    share: int = 80,
    top: int = 2000,
    map_bits: int = MAP_BITS,
    slice_bytes: int = SLICE,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of two to ``longest`` words, best first.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and these into words at spaces and tabs.
    ``a`` is the phrase's number of occurrences (``least`` at least), l and r are those of the two parts of its weakest
    cut, score is floor(2000000 a / (l + r)) there, and n is the language's number of words. Phrases of which a longer
    one takes ``share`` per cent are left out. Ties: higher a, then the phrase by bytes. Null texts are empty, a null
    language is ``und``; repeated rows count each time; other columns are not read; an empty table gives an empty one.
    Long texts are cut between pieces into slices of ``slice_bytes``; ``map_bits`` sets the size of a screen's bitmap.
    """
    src = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].alias("text"))
    graph = write_table(edges(src, longest, least, map_bits, slice_bytes), "edges")
    found = write_table(phrases(graph, longest, least), "phrases")
    total = write_table(graph.groupBy("lang").agg(F.sum("f").alias("n")), "words")
    drop_table(graph)
    # a cut's parts are at least as frequent as the phrase, so they are all in ``found``
    cuts = compact(found, share).select("lang", "gram", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), first(F.col("gram"), F.col("k")).alias("part")),
        F.struct(F.lit(1).alias("side"), last(F.col("gram"), F.col("words") - F.col("k"), F.col("words")).alias("part")),
    )
    asked = write_table(cuts.select("lang", "gram", "a", "k", F.inline(sides)), "cuts")
    known = found.select("lang", F.col("gram").alias("part"), F.col("a").alias("f"))
    known = known.join(asked.groupBy("lang", "part").agg(F.count("*").alias("n")), ["lang", "part"])
    both = salted_join(asked, known, ["lang", "part"], ["gram", "k"], "inner").groupBy("lang", "gram", "a", "k")
    both = both.agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = both.withColumn("score", score).groupBy("lang", "gram", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
    rows = weakest.select("lang", F.col("gram").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language's best of each deal first, so that no task sorts a whole language
    rows = rows.withColumn("_deal", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    rows = rows.withColumn("_best", F.row_number().over(Window.partitionBy("lang", "_deal").orderBy(*order))).filter(F.col("_best") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
