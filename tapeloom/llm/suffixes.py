"""Suffix-array dedup: remove bytes that a repeated string of 400 bytes covers, by deep-shallow suffix sorting.

Sorting every suffix isn't needed. Each 400-byte window chooses one of its 80-byte grams, the one of least hash
(leftmost on ties), so equal windows choose equal grams at equal offsets. Only the suffixes that start at chosen
grams which occur more than once are sorted, forwards and backwards from the gram: multikey quicksort to a shallow
depth, then blind tries for what is still tied. From the two orders and their common prefixes follows, for each
suffix, the leftmost and rightmost repeated window that chose it; the windows between cover the same bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import FEW, by_group, drop_table, salted_join, texts, write_table

LENGTH, GRAM, SHALLOW, HOT, CHUNK = 400, 80, 16, 16_384, 1 << 20
NO_ID = -(1 << 63)  # stands for a null id
_ODD = 0x9E3779B97F4A7C15
_TABLE = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)


class Grams:
    """Chooses grams: polynomial hashes of all grams by prefix sums, then the least one in each window."""

    def __init__(self, length: int, gram: int, chunk: int = CHUNK):
        self.length, self.gram, self.window, self.chunk = length, gram, length - gram + 1, chunk
        n = chunk + length
        with np.errstate(over="ignore"):
            self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _ODD, np.uint64))])
            self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, pow(_ODD, -1, 1 << 64), np.uint64))])

    def choose(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position, hash, first window, last window) of each chosen gram, for all windows of the text."""
        parts, n = [], len(text) - self.length + 1
        for start in range(0, max(n, 0), self.chunk):
            count = min(self.chunk, n - start)
            data = np.frombuffer(text, np.uint8, count + self.length - 1, start)
            with np.errstate(over="ignore"):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[data] * self.power[: len(data)])])
                m = len(data) - self.gram + 1
                h = (sums[self.gram :] - sums[:m]) * self.inverse[:m]
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            key = h & np.uint64(0xFFFFFFFF00000000) | np.arange(m, dtype=np.uint64)
            w = self.window
            padded = np.full(-(-m // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
            padded[:m] = key
            rows = padded.reshape(-1, w)
            ahead = np.minimum.accumulate(rows, axis=1).ravel()
            behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
            pos = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            cut = np.flatnonzero(np.diff(pos, prepend=-1))
            last = np.append(cut[1:], count) - 1
            parts.append((pos[cut] + start, h[pos[cut]].view(np.int64), cut + start, last + start))
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differing = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differing.bit_length() + 7) // 8


def _at(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_trie(strings: list[bytes], rows: list[int]) -> tuple[list[int], list[int]]:
    """Order the rows' strings by a blind trie: inner nodes keep a depth and one byte a branch, leaves keep rows.

    A string goes down by single bytes to some leaf, is compared with that leaf's string once, and branches off at
    their common prefix. Returns the rows in order and the common prefix of each with the one before (-1 first).
    """
    root: list = [None, [rows[0]]]  # a leaf: [None, equal rows]; an inner node: [depth, {byte: node}]
    for r in rows[1:]:
        s, node = strings[r], root
        while node[0] is not None:
            node = node[1].get(_at(s, node[0])) or next(iter(node[1].values()))
        t = strings[node[1][0]]
        if s == t:
            node[1].append(r)
            continue
        split = common_prefix(s, t)
        node = root
        while node[0] is not None and node[0] < split:
            node = node[1][_at(s, node[0])]
        if node[0] == split:
            node[1][_at(s, split)] = [None, [r]]
        else:
            node[:] = [split, {_at(t, split): node[:], _at(s, split): [None, [r]]}]
    order: list[int] = []
    shared: list[int] = []
    stack: list[tuple[list, int]] = [(root, -1)]
    while stack:
        node, before = stack.pop()
        if node[0] is None:
            order += node[1]
            shared += [before] + [len(strings[node[1][0]])] * (len(node[1]) - 1)
        else:
            kids = [node[1][b] for b in sorted(node[1])]
            stack += [(k, node[0]) for k in reversed(kids[1:])] + [(kids[0], before)]
    return order, shared


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], np.ndarray]:
    """Sort strings that agree in their first ``depth`` bytes: order, and common prefixes of neighbours (-1 first).

    Multikey quicksort on 8-byte words down to ``shallow`` bytes more; groups that are still tied, or small, go to
    blind tries. Equal strings share their whole length.
    """
    order: list[int] = []
    shared: list[int] = []
    stack = [(list(range(len(strings))), depth)]
    while stack:
        rows, d = stack.pop()
        if len(rows) <= 16 or d >= depth + shallow:
            o, s = blind_trie(strings, rows) if rows else ([], [])
            if o and order:
                s[0] = common_prefix(strings[order[-1]], strings[o[0]])
            order += o
            shared += s
            continue
        if any(len(strings[r]) < d + 8 for r in rows):
            o, s = blind_trie(strings, rows)  # ends of strings inside the word: their order is the trie's to find
            if order:
                s[0] = common_prefix(strings[order[-1]], strings[o[0]])
            order += o
            shared += s
            continue
        words = np.array([int.from_bytes(strings[r][d : d + 8].ljust(8, b"\0"), "big") for r in rows], np.uint64)
        pivot = np.sort(words)[len(rows) // 2]
        arr = np.array(rows)
        stack += [(arr[words > pivot].tolist(), d), (arr[words == pivot].tolist(), d + 8), (arr[words < pivot].tolist(), d)]
    return order, np.array(shared, np.int64)


def extents(left: list[bytes], right: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes that share a gram: the least and greatest number of bytes before it in a repeated window; -1: none.

    ``left`` are the bytes before the gram in reverse, ``right`` those after it, up to ``window`` of each. A window
    with a bytes before the gram repeats if another suffix agrees in a bytes to the left and window - a to the right.
    """
    n = len(left)
    low, high = np.full(n, -1), np.full(n, -1)
    if n < 2:
        return low, high
    if n == 2:
        a, b = common_prefix(*left), common_prefix(*right)
        if a + b >= window:
            low[:], high[:] = window - b, a
        return low, high
    (lo, ls), (ro, rs) = deep_shallow(left), deep_shallow(right)
    lo, ro = np.array(lo), np.array(ro)

    def repeated(a: int) -> np.ndarray:
        x, y = np.empty(n, np.int64), np.empty(n, np.int64)
        x[lo], y[ro] = np.cumsum(ls < a), np.cumsum(rs < window - a)
        _, inv, num = np.unique(x * n + y, return_inverse=True, return_counts=True)
        return num[inv] > 1

    for a in sorted({int(v) for v in ls if v >= 0} | {window}):
        if a <= window:
            high[repeated(a)] = a
    for a in sorted({window - int(v) for v in rs if 0 <= v <= window} | {0}, reverse=True):
        low[repeated(a)] = a
    return low, high


def _cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, chunk: int = CHUNK, few: int = FEW) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary): each text without the bytes that repeated strings cover.

    A string of ``length`` bytes counts as repeated if it starts anywhere else, in any text; matches never cross
    texts, and are judged on the input. Null and empty texts keep nothing and lose nothing; rows that repeat a text
    are copies of each other; a null id stays null; an empty table gives an empty one. Only id and text are read.

    Equal texts collapse first: a copy loses all it has, and one of the copies stands for them against other texts.
    Grams chosen more than ``hot`` times (in periodic texts, say) don't meet in one task: there the windows themselves
    are counted by hash, with partial sums, and joined back by a join that splits skewed keys. A window that
    repeats inside its own text is known to at once, and counts for the others as one row.
    """
    x, y = F.xxhash64(text_col), F.crc32(F.col(text_col).cast("binary")) + F.octet_length(text_col).cast("long") * (1 << 32)
    base = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias(text_col))
    base = base.select(F.coalesce("id", F.lit(NO_ID)).alias("rid"), x.alias("x"), text_col, y.alias("y"))
    window = length - gram

    def choose(batches):
        grams = Grams(length, gram, chunk)
        for batch, raw in texts(batches, text_col):
            got = [grams.choose(t) for t in raw]
            of = np.repeat(np.arange(len(raw)), [len(g[0]) for g in got])
            pos, h, first, last = (np.concatenate([g[i] for g in got]) for i in range(4))
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(h), pa.array(pos), pa.array(first), pa.array(last)], names=["rid", "x", "h", "pos", "first", "last"])

    grams = write_table(base.filter(F.octet_length(text_col) >= length).select("rid", "x", text_col).mapInArrow(choose, "rid long, x long, h long, pos long, first long, last long"), "grams")
    place = F.xxhash64("x", "pos")
    again = grams.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).filter("a <> b")
    again = write_table(again.select("h", "n"), "repeated")
    # a gram chosen on both sides of a chunk's border comes twice, with adjoining windows
    found = salted_join(grams, again, ["h"], ["rid", "pos"], few=few).groupBy("h", "x", "pos").agg(F.min("rid").alias("rid"), F.min("first").alias("first"), F.max("last").alias("last"))
    found = write_table(found, "found")
    drop_table(grams)
    drop_table(again)
    many = write_table(found.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("h", F.lit(True).alias("hot")), "hot")
    any_hot = not many.isEmpty()
    tagged = found.join(many.hint("merge"), "h", "left") if any_hot else found.withColumn("hot", F.lit(None).cast("boolean"))
    wanted = tagged.groupBy("rid", "x").agg(F.collect_list(F.struct("h", "pos", "first", "last", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("places"))
    wanted = write_table(wanted, "wanted")
    drop_table(found)
    drop_table(many)
    body = base.select("rid", "x", text_col)  # the same columns for all joins below, so Spark shuffles the texts once
    joined = body.join(wanted.hint("merge"), ["rid", "x"]).select("rid", "x", text_col, "places")

    def contexts(batches):
        for batch, raw in texts(batches, text_col):
            rows = []
            for rid, key, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw, batch.column(3).to_pylist(), strict=True):
                for p in places:
                    if not p["hot"]:
                        at = p["pos"]
                        rows.append((p["h"], rid, key, at, text[max(0, at - window) : at][::-1], text[at : at + length]))
            if rows:
                types = [*[pa.int64()] * 4, pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["h", "rid", "x", "pos", "l", "r"])

    def sort(g: pa.Table) -> pa.RecordBatch | None:
        by_place: dict = {}
        for row, (key, pos) in enumerate(zip(g.column("x").to_pylist(), g.column("pos").to_pylist(), strict=True)):
            by_place.setdefault((key, pos), []).append(row)  # rows that repeat an id and a text are one place
        left, right = g.column("l").to_pylist(), g.column("r").to_pylist()
        same: dict = {}
        for rows in by_place.values():
            same.setdefault((left[rows[0]], right[rows[0]]), []).append(rows)
        by_gram: dict = {}
        for c in same:
            by_gram.setdefault(c[1][:gram], []).append(c)  # a hash may stand for several grams
        out = []
        for own in by_gram.values():
            low, high = extents([c[0] for c in own], [c[1][gram:] for c in own], window)
            for i, c in enumerate(own):
                a, b = int(low[i]), int(high[i])
                if len(same[c]) > 1:  # the same surroundings elsewhere: as far as they reach, if a window fits
                    reach_left, reach_right = len(c[0]), len(c[1]) - gram
                    if reach_left + reach_right >= window:
                        a, b = min(x for x in (a, window - reach_right) if x >= 0), max(b, reach_left)
                if b >= 0:
                    out += [(row, a, b) for rows in same[c] for row in rows]
        if not out:
            return None
        rows, a, b = (np.array(c) for c in zip(*out, strict=True))
        pos = g.column("pos").to_numpy()[rows]
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays([g.column("rid").combine_chunks().take(at), g.column("x").combine_chunks().take(at), pa.array(pos - b), pa.array(pos + length - a)], names=["rid", "x", "lo", "hi"])

    spans = by_group(joined.mapInArrow(contexts, "h long, rid long, x long, pos long, l binary, r binary"), ["h"], sort, "rid long, x long, lo long, hi long")
    if any_hot:

        def hashed(batches):
            """(batch, row in it, window starts, window hashes) of the hot grams of each text."""
            for batch, raw in texts(batches, text_col, 1 << 20):
                for i, (text, places) in enumerate(zip(raw, batch.column(3).to_pylist(), strict=True)):
                    starts = [s for p in places if p["hot"] for s in range(p["first"], p["last"] + 1)]
                    if starts:
                        w = np.array([xxhash.xxh3_64_intdigest(text[s : s + length]) for s in starts], np.uint64).view(np.int64)
                        yield batch, i, np.array(starts, np.int64), w

        def once(batches):
            """One row for each distinct window of a text: a place where it starts."""
            for batch, i, starts, w in hashed(batches):
                w, first = np.unique(w, return_index=True)
                same = pa.array(np.full(len(w), i))
                yield pa.RecordBatch.from_arrays([pa.array(w), batch.column(0).take(same), batch.column(1).take(same), pa.array(starts[first])], names=["w", "rid", "x", "pos"])

        def within(batches):
            """The bytes covered by windows that start more than once in their own text."""
            for batch, i, starts, w in hashed(batches):
                _, back, n = np.unique(w, return_inverse=True, return_counts=True)
                own = np.sort(starts[n[back] > 1])
                if len(own):
                    cut = np.flatnonzero(np.append(True, np.diff(own) > length))
                    same = pa.array(np.full(len(cut), i))
                    ends = own[np.append(cut[1:], len(own)) - 1] + length
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(own[cut]), pa.array(ends)], names=["rid", "x", "lo", "hi"])

        seen = joined.mapInArrow(once, "w long, rid long, x long, pos long")
        twice = seen.groupBy("w").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("w")
        back = seen.join(twice.hint("merge"), "w", "left_semi").select("rid", "x", F.col("pos").alias("lo"), (F.col("pos") + length).alias("hi"))
        back = back.unionByName(joined.mapInArrow(within, "rid long, x long, lo long, hi long"))
        spans = spans.unionByName(back)
    per_text = spans.groupBy("rid", "x").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    keys = base.select("rid", "x", "y")
    copies = write_table(keys.groupBy("x", "y").agg(F.count("*").alias("n")).filter("n > 1"), "copies")
    copied = salted_join(keys, copies, ["x", "y"], ["rid"], few=few)
    copied = copied.select("rid", "x").distinct().withColumn("copied", F.lit(True))
    whole = body.join(per_text.hint("merge"), ["rid", "x"], "left").join(copied.hint("merge"), ["rid", "x"], "left").select("rid", "x", text_col, "spans", "copied")

    def strike(batches):
        for batch, raw in texts(batches, text_col):
            out = []
            for text, spans, copied in zip(raw, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                cover = [(0, len(text))] if copied and len(text) >= length else _cover([(s["lo"], s["hi"]) for s in spans or []])
                at, kept = 0, []
                for a, b in cover:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(kept), len(cover), kept))
            cols = list(zip(*out, strict=True))
            ids = pa.compute.if_else(pa.compute.equal(batch.column(0), NO_ID), pa.scalar(None, pa.int64()), batch.column(0))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return whole.mapInArrow(strike, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept binary")
