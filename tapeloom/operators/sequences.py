"""Order-dependent processing: islands, absorption, trimming, numbering, rendering, packing, planning.

Rows carry explicit ordinals. Windows and ordered aggregates do the work; folds over one document's, entry's or
recording's own array run as ``aggregate`` expressions in the JVM. Only the fingerprints of a text's sentences are
counted by numpy, in Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import text as tx


def ordered_texts(value: str, *order: str, sep: str = " ") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"]), sep)


def islands(df: DataFrame, by: list[str], order: list[str], key: str, fill: bool = False) -> DataFrame:
    """Number the runs of equal keys; with ``fill`` a null key extends the run before it (leading nulls stay one)."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_k", F.last(key, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if fill else F.col(key))
    change = (~F.col("_k").eqNullSafe(F.lag("_k").over(w))) | (F.row_number().over(w) == 1)
    return out.withColumn("island", F.sum(change.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def group_words(words: DataFrame, by: list[str]) -> DataFrame:
    """Consecutive words of one speaker as groups: speaker, words, start, end."""
    runs = islands(words, by, ["word_pos"], "speaker", fill=True)
    return runs.groupBy(*by, "island").agg(
        F.first("_k").alias("speaker"),
        F.count("*").cast("int").alias("n_words"),
        F.min_by("start", "word_pos").alias("start"),
        F.max_by("end", "word_pos").alias("end"),
        ordered_texts("word", "word_pos").alias("text"),
    )


def absorb_small(groups: DataFrame, by: list[str], min_words: int, min_seconds: float) -> DataFrame:
    """Fold groups under either threshold into the group before; leading ones into the first that stays.

    A null group joins the one before if there is one, else it stays. Then neighbours of one speaker merge. If no
    group is big enough nothing is left.
    """
    w = Window.partitionBy(*by).orderBy("island")
    upto, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    big = (F.col("n_words") >= min_words) & (F.col("end") - F.col("start") >= min_seconds) & F.col("speaker").isNotNull()
    out = groups.withColumn("_big", big)
    before = F.max(F.col("_big").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    null_before = F.max(F.col("speaker").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    stays = F.col("_big") | (F.col("speaker").isNull() & (F.coalesce(before, F.lit(0)) == 0) & (F.coalesce(null_before, F.lit(0)) == 0))
    out = out.withColumn("_anchor", F.when(stays, F.col("island")))
    out = out.withColumn("_to", F.coalesce(F.last("_anchor", ignorenulls=True).over(upto), F.first("_anchor", ignorenulls=True).over(ahead))).filter("_to is not null")
    kept = out.groupBy(*by, "_to").agg(
        F.max(F.when(F.col("island") == F.col("_to"), F.col("speaker"))).alias("speaker"),
        F.sum("n_words").cast("int").alias("n_words"),
        F.min_by("start", "island").alias("start"),
        F.max_by("end", "island").alias("end"),
        ordered_texts("text", "island").alias("text"),
    )
    return merge_adjacent(kept.withColumnRenamed("_to", "island"), by)


def merge_adjacent(groups: DataFrame, by: list[str]) -> DataFrame:
    """Merge neighbours of one speaker."""
    runs = islands(groups.withColumnRenamed("island", "_pos"), by, ["_pos"], "speaker")
    return runs.groupBy(*by, "island").agg(
        F.first("speaker").alias("speaker"),
        F.sum("n_words").cast("int").alias("n_words"),
        F.min_by("start", "_pos").alias("start"),
        F.max_by("end", "_pos").alias("end"),
        ordered_texts("text", "_pos").alias("text"),
    )


def glue_subwords(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Join subword tokens into words where any token of the entry is marked by a leading space.

    Words are stripped. Blank and null tokens are none and open no word, though a leading space of theirs counts as a mark.
    """
    w = Window.partitionBy(*by).orderBy("word_pos")
    marked = tokens.withColumn("_m", F.coalesce(F.max(F.col("word").startswith(" ").cast("int")).over(Window.partitionBy(*by)), F.lit(0)) == 1)
    full = marked.withColumn("_w", tx.strip(F.col("word"))).filter("_w <> ''")
    opens = F.col("word").startswith(" ") | (F.row_number().over(w) == 1) | ~F.col("_m")
    runs = full.withColumn("word_no", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "word_no").agg(ordered_texts("_w", "word_pos", sep="").alias("word"), F.min_by("start", "word_pos").alias("start"), F.max_by("end", "word_pos").alias("end"))


def usable_words(words: DataFrame, by: list[str]) -> DataFrame:
    """Words of entries that have words, all of them with times."""
    bad = F.max((F.col("start").isNull() | F.col("end").isNull()).cast("int")).over(Window.partitionBy(*by))
    return words.withColumn("_bad", bad).filter("_bad = 0").drop("_bad")


def label_map(entries: DataFrame, names: DataFrame, word: str = "Speaker", by: str = "task_id") -> DataFrame:
    """Speakers numbered by first appearance, "<word> N"; a named one keeps its name but uses up its number."""
    first = entries.filter("speaker is not null").groupBy(by, "speaker").agg(F.min("pos").alias("_p"))
    n = F.row_number().over(Window.partitionBy(by).orderBy("_p", "speaker"))
    numbered = first.withColumn("_n", n).join(names, [by, "speaker"], "left")
    return numbered.select(by, "speaker", F.coalesce("name", F.concat(F.lit(f"{word} "), F.col("_n").cast("string"))).alias("label"))


def render_dialogue(entries: DataFrame, labels: DataFrame, by: str = "task_id") -> DataFrame:
    """Text of each recording: runs of one speaker joined by spaces, labelled, separated by blank lines.

    With at most one label the text is flat. Blank texts don't count; a null speaker's run has no label.
    """
    full = entries.filter(tx.strip(F.col("text")) != "").withColumn("text", tx.strip(F.col("text")))
    runs = islands(full.join(labels, [by, "speaker"], "left"), [by], ["pos"], "speaker")
    blocks = runs.groupBy(by, "island").agg(F.first("label").alias("label"), ordered_texts("text", "pos").alias("block"))
    line = blocks.withColumn("block_out", F.when(F.col("label").isNotNull(), F.concat("label", F.lit(": "), "block")).otherwise(F.col("block")))
    out = line.groupBy(by).agg(F.count_distinct("label").alias("_n"), ordered_texts("block_out", "island", sep="\n\n").alias("_many"), ordered_texts("block", "island").alias("_flat"))
    return out.select(by, F.when(F.col("_n") > 1, F.col("_many")).otherwise(F.col("_flat")).alias("rendered"))


def flat_text(entries: DataFrame, by: str = "task_id", order: str = "pos") -> DataFrame:
    """Non-empty texts in order, joined by spaces."""
    full = entries.withColumn("text", tx.strip(F.col("text"))).filter("text <> ''")
    return full.groupBy(by).agg(ordered_texts("text", order).alias("text"))


def trimmed(units: Column, least: int = 6, most_chars: int = 64) -> Column:
    """(kept, head, tail): units without runs of ``least`` equal ones at the start, then at the end; repeated until none is left."""

    def strip_head(xs: Column) -> Column:
        keys = F.transform(xs, tx.normalize_token)
        state = F.aggregate(
            keys,
            F.struct(F.lit(0).alias("cut"), F.lit(0).alias("run"), F.lit(None).cast("string").alias("key"), F.lit(False).alias("over")),
            lambda a, k: F.when(a["over"], a)
            .when(a["key"] == k, F.struct(a["cut"].alias("cut"), (a["run"] + 1).alias("run"), k.alias("key"), F.lit(False).alias("over")))
            .otherwise(
                F.struct(
                    F.when(a["run"] >= least, a["cut"] + a["run"]).otherwise(a["cut"]).alias("cut"),
                    F.lit(1).alias("run"),
                    k.alias("key"),
                    (((a["key"].isNotNull()) & (a["run"] < least)) | (k == "") | (F.length(k) > most_chars)).alias("over"),
                )
            ),
        )
        return tx.let(state, lambda z: F.when(~z["over"] & (z["run"] >= least), z["cut"] + z["run"]).otherwise(z["cut"]))

    def cut_tail(x: Column) -> Column:
        tail = strip_head(F.reverse(x["rest"]))
        return tx.let(tail, lambda n: F.struct(F.slice(x["rest"], 1, F.greatest(F.lit(0), F.size(x["rest"]) - n)).alias("kept"), x["head"].alias("head"), n.alias("tail")))

    def cut_head(us: Column) -> Column:
        return tx.let(strip_head(us), lambda n: F.struct(F.slice(us, n + 1, F.greatest(F.lit(0), F.size(us) - n)).alias("rest"), n.alias("head")))

    return tx.let(tx.let(units, cut_head), cut_tail)


def trim_edges(text: Column) -> Column:
    """A text without sentences that repeat at its edges; if all would go, the text itself."""
    kept = F.array_join(trimmed(tx.transcript_sentences(text))["kept"], " ")
    return F.when(kept != "", kept).otherwise(tx.strip(text))


def trim_entries(entries: DataFrame, by: str = "task_id") -> DataFrame:
    """The same over all sentences of a recording's entries, so runs may cross entries; emptied entries go.

    If nothing would be left the entries stay as they are.
    """
    flat = entries.select(by, "pos", F.posexplode(tx.transcript_sentences(F.col("text"))).alias("_i", "_s"))
    whole = flat.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "_i", "_s"))).alias("_all"))
    cut = trimmed(F.transform("_all", lambda x: x["_s"]))
    kept = whole.withColumn("_cut", cut).withColumn("_left", F.slice("_all", F.col("_cut.head") + 1, F.size("_cut.kept")))
    alive = kept.filter(F.size("_left") > 0)
    own = alive.select(by, F.explode("_left").alias("x")).select(by, "x.*").groupBy(by, "pos").agg(ordered_texts("_s", "_i").alias("_text"))
    out = entries.join(own, [by, "pos"], "left").join(alive.select(by, F.lit(True).alias("_alive")), by, "left")
    out = out.filter(F.col("_text").isNotNull() | F.col("_alive").isNull())
    return out.withColumn("text", F.coalesce("_text", "text")).select(entries.columns)


def previous_tail(segments: DataFrame, by: str = "task_id", most: int = 800) -> DataFrame:
    """The end of the segment whose index is one less, as a prompt; none if it is missing or suspicious."""
    before = segments.select(by, (F.col("segment_index") + 1).alias("segment_index"), F.when(~tx.is_probable_hallucination(F.col("text")), tx.tail_prompt(F.col("text"), most)).alias("prompt"))
    return segments.join(before, [by, "segment_index"], "left")


def pack_units(units: Column, sizes: Column, budget: int) -> Column:
    """Greedy packing in order: a unit that would exceed the budget opens a new pack; an oversized one stands alone."""
    start = F.struct(F.lit(1).alias("first"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("n"))
    over = lambda s: s.cast("long") > budget

    def step(a: Column, s: Column) -> tuple[Column, Column, Column]:
        """The open pack holds ``k`` units from ``first`` on; given out are the (first, k) of the one before, closed by s."""
        n, next_ = s.cast("long"), a["first"] + a["k"]
        full = (a["k"] > 0) & (over(s) | (a["n"] + n > budget) | (a["n"] > budget))
        opened = F.struct(next_.alias("first"), F.lit(1).alias("k"), n.alias("n"))
        joined = F.struct(a["first"].alias("first"), (a["k"] + 1).alias("k"), (a["n"] + n).alias("n"))
        return F.when(full | (a["k"] == 0), opened).otherwise(joined), full, F.struct(a["first"].alias("first"), a["k"].alias("k"))

    spans = tx.fold(sizes, start, step, "struct<first:int,k:int>", lambda a: (a["k"] > 0, F.struct(a["first"].alias("first"), a["k"].alias("k"))))
    return tx.let(units, lambda u: F.transform(spans, lambda x: F.slice(u, x["first"], x["k"])))


def chunk_sentences(text: Column) -> Column:
    """Sentences for packing: no cut after abbreviations, initials and bare numbers; "!", "?" and "…" always cut."""
    marked = F.regexp_replace(text, r"(?U)((?<=[.!?…])\s+|\n{2,})", "$1\u0001")
    lists = F.array(*[F.lit(a) for a in tx.ABBREVIATIONS])

    def false_end(piece: Column) -> Column:
        """Whether a piece ends in an abbreviation: its last word tells, as pieces end in white space."""
        listed = lambda word: F.array_contains(lists, word) | word.rlike(r"(?U)^[^\W\d_]\.$") | word.rlike(r"(?U)^\d+\.$")
        last = lambda bare: F.lower(F.regexp_extract(bare, r"(?U)(?<!\S)(\S++)$", 1))
        return tx.let(F.regexp_replace(piece, r"(?U)\s+$", ""), lambda bare: bare.endswith(".") & tx.let(last(bare), listed))

    judged = F.transform(F.split(marked, "\u0001"), lambda p: F.struct(p.alias("p"), false_end(p).alias("goes_on")))

    def step(open_: Column, x: Column) -> tuple[Column, Column, Column]:
        whole = F.concat(open_, x["p"])
        return F.when(x["goes_on"], whole).otherwise(""), ~x["goes_on"], whole

    # The fold only joins pieces; each sentence is stripped once, afterwards.
    sentences = tx.fold(judged, F.lit(""), step, "string", lambda open_: (open_ != "", open_))
    return F.filter(F.transform(sentences, tx.strip), lambda x: x != "")


def thin_points(points: Column, window: float) -> Column:
    """Silence points in order, each kept if it is more than max(window / 10, 1) after the last kept one."""
    gap = max(window / 10, 1.0)

    def step(last: Column, p: Column) -> tuple[Column, Column, Column]:
        far = last.isNull() | (p - last > gap)
        return F.when(far, p).otherwise(last), far, p

    return tx.fold(F.array_sort(points).cast("array<double>"), F.lit(None).cast("double"), step, "double")


def plan_segments(duration: Column, points: Column, target: float, window: float, overlap: float, least: float = 45.0) -> Column:
    """Segments [start, end] of a recording, cut near every target at the nearest silence, inner edges overlapping.

    A cut less than ``least`` seconds after the last one moves to last + target. Equally near points: the earliest.
    """
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(duration / least).cast("int")))
    start = F.struct(F.array(F.lit(0.0)).alias("cuts"), F.lit(float(target)).alias("cursor"))

    def step(a: Column, _: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), a["cursor"] - window), F.least(duration, a["cursor"] + window)
        near = F.filter(points, lambda p: (p >= low) & (p <= high))
        best = F.array_min(F.transform(near, lambda p, i: F.struct(F.abs(p - a["cursor"]).alias("d"), i.alias("i"), p.alias("p"))))["p"]
        chosen = F.coalesce(best, a["cursor"])
        last = F.get(a["cuts"], F.size(a["cuts"]) - 1)
        cut = F.when(chosen - last < least, F.least(duration, last + target)).otherwise(chosen)
        return F.when(a["cursor"] < duration, F.struct(F.concat(a["cuts"], F.array(cut)).alias("cuts"), (cut + target).alias("cursor"))).otherwise(a)

    def spans_of(cuts: Column) -> Column:
        n = F.size(cuts) - 1
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(
                F.greatest(F.lit(0.0), F.get(cuts, i) - F.when(i > 0, overlap).otherwise(0.0)).alias("start"),
                F.least(duration, F.get(cuts, i + 1) + F.when(i < n - 1, overlap).otherwise(0.0)).alias("end"),
            ),
        )

    spans = tx.let(F.aggregate(steps, start, step, lambda a: F.concat(a["cuts"], F.array(duration))), spans_of)
    return F.when(duration > 0, spans).otherwise(F.array().cast("array<struct<start:double,end:double>>"))


def preview_turns(turns: DataFrame, by: str, seconds: float, n: int = 3) -> DataFrame:
    """The n longest turns of each speaker, each clipped to ``seconds`` in its middle."""
    length = F.col("end") - F.col("start")
    rank = F.row_number().over(Window.partitionBy(by, "speaker").orderBy(F.desc(length), "seg_pos"))
    clip = F.least(F.lit(seconds), length)
    out = turns.withColumn("rank", rank).filter(F.col("rank") <= n)
    return out.select(by, "speaker", "rank", ((F.col("start") + F.col("end") - clip) / 2).alias("clip_start"), ((F.col("start") + F.col("end") + clip) / 2).alias("clip_end"))


# As bytes: where a sentence ends, with the white space after it; Unicode's white space beyond that of bytes.
_CUT = re.compile(rb"[.!?\xa6\n](?:(?<=\n)\n+|(?:(?<=[.!?])|(?<=\xe2\x80\xa6))[ \t-\r]+)")
_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _fingerprints(text: str, n: int, step: int = 1 << 16) -> tuple[int, np.ndarray]:
    """The number of sentences of a text in lower case, and their distinct ``tx.sentence_hashes`` as they first occur.

    The bits of ``step`` shingles are counted at once, so a long text takes no more memory than a shingle's 64 bytes for each.
    """
    flat = _SPACES.sub(" ", text).encode()
    ends = [m.end() for m in _CUT.finditer(flat)]
    said = [w for a, b in zip([0, *ends], [*ends, len(flat)]) if (w := b" ".join(flat[a:b].split()))]
    once = list(dict.fromkeys(said))
    lengths = []

    def shingles(sentence: bytes):
        words = sentence.split(b" ")
        lengths.append(len(words) - n + 1 if len(words) >= n else len(words))
        return map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else words

    flow, totals, done = chain.from_iterable(map(shingles, once)), np.zeros((len(once), 64), np.int64), 0
    while part := [hashlib.md5(x).digest() for x in islice(flow, step)]:
        bits = np.unpackbits(np.ascontiguousarray(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 16)[:, :8]).ravel())
        ends = np.cumsum(lengths) - done
        first = int(np.searchsorted(ends, 0, "right"))
        starts = np.concatenate(([0], ends[first:-1][ends[first:-1] < len(part)]))
        # Up to 255 shingles are counted in bytes, eight of them in a word; of longer sentences several such counts are added.
        runs = np.union1d(starts, np.arange(0, len(part), 255))
        counts = np.add.reduceat(bits.view(np.uint64).reshape(-1, 8), runs, axis=0).view(np.uint8)
        totals[first : first + len(starts)] += np.add.reduceat(counts, np.searchsorted(runs, starts), axis=0, dtype=np.int64)
        done += len(part)
    hashes = np.packbits(totals * 2 > np.array(lengths, np.int64)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return len(said), hashes[np.sort(np.unique(hashes, return_index=True)[1])]


def _near_earlier(hashes: np.ndarray, most: int, few: int, rows: int = 256) -> int:
    """How many of distinct fingerprints are within ``most`` bits of an earlier one; ``rows`` meet a group's others at once."""
    near = np.zeros(len(hashes), bool)

    def meet(at: np.ndarray) -> None:
        for lo in range(0, len(at), rows):
            own = at[lo : lo + rows]
            own = own[~near[own]]
            for to in range(0, lo + rows, 1 << 14):
                others = at[to : min(to + (1 << 14), lo + rows)]
                close = np.bitwise_count(hashes[own, None] ^ hashes[None, others]) <= most
                near[own] |= (close & (others[None, :] < own[:, None])).any(axis=1)

    if len(hashes) <= few:
        meet(np.arange(len(hashes)))
        return int(near.sum())
    width = -(-64 // (most + 1))
    for b in range(most + 1):
        value = hashes >> np.uint64(b * width) & np.uint64((1 << width) - 1)
        order = np.argsort(value, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
            if len(group) > 1:
                meet(group)
    return int(near.sum())


def repeat_share(text: Column, n: int = 3, most: int = 3, few: int = 256) -> Column:
    """``tx.redundancy`` of texts of any length; null for texts of fewer than two sentences.

    Equal fingerprints of a text collapse first. Up to ``few`` of them are all compared. Of more, two within ``most`` bits
    agree in one of ``most`` + 1 blocks of bits, so only those that share a block's value meet.
    """

    @F.arrow_udf("double")
    def share(texts: pa.Array) -> pa.Array:
        def one(x: str | None) -> float | None:
            if x is None:
                return None
            total, hashes = _fingerprints(x, n)
            return (total - len(hashes) + _near_earlier(hashes, most, few)) / total if total > 1 else None

        return pa.array([one(x.as_py()) for x in texts], pa.float64())

    return share(F.lower(text))


def repeat_shares(texts: DataFrame, key: list[str], text: str = "text", n: int = 3, most: int = 3, few: int = 256) -> DataFrame:
    """(key, share): ``repeat_share`` by key; texts of fewer than two sentences have no row, equal texts under one key count once."""
    return texts.select(*key, repeat_share(F.col(text), n, most, few).alias("share")).filter("share is not null").groupBy(*key).agg(F.max("share").alias("share"))
