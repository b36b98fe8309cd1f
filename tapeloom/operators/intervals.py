"""Interval joins of spans with speaker turns, and totals of speech.

Spans and turns meet by recording and time bin, so a recording of any length is spread over its bins and neither a
cross product nor one task per recording arises; results are reduced by partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.numbers import overlap


def _bins(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(start, end) / width))))


def speaker_at(spans: DataFrame, turns: DataFrame, by: str = "task_id", width: float = 60.0, onto: DataFrame | None = None) -> DataFrame:
    """Spans (task, span_id, start, end) with the speaker whose turn overlaps most.

    Ties go to the turn that comes first (seg_pos). A span without length gets the first turn that holds its point,
    both ends included. No turn: null. ``onto`` are the spans with more columns, if those shall be kept.
    """
    s = _bins(spans.select(by, "span_id", "start", "end"), "start", "end", width)
    t = _bins(turns.select(by, "seg_pos", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "speaker"), "t_start", "t_end", width)
    ov = overlap(F.col("start"), F.col("end"), F.col("t_start"), F.col("t_end"))
    point = (F.col("start") == F.col("end")) & (F.col("start") >= F.col("t_start")) & (F.col("start") <= F.col("t_end"))
    met = s.join(t, [by, "_bin"]).withColumn("_ov", ov).filter((F.col("_ov") > 0) | point)
    best = met.groupBy(by, "span_id").agg(F.max_by("speaker", F.struct("_ov", -F.col("seg_pos"))).alias("speaker"))
    return (spans if onto is None else onto).join(best, [by, "span_id"], "left")


def nearest_speaker(spans: DataFrame, turns: DataFrame, by: str = "task_id", width: float = 60.0) -> DataFrame:
    """As ``speaker_at``; spans without an overlap get the turn nearest to their midpoint, the first of equals.

    The nearest turn ends last before the midpoint or starts first after it: two running values over the merged
    time line, carried inside a recording, on which the spans travel with all their columns.
    """
    mid = (F.col("start") + F.col("end")) / 2
    none = "struct<at:double,seg_pos:bigint,speaker:string>"
    null = F.lit(None).cast(none)
    kind = spans.select(F.struct(*(c for c in spans.columns if c != by)).alias("s")).schema["s"].dataType
    edge = lambda c: F.struct(F.col(c).cast("double").alias("at"), F.col("seg_pos").cast("long").alias("seg_pos"), "speaker")
    points = spans.select(by, F.struct(*(c for c in spans.columns if c != by)).alias("_span"), mid.alias("at"), F.lit(1).alias("kind"), null.alias("last_end"), null.alias("first_start"))
    ends = turns.select(by, F.lit(None).cast(kind).alias("_span"), F.col("end").cast("double").alias("at"), F.lit(0).alias("kind"), edge("end").alias("last_end"), null.alias("first_start"))
    starts = turns.select(by, F.lit(None).cast(kind).alias("_span"), F.col("start").cast("double").alias("at"), F.lit(2).alias("kind"), null.alias("last_end"), edge("start").alias("first_start"))
    line = points.unionByName(ends).unionByName(starts)
    back = Window.partitionBy(by).orderBy("at", "kind", F.desc("last_end.seg_pos")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(F.desc("at"), F.desc("kind"), F.desc("first_start.seg_pos")).rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumns({"b": F.last("last_end", ignorenulls=True).over(back), "f": F.last("first_start", ignorenulls=True).over(ahead)}).filter("kind = 1")
    gap_b, gap_f = F.col("at") - F.col("b.at"), F.col("f.at") - F.col("at")
    takes_b = F.col("f").isNull() | F.coalesce((gap_b < gap_f) | ((gap_b == gap_f) & (F.col("b.seg_pos") < F.col("f.seg_pos"))), F.lit(False))
    near = line.select(by, "_span.*", F.when(takes_b, F.col("b.speaker")).otherwise(F.col("f.speaker")).alias("_near"))
    return speaker_at(spans, turns, by, width, near).withColumn("speaker", F.coalesce("speaker", "_near")).select(*spans.columns, "speaker")


def midpoint_blocks(blocks: DataFrame, sentences: DataFrame, by: str = "task_id", width: float = 60.0) -> DataFrame:
    """Blocks (task, block_id, start, end, text) with the sentences whose midpoint falls into [start, end).

    A block without any gets its own text as its one sentence.
    """
    mid = ((F.col("start") + F.col("end")) / 2).alias("mid")
    s = sentences.select(by, "sent_id", mid, F.col("text").alias("sentence")).withColumn("_bin", F.floor(F.col("mid") / width))
    b = _bins(blocks.select(by, "block_id", "start", "end"), "start", "end", width)
    met = b.join(s, [by, "_bin"]).filter((F.col("mid") >= F.col("start")) & (F.col("mid") < F.col("end")))
    own = met.groupBy(by, "block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("mid", "sent_id", "sentence"))), lambda x: x["sentence"]).alias("sentences"))
    return blocks.join(own, [by, "block_id"], "left").withColumn("sentences", F.coalesce("sentences", F.array("text")))


def words_in_entry(words: DataFrame) -> DataFrame:
    """Words moved from their segment's clock to the recording's, if they touch their entry's span."""
    moved = words.withColumns({"start": F.col("start") + F.col("offset"), "end": F.col("end") + F.col("offset")})
    return moved.filter((F.col("end") > F.col("entry_start")) & (F.col("start") < F.col("entry_end")))


def labels_without_entries(turns: DataFrame, entries: DataFrame, by: str = "task_id") -> DataFrame:
    """Speaker labels of the turns that no entry has."""
    return turns.select(by, "speaker").distinct().join(entries.select(by, "speaker").distinct(), [by, "speaker"], "left_anti")


def speaker_seconds(entries: DataFrame, by: str = "task_id") -> DataFrame:
    return entries.filter("speaker is not null").groupBy(by, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))


def speaker_shares(entries: DataFrame, by: str = "task_id") -> DataFrame:
    """Each speaker's share of a recording's speech; recordings without any speech have no rows."""
    each = speaker_seconds(entries, by)
    total = F.sum("seconds").over(Window.partitionBy(by))
    return each.withColumn("_t", total).filter("_t > 0").select(by, "speaker", (F.col("seconds") / F.col("_t")).alias("share"))


def drop_marginal(entries: DataFrame, least: float, by: str = "task_id") -> DataFrame:
    """Give the entries of speakers under a share of speech to the speaker with most; null speakers stay.

    Of equal totals the speaker that appears first prevails.
    """
    each = entries.filter("speaker is not null").groupBy(by, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("_s"), F.min("pos").alias("_p"))
    whole = Window.partitionBy(by)
    each = each.withColumns({"_t": F.sum("_s").over(whole), "_top": F.max_by("speaker", F.struct("_s", -F.col("_p"))).over(whole)})
    moved = each.filter((F.col("_t") > 0) & (F.col("_s") / F.col("_t") < least)).select(by, "speaker", "_top")
    return entries.join(moved, [by, "speaker"], "left").withColumn("speaker", F.coalesce("_top", "speaker")).drop("_top").select(entries.columns)


def speaker_count(entries: DataFrame, noise: DataFrame, by: str = "task_id") -> DataFrame:
    """Distinct speakers of each recording without those flagged as noise."""
    named = entries.filter("speaker is not null").select(by, "speaker").distinct().join(noise.select(by, "speaker", F.lit(True).alias("_noise")).distinct(), [by, "speaker"], "left")
    return named.groupBy(by).agg(F.count_if(F.col("_noise").isNull()).alias("speakers"))


def participants(entries: DataFrame, names: DataFrame, by: str = "task_id") -> DataFrame:
    """Named and anonymous speakers of each recording in the order of their first appearance."""
    first = entries.filter("speaker is not null").groupBy(by, "speaker").agg(F.min("pos").alias("_p")).join(names, [by, "speaker"], "left")
    order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    return first.groupBy(by).agg(
        order(F.when(F.col("name").isNotNull(), F.struct("_p", F.col("name").alias("v")))).alias("named"),
        order(F.when(F.col("name").isNull(), F.struct("_p", F.col("speaker").alias("v")))).alias("anonymous"),
    )
