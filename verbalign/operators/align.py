"""One-to-one alignment of speech and subtitle segments of each media item.

Inputs carry ``media_id`` and ``seq`` (the order within the item, which decides
ties). Where every speech segment of an item has an id of its own that some
subtitle has too, the result is an equi-join with anti-joined rest. Elsewhere the
match is greedy in order, since an earlier segment may take a subtitle that a
later one has the id of; that runs per item in ``applyInPandas``.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPEECH = "media_id string, seq long, id int, start double, end double, ts double, text string"
SUBTITLE = "media_id string, seq long, id int, ts double, text string"
PAIR = "media_id string, a_seq long, s_seq long"


def timestamp_of(timestamp: Column, midpoint: Column, mid: Column, start: Column, end: Column) -> Column:
    """The first time that is there, else the middle of start and end, else an error."""
    return F.coalesce(timestamp, midpoint, mid, (start + end) / 2, F.raise_error(F.lit("segment has no timestamp")).cast("double"))


def first_text(*names: Column) -> Column:
    """The first text that isn't empty."""
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit(""))


def bounds(start: Column, end: Column, ts: Column) -> tuple[Column, Column]:
    """Rounded start and end; if one is missing, the segment's time stands for it."""
    some = start.isNotNull() | end.isNotNull()
    return F.when(some, F.round(F.coalesce(start, ts), 3)), F.when(some, F.round(F.coalesce(end, ts), 3))


def greedy(speech: pd.DataFrame, subtitles: pd.DataFrame, tolerance: float) -> list[tuple[int | None, int | None]]:
    """(speech seq, subtitle seq) pairs of one item: by id, else the nearest free subtitle in tolerance."""
    speech, subtitles = speech.sort_values("seq"), subtitles.sort_values("seq")
    seqs, times = subtitles.seq.tolist(), subtitles.ts.tolist()
    by_id = {int(i): k for k, i in enumerate(subtitles.id) if pd.notna(i)}  # the last one with an id has it
    order = sorted(range(len(times)), key=lambda k: (times[k], k))
    sorted_times = [times[k] for k in order]
    used, pairs = [False] * len(times), []
    for seq, i, ts in zip(speech.seq, speech.id, speech.ts):
        k = by_id.get(int(i)) if pd.notna(i) else None
        if k is None or used[k]:
            near = [j for j in order[bisect.bisect_left(sorted_times, ts - tolerance - 1e-6) : bisect.bisect_right(sorted_times, ts + tolerance + 1e-6)] if not used[j] and abs(ts - times[j]) <= tolerance]
            k = min(near, key=lambda j: (abs(ts - times[j]), j), default=None)
        if k is not None:
            used[k] = True
        pairs.append((seq, None if k is None else seqs[k]))
    return pairs + [(None, seqs[k]) for k in range(len(times)) if not used[k]]


def align_ids(speech: DataFrame, subtitles: DataFrame) -> DataFrame:
    """Pairs by (media_id, id), the last of repeated subtitle ids, and what is left on either side."""
    last = subtitles.where("id is not null").groupBy("media_id", "id").agg(F.max("seq").alias("s_seq"))
    own = speech.select("media_id", "id", F.col("seq").alias("a_seq"))
    met = own.join(last, ["media_id", "id"], "left").select("media_id", "a_seq", "s_seq")
    taken = met.where("s_seq is not null").select("media_id", F.col("s_seq").alias("seq"))
    rest = subtitles.join(taken, ["media_id", "seq"], "left_anti").select("media_id", F.lit(None).cast("long").alias("a_seq"), F.col("seq").alias("s_seq"))
    return met.unionByName(rest)


def simple_media(speech: DataFrame, subtitles: DataFrame) -> DataFrame:
    """media_id of items whose speech ids are all there, all different, and all among the subtitles'."""
    ids = subtitles.where("id is not null").select("media_id", "id").distinct().withColumn("known", F.lit(1))
    s = speech.join(ids, ["media_id", "id"], "left").groupBy("media_id")
    s = s.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count("known").alias("known"))
    return s.where("n = ids and n = known").select("media_id")


def align(speech: DataFrame, subtitles: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """media_id, pos, a_seq, s_seq: pairs in order of time (speech first on ties)."""
    easy = simple_media(speech, subtitles)
    fast = align_ids(speech.join(easy, "media_id", "left_semi"), subtitles.join(easy, "media_id", "left_semi"))
    # both sides may come of one table: fresh names keep their columns apart
    fresh = lambda d: d.join(easy, "media_id", "left_anti").select(*[F.col(c).alias(c) for c in ("media_id", "seq", "id", "ts")])
    hard_a, hard_s = fresh(speech), fresh(subtitles)

    def one(key, a: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        rows = greedy(a, s, tolerance)
        out = pd.DataFrame(rows, columns=["a_seq", "s_seq"]).astype("Int64")
        out.insert(0, "media_id", key[0])
        return out

    slow = hard_a.groupBy("media_id").cogroup(hard_s.groupBy("media_id")).applyInPandas(one, PAIR)
    pairs = fast.unionByName(slow)
    pairs = pairs.join(speech.select("media_id", F.col("seq").alias("a_seq"), F.col("ts").alias("a_ts")), ["media_id", "a_seq"], "left")
    pairs = pairs.join(subtitles.select("media_id", F.col("seq").alias("s_seq"), F.col("ts").alias("s_ts")), ["media_id", "s_seq"], "left")
    order = Window.partitionBy("media_id").orderBy(F.coalesce("a_ts", "s_ts"), F.col("a_seq").isNull(), "a_seq", "s_seq")
    return pairs.select("media_id", F.row_number().over(order).alias("pos"), "a_seq", "s_seq", F.coalesce("a_ts", "s_ts").alias("ts"))


def nearest_within(left: DataFrame, right: DataFrame, key: str, tolerance: float, left_id: str, right_id: str) -> DataFrame:
    """For each left row the nearest right row of its key in tolerance, the smaller id on ties; else none.

    ``left`` and ``right``: key, ts, id. A range join by buckets of the
    tolerance's width: each right row stands in three buckets, so it is an equi-join.
    """
    b = lambda c: F.floor(c / tolerance).cast("long")
    r = right.select(key, F.col("ts").alias("r_ts"), right_id).withColumn("bucket", F.explode(F.sequence(b(F.col("r_ts")) - 1, b(F.col("r_ts")) + 1)))
    met = left.withColumn("bucket", b(F.col("ts"))).join(r, [key, "bucket"]).where(F.abs(F.col("ts") - F.col("r_ts")) <= tolerance)
    best = met.groupBy(left_id).agg(F.min(F.struct(F.abs(F.col("ts") - F.col("r_ts")).alias("gap"), F.col(right_id).alias("r"))).alias("m"))
    return left.join(best, left_id, "left").select(left_id, F.col("m.r").alias(right_id), F.col("m.gap").alias("gap"))
