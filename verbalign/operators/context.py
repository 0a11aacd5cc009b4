"""Candidate subtitles around each speech segment, single and joined.

The three ways in (within the widened segment, near its time, near its id) are
one equi-join: by buckets of time and by id. A subtitle serves any number of
segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..params import CompareParams

BUCKET = 8.0  # seconds


def nearby(speech: DataFrame, subtitles: DataFrame, p: CompareParams, keep: str = "") -> DataFrame:
    """media_id, a_seq, s_seq, s_ts, s_text, span of all single candidates.

    ``speech``: media_id, a_seq, id, ts, b_start, b_end (both rounded, or null); one
    without id and times has no candidates. ``keep``: a column of speech; each
    segment then also has a row of its own with it, where the subtitle is null.
    """
    subs = subtitles.select("media_id", F.col("seq").alias("s_seq"), F.col("id").alias("s_id"), F.col("ts").alias("s_ts"), strip(F.col("text")).alias("s_text")).where("s_text <> ''")
    lo, hi = F.least("b_start", "b_end"), F.greatest("b_start", "b_end")
    a = speech.withColumn("from", F.least(F.col("ts") - p.context, F.coalesce(lo - p.context, F.col("ts")))).withColumn("to", F.greatest(F.col("ts") + p.context, F.coalesce(hi + p.context, F.col("ts"))))
    a = a.withColumn("span", F.coalesce(hi - lo, F.lit(0.0)))
    b = lambda c: F.floor(c / BUCKET).cast("long")
    # keys of kind 0 are buckets, of kind 1 ids; a segment's own row has kind 2
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.cast("long").alias("key"))
    none = F.array().cast("array<struct<kind:int,key:bigint>>")
    subs = subs.select("*", F.inline(F.array_compact(F.array(key(0, b(F.col("s_ts"))), F.when(F.col("s_id").isNotNull(), key(1, F.col("s_id")))))))
    id_ = F.col("id").cast("long")
    times = F.transform(F.sequence(b(F.col("from") - 1e-6), b(F.col("to") + 1e-6)), lambda k: key(0, k))
    ids = F.transform(F.sequence(id_ - p.id_band, id_ + p.id_band), lambda k: key(1, k))
    own = F.array(key(2, F.col("a_seq"))) if keep else none
    a = a.select("*", F.inline(F.concat(own, F.coalesce(times, none), F.coalesce(ids, none))))
    if keep:
        a = a.withColumn(keep, F.when(F.col("kind") == 2, F.col(keep)))
    met = a.join(subs, ["media_id", "kind", "key"], "left" if keep else "inner")
    inside = (lo - p.context <= F.col("s_ts")) & (F.col("s_ts") <= hi + p.context)
    timed = F.coalesce(inside, F.lit(False)) | F.coalesce(F.abs(F.col("s_ts") - F.col("ts")) <= p.context, F.lit(False))
    # what its time brings is not brought again by its id
    met = met.where((F.col("kind") == 2) | (F.col("s_seq").isNotNull() & ((F.col("kind") == 0) == timed)))
    return met.select("media_id", "a_seq", "s_seq", "s_ts", "s_text", "span", *([keep] if keep else []))


def groups(candidates: DataFrame, p: CompareParams, keep: str = "") -> DataFrame:
    """Single candidates and runs of 2 to 4: media_id, a_seq, ordinal, source, text.

    ``ordinal`` is the order in which candidates are tried: singles by time,
    then runs by their first candidate and length. ``keep``: as in ``nearby``; a
    segment's own row has ordinal 0 and null source and text.
    """
    w = Window.partitionBy("media_id", "a_seq").orderBy("s_ts", "s_seq")
    c = candidates.withColumn("i", (F.row_number().over(w) - (1 if keep else 0)).cast("long"))
    most = F.when(F.col("span") > p.long_span, 4).otherwise(2)
    reach = F.greatest(F.lit(p.context * 2), F.col("span") + p.context)
    for k in (1, 2, 3):
        c = c.withColumn(f"t{k}", F.lead("s_ts", k).over(w)).withColumn(f"x{k}", F.lead("s_text", k).over(w))
    runs = []
    for size in (2, 3, 4):
        last = F.col(f"t{size - 1}")
        text = F.concat_ws(" ", "s_text", *[f"x{k}" for k in range(1, size)])
        runs.append(F.when((F.lit(size) <= most) & (last - F.col("s_ts") <= reach), F.struct((1_000_000_000 + F.col("i") * 10 + size).alias("ordinal"), F.lit(f"nearby_{size}x").alias("source"), text.alias("text"))))
    single = F.struct(F.col("i").alias("ordinal"), F.when(F.col("s_seq").isNotNull(), "nearby").alias("source"), F.col("s_text").alias("text"))
    out = c.withColumn("c", F.explode(F.array_compact(F.array(single, *runs))))
    return out.select("media_id", "a_seq", "c.ordinal", "c.source", "c.text", *([F.when(F.col("c.ordinal") == 0, F.col(keep)).alias(keep)] if keep else []))
