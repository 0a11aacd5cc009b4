"""Speech against screen: scored, classified rows of each item, and their roll-up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..functions.similarity import METRICS, best_texts, breakdown
from ..functions.text import normalize_text, strip
from ..params import CompareParams
from .align import align, bounds
from .context import groups, nearby

SUMMARY = ["segment_count", "flagged_count", "avg_score", "missing_subtitle_count", "missing_speech_count", "duplicate_count"]


def judge(candidates: DataFrame, profile: str = "indel") -> DataFrame:
    """Of candidates (media_id, a_seq, ordinal, a_norm, c_norm, ...) those that count, with ``m``, their METRICS.

    Of each segment that is its own row, of ordinal 0, the only one with a_norm, and
    the candidate that scores above it and best, the first on ties. A segment's rows
    are adjacent, its own first. Where a batch ends within a segment, both parts
    have one.
    """
    names = [x.split()[0] for x in METRICS.split(", ")]
    schema = StructType([*candidates.drop("a_norm", "c_norm").schema, StructField("m", StructType.fromDDL(METRICS))])

    def metrics(pairs: list[tuple[str, str]]) -> list[dict]:
        each = list(dict.fromkeys(pairs))
        rows = dict(zip(each, breakdown([a for a, _ in each], [c for _, c in each], profile)))
        return [dict(zip(names, rows[x])) for x in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said, floor = "", 0.0
        for b in batches:
            own = b.column("ordinal").to_numpy() == 0
            a, c = b.column("a_norm").to_pylist(), b.column("c_norm").to_pylist()
            first, rest = np.flatnonzero(own), np.flatnonzero(~own)
            m = metrics([(a[k], c[k]) for k in first])
            texts, floors = [said, *(a[k] for k in first)], np.array([floor, *(x["score"] for x in m)])
            best = best_texts(texts, np.cumsum(own)[rest], [c[k] for k in rest], floors, profile)
            m += metrics([(texts[i], c[rest[k]]) for i, k in best.items()])
            said, floor = texts[-1], floors[-1]
            out = b.drop_columns(["a_norm", "c_norm"]).take(pa.array(np.r_[first, rest[list(best.values())]].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(m, to_arrow_type(schema["m"].dataType))], [*out.schema.names, "m"])

    return candidates.mapInArrow(run, schema)


def compare(speech: DataFrame, subtitles: DataFrame, p: CompareParams = CompareParams()) -> DataFrame:
    """One row per aligned pair: media_id, id, timestamp, texts, score, status, reason, bounds, metrics."""
    pairs = align(speech, subtitles, p.tolerance)
    a = speech.select("media_id", F.col("seq").alias("a_seq"), F.col("id").alias("a_id"), "start", "end", F.col("text").alias("a_text"))
    s = subtitles.select("media_id", F.col("seq").alias("s_seq"), F.col("text").alias("s_text"))
    rows = pairs.join(a, ["media_id", "a_seq"], "left").join(s, ["media_id", "s_seq"], "left")
    start, end = bounds(F.col("start"), F.col("end"), F.col("ts"))
    rows = rows.select("media_id", "pos", "a_seq", "ts", "a_id", start.alias("b_start"), end.alias("b_end"), F.coalesce("a_text", F.lit("")).alias("a_text"), F.coalesce("s_text", F.lit("")).alias("s_text"))
    rows = rows.withColumn("a_norm", normalize_text(F.col("a_text"))).withColumn("c_norm", normalize_text(F.col("s_text")))
    # nothing beats a score of 1, so of equal texts none looks around
    asks = F.col("a_seq").isNotNull() & (F.col("a_norm") != "") & (F.col("a_norm") != F.col("c_norm"))
    ask = [F.when(asks, F.col(c)).alias(n) for c, n in (("a_id", "id"), ("ts", "ts"), ("b_start", "b_start"), ("b_end", "b_end"))]
    rows = rows.select("media_id", F.col("pos").cast("long").alias("a_seq"), *ask, F.struct("ts", "b_start", "b_end", "a_text", "s_text", "a_norm", "c_norm").alias("row"))
    # a pair costs up to milliseconds, so segments are dealt evenly, however few they are
    cores = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = nearby(rows, subtitles, p, "row").repartition(cores, "media_id", "a_seq")
    near = groups(near, p, "row").withColumn("text", F.coalesce("row.s_text", "text")).withColumn("source", F.coalesce("source", F.lit("aligned")))
    near = near.withColumn("a_norm", F.col("row.a_norm")).withColumn("c_norm", F.coalesce("row.c_norm", normalize_text(F.col("text"))))
    best = judge(near.sortWithinPartitions("media_id", "a_seq", "ordinal"), p.profile).repartition("media_id").groupBy("media_id", F.col("a_seq").cast("int").alias("pos"))
    best = best.agg(F.max_by(F.struct("m", "source", "text"), F.struct(F.col("m.score"), -F.col("ordinal"))).alias("best"), F.first("row", ignorenulls=True).alias("row"))
    rows = best.select("media_id", "pos", "row.ts", "row.b_start", "row.b_end", "row.a_text", "row.a_norm", F.col("best.text").alias("sub"), F.col("best.m").alias("m"), F.col("best.source").alias("match_source"))
    return classify(rows, p)


def classify(rows: DataFrame, p: CompareParams) -> DataFrame:
    """Reason and status; a subtitle that is carried on from the row before is a duplicate."""
    sub = strip(F.col("sub"))
    before = F.last(F.nullif(sub, F.lit("")), ignorenulls=True).over(Window.partitionBy("media_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).withColumn("sub_norm", normalize_text(F.col("sub")))
    said, shown, low = strip(F.col("a_text")) != "", sub != "", F.col("m.score") < p.threshold
    again = shown & (sub == F.coalesce("before", F.lit(""))) & (F.col("a_norm") != F.col("sub_norm"))
    reason = F.when(said & ~shown, "missing_subtitle").when(shown & ~said, "missing_speech").when(again & low, "duplicate").when(low, "low_similarity").otherwise("ok")
    metrics = F.struct(*[F.col(f"m.{x.split()[0]}").alias(x.split()[0]) for x in METRICS.split(", ")], "match_source")
    return rows.select("media_id", F.col("pos").alias("id"), F.round("ts", 3).alias("timestamp"), F.col("a_text").alias("audio_text"), F.col("sub").alias("subtitle_text"), F.col("m.score").alias("score"), F.when(low, "REVIEW").otherwise("OK").alias("status"), reason.alias("reason"), F.col("b_start").alias("start"), F.col("b_end").alias("end"), metrics.alias("metrics"))


def summarize(rows: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """Counts and mean score by item; ``media``: items that may have no row."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    out = rows.groupBy("media_id").agg(F.count("*").alias("segment_count"), count("status", "REVIEW").alias("flagged_count"), F.round(F.avg("score"), 4).alias("avg_score"), *[count("reason", r).alias(f"{r}_count") for r in ("missing_subtitle", "missing_speech", "duplicate")])
    if media is not None:
        out = media.select("media_id").distinct().join(out, "media_id", "left").fillna(0)
    return out.select("media_id", *SUMMARY)
