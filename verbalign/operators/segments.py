"""Speech segments: building, noise, subtitle files, and times to sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE, loops, once, srt_timestamp, strip

#: Fixed values.
SRT_GAP, SRT_SHORTEST = 0.1, 0.3
NOISE_SECONDS = 0.5
LOW_CONFIDENCE, LOW_LENGTH = -1.5, 10


def build(raw: DataFrame) -> DataFrame:
    """Recogniser output (media_id, seq, start, end, text, avg_logprob) to segments; loops and weak short texts are blanked."""
    conf = F.round("avg_logprob", 4)
    raw = raw.withColumn("said", once(strip(F.coalesce("text", F.lit("")))))
    weak = (conf < LOW_CONFIDENCE) & (F.length("said") < LOW_LENGTH)
    text = once(F.when(loops(F.col("said")) | F.coalesce(weak, F.lit(False)), "").otherwise(F.col("said")))
    start, end = F.round("start", 3), F.round("end", 3)
    return raw.select("media_id", "seq", number().alias("id"), start.alias("start"), end.alias("end"), F.round((start + end) / 2, 3).alias("midpoint"), text.alias("text"), conf.alias("confidence"))


def number() -> Column:
    return F.row_number().over(Window.partitionBy("media_id").orderBy("seq"))


def filter_noise(segments: DataFrame) -> DataFrame:
    """Without empty segments under half a second; the others are numbered anew."""
    kept = segments.where(~((F.col("text") == "") & (F.col("end") - F.col("start") < NOISE_SECONDS)))
    return kept.withColumn("id", number())


def fix_overlaps(segments: DataFrame) -> DataFrame:
    """Segments for a subtitle file: in order of start, an end at least SRT_GAP before the next start."""
    kept = segments.where(F.col("text").rlike(rf"[^{WHITE[1:]}") & (F.col("end") - F.col("start") >= SRT_SHORTEST))
    w = Window.partitionBy("media_id").orderBy("start", "seq")
    nxt, end = F.lead("start").over(w), F.round("end", 3)
    fixed = F.when(nxt < end + SRT_GAP, F.round(nxt - SRT_GAP, 3)).otherwise(end)
    return kept.select("media_id", "seq", F.row_number().over(w).alias("id"), F.round("start", 3).alias("start"), fixed.alias("end"), "text")


def render_srt(segments: DataFrame, lenient: bool = False) -> DataFrame:
    """media_id, srt: one subtitle file's text per item. A negative time is an error; ``lenient``: such segments are left out."""
    f = fix_overlaps(segments)
    f = f.where("start >= 0 and end >= 0") if lenient else f
    block = F.concat(F.col("id").cast("string"), F.lit("\n"), srt_timestamp(F.col("start")), F.lit(" --> "), srt_timestamp(F.col("end")), F.lit("\n"), F.col("text"))
    blocks = f.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("id", block.alias("block")))).alias("b"))
    return blocks.select("media_id", F.concat(F.array_join("b.block", "\n\n"), F.lit("\n")).alias("srt"))


def render_text(segments: DataFrame, metadata: DataFrame) -> DataFrame:
    """media_id, text: header lines and the timed texts. ``metadata``: media_id, input_file, language, model."""
    t = strip(F.col("text"))
    line = F.format_string("[%.2fs - %.2fs] %s", "start", "end", t)
    lines = segments.where(t != "").groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
    head = F.concat_ws("\n", F.concat(F.lit("# Input: "), "input_file"), F.concat(F.lit("# Language: "), "language"), F.concat(F.lit("# Model: "), "model"))
    body = F.coalesce(F.concat(F.lit("\n\n"), F.array_join("l.line", "\n")), F.lit(""))
    return metadata.join(lines, "media_id", "left").select("media_id", F.concat(head, body, F.lit("\n")).alias("text"))


def _spread(lo: Column, hi: Column, n: int) -> Column:
    step = (hi - lo) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + step * i)


def sample_times(start: Column, end: Column, mid: Column, window: float, samples: int) -> Column:
    """Times at which to look at a segment: around its middle, or spread over a long one."""
    shown = lambda x: F.round(F.greatest(F.lit(0.0), x), 3)
    around = F.array(shown(mid)) if window <= 0 or samples <= 1 else F.transform(_spread(mid - window, mid + window, samples), shown)
    if samples <= 1:
        return around
    s = F.greatest(F.lit(0.0), start)
    e = F.greatest(s, end)
    margin = F.least(F.greatest((e - s) * 0.15, F.lit(0.2)), F.lit(0.9))
    lo = F.least(e, s + margin)
    hi = F.greatest(lo, e - margin)
    spread = _spread(lo, hi, samples)
    if samples > 2:
        far = F.forall(spread, lambda t: F.abs(mid - t) > 0.05)
        spread = F.when(far, F.transform(spread, lambda t, i: F.when(i == samples // 2, mid).otherwise(t))).otherwise(spread)
    ordered = F.array_sort(F.transform(spread, shown))
    apart = F.aggregate(ordered, F.array().cast("array<double>"), lambda acc, t: F.when((F.size(acc) == 0) | (F.abs(t - F.element_at(acc, -1)) > 0.05), F.array_append(acc, t)).otherwise(acc))
    return F.when(start.isNull() | end.isNull() | (e - s <= max(0.8, window * 2)), around).otherwise(apart)


def transcript_counts(segments: DataFrame) -> DataFrame:
    """Segments with and without text by item."""
    return segments.groupBy("media_id").agg(F.count_if(F.col("text") != "").alias("valid"), F.count_if(F.col("text") == "").alias("empty"))
