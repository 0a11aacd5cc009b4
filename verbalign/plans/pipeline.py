"""The end-to-end plans: speech, screen, comparison, each over all items at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import image
from ..functions.languages import MULTI
from ..operators import compare as C
from ..operators import ocr_select, segments
from ..params import CompareParams
from ..sources import adapters


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the session's shared checkpoint folder."""
    spark = rows.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    path = f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def speech(media: DataFrame, make: Callable) -> DataFrame:
    """media_id, seq, id, start, end, midpoint, text, confidence. An item's failure is an error of the whole plan."""
    raw = adapters.transcribe(media, make)
    failed = F.raise_error(F.concat("media_id", F.lit(": "), "error")).cast("string")
    return segments.filter_noise(segments.build(raw.withColumn("text", F.when(F.col("error").isNotNull(), failed).otherwise(F.col("text")))))


def attempt(media: DataFrame, make: Callable) -> tuple[DataFrame, DataFrame]:
    """Speech of the items that can be recognised, and media_id, error of the others. The engine runs once."""
    raw = kept(adapters.transcribe(media, make))
    return segments.filter_noise(segments.build(raw.where("error is null"))), raw.where("error is not null").select("media_id", "error")


def screen(speech_rows: DataFrame, make: Callable, effort: str = "balanced", language: str = MULTI, window: float = 0.35, samples: int = 3, source: Callable | None = None, ratio: float = 0.15, dynamic: bool = True) -> DataFrame:
    """media_id, id, timestamp, subtitle_text, confidence, status, crop_region, ocr_variant for every speech segment.

    ``source`` makes a source of frames; without one the reader fetches its own
    and has no crop_region. Frames on which nothing can be read are looked at
    again in a wider band.
    """
    times = segments.sample_times(F.col("start"), F.col("end"), F.col("midpoint"), window, samples)
    frames = speech_rows.select("media_id", "id", F.col("midpoint").alias("mid"), F.col("text").alias("audio_text"), F.posexplode(times).alias("frame", "ts"))
    keys, grid = ["media_id", "id", "frame"], ocr_select.tries(effort)

    def read(looked: DataFrame, ratio: float) -> DataFrame:
        seen = kept(adapters.read_screen(looked, make, grid, source, ratio, dynamic))  # the engines run once
        words = seen.select(*keys, F.explode("words").alias("w")).select(*keys, "w.*")
        best = ocr_select.best_variant(ocr_select.filter_words(words, *keys, "variant", "psm", "ordinal"), *keys, language=language)
        return seen.drop("words").join(best, keys, "left")

    got = read(frames, ratio)
    wider = image.retry_ratio(ratio)
    if source and wider:
        got = kept(got)
        second = read(got.where("readable and text is null").select(*keys, "ts"), wider).where("text is not null")
        parts = ("text", "confidence", "ocr_variant", "crop_region")
        again = second.select(*keys, F.struct(*parts).alias("again"))
        new = {c: F.when(F.col("again").isNotNull(), F.col(f"again.{c}")).otherwise(F.col(c)) for c in parts}
        got = got.join(again, keys, "left").withColumns(new).drop("again")
    f = frames.join(got.drop("ts"), keys, "left")
    return ocr_select.best_frame(f.withColumn("readable", F.coalesce("readable", F.lit(False))), language)


def run(media: DataFrame, recogniser: Callable, reader: Callable, p: CompareParams = CompareParams(), **look) -> tuple[DataFrame, DataFrame]:
    """Result rows and roll-up of media paths. The engines run once: their output is kept as tables."""
    said = kept(speech(media, recogniser))
    return against_screen(media, said, kept(screen(said, reader, **look)), p)


def against_screen(media: DataFrame, said: DataFrame, shown: DataFrame, p: CompareParams) -> tuple[DataFrame, DataFrame]:
    a = said.select("media_id", "seq", "id", "start", "end", F.col("midpoint").alias("ts"), "text")
    s = shown.select("media_id", F.col("id").cast("long").alias("seq"), "id", F.col("timestamp").alias("ts"), F.col("subtitle_text").alias("text"))
    rows = C.compare(a, s, p)
    return rows, C.summarize(rows, media.select(F.col("path").alias("media_id")))
