"""A folder of speech and subtitle payloads as a stream: each item is compared when both are there.

The reference surface is batch; this keeps a results table up to date as files
arrive. A micro-batch appends its segments to two tables; items that have both
sides, and changed in the batch, are compared again and their partition replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import compare as C
from ..params import CompareParams

ROW = "media_id string, side string, seq long, id int, start double, end double, ts double, text string"


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, p: CompareParams = CompareParams()) -> StreamingQuery:
    """Follow JSON lines of ROW below ``source``; results are Parquet below ``target``, one folder per item."""

    def step(batch: DataFrame, epoch: int) -> None:
        batch.select(*[c.split()[0] for c in ROW.split(", ")]).write.mode("overwrite").parquet(f"{target}/segments/epoch={epoch}")
        every = spark.read.schema(ROW).parquet(f"{target}/segments")
        touched = batch.select("media_id").distinct()
        own = every.join(touched, "media_id", "left_semi").dropDuplicates(["media_id", "side", "seq"])
        both = own.groupBy("media_id").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select("media_id")
        own = own.join(both, "media_id", "left_semi")
        speech = own.where("side = 'speech'").select("media_id", "seq", "id", "start", "end", "ts", "text")
        shown = own.where("side = 'screen'").select("media_id", "seq", "id", "ts", "text")
        rows = C.compare(speech, shown, p)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("media_id").parquet(f"{target}/results")

    stream = spark.readStream.schema(ROW).json(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
