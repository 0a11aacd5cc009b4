"""Shared plumbing of the training-data operators.

Tables between jobs go to the folder that the session names in
``spark.checkpoint.dir``; every executor sees it, so a lost executor costs a
re-read and never a lost result.
"""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"  # one machine: every task sees it
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage."""
    path = f"{shared_dir(df.sparkSession)}/table"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the cleaner drop shuffle files of jobs whose results are already in tables."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def id_columns() -> list[Column]:
    """``doc_id`` for the way through pandas, whose integers know no null: a number and a flag."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id")]


def id_again(name: str = "doc_id") -> Column:
    return F.when(~F.col("no_id"), F.col("id")).alias(name)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


HOT_GROUPS = 50_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row for each key, ``size``: its rows), however large a group is.

    A group of over one ``HOT_GROUPS``-th of all rows is hot, so there are fewer
    than HOT_GROUPS such groups, at most: these are sent to the rows; all other
    rows meet their groups by shuffle. A hot row goes through that under a key of
    its own.
    """
    share = max(1000, rows.count() // HOT_GROUPS)
    others = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > share).select(F.col(key).alias("__hot"), F.struct(*others).alias("__mine"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").drop("__hot")
    spread = F.when(F.col("__mine").isNotNull(), F.monotonically_increasing_id())
    met = met.withColumn("__spread", F.coalesce(spread, F.lit(-1).cast("long")))
    # of -1 for all, but no literal: both columns deal the rows
    cold = groups.where(F.col(size) <= share).select(F.col(key).alias("__key"), F.least(F.col(size), F.lit(-1)).alias("__none"), F.struct(*others).alias("__theirs"))
    both = met.join(cold, (F.col(key) == F.col("__key")) & (F.col("__spread") == F.col("__none")), "left")
    found = F.coalesce("__mine", "__theirs")
    return both.where(found.isNotNull()).select(*rows.columns, *[found[c].alias(c) for c in others])


def running_offsets(df: DataFrame, group: list[str], block: str, order: list, size: str, out: str) -> DataFrame:
    """Exclusive running sum of ``size`` over ``(block, order)`` within ``group``.

    Blocks are summed first and only the block sums are ordered across blocks;
    rows are ordered within their own (group, block), so no task sees a whole
    group however large it is. ``block`` is a column of non-null numbers.
    """
    from pyspark.sql import Window as W

    keys = [*group, block]
    sums = df.groupBy(*keys).agg(F.sum(size).alias("__sum"))
    before = W.partitionBy(*group).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ran = df.withColumn("__run", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return ran.join(sums, keys).withColumn(out, F.col("__base") + F.col("__run")).drop("__base", "__run")
