"""The corpus pipeline: language, exact and near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``. Rows are dropped only by a stage's own decision: text
without a letter has no language; of equal texts the largest doc_id stays and of
near copies the smallest; a document that holds a benchmark item goes.

Defined results: null and empty texts have no letter and go; without labels the
language stage keeps every text with a letter; of rows that share id and text one
stays; rows that share only an id are judged each by their text, but count as one
document among near copies; a null doc_id comes before all others there and stays
null; a null source is the source ''; other columns pass through all but the last
stage; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbalign.llm.common import materialise
from verbalign.llm.dartminhash import one_of_each
from verbalign.llm.decontaminate import without_leaks
from verbalign.llm.exact_dedup import first_copies
from verbalign.llm.hyperdim import known_language
from verbalign.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("benchmark_decontamination", decontaminated),
    ("packing", packed),
]

#: Hyperdimensional profiles, signatures and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
