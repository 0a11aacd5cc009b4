"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

Each text (null: empty; A-Z lower-cased) is cut where its own content says so:
a chunk has at least ``CHUNK_MIN`` and at most ``CHUNK_MAX`` characters and ends
after the first of a few letter-and-space endings past the minimum. A chunk's
identifier is its 64-bit fingerprint, *verified* by content: the distinct
(fingerprint, chunk) pairs are gathered once, with map-side combining, and
where two different chunks share a fingerprint each gets its own number.
Documents are then compared by their ordered identifier lists, which are about
a hundredth of the text, so long documents move once and in distinct chunks only.

Defined results: a null text equals an empty one; of equal texts the largest
doc_id stays (a group with only null doc_ids keeps null); rows that repeat a
doc_id as well as its text share its ``kept``; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, materialise, text_of

CHUNK_MIN, CHUNK_MAX = 400, 4000
#: A cut follows the first such ending after CHUNK_MIN characters; without one, CHUNK_MAX holds.
CUT = rf"(?s).{{{CHUNK_MIN},{CHUNK_MAX}}}?[aeinrst.][ \n]|.{{1,{CHUNK_MAX}}}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` is the fast way and gives the same wherever it leaves the
    non-ASCII part of a text alone; elsewhere ``translate`` does it by letter.
    """
    other = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(other) == other, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, norm, chunks (array<string>), fps (array<bigint>)."""
    d = docs.select("doc_id", fold_ascii(text_of()).alias("norm"))
    d = d.withColumn("chunks", F.expr(f"regexp_extract_all(norm, r'{CUT}', 0)"))
    return d.withColumn("fps", F.expr("transform(chunks, c -> xxhash64(c))"))


def shared_fingerprints(docs: DataFrame) -> DataFrame:
    """fp, chunk, variant of chunks that share a fingerprint with a different chunk."""
    c = chunked(docs).select(F.explode("chunks").alias("chunk")).select(F.xxhash64("chunk").alias("fp"), "chunk")
    distinct = c.groupBy("fp", "chunk").agg(F.lit(1).alias("one"))
    clash = distinct.groupBy("fp").count().where("count > 1")
    both = distinct.join(clash, "fp", "left_semi")
    return both.select("fp", "chunk", F.row_number().over(Window.partitionBy("fp").orderBy("chunk")).alias("variant"))


def recipes(docs: DataFrame, clashes: DataFrame | None = None) -> DataFrame:
    """doc_id, text_sha256, recipe: the ordered list of verified chunk identifiers."""
    d = chunked(docs).select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "fps", "chunks")
    if clashes is None:
        return d.select("doc_id", "text_sha256", F.col("fps").alias("recipe"))
    at = d.select("text_sha256", F.posexplode("chunks").alias("pos", "chunk")).withColumn("fp", F.xxhash64("chunk"))
    fix = at.join(clashes.where("variant > 1"), ["fp", "chunk"]).groupBy("text_sha256").agg(F.map_from_entries(F.collect_set(F.struct("pos", "variant"))).alias("fix"))
    # a variant is told by a second entry -variant after its fingerprint's place, behind the list
    tail = F.expr("flatten(transform(array_sort(map_keys(fix)), p -> array(cast(p as bigint), cast(element_at(fix, p) as bigint))))")
    return d.join(fix, "text_sha256", "left").select("doc_id", "text_sha256", F.when(F.col("fix").isNull(), F.col("fps")).otherwise(F.concat(F.col("fps"), F.array(F.lit(None).cast("long")), tail)).alias("recipe"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    clashes = materialise(shared_fingerprints(docs))
    r = recipes(docs, None if clashes.isEmpty() else clashes)
    groups = r.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = join_groups(r, groups, "recipe", "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, that stay: of equal texts the largest doc_id, of rows that share that too any one."""
    stay = exact_dedup(docs).where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.count("*").alias("__n"))
    stay = materialise(stay)
    keyed = docs.withColumn("__norm", F.sha2(fold_ascii(text_of()), 256))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__norm") == F.col("__sha"))
    if stay.where("__n > 1").isEmpty():
        return keyed.join(stay, same, "left_semi").drop("__norm")
    single = keyed.join(stay.where("__n = 1"), same, "left_semi")
    return single.unionByName(keyed.join(stay.where("__n > 1"), same, "left_semi").dropDuplicates(["doc_id", "__norm"])).drop("__norm")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return exact_dedup(documents(spark, sf_dir)).drop("n_chunks")


ORACLE = f"""
with d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, sha256(d.t) as text_sha256
from d join g on d.t = g.t
"""
