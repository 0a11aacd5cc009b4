"""Timed segments made from plain tables, the same in Spark and in SQL.

A document (or a conversation's turn) is cut into captions of ``WORDS`` words.
Times come from character counts, in whole milliseconds. The subtitle side is
the speech side with ten kinds of deviation by (media + seq) % 10.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once

WORDS = 5
BLOCK = 64  # captions
MS = 60  # milliseconds a character


def prefixes(sizes: Column) -> Column:
    """Of each number the sum of those before it. Copies the sums for each number, so it is for short arrays."""
    none = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("before"))
    return F.aggregate(sizes, none, lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.array_append(acc["before"], acc["sum"]).alias("before")))["before"]


def captions(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """media (long), seq, text, ms (start) and len_ms of the captions of (key, text).

    Numbers and times are counted within each row and, with an order, over the rows
    of a key before they are cut, so captions needn't be sorted. Rows that share key
    and order alternate caption by caption; for their keys captions are sorted.
    """
    rows = rows.select(F.col(key).alias("media"), (F.col(order) if order else F.lit(0).cast("long")).alias("part"), "text")
    again = rows.groupBy("media", "part").count().where("count > 1").select("media").distinct()
    if again.isEmpty():
        return captions_in_rows(rows, order is not None)
    both = F.expr("media <=> key")
    again = again.withColumnRenamed("media", "key")
    return captions_in_rows(rows.join(again, both, "left_anti"), order is not None).unionByName(captions_in_turn(rows.join(again, both, "left_semi")))


def words_of(rows: DataFrame) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    return rows.select("media", "part", once(words).alias("w")).where(F.size("w") > 0)


def cut(words: Column, size: int) -> Column:
    """An array's slices of ``size`` items."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(words) / size).cast("int") - 1)), lambda k: F.slice(words, k * size + 1, F.lit(size)))


def captions_in_rows(rows: DataFrame, ordered: bool) -> DataFrame:
    blocks = F.transform(cut(F.col("w"), WORDS * BLOCK), lambda ws: F.transform(cut(ws, WORDS), lambda c: F.array_join(c, " ")))
    c = words_of(rows).select("media", "part", once(blocks).alias("blocks"))
    chars = F.transform("blocks", lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, t: n + F.length(t)))
    c = c.withColumn("chars", once(chars))
    if ordered:
        w = Window.partitionBy("media").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        own = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.size(b)), F.aggregate("chars", F.lit(0).cast("long"), lambda n, x: n + x)
        c = c.withColumn("n", own[0]).withColumn("all", own[1])
        c = c.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("past", F.coalesce(F.sum("all").over(w), F.lit(0)))
    else:
        c = c.withColumn("first", F.lit(0).cast("long")).withColumn("past", F.lit(0).cast("long"))
    c = c.select("media", "first", "past", F.posexplode(F.arrays_zip(F.col("blocks").alias("texts"), prefixes(F.col("chars")).alias("before"))).alias("block", "b"))
    c = c.select("media", (F.col("first") + F.col("block") * BLOCK).alias("first"), (F.col("past") + F.col("b.before")).alias("past"), F.col("b.texts").alias("texts"))
    c = c.select("media", "first", "past", F.posexplode(F.arrays_zip("texts", prefixes(F.transform("texts", lambda t: F.length(t).cast("long"))).alias("before"))).alias("pos", "t"))
    return c.select("media", (F.col("first") + F.col("pos") + 1).alias("seq"), F.col("t.texts").alias("text"), ((F.col("past") + F.col("t.before")) * MS).alias("ms"), (F.length("t.texts") * MS).cast("long").alias("len_ms"))


def captions_in_turn(rows: DataFrame) -> DataFrame:
    texts = F.transform(cut(F.col("w"), WORDS), lambda c: F.array_join(c, " "))
    c = words_of(rows).select("media", "part", F.posexplode(texts).alias("pos", "text"))
    w = Window.partitionBy("media").orderBy("part", "pos")
    c = c.select("media", F.row_number().over(w).cast("long").alias("seq"), "text", F.length("text").alias("n"), "part", "pos")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select("media", "seq", "text", (before * MS).alias("ms"), (F.col("n") * MS).cast("long").alias("len_ms"))


def speech_of(c: DataFrame) -> DataFrame:
    start, end = F.col("ms") / 1000, (F.col("ms") + F.col("len_ms")) / 1000
    return c.select(F.col("media").cast("string").alias("media_id"), "seq", F.col("seq").cast("int").alias("id"), start.alias("start"), end.alias("end"), ((F.col("ms") * 2 + F.col("len_ms")) / 2000).alias("ts"), "text")


def subtitles_of(c: DataFrame) -> DataFrame:
    """Kinds: 0 blank, 1 the text before, 2 noise around, 3 half the words, 4 shouted, 5 no id and later, 6 another id and later."""
    kind = (F.col("media") + F.col("seq")) % 10
    before = F.lag("text").over(Window.partitionBy("media").orderBy("seq"))
    words = F.split("text", " ")
    text = F.when(kind == 0, "").when(kind == 1, F.coalesce(before, "text")).when(kind == 2, F.concat(F.lit("xq zz "), "text", F.lit(" qx"))).when(kind == 3, F.array_join(F.slice(words, F.lit(1), F.ceil(F.size(words) / 2).cast("int")), " ")).when(kind == 4, F.concat(F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))), F.lit("!!"))).otherwise(F.col("text"))
    late = F.when(kind == 5, 800).when(kind == 6, 5000).otherwise(0)
    id_ = F.when(kind == 6, F.col("seq") + 100_000).when(kind != 5, F.col("seq")).cast("int")
    return c.select(F.col("media").cast("string").alias("media_id"), "seq", id_.alias("id"), ((F.col("ms") * 2 + F.col("len_ms") + late * 2) / 2000).alias("ts"), text.alias("text"))


def captions_sql(table: str, key: str, order: str = "0") -> str:
    """The same captions as a DuckDB CTE named c."""
    return rf"""
w as (select {key} as media, cast({order} as bigint) as part, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') as w from {table}),
p as (select media, part, unnest(range(0, cast(ceil(len(w) / {WORDS}.0) as bigint))) as pos, w from w where len(w) > 0),
q as (select media, part, pos, array_to_string(list_slice(w, pos * {WORDS} + 1, pos * {WORDS} + {WORDS}), ' ') as text from p),
c as (select media, row_number() over o as seq, text, cast(coalesce(sum(length(text)) over (partition by media order by part, pos rows between unbounded preceding and 1 preceding), 0) as bigint) * {MS} as ms, length(text) * {MS} as len_ms
  from q window o as (partition by media order by part, pos))
""".strip()


SPEECH_SQL = "speech as (select cast(media as varchar) as media_id, seq, cast(seq as integer) as id, ms / 1000.0 as \"start\", (ms + len_ms) / 1000.0 as \"end\", (ms * 2 + len_ms) / 2000.0 as ts, text from c)"
SUBTITLE_SQL = """
k as (select *, (media + seq) % 10 as kind, lag(text) over (partition by media order by seq) as before from c),
sub as (select cast(media as varchar) as media_id, seq,
  cast(case when kind = 6 then seq + 100000 when kind <> 5 then seq end as integer) as id,
  (ms * 2 + len_ms + 2 * case when kind = 5 then 800 when kind = 6 then 5000 else 0 end) / 2000.0 as ts,
  case when kind = 0 then '' when kind = 1 then coalesce(before, text) when kind = 2 then 'xq zz ' || text || ' qx'
    when kind = 3 then array_to_string(list_slice(string_split(text, ' '), 1, cast(ceil(len(string_split(text, ' ')) / 2.0) as bigint)), ' ')
    when kind = 4 then upper(replace(text, 'ß', 'ss')) || '!!' else text end as text from k)
""".strip()
