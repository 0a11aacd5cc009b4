"""Mixture-controlled packing by deficit round-robin over source queues.

Each source's documents form one queue of tokens. A round fills one window: each
source is credited its target share of it, serves the whole tokens of its credit,
and carries the rest as deficit to the next window, whichever task writes that.
With a quantum of one token the round-robin has a closed form: token k of a
source of weight w falls due at time (k + 1/2) / w, and tokens are served in the
order of their due times (then of sources). So the credit at any moment follows
from the weights alone, and no queue is walked in one place: time is cut into
blocks of about ``BLOCK`` tokens, a source's share of a block is the difference
of two roundings, a block's place is the sum of the blocks before, and a task
orders the tokens of its block and deals them to windows. In every full window a
source has its share to within about one token, however many sources there are.

By default weights are the sources' own token counts: every window holds the
corpus's mixture and no queue ends early. With given weights, a source whose
queue ends leaves its share to the others in proportion; sources without a
positive weight follow after all others, mixed by their own counts.

A window's tokens of one source (and block) are one stretch of its queue; where
the stretch crosses documents it is several pieces. Only the last sequence can be
short.

Defined results: null text is empty (one piece: the end id); null source is the
source ''; rows that repeat a doc_id are packed each; a null doc_id stays null;
no rows give no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, id_again
from .tokens import crc32_of, id_type, tokenised, tokenizer_path

WINDOW = 2048
BLOCK = 1 << 20  # tokens that one task orders at once
SPAN = 1 << 32  # tokens of a source whose blocks are listed by one row
CHUNK = 1 << 16  # tokens of a queue that are cut into pieces together


class Clock:
    """Tokens served by a time, of sources with totals T and weights w, and the times that cut them into blocks."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, block: int):
        ends = np.unique(totals / weights)
        self.times = np.r_[0.0, ends]
        self.served = np.array([np.minimum(totals, weights * t).sum() for t in self.times])
        self.blocks = max(1, int(-(-totals.sum() // block)))

    def edge(self, b: np.ndarray) -> np.ndarray:
        """The time at which block ``b`` begins; the last one ends with time."""
        t = np.interp(np.asarray(b, np.float64) / self.blocks * self.served[-1], self.served, self.times)
        return np.where(np.asarray(b) >= self.blocks, np.inf, np.where(np.asarray(b) <= 0, -np.inf, t))

    def count(self, b: np.ndarray, total: int, w: float) -> np.ndarray:
        """Tokens of a source before block ``b``."""
        return np.floor(np.clip(self.edge(b) * w + 0.5, 0, total)).astype(np.int64)

    def block_of(self, k: int, total: int, w: float) -> int:
        """The block of token ``k``."""
        lo, hi = 0, self.blocks  # count(lo) <= k < count(hi)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.count(mid, total, w) <= k else (lo, mid)
        return lo


def shares(clock: Clock, source: str, total: int, w: float, first: int, last: int) -> Iterator[pd.DataFrame]:
    """source, block, lo, hi: the tokens [first, last) of a queue, by block. Never more rows than tokens or blocks."""
    b, end = clock.block_of(first, total, w), clock.block_of(last - 1, total, w)
    if last - first < end - b:  # fewer tokens than blocks
        at = np.arange(first, last)
        of = np.array([clock.block_of(int(k), total, w) for k in at])
        new = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        yield pd.DataFrame({"source": source, "block": of[new], "lo": at[new], "hi": np.r_[at[new][1:], last]})
        return
    while b <= end:
        blocks = np.arange(b, min(end + 1, b + 100_000))
        lo = np.clip(clock.count(blocks, total, w), first, last)
        hi = np.clip(clock.count(blocks + 1, total, w), first, last)
        some = hi > lo
        yield pd.DataFrame({"source": source, "block": blocks[some], "lo": lo[some], "hi": hi[some]})
        b = int(blocks[-1]) + 1


def deal(f: pd.DataFrame, window: int = WINDOW) -> pd.DataFrame:
    """Order a block's tokens by due time and deal them to windows: source, lo, hi (of its queue), pos (in the stream).

    ``f``: source, w, lo, hi, base (tokens of all blocks before), the same base in every row.
    """
    f = f.sort_values("source", kind="stable")
    n = (f.hi - f.lo).to_numpy()
    row = np.repeat(np.arange(len(f)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + f.lo.to_numpy()[row]
    order = np.argsort((k + 0.5) / f.w.to_numpy()[row], kind="stable")  # ties: by source
    base = int(f.base.iloc[0])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    of = (base + rank) // window
    # tokens stand by source and k, and windows ascend along a queue: a stretch is one source in one window
    cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (of[1:] != of[:-1])])
    size = np.diff(np.r_[cut, len(row)])
    by_window = np.lexsort((row[cut], of[cut]))
    pos = np.empty(len(cut), np.int64)
    pos[by_window] = base + np.cumsum(size[by_window]) - size[by_window]
    return pd.DataFrame({"source": f.source.to_numpy()[row[cut]], "lo": k[cut], "hi": k[cut] + size, "pos": pos})


def schedule(totals: DataFrame, weights: dict[str, float] | None = None, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """source, lo, hi, pos: where each stretch of a source's queue stands in the packed stream.

    ``totals``: source, total (tokens), small and already summed.
    """
    weights = {k: float(v) for k, v in (weights or {}).items() if v > 0}
    listed, parts = F.col("source").isin(list(weights)) if weights else F.lit(False), []
    if weights:  # as many rows as the caller gave weights
        got = [(r.source, r.total, weights[r.source]) for r in totals.where(listed).collect()]
        if got:
            clock = Clock(np.array([float(t) for _, t, _ in got]), np.array([w for *_, w in got]), block)
            weight = F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col("source"))
            parts.append((clock, totals.where(listed).select("source", "total", weight.alias("w"))))
    rest = totals.where(~listed)
    every = rest.agg(F.sum("total")).first()[0]
    if every:
        # by their own counts all queues end together: one source stands for the clock
        parts.append((Clock(np.array([float(every)]), np.array([float(every)]), block), rest.select("source", "total", F.col("total").cast("double").alias("w"))))
    out, ahead = None, 0
    for clock, rows in parts:

        def list_shares(batches: Iterator[pd.DataFrame], clock=clock) -> Iterator[pd.DataFrame]:
            for f in batches:
                for source, total, w, first in zip(f.source, f.total, f.w, f["first"]):
                    for part in shares(clock, source, total, w, first, min(first + SPAN, total)):
                        part["w"] = w
                        yield part

        spans = rows.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(SPAN).cast("long"))))
        got = spans.mapInPandas(list_shares, "source string, block long, lo long, hi long, w double").withColumn("block", F.col("block") + ahead)
        out, ahead = got if out is None else out.unionByName(got), ahead + clock.blocks
    if out is None:
        return totals.select("source", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("pos")).limit(0)
    sums = out.groupBy("block").agg(F.sum(F.col("hi") - F.col("lo")).alias("size"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    base = sums.select("block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    # a block's few rows stand for many tokens: blocks are dealt to as many tasks as that asks for
    dealt = out.join(base, "block").repartition(min(20_000, -(-ahead // 4)), "block")
    return dealt.groupBy("block").applyInPandas(lambda f: deal(f, window), "source string, lo long, hi long, pos long")


def chunked(df: DataFrame, mark: str) -> DataFrame:
    """Stretches (source, lo, hi, ...) cut where a chunk of the queue ends: source, chunk, at, and what they are."""
    first, last = F.floor(F.col("lo") / CHUNK), F.floor((F.col("hi") - 1) / CHUNK)
    cut = df.withColumn("chunk", F.explode(F.sequence(first, last)))
    return cut.select("source", "chunk", F.greatest("lo", F.col("chunk") * CHUNK).alias("at"), F.struct(*[c for c in df.columns if c != "source"]).alias(mark))


def pack(docs: DataFrame, weights: dict[str, float] | None = None, tokenizer: str | None = None, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source."""
    path = tokenizer or tokenizer_path()
    tokens = tokenised(docs, path)
    # a row's place in its source's queue: what its task wrote before, and the tasks before
    sums = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    at = F.col("base") + F.col("source_before")
    placed = tokens.select("row_id", "source", "part", "source_before", "n").join(base, ["source", "part"]).select("source", at.alias("lo"), (at + F.col("n")).alias("hi"), "row_id")
    plan = schedule(sums.groupBy("source").agg(F.sum("n").alias("total")), weights, window, block)
    # documents and stretches both part the queue: between two cuts stand the last document and the last stretch
    nothing = lambda other, mark: F.lit(None).cast(other.schema[mark].dataType).alias(mark)
    rows, stretches = chunked(placed, "doc"), chunked(plan, "run")
    cuts = rows.select("source", "chunk", "at", "doc", nothing(stretches, "run")).unionByName(stretches.select("source", "chunk", "at", nothing(rows, "doc"), "run"))
    by = Window.partitionBy("source", "chunk").orderBy("at")
    here = by.rowsBetween(Window.unboundedPreceding, 0)
    cuts = cuts.groupBy("source", "chunk", "at").agg(F.max("doc").alias("doc"), F.max("run").alias("run"))
    cuts = cuts.select("at", F.last("doc", True).over(here).alias("doc"), F.last("run", True).over(here).alias("run"), F.lead("at").over(by).alias("next"), "chunk")
    end = F.least(F.coalesce("next", (F.col("chunk") + 1) * CHUNK), F.col("doc.hi"), F.col("run.hi"))
    pieces = cuts.select(F.col("doc.row_id").alias("row_id"), (F.col("at") - F.col("doc.lo")).alias("start"), (end - F.col("at")).alias("length"), (F.col("run.pos") + F.col("at") - F.col("run.lo")).alias("pos"))
    lists = pieces.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "pos"))).alias("parts"))
    lists = lists.select("row_id", *[F.col(f"parts.{c}").alias(c) for c in ("start", "length", "pos")])
    dtype = id_type(path)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, no_id, n, source, raw, starts, lengths, places in zip(b.id, b.no_id, b.n, b.source, b.ids, b.start, b.length, b.pos):
                ids = np.frombuffer(raw, dtype).astype("<u4")
                # a chunk's end may part what is one piece
                new = np.flatnonzero(np.r_[True, (places[1:] != places[:-1] + lengths[:-1]) | (places[1:] % window == 0)])
                size = np.add.reduceat(lengths, new)
                for start, length, pos in zip(starts[new].tolist(), size.tolist(), places[new].tolist()):
                    out.append((doc, no_id, start, length, crc32_of(ids[start : start + length]), n, pos // window, pos % window, source))
            yield pd.DataFrame(out, columns=["id", "no_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    joined = tokens.join(lists, "row_id").select("id", "no_id", "n", "source", "ids", "start", "length", "pos")
    made = joined.mapInPandas(cut, "id long, no_id boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
    return made.select(id_again(), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
