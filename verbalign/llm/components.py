"""Connected components of an edge table: local contraction, then alternating stars.

A task first contracts its own share of the edges, at most ``SHARE`` of them, by
union-find: what leaves it is one edge from each node to its smallest known
partner. One share is the whole answer; more shares go on by alternating large
and small stars, whose every step is a group-by with map-side combining and a
join. No component is ever in one place beyond a share, and hubs are split by
adaptive execution. A round's edges are a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SHARE = 500_000


def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) to edges (node, smallest node of its component in this share)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for u, v in zip(b.u.tolist(), b.v.tolist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    nodes = np.fromiter(parent, np.int64, len(parent))
    tops = np.fromiter(map(find, list(parent)), np.int64, len(parent))
    yield pd.DataFrame({"u": nodes[nodes != tops], "v": tops[nodes != tops]})


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def components(edges: DataFrame, share: int = SHARE) -> DataFrame:
    """node, comp (its component's smallest node) of every node of an edge (u, v), both non-null."""
    e = edges.where("u <> v").select("u", "v")
    shares = max(1, -(-e.count() // share))
    e = materialise((e.coalesce(1) if shares == 1 else e.repartition(shares)).mapInPandas(contract, "u long, v long"))
    before = None
    while shares > 1 and (now := _sum(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = materialise(small.where("u <> v").distinct())
    stars = e if shares == 1 else e.groupBy("u").agg(F.min("v").alias("v"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
