"""Near-duplicate classes by DartMinHash over weighted word shingles.

A document is the multiset of its five-word shingles (of lower-cased words; fewer
than five words are one shingle); similarity is weighted Jaccard. Darts fall on
an element's region, weight by rank, as a Poisson process that a hash of the
element draws: the region is cut into unit cells, each with its own hashed number
of darts, places and ranks. Darts below the document's weight and below rank
``t / weight`` (about ``t`` of them) are thrown to ``K`` hashed coordinates; the
earliest of each is the signature, so equal coordinates are as likely as the
weighted Jaccard. A coordinate left empty doubles the rank bound.

Bands of ``ROWS`` coordinates are joined. Documents of equal content are one
node. In a bucket, every node is paired with a centre; pairs are verified by
their exact shingle multisets, and verified links give components. ``STARS``
rounds pair what is outside a bucket's largest component with another of its
nodes. Where a bucket still has several components, pairs across them are met by
an index of each node's rarest units, which loses no pair at the similarity, in
blocks, and decided by multiset. So no link of a bucket is lost, and thousands of
copies cost thousands of rows, not millions.

Defined results: texts without a word (null, empty, punctuation) are classes of
their own; rows that repeat a doc_id are one document; a null doc_id counts as
the smallest id and stays null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, join_groups, materialise, release, text_of
from .components import components
from .recompression import NULL_ID
from .words import U, mix, spaced, word_names

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
K = BANDS * ROWS
DARTS = math.ceil(K * math.log(K) + 2 * K)
#: Chance of at most 0, 1, 2, ... darts in a unit cell.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)])
BATCH_BYTES = 1_200_000
FRACTION = 2.0**-53
STARS = 2
BLOCK = 1024
BROADCAST_IDS = 1_000_000  # 8 MB
SPLIT = 4096  # members that meet one copy of their centre's list


def units_of(blobs: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document and 64-bit name of every unit: a shingle and which of its occurrences it is."""
    names, lengths = word_names(blobs)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(blobs)), lengths)
    at = np.arange(len(names))
    start = (ends - lengths)[doc]
    ok = (at + n <= ends[doc]) | (at == start)  # a short document is one shingle
    at, doc = at[ok], doc[ok]
    sh = np.zeros(len(at), U)
    for k in range(n):
        inside = at + k < ends[doc]
        sh = mix(sh * U(0x9E3779B97F4A7C15) + np.where(inside, names[np.minimum(at + k, max(0, len(names) - 1))], U(0)) + U(k + 1)) if len(at) else sh
    order = np.lexsort((sh, doc))
    doc, sh = doc[order], sh[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (sh[1:] != sh[:-1])] if len(doc) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0)) if len(doc) else np.zeros(0, np.int64)
    nth = (np.arange(len(doc)) - first).astype(U)
    return doc, np.where(nth > 0, mix(sh + nth * U(0xD6E8FEB86659FD93)), sh)


def signatures(doc: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """n x K names of the earliest darts; a document without units has zeros."""
    weight = np.bincount(doc, minlength=n)
    bound = np.where(weight > 0, DARTS / np.maximum(weight, 1), 0.0)
    best = np.full(n * K, ~U(0))
    todo = weight > 0
    while todo.any():
        mine = todo[doc]
        d, u = doc[mine], unit[mine]
        cells = np.ceil(bound[d]).astype(np.int64)
        which = np.repeat(np.arange(len(d)), cells)
        block = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
        cell = mix(u[which] + (block.astype(U) + U(1)) * U(0xA0761D6478BD642F))
        darts = np.searchsorted(POISSON, (cell >> U(11)) * FRACTION)
        hit = np.repeat(np.arange(len(which)), darts)
        nth = np.arange(len(hit)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(cell[hit] + (nth.astype(U) + U(1)) * U(0xE7037ED1A0B428DB))
        rank = block[hit] + (dart >> U(11)) * FRACTION
        low = rank <= bound[d[which[hit]]]
        dart, rank, owner = dart[low], rank[low], d[which[hit[low]]]
        other = mix(dart)
        value = ((rank * 2.0**21).astype(U) << U(32)) | (other & U(0xFFFFFFFF))
        np.minimum.at(best, owner * K + ((other >> U(32)) % U(K)).astype(np.int64), value)
        todo &= (best.reshape(n, K) == ~U(0)).any(1)
        bound[todo] *= 2
    out = (best & U(0xFFFFFFFF)).reshape(n, K)
    out[weight == 0] = 0
    return out


def groups_of(texts: list[str]) -> Iterator[tuple[int, int, list[bytes]]]:
    at, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(spaced(t))
        size += len(part[-1]) + 1200  # a short document throws as many darts as a longer one
        if size >= BATCH_BYTES or i == len(texts) - 1:
            yield at, i + 1, part
            at, part, size = i + 1, [], 0


def sketches(rows: DataFrame) -> DataFrame:
    """doc, c1, c2 (128-bit name of the unit multiset), units (their number), bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            ids = f.doc.to_numpy()
            for i, j, blobs in groups_of(list(f.text)):
                doc, unit = units_of(blobs)
                n = j - i
                sig = signatures(doc, unit, n)
                band = np.zeros((n, BANDS), U)
                for r in range(ROWS):
                    band = mix(band * U(0x9E3779B97F4A7C15) + sig.reshape(n, BANDS, ROWS)[:, :, r] + U(r + 1))
                band = mix(band + np.arange(BANDS).astype(U))
                c1, c2 = np.zeros(n, U), np.zeros(n, U)
                np.add.at(c1, doc, mix(unit + U(1)))
                np.add.at(c2, doc, mix(unit * U(0xD6E8FEB86659FD93) + U(7)))
                count = np.bincount(doc, minlength=n)
                for e in np.flatnonzero(count == 0):  # no words: like nothing else
                    c1[e], c2[e] = U(int(ids[i + e]) % 2**64), U(0)
                yield pd.DataFrame({"doc": ids[i:j], "c1": c1.view(np.int64), "c2": c2.view(np.int64), "units": count, "bands": list(band.view(np.int64))})

    return rows.mapInPandas(run, "doc long, c1 long, c2 long, units long, bands array<long>")


def node_table(rows: DataFrame) -> DataFrame:
    """doc, list (the exact unit multiset) of each row of (doc, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            ids = f.doc.to_numpy()
            for i, j, blobs in groups_of(list(f.text)):
                doc, unit = units_of(blobs)
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                yield pd.DataFrame({"doc": ids[i:j], "list": [unit[cut[k] : cut[k + 1]].view(np.int64) for k in range(j - i)]})

    return rows.mapInPandas(run, "doc long, list array<long>")


def verified(pairs: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (u, v), those at or above the similarity. A table."""
    left = table.select(F.col("doc").alias("u"), F.col("list").alias("a"))
    # the many members bring their lists to the few centres, not the other way round; a centre
    # of many members has a copy of its list for each SPLIT of them
    centres = pairs.groupBy("v").agg(F.count("*").alias("n"))
    copies = F.ceil(F.col("n") / SPLIT)
    right = table.join(centres, table.doc == centres.v).select("v", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"), F.col("list").alias("b"))
    dealt = join_groups(pairs, centres, "v", "n").select("u", "v", F.pmod(F.xxhash64("u"), copies).alias("copy"))
    both = dealt.join(left, "u").join(right, ["v", "copy"])
    both = both.select("u", "v", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("both"))
    return materialise(both.where(F.col("both") >= similarity * (F.col("na") + F.col("nb") - F.col("both")) - 1e-9).select("u", "v"))


def prefixes(lists: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Owner and unit of each list's rarest units, so many that two lists at the similarity share one of them.

    Such lists have at least similarity * size units in common, so not all of
    these can be among a list's size - similarity * size last ones.
    """
    size = np.array([len(x) for x in lists])
    unit, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), size)
    _, back, count = np.unique(unit, return_inverse=True, return_counts=True)
    order = np.lexsort((unit, count[back], owner))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    most = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    use = order[(rank < most[owner[order]]) & (count[back[order]] > 1)]
    return owner[use], unit[use]


def block_links(members: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that join the components of a bucket: of all pairs across them, those at the similarity.

    ``members``: key, node, comp, list, n (the bucket's nodes). A bucket is worked through by blocks of
    BLOCK nodes, two blocks in a task. In a task, pairs are met by an index of
    their rarest units, which loses none, and the exact multisets decide; only
    links between what is still apart leave it: fewer than there are nodes.
    """
    m = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    m = m.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "list")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        node, block, lists = f.node.to_numpy(), f.block.to_numpy(), [np.sort(x) for x in f.list]
        _, root = np.unique(f.comp.to_numpy(), return_inverse=True)
        size = np.array([len(x) for x in lists])
        apart, out = f.i.iloc[0] != f.j.iloc[0], []
        owner, unit = prefixes(lists, similarity)
        met: dict[int, list[int]] = {}
        cuts = np.searchsorted(owner, np.arange(len(f) + 1))
        for k in range(len(f)):
            own = unit[cuts[k] : cuts[k + 1]].tolist()
            rest = np.array(sorted({o for u in own for o in met.get(u, ())}), np.int64)
            for u in own:
                met.setdefault(u, []).append(k)
            rest = rest[(root[rest] != root[k]) & (~apart | (block[rest] != block[k]))]
            # sizes alone rule a pair out, too
            for o in rest[np.minimum(size[rest], size[k]) >= similarity * np.maximum(size[rest], size[k])]:
                if root[o] == root[k]:
                    continue
                both = len(np.intersect1d(lists[o], lists[k], assume_unique=True))
                if both >= similarity * (size[o] + size[k] - both) - 1e-9:
                    root[root == root[o]] = root[k]
                    out.append((node[o], node[k]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return m.groupBy("key", "i", "j").applyInPandas(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size, kept: one row per document; the smallest doc_id of a class is kept."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), text_of().alias("text"))
    sk = materialise(sketches(rows))
    nodes = materialise(sk.where("units > 0").groupBy("c1", "c2").agg(F.min("doc").alias("node"), F.any_value("bands").alias("bands")))
    every = nodes.select("node", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialise(join_groups(every, shared, "key", "n").select("key", "node"))
    own = materialise(buckets.select(F.col("node").alias("doc")).distinct())
    few = own.count() <= BROADCAST_IDS
    table = materialise(node_table(rows.join(F.broadcast(own) if few else own, "doc", "left_semi")).groupBy("doc").agg(F.any_value("list").alias("list")))
    links = comp = None
    for r in range(STARS):
        at = buckets.withColumn("comp", F.col("node")) if comp is None else buckets.join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
        # a star's centre is of the bucket's largest component, another one in each round
        sizes = at.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min_by("node", F.struct(F.xxhash64("node", F.lit(r)) if r else F.lit(0), "node")).alias("centre"))
        main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.max_by("centre", F.struct("n", -F.col("comp"))).alias("centre"), F.count("*").alias("comps"), F.sum("n").alias("all")).where("comps > 1")
        pairs = join_groups(at, main, "key", "all").where("comp <> main").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()
        found = verified(materialise(pairs), table, similarity)
        links = found if links is None else links.unionByName(found)
        if r and found.isEmpty():
            break
        comp = components(links)
        release(docs.sparkSession)
    at = buckets.join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    still = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2")
    members = join_groups(at, still.select("key", "n"), "key", "n").join(table.select(F.col("doc").alias("node"), "list"), "node")
    more = materialise(block_links(members, similarity))
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    release(docs.sparkSession)
    content = F.struct("c1", "c2").alias("content")
    copies = sk.where("units > 0").groupBy("c1", "c2").agg(F.count("*").alias("n"))
    label = nodes.select("c1", "c2", "node").join(comp, "node", "left").join(copies, ["c1", "c2"]).select(content, F.coalesce("comp", "node").alias("class"), "n")
    out = join_groups(sk.where("units > 0").select("doc", content), label, "content", "n").select("doc", "class")
    out = materialise(out.unionByName(sk.where("units = 0").select("doc", F.col("doc").alias("class"))))
    size = out.groupBy("class").agg(F.count("*").alias("class_size"))
    named = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return join_groups(out, size, "class", "class_size").select(named("doc").alias("doc_id"), named("class").alias("class_id"), "class_size", (F.col("doc") == F.col("class")).alias("kept"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, whole, that stay: of a class the smallest doc_id."""
    stay = near_duplicates(docs, similarity).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
