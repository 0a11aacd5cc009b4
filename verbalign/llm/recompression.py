"""Removal of repeated passages, found by recompression.

A document's words become symbols, which a few rounds compress: first runs of
one word, then pairs. A pair is merged where a keyed bit of the left symbol's
name is 0 and of the right one's is 1, so that merges never overlap; its name is
a 64-bit digest of the two names. Names and merges depend on names alone, so
equal text gets equal symbols on every executor, but for symbols near its ends.
With each symbol goes the stretch of words that determined it.

Every window of ``WINDOW`` words picks, among the symbols determined by its own
words, one of the highest round (then by name, then the leftmost). Equal windows
pick equal symbols, and neighbouring windows mostly the same one. The picked
symbols, with the words that determined them, are counted over the whole corpus;
a window whose symbol occurs once occurs once. The windows of shared symbols are
then verified: 128-bit digests of their bytes are grouped, and all but the
earliest (smaller doc_id, then earlier start) are repeats. What a task can see to
repeat is settled there, so that a passage in a third of all documents reaches
its group about twice per task. Whole copies are set aside before.

Defined results: null text has no words; documents below ``WINDOW`` words lose
none; rows that repeat a doc_id are one document: a window that starts at the
same word in both is in one place and neither is earlier, one that starts later
in either is a repeat; a null doc_id comes before all others; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, id_again, id_columns, join_groups, materialise, release, text_of
from .words import U, digest, mix, prefix_sums, stretch_names, word_names

WINDOW = 20
ROUNDS = 4
BATCH_BYTES = 3_000_000
SPOKEN = 500_000  # names a task remembers to have sent on
BROADCAST_IDS = 1_000_000  # 16 MB
NULL_ID = -(2**63)
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def batches_of(texts: list[str]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows of about BATCH_BYTES: first, end, their bytes."""
    at, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t.encode("utf-8", "replace"))
        size += len(part[-1])
        if size >= BATCH_BYTES or i == len(texts) - 1:
            yield at, i + 1, part
            at, part, size = i + 1, [], 0


class Level:
    """Symbols of one round: names, spans [x, y), determining words [lo, hi), and document ends."""

    def __init__(self, name, x, y, lo, hi, first, last):
        self.name, self.x, self.y, self.lo, self.hi, self.first, self.last = name, x, y, lo, hi, first, last

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """lo and hi of the previous and of the next symbol; beyond a document's end, outside of it."""
        plo, phi = np.r_[self.lo[:1], self.lo[:-1]], np.r_[self.hi[:1], self.hi[:-1]]
        nlo, nhi = np.r_[self.lo[1:], self.lo[-1:]], np.r_[self.hi[1:], self.hi[-1:]]
        plo, phi = np.where(self.first, self.x - 1, plo), np.where(self.first, self.hi, phi)
        nlo, nhi = np.where(self.last, self.lo, nlo), np.where(self.last, self.y + 1, nhi)
        return plo, phi, nlo, nhi

    def runs(self) -> Level:
        """Runs of one name become one symbol; being a run or not is up to both neighbours."""
        starts = self.first | np.r_[True, self.name[1:] != self.name[:-1]]
        at = np.flatnonzero(starts)
        end = np.r_[at[1:], len(starts)] - 1
        plo, phi, nlo, nhi = self.neighbours()
        n = (end - at + 1).astype(U)
        name = np.where(n > 1, mix(self.name[at] + n * U(BASE2)), self.name[at])
        return Level(name, self.x[at], self.y[end], np.minimum(self.lo[at], plo[at]), np.maximum(self.hi[end], nhi[end]), self.first[at], self.last[end])

    def pairs(self, r: int) -> Level:
        right = mix(self.name + U((r + 1) * BASE % 2**64)) >> U(63) == 1
        merge = ~right & np.r_[right[1:], False] & ~self.last
        plo, phi, nlo, nhi = self.neighbours()
        lo = np.where(right, np.minimum(self.lo, plo), np.minimum(self.lo, nlo))
        hi = np.where(right, np.maximum(self.hi, phi), np.maximum(self.hi, nhi))
        keep = ~np.r_[False, merge[:-1]]
        nxt = lambda a: np.r_[a[1:], a[-1:]]
        name = np.where(merge, mix(self.name * U(BASE) + mix(nxt(self.name) + U(r + 1))), self.name)
        return Level(name[keep], self.x[keep], np.where(merge, nxt(self.y), self.y)[keep], np.where(merge, np.minimum(lo, nxt(lo)), lo)[keep], np.where(merge, np.maximum(hi, nxt(hi)), hi)[keep], self.first[keep], np.where(merge, nxt(self.last), self.last)[keep])


def picked(names: np.ndarray, lengths: np.ndarray, sums: np.ndarray, down: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of window starts with the symbol they picked: first start, last start, symbol's digest.

    Starts count over all documents of the batch, laid end to end.
    """
    n = len(names)
    ends = np.cumsum(lengths)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    full = lengths > 0
    first[(ends - lengths)[full]], last[ends[full] - 1] = True, True
    doc_end = np.repeat(ends, lengths).astype(np.int32)
    doc_start = np.repeat(ends - lengths, lengths).astype(np.int32)
    valid = np.arange(n) + window <= doc_end
    at = np.arange(n, dtype=np.int32)
    levels = [Level(names, at, at + 1, at, at + 1, first, last)]
    levels.append(levels[0].runs())
    for r in range(rounds):
        levels.append(levels[-1].pairs(r))
    symbol, mark = np.full(n, -1), np.zeros(n, U)
    open_ = valid.copy()
    for k in range(len(levels) - 1, -1, -1):
        v = levels[k]
        low = np.maximum(doc_start[v.x], v.hi - window)
        high = np.minimum(v.lo, doc_end[v.x] - window)
        # below the top, only symbols that reach a window still without one
        left = np.r_[0, np.cumsum(open_)]
        ok = np.flatnonzero((high >= low) & (v.hi - v.lo <= window))
        ok = ok[left[high[ok] + 1] > left[low[ok]]]
        if len(ok):
            rank = np.empty(len(ok), np.int32)
            rank[np.lexsort((-v.x[ok], v.name[ok]))] = np.arange(len(ok), dtype=np.int32)
            times = high[ok] - low[ok] + 1
            best = np.full(n, -1, np.int32)
            for step in range(int(times.max())):  # at most a window's length
                more = times > step
                np.maximum.at(best, low[ok[more]] + step, rank[more])
            back = np.empty(len(ok), np.int64)
            back[rank] = ok
            new = np.flatnonzero(open_ & (best >= 0))
            open_[new] = False
            s = back[best[new]]
            symbol[new] = s * len(levels) + k
            mark[new] = mix(digest(sums, down, v.lo[s], v.hi[s]) + (v.x[s] - v.lo[s]).astype(U) * U(BASE2) + U(k))
        if not open_.any():
            break
    starts = np.flatnonzero(valid)
    if not len(starts):
        return starts, starts, np.empty(0, U)
    s = symbol[starts]
    cut = np.r_[True, (s[1:] != s[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc_end[starts[1:]] != doc_end[starts[:-1]])]
    a = np.flatnonzero(cut)
    b = np.r_[a[1:], len(starts)] - 1
    return starts[a], starts[b], mark[starts[a]]


class Spoken:
    """Names a task has sent on, with the earliest place of each; bounded: those met once go first."""

    def __init__(self, cap: int = SPOKEN):
        self.cap, self.table = cap, np.empty((5, 0), np.int64)  # name (sorted), second name, doc, start, times met

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table of each name, and whether it is there."""
        at = np.searchsorted(self.table[0], h1)
        at[at == self.table.shape[1]] = 0
        return at, (self.table[0][at] == h1) & (self.table[1][at] == h2) if self.table.shape[1] else np.zeros(len(h1), bool)

    def add(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> None:
        t = self.table
        if t.shape[1] + len(h1) > self.cap:
            t = t[:, t[4] > 1]
            t = t[:, :0] if t.shape[1] > self.cap // 2 else t
        t = np.concatenate([t, np.stack([h1, h2, doc, start, np.ones(len(h1), np.int64)])], 1)
        t = t[:, np.argsort(t[0], kind="stable")]
        self.table = t[:, np.r_[True, t[0][1:] != t[0][:-1]]] if t.shape[1] else t


def symbols_of(docs: DataFrame, window: int) -> DataFrame:
    """key, settled, doc, th, a, b: each document's picked symbols and the windows that picked them.

    A symbol is settled if the task alone can see that it occurs twice. Of its
    occurrences at most two go to the symbol's group, the others are keyed apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spoken = Spoken()
        for f in batches:
            ids, hashes = f.doc.to_numpy(), f.th.to_numpy()
            for i, j, blobs in batches_of(list(f.text)):
                names, lengths = word_names(blobs)
                if not len(names):
                    continue
                a, b, mark = picked(names, lengths, *prefix_sums(names, BASE), window)
                doc = np.searchsorted(np.cumsum(lengths), a, "right")
                base = (np.cumsum(lengths) - lengths)[doc]
                mark = mark.view(np.int64)
                unique, at, group, count = np.unique(mark, return_index=True, return_inverse=True, return_counts=True)
                zero = np.zeros(len(unique), np.int64)
                where, known = spoken.find(unique, zero)
                twice = known.copy()
                twice[known] = spoken.table[4][where[known]] > 1
                spoken.table[4][where[known]] += 1
                spoken.add(unique[~known], zero[~known], zero[~known], zero[~known])
                settled = (count > 1)[group] | twice[group]
                speaks = np.zeros(len(mark), bool)
                speaks[at[~twice]] = True
                who, start = ids[i:j][doc], a - base
                key = np.where(speaks, mark, mix(mix(who.view(U)) + start.astype(U)).view(np.int64))
                yield pd.DataFrame({"key": key, "settled": settled, "doc": who, "th": hashes[i:j][doc], "a": start.astype(np.int32), "b": (b - base).astype(np.int32)})

    return docs.mapInPandas(run, "key long, settled boolean, doc long, th long, a int, b int")


def windows_of(docs: DataFrame, window: int) -> DataFrame:
    """h1, h2, settled, doc, th, a, b of the windows in each document's ``spans``.

    Not settled: one window, the earliest of its 128-bit name that the task has
    met. Settled: windows a..b that repeat an earlier one the task has met.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spoken = Spoken()
        for f in batches:
            ids, hashes, spans = f.doc.to_numpy(), f.th.to_numpy(), list(f.spans)
            for i, j, blobs in batches_of(list(f.text)):
                first, second, lengths = word_names(blobs, (1, 2))
                starts, docs = [], []
                for d in range(j - i):
                    top = lengths[d] - window + 1
                    if top > 0:
                        mark = np.zeros(top + 1, np.int32)
                        lo = np.array([s["a"] for s in spans[i + d]], np.int64)
                        hi = np.array([s["b"] for s in spans[i + d]], np.int64) + 1
                        np.add.at(mark, np.minimum(lo, top), 1)
                        np.add.at(mark, np.minimum(hi, top), -1)
                        s = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                        starts.append(s)
                        docs.append(np.full(len(s), d))
                if not starts:
                    continue
                start, doc = np.concatenate(starts), np.concatenate(docs)
                at = (np.cumsum(lengths) - lengths)[doc] + start
                # two names of every word, so windows are told apart by 128 bits of their bytes
                h1, h2 = (stretch_names(n, at, window, k).view(np.int64) for k, n in enumerate((first, second)))
                who, th = ids[i:j][doc], hashes[i:j][doc]
                o = np.lexsort((start, who, h2, h1))
                same = np.r_[False, (h1[o][1:] == h1[o][:-1]) & (h2[o][1:] == h2[o][:-1])]
                # rows of one doc_id and start are one place: neither repeats the other
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(o))))
                repeat = np.zeros(len(o), bool)
                repeat[o] = same & ((who[o] != who[o][head]) | (start[o] != start[o][head]))
                one = o[~same]  # the earliest of its name in the batch
                where, known = spoken.find(h1[one], h2[one])
                t, w = spoken.table, where[known]
                t[4][w] += 1
                later = np.zeros(len(one), bool)
                later[known] = (who[one[known]] > t[2][w]) | ((who[one[known]] == t[2][w]) & (start[one[known]] > t[3][w]))
                earlier = known & ~later
                t[2][where[earlier]], t[3][where[earlier]] = who[one[earlier]], start[one[earlier]]
                new = one[~known]
                spoken.add(h1[new], h2[new], who[new], start[new])
                repeat[one[later]] = True
                # another row of the same place follows its first
                twin = np.flatnonzero(same & ~repeat[o])
                follows = o[twin]
                repeat[follows] = repeat[o[head[twin]]]
                one = np.r_[one[~later], follows[~repeat[follows]]]
                yield pd.DataFrame({"h1": h1[one], "h2": h2[one], "settled": False, "doc": who[one], "th": th[one], "a": start[one].astype(np.int32), "b": start[one].astype(np.int32)})
                r = np.flatnonzero(repeat)
                if len(r):
                    cut = np.r_[True, (doc[r][1:] != doc[r][:-1]) | (start[r][1:] != start[r][:-1] + 1)]
                    a = np.flatnonzero(cut)
                    b = np.r_[a[1:], len(r)] - 1
                    own = mix(who[r[a]].view(U) + mix(start[r[a]].astype(U)))
                    yield pd.DataFrame({"h1": own.view(np.int64), "h2": np.int64(0), "settled": True, "doc": who[r[a]], "th": th[r[a]], "a": start[r[a]].astype(np.int32), "b": start[r[b]].astype(np.int32)})

    return docs.mapInPandas(run, "h1 long, h2 long, settled boolean, doc long, th long, a int, b int")


def keyed(docs: DataFrame) -> DataFrame:
    """doc, th (64 bits of the text), id, no_id, text. A row is known by doc and th: rows that agree in both are alike."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), *id_columns(), text_of().alias("text"))
    return rows.withColumn("th", F.xxhash64("text"))


def later_copies(rows: DataFrame) -> DataFrame:
    """doc, th of rows whose whole text a smaller doc_id has. All their windows start earlier. A table."""
    sha = rows.select("doc", "th", F.sha2("text", 256).alias("sha"))
    first = sha.groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("size")).where("first < last")
    return materialise(join_groups(sha, first.select("sha", "first", "size"), "sha", "size").where("doc > first").select("doc", "th").distinct())


def without(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """``rows`` but ``copies``: by broadcast while these are few, by shuffle beyond."""
    few = copies.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(copies) if few else copies, ["doc", "th"], "left_anti")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, th, spans: starts a..b of windows that also start earlier. A table in the shared folder."""
    rows = keyed(docs)
    copies = later_copies(rows)
    rows = without(rows.select("doc", "th", "text"), copies)
    symbols = symbols_of(rows, window)
    shared = symbols.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("settled or n > 1")
    spans = materialise(shared.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    del symbols, shared
    release(docs.sparkSession)
    found = windows_of(rows.join(spans, ["doc", "th"]).select("doc", "th", "text", "spans"), window)
    earliest = F.min(F.when(~F.col("settled"), F.struct("doc", "a"))).over(Window.partitionBy("h1", "h2"))
    found = found.withColumn("earliest", earliest).where("settled or struct(doc, a) > earliest")
    out = materialise(found.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    del found
    release(docs.sparkSession)
    whole = copies.select("doc", "th", F.array(F.struct(F.lit(0).alias("a"), F.lit(2**31 - 1 - window).alias("b"))).alias("spans"))
    return out.unionByName(whole)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: the words that stay, joined by a space."""
    spans = repeated_windows(docs, window)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for text, found in zip(f.text, f.spans):
                words = text.encode("utf-8", "replace").split()
                kept = words
                if found is not None and len(found):
                    mark = np.zeros(len(words) + 1, np.int32)
                    if len(words) >= window:
                        np.add.at(mark, np.minimum([s["a"] for s in found], len(words)), 1)
                        np.add.at(mark, np.minimum([s["b"] + window for s in found], len(words)), -1)
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8")))
            frame = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept"])
            frame["id"], frame["no_id"] = f.id.to_numpy(), f.no_id.to_numpy()
            yield frame

    rows = keyed(docs).join(spans, ["doc", "th"], "left").select("id", "no_id", "text", "spans")
    made = rows.mapInPandas(run, "id long, no_id boolean, n_words long, n_removed long, kept_sha256 string, kept string")
    return made.select(id_again(), "n_words", "n_removed", "kept_sha256", "kept")


def op10_repeated_passages(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
