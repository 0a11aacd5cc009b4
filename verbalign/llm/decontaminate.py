"""Benchmark decontamination: training passages query an index of test items.

The test items are few and the training text is everything, so the inverted
index holds the items and every training passage is a query. Postings carry
BM25 impacts divided by the item's score for its own text: a score of 1 is the
whole item and one threshold serves all items. Numbers of items, term counts and
mean lengths are those of all items, however these are parted into indexes.
Block-max WAND retrieves *every* item at or above the threshold. Its two bounds
are tested for many passages at once: where all terms' bounds together stay below
the threshold there is no pivot, and a block of items whose own bounds do is
skipped whole. In the blocks that are left, passage by passage, pivots move over
the postings and only items that can reach the threshold are scored.

Items are indexed by length class; a class's passages have twice the class's
longest item and overlap by half, so an item's text is whole within a passage.
A retrieved pair counts as a leak if the passage also covers the item's question
and its answer: the share of each part's word trigrams that the passage has. An
item's answer is its last sentence (of one sentence: the last third).

Defined results: null or empty texts and items give nothing; repeated items or
documents are reported each; one row per document and item, of its best passage.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_again, id_columns, materialise, text_of
from .words import words_of

THRESHOLD = 0.6
OVERLAP = 0.6
GRAM = 3
K1, B = 1.2, 0.75
BLOCK = 8
CELLS = 4_000_000  # block bounds added up at once
#: Characters of items in one index. More items make more indexes, each queried by everything, with the same scores.
INDEX_CHARS = 16_000_000


def parts_of(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of an item's question and of its answer."""
    cut = [m.end() for m in re.finditer(r"[.?!:]\s+(?=\S)", text)]
    if cut and words_of(text[: cut[-1]]) and words_of(text[cut[-1] :]):
        return words_of(text[: cut[-1]]), words_of(text[cut[-1] :])
    words = words_of(text)
    k = max(1, 2 * len(words) // 3)
    return words[:k], words[k:]


def grams(words: list[bytes], n: int = GRAM) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class Statistics:
    """BM25's view of all items of a length class: their number, mean length, and how many hold a term."""

    def __init__(self, n: int, mean: float, df: dict[bytes, int]):
        self.n, self.mean, self.df = n, mean, df

    @staticmethod
    def of(words: list[list[bytes]]) -> Statistics:
        return Statistics(len(words), sum(map(len, words)) / len(words), Counter(t for w in words for t in set(w)))


class Index:
    """Items of one length class: terms, postings with impacts, and their bounds by term and by block of items."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None, longest: int = 0):
        items = sorted(items, key=lambda x: words_of(x[1]))  # like items share blocks, so block bounds are close
        self.ids = [i for i, _ in items]
        self.parts = [parts_of(t) for _, t in items]
        words = [q + a for q, a in self.parts]
        self.longest = max(longest, *map(len, words))
        s = statistics or Statistics.of(words)
        idf = lambda t: math.log(1 + (s.n - s.df[t] + 0.5) / (s.df[t] + 0.5))
        raw = [{t: idf(t) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / s.mean)) for t, f in Counter(w).items()} for w in words]
        postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for k, impacts in enumerate(raw):
            whole = sum(impacts.values())
            for t, x in impacts.items():
                postings[t].append((k, x / whole))
        self.term = {t: i for i, t in enumerate(postings)}
        self.items = [[k for k, _ in p] for p in postings.values()]
        self.impacts = [[x for _, x in p] for p in postings.values()]
        self.bound = np.array([max(x) for x in self.impacts])
        self.grams = [(grams(q), grams(a)) for q, a in self.parts]
        # block b holds items b * BLOCK and on; a term's bound in it is its largest impact there
        self.blocks = -(-len(items) // BLOCK)
        maxima = [{} for _ in self.items]
        for m, ks, xs in zip(maxima, self.items, self.impacts):
            for k, x in zip(ks, xs):
                m[k // BLOCK] = max(m.get(k // BLOCK, 0.0), x)
        self.block_bound = maxima
        self.count = np.array([len(m) for m in maxima])
        self.start = np.r_[0, np.cumsum(self.count)]
        self.flat_block = np.array([k for m in maxima for k in m], np.int64)
        self.flat_bound = np.array([x for m in maxima for x in m.values()])

    def open_blocks(self, windows: np.ndarray, terms: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The (window, block) pairs that may hold an item at or above the threshold, in order, for many windows at once.

        First the pivot test: where all terms' bounds stay below the threshold no
        item can be a pivot. Then the block-max test, by the bounds within a block.
        """
        low = threshold - 1e-9
        may = np.bincount(windows, self.bound[terms], n) >= low
        windows, terms = windows[may[windows]], terms[may[windows]]
        found = []
        ends = np.r_[np.flatnonzero(np.r_[True, windows[1:] != windows[:-1]]), len(windows)] if len(windows) else np.zeros(1, int)
        size = np.r_[0, np.cumsum(self.count[terms])][ends]
        at = 0
        while at < len(ends) - 1:  # as many windows as CELLS block bounds
            to = max(at + 1, int(np.searchsorted(size, size[at] + CELLS, "right")) - 1)
            w, t = windows[ends[at] : ends[to]], terms[ends[at] : ends[to]]
            times = self.count[t]
            post = np.arange(times.sum()) + np.repeat(self.start[t] - (np.cumsum(times) - times), times)
            key = (np.repeat(w, times) - w[0]) * self.blocks + self.flat_block[post]
            cells = (int(w[-1] - w[0]) + 1) * self.blocks
            if cells <= 4 * CELLS:
                hit = np.flatnonzero(np.bincount(key, self.flat_bound[post], cells) >= low)
            else:
                keys, back = np.unique(key, return_inverse=True)
                hit = keys[np.bincount(back, self.flat_bound[post]) >= low]
            found.append(np.stack([hit // self.blocks + w[0], hit % self.blocks]))
            at = to
        return tuple(np.concatenate(found, 1)) if found else (np.empty(0, int), np.empty(0, int))

    def retrieve(self, terms: list[int], threshold: float, blocks: list[int] | None = None) -> list[tuple[int, float]]:
        """(item, score) of all items at or above the threshold, by block-max WAND.

        ``blocks``: those that pass the block-max test, ascending; every other
        block is skipped whole. Without it the test is made when a block is met.
        """
        low, found = threshold - 1e-9, []
        if blocks is None:
            blocks = range(self.blocks)
        cursor = dict.fromkeys(terms, 0)

        def seek(t: int, to: int) -> int:
            """The term's first item from ``to`` on; beyond all items, one past the last."""
            cursor[t] = p = bisect.bisect_left(self.items[t], to, cursor[t])
            return self.items[t][p] if p < len(self.items[t]) else len(self.ids)

        for block in blocks:
            bound = {t: x for t in terms if (x := self.block_bound[t].get(block))}
            if sum(bound.values()) < low:
                continue
            first, end = block * BLOCK, min((block + 1) * BLOCK, len(self.ids))
            at = {t: seek(t, first) for t in bound}
            while True:
                live = sorted((t for t in bound if at[t] < end), key=at.__getitem__)
                total, pivot = 0.0, -1
                for i, t in enumerate(live):
                    total += bound[t]
                    if total >= low:
                        pivot = i
                        break
                if pivot < 0:
                    break
                item = at[live[pivot]]
                if at[live[0]] == item:
                    while pivot + 1 < len(live) and at[live[pivot + 1]] == item:
                        pivot += 1
                    score = sum(self.impacts[t][cursor[t]] for t in live[: pivot + 1])
                    if score >= low:
                        found.append((item, score))
                    to = item + 1
                else:
                    to = item
                for t in live[: pivot + 1]:
                    if at[t] < to:
                        at[t] = seek(t, to)
        return found


def length_class(n: int) -> int:
    return max(6, (n - 1).bit_length())


def build(items: list[tuple[int, str]], statistics: dict[int, tuple[Statistics, int]] | None = None) -> list[Index]:
    """An index for each length class (powers of two of words); ``statistics``: of all items by class, with the longest."""
    classes: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for i, t in items:
        if n := len(words_of(t)):
            classes[length_class(n)].append((i, t))
    return [Index(c, *(statistics[k] if statistics else ())) for k, c in sorted(classes.items())]


def search(index: Index, docs: list[list[bytes]], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Iterator[tuple]:
    """(doc, place of the item, score, question overlap, answer overlap, first word) of verified leaks."""
    step = index.longest
    get, terms, window, owner, base = index.term.get, [], [], [], 0
    for d, words in enumerate(docs):
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(ids >= 0)
        n = max(1, -(-len(words) // step) - 1)  # windows of 2 * step words, every step words
        at = known // step
        for shift in (0, 1):
            w = at - shift
            ok = (w >= 0) & (w < n)
            terms.append(ids[known[ok]])
            window.append(base + w[ok])
        owner.append(np.full(n, d))
        base += n
    if not docs:
        return
    owner, width = np.concatenate(owner), len(index.term)
    pairs = np.unique(np.concatenate(window) * width + np.concatenate(terms))
    windows, terms = pairs // width, pairs % width
    first = np.searchsorted(owner, np.arange(len(docs)))
    ends = np.searchsorted(windows, np.arange(base + 1))
    opened, blocks = index.open_blocks(windows, terms, base, threshold)
    cuts = np.flatnonzero(np.r_[True, opened[1:] != opened[:-1]]) if len(opened) else np.empty(0, int)
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(opened)]):
        w = opened[lo]
        hits = index.retrieve(terms[ends[w] : ends[w + 1]].tolist(), threshold, blocks[lo:hi].tolist())
        if hits:
            d = owner[w]
            start = (w - first[d]) * step
            passage = docs[d][start : start + 2 * step]
            has = grams(passage)
            short = {n: grams(passage, n) for n in range(1, GRAM)}
            for k, score in hits:
                shares = [len([g for g in part if g in (short[len(g)] if len(g) < GRAM else has)]) / max(1, len(part)) if part else 1.0 for part in index.grams[k]]
                if min(shares) >= overlap:
                    yield int(d), k, float(score), *shares, int(start)


Part = tuple[list[tuple[int, str]], dict[int, tuple[Statistics, int]]]


def item_parts(benchmark: DataFrame, index_chars: int) -> Iterator[Part]:
    """The test items in parts of about ``index_chars`` characters, each with the statistics of *all* items for its terms."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-chars // index_chars))
    if parts == 1:
        yield [(r.item_id, r.text) for r in items.collect()], {}
        return

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for text in f.text:
                words = words_of(text)
                if words:
                    k = length_class(len(words))
                    out.append((k, None, len(words)))
                    out += [(k, t, 0) for t in set(words)]
            yield pd.DataFrame(out, columns=["class", "term", "words"])

    made = lambda rows: rows.select("text").mapInPandas(terms, "class int, term binary, words long")
    counts = materialise(made(items).groupBy("class", "term").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.max("words").alias("longest")))
    classes = {r["class"]: r for r in counts.where("term is null").collect()}  # a row for each power of two
    for p in range(parts):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p)
        wanted = made(own).where("term is not null").select("class", "term").distinct()
        df: dict[int, dict[bytes, int]] = defaultdict(dict)
        for r in counts.join(wanted, ["class", "term"]).select("class", "term", "n").collect():  # the part's own terms
            df[r["class"]][bytes(r.term)] = r.n
        yield [(r.item_id, r.text) for r in own.collect()], {k: (Statistics(c.n, c.words / c.n, df[k]), c.longest) for k, c in classes.items()}


def leaks_in(indexes: list[Index], texts: list[str], threshold: float, overlap: float) -> dict[tuple[int, int], list]:
    """By row and place of the item: the best passage's item, score, overlaps and first word."""
    best: dict[tuple[int, int], list] = {}
    for at in range(0, len(texts), 1000):
        words = [words_of(t) for t in texts[at : at + 1000]]
        for k, index in enumerate(indexes):
            for d, item, *rest in search(index, words, threshold, overlap):
                key = at + d, k, item
                if key not in best or rest[0] > best[key][1]:
                    best[key] = [index.ids[item], *rest]
    return best


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_chars: int = INDEX_CHARS) -> DataFrame:
    """One row per document and leaked item."""
    rows, out = docs.select(*id_columns(), text_of().alias("text")), None
    names = ["item_id", "score", "question_overlap", "answer_overlap", "first_word"]
    for items, statistics in item_parts(benchmark, index_chars):

        def run(batches: Iterator[pd.DataFrame], items=items, statistics=statistics) -> Iterator[pd.DataFrame]:
            indexes = build(items, statistics)
            for b in batches:
                best = leaks_in(indexes, list(b.text), threshold, overlap)
                # ids stay out of a column with nulls, which would make them doubles
                out = [(item or 0, item is None, *rest) for item, *rest in best.values()]
                found = pd.DataFrame(out, columns=["item_id", "no_item", *names[1:]])
                at = [d for d, *_ in best]
                found["id"], found["no_id"] = b.id.to_numpy()[at], b.no_id.to_numpy()[at]
                yield found

        found = rows.mapInPandas(run, "id long, no_id boolean, item_id long, no_item boolean, score double, question_overlap double, answer_overlap double, first_word long")
        found = found.select(id_again(), F.when(~F.col("no_item"), F.col("item_id")).alias("item_id"), *names[1:])
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_chars: int = INDEX_CHARS) -> DataFrame:
    """The rows of ``docs``, whole, that hold no test item."""
    for items, statistics in item_parts(benchmark, index_chars):

        def keep(batches, items=items, statistics=statistics):
            import pyarrow as pa

            indexes = build(items, statistics)
            for b in batches:
                leaky = {d for d, *_ in leaks_in(indexes, [t or "" for t in b.column("text").to_pylist()], threshold, overlap)}
                yield b.filter(pa.array([i not in leaky for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
