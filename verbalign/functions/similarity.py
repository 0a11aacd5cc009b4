"""Fuzzy similarity of text pairs, for whole batches at once.

The common subsequence of many pairs is computed together: a pair's pattern is
one bit row per 64 characters, and every character of the texts updates all rows
(the published bit-parallel recurrence). So a batch of pairs costs a few numpy
calls for each text position, whatever their number. From that come the Indel
similarities of the published fuzzy-matching family, and their blend.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

METRICS = "char double, token_sort double, partial double, token_set double, length_coverage double, score double, window double, matched_window_text string"
#: Fixed values of the blend.
W_SORT, W_CHAR, W_PARTIAL, W_SET, W_COVER = 0.30, 0.22, 0.22, 0.16, 0.10
CHUNK = 2_000
U = np.uint64


class Codes:
    """Texts as rows of small codes; 0 is past the end."""

    def __init__(self, texts: list[str]):
        self.length = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.zeros(int(points.max()) + 1 if len(points) else 1, np.int16)
        place[points] = 1
        place = np.where(place > 0, np.cumsum(place > 0), 0)
        self.kinds = int(place.max()) + 1
        self.flat = np.r_[place[points], 0]
        self.start = np.cumsum(self.length) - self.length

    def rows(self, which: np.ndarray, lo: np.ndarray, n: np.ndarray, back: bool = False) -> np.ndarray:
        """Of texts ``which``, n codes from lo on, padded; ``back``: reversed."""
        width = int(n.max()) if len(n) else 0
        at = np.arange(width)
        place = (self.start[which] + lo)[:, None] + (n[:, None] - 1 - at if back else at)
        return np.where(at < n[:, None], self.flat[np.minimum(place, len(self.flat) - 1)], 0)


def common(kinds: int, pattern: np.ndarray, text: np.ndarray, every: bool = False, which: np.ndarray | None = None) -> np.ndarray:
    """Length of the longest common subsequence by row; ``every``: for each prefix of the text as well; ``which``: each text's row of ``pattern``."""
    n, m = pattern.shape
    words = max(1, -(-m // 64))
    masks = np.zeros((words, n, kinds), U)
    at = np.arange(n)
    for i in range(m):
        masks[i // 64, at, pattern[:, i]] |= U(1) << U(i % 64)
    masks[:, :, 0] = 0
    masks = masks.reshape(words, -1)
    place = np.ascontiguousarray(text.T) + (at if which is None else which) * kinds
    v = np.full((words, text.shape[0]), ~U(0))
    out = np.zeros((text.shape[0], text.shape[1] + 1), np.int32) if every else None
    for j in range(text.shape[1]):
        if words == 1:
            u = v[0] & masks[0].take(place[j])
            v[0] = (v[0] + u) | (v[0] - u)
        else:
            carry = np.zeros(text.shape[0], U)
            for k in range(words):
                x = v[k]
                u = x & masks[k].take(place[j])
                s = x + u
                more = s < x
                s2 = s + carry
                carry = (more | (s2 < s)).astype(U)
                v[k] = s2 | (x - u)
        if every:
            out[:, j + 1] = np.bitwise_count(~v).sum(0)
    return out if every else np.bitwise_count(~v).sum(0).astype(np.int64)


def in_chunks(n: int) -> Iterator[slice]:
    for at in range(0, n, CHUNK):
        yield slice(at, min(n, at + CHUNK))


def indel(a: list[str], b: list[str]) -> np.ndarray:
    """2 * common / (len a + len b); 1 for two empty texts."""
    c = Codes([*a, *b])
    n = len(a)
    la, lb, both = c.length[:n], c.length[n:], np.zeros(n, np.int64)
    order = np.argsort(la + lb, kind="stable")  # rows of a chunk are of like length
    zero = np.zeros(n, np.int64)
    for s in in_chunks(n):
        w = order[s]
        both[w] = common(c.kinds, c.rows(w, zero[w], la[w]), c.rows(w + n, zero[w], lb[w]))
    return np.where(la + lb > 0, 2 * both / np.maximum(la + lb, 1), 1.0)


def partial(a: list[str], b: list[str]) -> np.ndarray:
    """The shorter text against every window of its length in the longer, and its shorter prefixes and suffixes."""
    n = len(a)
    c = Codes([*a, *b])
    la, lb = c.length[:n], c.length[n:]
    one = np.arange(n)
    short, long_ = np.where(la <= lb, one, one + n), np.where(la <= lb, one + n, one)
    best = np.zeros(n)

    def windows(short: np.ndarray, long_: np.ndarray, who: np.ndarray) -> None:
        ls, ll = c.length[short], c.length[long_]
        count = ll - ls + 1
        owner = np.repeat(np.arange(len(short)), count)
        lo = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        order = np.argsort(ls[owner], kind="stable")
        for s in in_chunks(len(owner)):
            o = order[s]
            k = owner[o]
            both = common(c.kinds, c.rows(short[k], np.zeros(len(k), np.int64), ls[k]), c.rows(long_[k], lo[o], ls[k]))
            np.maximum.at(best, who[k], both / np.maximum(ls[k], 1))
        order = np.argsort(ls, kind="stable")
        for s in in_chunks(len(short)):
            k = order[s]
            zero = np.zeros(len(k), np.int64)
            for back in (False, True):
                own = np.maximum(ls[k] - 1, 0)
                lo = ll[k] - own if back else zero
                both = common(c.kinds, c.rows(short[k], zero, ls[k], back), c.rows(long_[k], lo, own, back), True)
                m = np.arange(both.shape[1])
                share = np.where(m <= own[:, None], 2 * both / np.maximum(ls[k][:, None] + m, 1), 0)
                np.maximum.at(best, who[k], share.max(1))

    ok = np.flatnonzero((la > 0) & (lb > 0))
    windows(short[ok], long_[ok], ok)
    same = ok[la[ok] == lb[ok]]
    if len(same):
        windows(long_[same], short[same], same)
    return best


def token_set(a: list[list[str]], b: list[list[str]]) -> np.ndarray:
    """Shared words against each side's own words."""
    n = len(a)
    out, left, right, todo = np.zeros(n), [], [], []
    for i, (x, y) in enumerate(zip(a, b)):
        sx, sy = set(x), set(y)
        both = sx & sy
        if both and (sx <= sy or sy <= sx):
            out[i] = 1.0
            continue
        ab, ba, sect = " ".join(sorted(sx - both)), " ".join(sorted(sy - both)), " ".join(sorted(both))
        todo.append((i, len(sect), len(ab), len(ba)))
        left.append(ab)
        right.append(ba)
    if todo:
        i, ls, la, lb = np.array(todo).T
        gap = (ls > 0).astype(int)
        dist = (la + lb) * (1 - indel(left, right))
        va, vb = ls + gap + la, ls + gap + lb
        r = 1 - dist / np.maximum(va + vb, 1)
        ra = np.where(ls > 0, 1 - (gap + la) / np.maximum(ls + va, 1), 0)
        rb = np.where(ls > 0, 1 - (gap + lb) / np.maximum(ls + vb, 1), 0)
        out[i] = np.maximum(r, np.maximum(ra, rb))
    return out


def cheap(a: list[str], b: list[str]) -> tuple[np.ndarray, ...]:
    """char, token_sort, token_set, length_coverage of non-empty texts, and a bound of partial.

    No window's common subsequence is longer than the whole texts'.
    """
    ta, tb = [x.split() for x in a], [x.split() for x in b]
    both = indel([*a, *(" ".join(sorted(t)) for t in ta)], [*b, *(" ".join(sorted(t)) for t in tb)])
    char, sort = both[: len(a)], both[len(a) :]
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    short = np.minimum(la, lb)
    longest = char * (la + lb) / 2
    # without a shared or a repeated word the word sets are the word lists
    sets, rest = sort.copy(), []
    for i, (x, y) in enumerate(zip(ta, tb)):
        sx, sy = set(x), set(y)
        if len(sx) < len(x) or len(sy) < len(y) or not sx.isdisjoint(sy):
            rest.append(i)
    if rest:
        sets[rest] = token_set([ta[i] for i in rest], [tb[i] for i in rest])
    return char, sort, sets, short / np.maximum(la, lb), np.minimum(1, 2 * longest / (short + longest))


def blended(char, sort, part, sets, cover) -> np.ndarray:
    blend = W_SORT * sort + W_CHAR * char + W_PARTIAL * part + W_SET * sets + W_COVER * cover
    inside = part * np.where(cover >= 0.65, 0.88, 0.72)
    relaxed = np.where((part >= 0.80) & (sets >= 0.60) & (cover >= 0.50), np.minimum(0.84, part * 0.96), 0)
    return np.minimum(1, np.maximum(blend, np.maximum(inside, relaxed)))


def base(a: list[str], b: list[str], profile: str = "indel") -> np.ndarray:
    """char, token_sort, partial, token_set, length_coverage, score by row, rounded to 4 digits."""
    n = len(a)
    out = np.zeros((n, 6))
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    same = np.array([x == y for x, y in zip(a, b)], bool)
    out[same] = 1.0
    ok = np.flatnonzero((la > 0) & (lb > 0) & ~same)
    if not len(ok):
        return out
    a, b = [a[i] for i in ok], [b[i] for i in ok]
    if profile == "difflib":
        from difflib import SequenceMatcher

        ratio = lambda pairs: np.array([SequenceMatcher(None, x, y).ratio() for x, y in pairs])
        char, sort = ratio(zip(a, b)), ratio((" ".join(sorted(x.split())), " ".join(sorted(y.split()))) for x, y in zip(a, b))
        part, sets, cover = char, sort, np.minimum(la[ok], lb[ok]) / np.maximum(la[ok], lb[ok])
    else:
        char, sort, sets, cover, _ = cheap(a, b)
        part = partial(a, b)
    rows = np.c_[char, sort, part, sets, cover, blended(char, sort, part, sets, cover)]
    out[ok] = [[round(float(x), 4) for x in row] for row in rows]
    return out


def best_windows(owner: np.ndarray, a: list[str], texts: list[str], floor: np.ndarray, profile: str) -> dict[int, tuple[float, int]]:
    """By owner: the best score above its floor and the first window that has it.

    The costly measure is bounded by the cheap ones. Each owner's most promising
    window is scored first, then all windows that may still reach its score.
    """
    if profile == "difflib":
        scores, todo = base([a[i] for i in owner], texts, profile)[:, 5], np.arange(len(texts))
    else:
        left = [a[i] for i in owner]
        char, sort, sets, cover, most = cheap(left, texts)
        bound = blended(char, sort, most, sets, cover) + 6e-5
        scores = np.full(len(texts), -1.0)

        def score(k: np.ndarray) -> None:
            part = partial([left[i] for i in k], [texts[i] for i in k])
            scores[k] = [round(float(x), 4) for x in blended(char[k], sort[k], part, sets[k], cover[k])]

        order = np.lexsort((-bound, owner))
        first = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        first = first[bound[first] > floor[owner[first]]]
        score(first)
        reach = floor.copy()
        np.maximum.at(reach, owner[first], scores[first])
        rest = np.flatnonzero((bound >= reach[owner]) & (bound > floor[owner]) & (scores < 0))
        score(rest)
    out: dict[int, tuple[float, int]] = {}
    for k in np.flatnonzero(scores > floor[owner]):
        if (i := int(owner[k])) not in out or scores[k] > out[i][0]:
            out[i] = float(scores[k]), int(k)
    return out


def windows_of(a: str, b: str) -> list[str]:
    """Word windows of b of about a's number of words, in order of size and start."""
    words, other = a.split(), b.split()
    n = len(words)
    if not n or len(other) <= n + 1:
        return []
    return [" ".join(other[k : k + size]) for size in range(max(1, int(n * 0.55)), min(len(other), max(n + 4, int(n * 1.45))) + 1) for k in range(len(other) - size + 1)]


class Spans:
    """Runs of words as rows of codes, made from one table of all words.

    Words are numbered in their order, so a run's words are sorted as numbers.
    """

    def __init__(self, lists: list[list[str]]):
        self.count = np.array([len(x) for x in lists], np.int64)
        self.start = np.cumsum(self.count) - self.count
        ids, words = pd.factorize(np.array([w for x in lists for w in x] or [""], object), sort=True)
        self.ids, self.kinds = ids.astype(np.int64), len(words)
        self.codes = Codes([f"{w} " for w in words])
        self.before = np.r_[0, np.cumsum(self.codes.length[self.ids])]  # characters before each word, a space after each one

    def width(self, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Characters of the n words from place lo on."""
        return np.maximum(self.before[lo + n] - self.before[lo] - 1, 0)

    def first(self, owner: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of an owner's runs with the same words, which come first by place: their numbers."""
        number, keep = self.ids.copy(), []
        order = np.lexsort((lo, n))
        cut = np.searchsorted(n[order], np.arange(1, n.max(initial=0) + 2))
        for size in range(1, len(cut)):
            if size > 1:  # runs are numbered by their shorter beginning and their last word
                number = np.unique(number[:-1] * self.kinds + self.ids[size - 1 :][: len(number) - 1], return_inverse=True)[1]
            k = order[cut[size - 1] : cut[size]]
            keep.append(k[np.unique(owner[k] * len(self.ids) + number[lo[k]], return_index=True)[1]])
        return np.sort(np.concatenate(keep)) if keep else order

    def rows(self, lo: np.ndarray, n: np.ndarray, ordered: bool) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the n words from place lo on, ``ordered`` by word if asked, and then whether a word is there twice."""
        row, width = np.repeat(np.arange(len(lo)), n), self.width(lo, n)
        ids = self.ids[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]]
        twice = np.zeros(len(lo), bool)
        if ordered:
            ids = np.sort(row * self.kinds + ids) % self.kinds
            twice[row[1:][(ids[1:] == ids[:-1]) & (row[1:] == row[:-1])]] = True
        size = self.codes.length[ids]
        at = np.arange(size.sum())
        line = np.repeat(row, size)
        out = np.zeros((len(lo), int(width.max(initial=0)) + 1), self.codes.flat.dtype)
        out[line, at - (np.cumsum(width + 1) - width - 1)[line]] = self.codes.flat[at + np.repeat(self.codes.start[ids] - np.cumsum(size) + size, size)]
        out[np.arange(len(lo)), width] = 0  # no space after the last word
        return out[:, :-1], twice


def runs_of(n: np.ndarray, most: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, first word, words of the word windows of ``windows_of`` by number of words; ``whole``: and of each whole text."""
    low, high = np.maximum(1, (n * 0.55).astype(np.int64)), np.minimum(most, np.maximum(n + 4, (n * 1.45).astype(np.int64)))
    sizes = np.where((n > 0) & (most > n + 1), np.maximum(high - low + 1, 0), 0)
    text = np.repeat(np.arange(len(n)), sizes)
    size = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[text]
    places = most[text] - size + 1
    place = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
    text, size = np.repeat(text, places), np.repeat(size, places)
    if whole:
        rest, every = size < most[text], np.flatnonzero(most > 0)
        text, place, size = np.r_[every, text[rest]], np.r_[every * 0, place[rest]], np.r_[most[every], size[rest]]
    return text, place, size


def best_runs(a: list[list[str]], owner: np.ndarray, texts: list[list[str]], floor: np.ndarray, whole: bool) -> dict[int, tuple[float, int, int, int]]:
    """By owner: the best score above its floor of a run of words of its texts, and the first one that has it: text, first word, words.

    The costly measures are bounded by the cheap ones. Each owner's most promising
    run is scored first, then all runs that may still reach its score.
    """
    spans, na = Spans([*a, *texts]), len(a)
    text, place, size = runs_of(spans.count[owner], spans.count[na:], whole)
    me, lo = owner[text], spans.start[na + text] + place
    la, lb = spans.width(spans.start[me], spans.count[me]), spans.width(lo, size)
    # of equal runs the first stays, and lengths alone rule some out
    alike, short = 2 * np.minimum(la, lb) / np.maximum(la + lb, 1), np.minimum(la, lb)
    some = blended(alike, alike, 1.0, 1.0, short / np.maximum(np.maximum(la, lb), 1)) + 6e-5 > floor[me]
    some = np.flatnonzero(some)[spans.first(me[some], lo[some], size[some])]
    text, place, size, me, lo, la, lb = (x[some] for x in (text, place, size, me, lo, la, lb))
    char, sort, twice = np.zeros(len(me)), np.zeros(len(me)), np.zeros(len(me), bool)
    order = np.lexsort((lb, la))  # rows of a chunk are of like length
    for s in in_chunks(len(me)):
        k = order[s]
        for ordered, out in ((False, char), (True, sort)):
            own, which = np.unique(me[k], return_inverse=True)
            left, twice_a = spans.rows(spans.start[own], spans.count[own], ordered)
            right, twice_b = spans.rows(lo[k], size[k], ordered)
            out[k] = 2 * common(spans.codes.kinds, left, right, which=which) / np.maximum(la[k] + lb[k], 1)
            twice[k] |= twice_a[which] | twice_b
    # words that the owner has too, counted up to each place
    whose = np.repeat(np.r_[np.arange(na), owner], spans.count) * spans.kinds + spans.ids[: spans.count.sum()]
    shared = np.r_[0, np.cumsum(np.isin(whose, whose[: spans.count[:na].sum()]))]
    unsure = twice | (shared[lo + size] > shared[lo])
    # without a shared or a repeated word the word sets are the word lists
    sets, short = np.where(unsure, 1.0, sort), np.minimum(la, lb)
    cover, longest = short / np.maximum(np.maximum(la, lb), 1), char * (la + lb) / 2
    most = np.minimum(1, 2 * longest / np.maximum(short + longest, 1))
    bound, scores, least = blended(char, sort, most, sets, cover) + 6e-5, np.full(len(me), -1.0), floor[me]
    words = lambda i: texts[text[i]][place[i] : place[i] + size[i]]
    # a run's score is at least its blend without a part
    reach = floor.astype(float)
    np.maximum.at(reach, me, np.floor(blended(char, sort, 0 * char, np.where(unsure, 0, sets), cover) * 10_000) / 10_000)
    for first in (True, True, False):
        k = np.flatnonzero((scores < 0) & (bound >= reach[me]) & (bound > least))
        if first:
            k = k[np.lexsort((-bound[k], me[k]))]
            k = k[np.diff(me[k], prepend=-1) != 0]
        ask = k[unsure[k]]
        sets[ask] = token_set([a[me[i]] for i in ask], [words(i) for i in ask])
        unsure[ask] = False
        bound[k] = blended(char[k], sort[k], most[k], sets[k], cover[k]) + 6e-5
        k = k[(bound[k] >= reach[me[k]]) & (bound[k] > least[k])]
        part = partial([" ".join(a[me[i]]) for i in k], [" ".join(words(i)) for i in k])
        scores[k] = [round(float(x), 4) for x in blended(char[k], sort[k], part, sets[k], cover[k])]
        np.maximum.at(reach, me[k], scores[k])
    k = np.flatnonzero(scores > least)
    k = k[np.lexsort((place[k], size[k], text[k], -scores[k], me[k]))]
    k = k[np.diff(me[k], prepend=-1) != 0]
    return {int(me[i]): (float(scores[i]), int(text[i]), int(place[i]), int(size[i])) for i in k}


def plain(texts: list[str]) -> bool:
    """Whether words are apart by one space, as in normalised texts."""
    return all(x == " ".join(x.split()) for x in texts)


def in_portions(a: list[list[str]], owner: np.ndarray, texts: list[list[str]], floor: np.ndarray, whole: bool) -> Iterator[tuple[int, float, int, int, int]]:
    """``best_runs`` of some 50,000 runs at a time: owner, score, text, first word, words, each better than the owner's one before.

    ``owner`` ascends. A later text has to beat the best of those before it.
    """
    n, most = np.array([len(a[i]) for i in owner], np.int64), np.array([len(x) for x in texts], np.int64)
    runs = np.cumsum(1 + np.where(most > n + 1, most * (n + 4) * 9 // 10, 0))
    floor = floor.astype(float)
    for which in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(runs // 50_000)) + 1):
        own, local = np.unique(owner[which], return_inverse=True)
        found = best_runs([a[i] for i in own], local, [texts[k] for k in which], floor[own], whole)
        for i, (score, k, lo, size) in found.items():
            floor[own[i]] = score
            yield int(own[i]), score, int(which[k]), lo, size


def best_texts(a: list[str], owner: np.ndarray, texts: list[str], floor: np.ndarray, profile: str = "indel") -> dict[int, int]:
    """By text of ``a``, none of them empty: which of ``texts``, of which it is the owner, has the best score above its floor, the first one on ties.

    Scores are those of ``breakdown``. ``owner`` ascends.
    """
    floor, out = floor.astype(float), {}
    if profile == "indel" and plain(a) and plain(texts):
        # an equal text has all there is to have, so only texts before it may come first
        todo, words = [], [x.split() for x in a]
        for k, i in enumerate(owner.tolist()):
            if floor[i] < 1 and i not in out:
                if texts[k] == a[i]:
                    out[i] = k
                else:
                    todo.append(k)
        for i in out:
            floor[i] = max(floor[i], 0.9999)
        return out | {i: todo[k] for i, _, k, *_ in in_portions(words, owner[todo], [texts[k].split() for k in todo], floor, True)}
    for k, row in enumerate(breakdown([a[i] for i in owner], texts, profile)):
        if row[5] > floor[owner[k]]:
            floor[owner[k]], out[int(owner[k])] = row[5], k
    return out


def breakdown(a: list[str], b: list[str], profile: str = "indel") -> list[tuple]:
    """METRICS of each pair: the base scores, and a better word window of b if there is one."""
    scores = base(a, b, profile)
    out = [[*map(float, row), None, None] for row in scores]
    floor = scores[:, 5].copy()
    look = [i for i in range(len(a)) if out[i][5] < 1]
    if profile == "indel" and plain([a[i] for i in look]):
        left, right = [a[i].split() for i in look], [b[i].split() for i in look]
        for i, score, _, lo, size in in_portions(left, np.arange(len(look)), right, floor[look], False):
            out[look[i]][5:] = score, score, " ".join(right[i][lo : lo + size])
        return [tuple(x) for x in out]
    todo: list[int] = []
    texts: list[str] = []

    def flush() -> None:
        for i, (score, k) in best_windows(np.array(todo), a, texts, floor, profile).items():
            out[i][5] = out[i][6] = score
            out[i][7] = texts[k]
        todo.clear()
        texts.clear()

    for i in look:
        own = windows_of(a[i], b[i])
        todo += [i] * len(own)
        texts += own
        if len(texts) > 100_000:
            flush()
    if todo:
        flush()
    return [tuple(x) for x in out]


def metrics_udf(profile: str = "indel"):
    """Column function of two normalised texts to METRICS.

    Declared as not deterministic: the optimizer then neither repeats the costly
    call for each field that is read nor moves it into an aggregate.
    """

    @F.pandas_udf(METRICS)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = breakdown(list(a.fillna("")), list(b.fillna("")), profile)
        return pd.DataFrame(rows, columns=[m.split()[0] for m in METRICS.split(", ")])

    return run.asNondeterministic()
