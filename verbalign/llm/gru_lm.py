"""LM scoring: a gated recurrent language model in numpy, with class-factored output.

Learning gathers every training word's count over the whole corpus (map-side
counters, one shuffle). Words fall into classes by frequency: the ``HEAD`` most
frequent into ``CLASSES`` classes of about equal mass, the rest of ``LISTED``
words into classes by count, all others into one; there, what was never seen is
one more word, with the mass that words seen once have (Good-Turing). The output
is the class given the state times the word given class and state; outside the
head a word's share of its class is its count's, so any vocabulary fits.

Weights start as the unigram model and are trained by truncated backpropagation
(windows of ``STEPS`` words, state carried across them) on every training
document, in ``PASSES`` rounds. In a round each task trains from the common
weights over its share, and the weights are averaged by words seen, block by
block in Spark.

Scoring lays a bucket's documents into parallel streams and walks them once,
with the state carried from a document's first word to its end, so a score is of
the whole text. Buckets are bounded by size; a bucket gets the counts of its own
distinct words by join, never the whole vocabulary.

Defined results: null text is empty (its end alone); a null doc_id trains as the
empty id and stays null; rows that repeat a doc_id are scored each; without
training tokens every word is the unknown one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Collection, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_again, id_columns, materialise, release, text_of
from .hyperdim import held_out

HEAD, CLASSES, HIDDEN, EMBED = 2048, 40, 24, 16
LISTED, SURE = 60_000, 3  # words whose class is known everywhere: a bounded list
STEPS, STREAMS, PASSES, RATE = 16, 384, 1, 0.15
WINDOW = 8192  # words scored at once, about
BUCKET_CHARS = 16_000_000
END = b""  # the end's name: no word is empty
HELD_MODULUS, HELD_REMAINDER = 7, 2
LN10 = math.log(10)
PARAMETERS = ["embed", "wx", "wh", "b", "wc", "bc", "wo", "bo"]


def words_in(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, and the end."""
    words = text.encode("utf-8", "replace").lower().split()
    words.append(END)
    return words


def names_of(words: Collection[bytes]) -> np.ndarray:
    """64-bit digests, signed: each less 2**63."""
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) ^ np.uint64(1 << 63)).view(np.int64)


class Numbered(dict):
    """Words to numbers in order of their first look-up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Vocabulary:
    """Classes of words. ``listed``: (word, count) of the LISTED most frequent words seen SURE times at least."""

    def __init__(self, listed: list[tuple[bytes, int]], total: int, types: int, once: int):
        self.total, self.types = total, types
        self.counts = np.array([c for _, c in listed], np.float64)
        self.index = {w: i for i, (w, _) in enumerate(listed)}
        heads = min(HEAD, len(listed))
        head = self.counts[:heads]
        share = (np.cumsum(head) - head / 2) / max(1.0, head.sum())
        of = np.unique(np.minimum((share * CLASSES).astype(int), CLASSES - 1), return_inverse=True)[1] if heads else np.empty(0, int)
        self.heads = int(of.max()) + 1 if heads else 0
        self.members = np.searchsorted(of, np.arange(self.heads + 1))  # classes are ranges of the head
        bits = np.log2(self.counts[heads:]).astype(int)
        kinds, tail = np.unique(bits, return_inverse=True) if len(bits) else (np.empty(0, int), bits)
        self.class_of = np.r_[of, self.heads + tail].astype(np.int64)
        self.input_of = np.r_[np.arange(heads), heads + tail].astype(np.int64)
        self.rare = self.heads + len(kinds)  # the class of every other word, and of the unknown one
        self.classes, self.inputs, self.head_size = self.rare + 1, heads + len(kinds) + 1, heads
        mass = np.bincount(self.class_of, self.counts, self.rare) if len(listed) else np.zeros(self.rare)
        self.rare_mass = max(0.0, total - self.counts.sum())
        self.class_mass = np.r_[mass, max(self.rare_mass, 1.0)]
        self.share = np.r_[np.zeros(heads), np.log(self.counts[heads:] / np.maximum(mass[self.class_of[heads:]], 1))]
        self.class_mass = self.class_mass / self.class_mass.sum()
        self.head_counts = head
        # a word is new as often as words were seen once (Good-Turing); of the rare class that is this share
        self.new = min(0.99, (once + 0.5) / (self.rare_mass + 1.0)) if self.rare_mass else 1.0

    def find(self, words: Collection[bytes]) -> np.ndarray:
        """Places in the list; -1 for any other word."""
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))

    def places(self, found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input rows, classes, and outside head classes the natural log shares of the class, of words as ``find`` gives them."""
        rare = np.log(np.where(counts > 0, (1 - self.new) * counts / max(self.rare_mass, 1.0), self.new), where=found < 0, out=np.zeros(len(found)))
        return np.r_[self.input_of, self.inputs - 1][found], np.r_[self.class_of, self.rare][found], np.r_[self.share, 0.0][found] + rare

    def place(self, word: bytes, count: int) -> tuple[int, int, float]:
        """The same of one word."""
        row, kind, share = self.places(self.find([word]), np.array([count], np.float64))
        return int(row[0]), int(kind[0]), float(share[0])

    def start(self, seed: int = 1) -> dict[str, np.ndarray]:
        """Weights that give the unigram model, whatever the state."""
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        return {
            "embed": draw(self.inputs, EMBED), "wx": draw(EMBED, 3 * HIDDEN), "wh": draw(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
            "wc": np.zeros((HIDDEN, self.classes), np.float32), "bc": np.log(self.class_mass + 1e-12).astype(np.float32),
            "wo": np.zeros((self.head_size, HIDDEN), np.float32), "bo": np.log(self.head_counts + 1e-9).astype(np.float32),
        }


def soft(x: np.ndarray, into: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in (-1, 1) as tanh is; its slope is (1 - |it|) squared."""
    np.abs(x, out=into)
    into += np.float32(1)
    return np.divide(x, into, out=into)


def gates_of(w: dict[str, np.ndarray], inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings of T x S words, T x S x E, and what they put into the gates, T x S x 3H with the streams innermost."""
    x = w["embed"].take(inputs, 0)
    gates = np.matmul(w["wx"].T, x.transpose(0, 2, 1))
    gates += w["b"][:, None]
    return x, gates.transpose(0, 2, 1)


def forward(w: dict[str, np.ndarray], gates: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
    """States before each step's word. ``gates``: T x S x 3H of the words' own input; ``fresh``: T x S, a document begins.

    The state at step t comes from the words up to t-1: it predicts word t, then
    takes it in. Gates are (1 + soft) / 2 and candidates soft; these are kept.
    Arrays lie with the streams innermost, so that each gate's part is one stretch.
    """
    T, S = fresh.shape
    H = h.shape[1]
    gates, begins, half = gates.transpose(0, 2, 1), fresh.any(1), np.float32(0.5)
    states, kept = np.empty((T + 1, H, S), h.dtype), T if keep else 1
    a, c, rh = (np.empty((kept, n, S), h.dtype) for n in (2 * H, H, H))
    uzr, uc = np.ascontiguousarray(w["wh"][:, : 2 * H].T), np.ascontiguousarray(w["wh"][:, 2 * H :].T) * half
    zr, new, step, more = (np.empty((n, S), h.dtype) for n in (2 * H, H, H, H))
    states[0] = h.T
    for t in range(T):
        k = t if keep else 0
        h, x = states[t], gates[t]
        if begins[t]:
            h[:, fresh[t]] = 0
        np.matmul(uzr, h, out=zr)
        zr += x[: 2 * H]
        soft(zr, a[k])
        np.multiply(a[k, H:], h, out=rh[k])
        rh[k] += h  # twice the state that the reset gate lets through
        np.matmul(uc, rh[k], out=new)
        new += x[2 * H :]
        soft(new, c[k])
        np.subtract(c[k], h, out=step)
        np.multiply(a[k, :H], step, out=more)
        step += more
        step *= half
        np.add(h, step, out=states[t + 1])
    return states[:T].transpose(0, 2, 1), states[T].T, (a, c, rh)


def backward(w: dict[str, np.ndarray], states: np.ndarray, saved, begin: np.ndarray, dstates: np.ndarray, grads: dict) -> np.ndarray:
    """Gradients of the gates' inputs, T x S x 3H; adds those of ``wh``."""
    T, S, H = states.shape
    (a, c, rh), begins, half = saved, begin.any(1), np.float32(0.5)
    states, dstates = states.transpose(0, 2, 1), np.ascontiguousarray(dstates.transpose(0, 2, 1))
    dx = np.empty((T, 3 * H, S), states.dtype)
    uzr, uc = np.ascontiguousarray(w["wh"][:, : 2 * H]), w["wh"][:, 2 * H :] * half
    slope_a, slope_c, by_z, dh_half, drh, more = (np.empty((n, S), states.dtype) for n in (2 * H, H, H, H, H, H))
    dh, one = np.zeros((H, S), states.dtype), np.float32(1)
    for t in range(T - 1, -1, -1):
        dz, dr, dc, h = dx[t, :H], dx[t, H : 2 * H], dx[t, 2 * H :], states[t]
        for x, slope in ((a[t], slope_a), (c[t], slope_c)):
            np.abs(x, out=slope)
            np.subtract(one, slope, out=slope)
            slope *= slope
        np.multiply(dh, half, out=dh_half)
        np.subtract(c[t], h, out=dz)
        dz *= dh_half
        dz *= slope_a[:H]
        np.multiply(dh_half, a[t, :H], out=by_z)
        by_z += dh_half
        dh -= by_z
        np.multiply(by_z, slope_c, out=dc)
        np.matmul(uc, dc, out=drh)  # half of it, as uc is halved
        np.multiply(drh, h, out=dr)
        dr *= slope_a[H:]
        dh += drh
        drh *= a[t, H:]
        dh += drh
        np.matmul(uzr, dx[t, : 2 * H], out=more)
        dh += more
        dh += dstates[t]
        if begins[t]:
            dh[:, begin[t]] = 0
    back = dx.transpose(0, 2, 1)
    grads["wh"][:, : 2 * H] += np.matmul(states, back[:, :, : 2 * H]).sum(0)
    grads["wh"][:, 2 * H :] += np.matmul(rh, back[:, :, 2 * H :]).sum(0) * half
    return back


HIGHEST = np.float32(60)  # of a logit, far beyond what weights reach: its exponential is finite


def product(a: np.ndarray, b: np.ndarray, rows: int = 384) -> np.ndarray:
    """a.T @ b of many rows, some at a time, which is faster for few columns."""
    cut = len(a) // rows * rows
    parts = np.matmul(a[:cut].reshape(-1, rows, a.shape[1]).transpose(0, 2, 1), b[:cut].reshape(-1, rows, b.shape[1]))
    return parts.sum(0) + a[cut:].T @ b[cut:]


def outputs(w, vocab: Vocabulary, h: np.ndarray, words: np.ndarray, classes: np.ndarray, grads=None):
    """Natural log probabilities of words (tail shares left out); with ``grads``, adds gradients and returns the states'.

    The classes' own softmaxes lie one after the other in one array: a class costs
    its products only. Exponentials stay undivided; states and results are instead.
    """
    n, H = h.shape
    order = np.argsort(classes.astype(np.uint16) if vocab.classes < 65536 else classes, kind="stable")  # a class's words side by side
    h1 = np.empty((n, H + 1), h.dtype)  # with a one for the bias
    h1[:, :H], h1[:, H] = h.take(order, 0), 1
    words, classes, at = words[order], classes[order], np.arange(n)

    x = h1 @ np.concatenate([w["wc"], w["bc"][None]])
    np.minimum(x, HIGHEST, out=x)
    got = x[at, classes]
    e = np.exp(x, out=x)
    total = e @ np.ones(e.shape[1], e.dtype)
    got -= np.log(total)
    dh = None
    if grads is not None:
        e[at, classes] -= total
        total = 1 / total
        g = product(h1 * total[:, None], e)
        grads["wc"] += g[:H]
        grads["bc"] += g[H]
        dh = e @ w["wc"].T
        dh *= total[:, None]

    cuts = np.searchsorted(classes, np.arange(vocab.heads + 1))
    sizes = np.diff(vocab.members)
    sizes = np.where(sizes > 1, sizes, 0)  # of one word the share is 1
    mine = classes[: cuts[-1]]
    width = sizes[mine]
    if width.any():
        ends = np.cumsum(width)
        logits, wo1, total = np.empty(ends[-1], x.dtype), np.concatenate([w["wo"], w["bo"][:, None]], 1), np.ones(len(mine), x.dtype)
        parts, done = [], 0
        for k in np.flatnonzero((np.diff(cuts) > 0) & (sizes > 0)).tolist():
            rows, of = slice(cuts[k], cuts[k + 1]), slice(vocab.members[k], vocab.members[k + 1])
            size = int((rows.stop - rows.start) * sizes[k])
            part = logits[done : done + size].reshape(-1, sizes[k])
            np.matmul(h1[rows], wo1[of].T, out=part)
            parts.append((part, rows, of))
            done += size
        np.minimum(logits, HIGHEST, out=logits)
        some = np.flatnonzero(width)
        pick = (ends - width + words[: len(mine)] - vocab.members[mine])[some]
        got[some] += logits[pick]
        e, ones = np.exp(logits, out=logits), np.ones(int(sizes.max()), x.dtype)
        for part, rows, _ in parts:
            np.matmul(part, ones[: part.shape[1]], out=total[rows])
        got[: len(mine)] -= np.log(total)
        if grads is not None:
            e[pick] -= total[some]
            total = 1 / total
            scaled, g, d = h1[: len(mine)] * total[:, None], np.zeros_like(wo1), np.zeros((len(mine), H), x.dtype)
            for part, rows, of in parts:
                np.matmul(part.T, scaled[rows], out=g[of])
                np.matmul(part, w["wo"][of], out=d[rows])
            grads["wo"] += g[:, :H]
            grads["bo"] += g[:, H]
            d *= total[:, None]
            dh[: len(mine)] += d
    back = np.empty(n, np.int64)
    back[order] = at
    return got.take(back), None if dh is None else dh.take(back, 0)


def streams_of(lengths: np.ndarray, streams: int) -> list[list[int]]:
    """Documents dealt to streams of about equal length, the longest first."""
    import heapq

    heap, deal = [(0, s) for s in range(streams)], [[] for _ in range(streams)]
    for d in np.argsort(-lengths, kind="stable"):
        n, s = heapq.heappop(heap)
        deal[s].append(int(d))
        heapq.heappush(heap, (n + int(lengths[d]), s))
    return [x for x in deal if x]


def laid_out(docs: list[np.ndarray], streams: int) -> tuple[np.ndarray, np.ndarray]:
    """T x S: place of each stream's word in the concatenated documents (-1: past the end), and where documents begin."""
    lengths = np.array([len(d) for d in docs])
    first = np.cumsum(lengths) - lengths
    deal = streams_of(lengths, min(streams, len(docs)))
    T = max(int(lengths[x].sum()) for x in deal)
    at, fresh = np.full((T, len(deal)), -1), np.zeros((T, len(deal)), bool)
    for s, own in enumerate(deal):
        t = 0
        for d in own:
            at[t : t + lengths[d], s] = first[d] + np.arange(lengths[d])
            fresh[t, s] = True
            t += lengths[d]
    return at, fresh


def score_documents(w, vocab: Vocabulary, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], streams: int = STREAMS) -> np.ndarray:
    """log10 probability of each document: (inputs, classes, tail shares) of its words."""
    if not docs:
        return np.empty(0)
    lengths = np.array([len(d[0]) for d in docs])
    words, classes, shares = (np.concatenate([d[k] for d in docs]) for k in range(3))
    at, fresh = laid_out([d[0] for d in docs], max(8, min(streams * 2, int(lengths.sum() // 2000))))
    table = np.ascontiguousarray((w["embed"] @ w["wx"] + w["b"]).T)  # of every input word, what it puts into the gates
    logs, h = np.zeros(len(words), np.float64), np.zeros((at.shape[1], w["wh"].shape[0]), w["wh"].dtype)
    while len(at):
        steps = max(16, WINDOW // at.shape[1])  # few streams take more steps at once
        part = at[:steps]
        gates = np.empty((len(part), len(table), part.shape[1]), table.dtype)
        for ids, into in zip(words[part], gates):
            np.take(table, ids, 1, into, "clip")
        states, h, _ = forward(w, gates.transpose(0, 2, 1), fresh[:steps], h, False)
        on = part >= 0
        places, flat = part[on], states.reshape(-1, states.shape[2])
        logs[places] = outputs(w, vocab, flat if len(places) == len(flat) else flat[on.ravel()], words[places], classes[places])[0]
        live, at, fresh = on[-1], at[steps:], fresh[steps:]
        if live.sum() < 0.8 * len(live):  # streams that have ended leave, many at once
            at, fresh, h = at[:, live], fresh[:, live], h[live]
    logs += shares
    return np.minimum(np.add.reduceat(logs, np.cumsum(lengths) - lengths) / LN10, 0.0)


def gradients(w, vocab: Vocabulary, x, ids, classes, on, begin, states, saved) -> tuple[dict, np.ndarray]:
    """Of the sum of the words' negative log probabilities over a window: by weight, and of the gates' inputs."""
    H = states.shape[2]
    grads = {k: np.zeros_like(w[k]) for k in PARAMETERS if k != "embed"}
    if on.all():
        dstates = outputs(w, vocab, states.reshape(-1, H), ids.ravel(), classes.ravel(), grads)[1].reshape(states.shape)
    else:
        dstates = np.zeros(states.shape, states.dtype)  # past a stream's end all gradients are 0
        dstates[on] = outputs(w, vocab, states[on], ids[on], classes[on], grads)[1]
    dx = backward(w, states, saved, begin, dstates, grads)
    grads["wx"] += np.matmul(x.transpose(0, 2, 1), dx).sum(0)
    grads["b"] += np.matmul(dx.transpose(0, 2, 1), np.ones(dx.shape[1], dx.dtype)).sum(0)
    return grads, dx


def train_documents(w, vocab: Vocabulary, docs: list[tuple[np.ndarray, np.ndarray]], rate: float, moments: dict) -> int:
    """Truncated backpropagation over the documents with Adagrad steps; changes ``w``; number of words."""
    at, fresh = laid_out([d[0] for d in docs], STREAMS)
    words, classes = (np.concatenate([d[k] for d in docs]) for k in range(2))
    h, seen = np.zeros((at.shape[1], HIDDEN), np.float32), 0
    for k in w:
        if k not in moments:
            moments[k] = np.full_like(w[k], 0.1)
    for t0 in range(0, len(at), STEPS):
        live = at[t0] >= 0
        if not live.all():  # streams that have ended leave
            at, fresh, h = at[:, live], fresh[:, live], h[live]
        part, begin = at[t0 : t0 + STEPS], fresh[t0 : t0 + STEPS]
        on, ids = part >= 0, words[part]
        x, gates = gates_of(w, ids)
        states, h, saved = forward(w, gates, begin, h, True)
        grads, dx = gradients(w, vocab, x, ids, classes[part], on, begin, states, saved)
        n = max(1, int(on.sum()))
        seen += n
        scale = np.float32(1 / math.sqrt(n))
        # by word, a column of the embedding at a time
        rows, e = ids.ravel().astype(np.int64), np.matmul(w["wx"], dx.transpose(0, 2, 1)).transpose(1, 0, 2).astype(np.float64, order="C")
        e = np.stack([np.bincount(rows, column, vocab.inputs) for column in e.reshape(len(e), -1)], 1).astype(np.float32)
        for k, g in (*grads.items(), ("embed", e)):
            g *= scale
            if k != "embed":
                np.clip(g, -5, 5, out=g)
            m, step = moments[k], g * g
            m += step
            np.sqrt(m, out=step)
            np.divide(g, step, out=step)
            step *= np.float32(rate)
            w[k] -= step
    return seen


def counted(rows: DataFrame) -> DataFrame:
    """word (name), text of the word, n: counts of all training words. Counters are summed before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter: Counter = Counter()

        def flush() -> pd.DataFrame:
            f = pd.DataFrame({"word": names_of(counter), "token": list(counter), "n": list(counter.values())})
            counter.clear()
            return f

        for b in batches:
            for t in b.text:
                counter.update(words_in(t))
                if len(counter) > 1_000_000:
                    yield flush()
        yield flush()

    return rows.mapInPandas(run, "word long, token binary, n long")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From (token, n): the listed words, and the sums over all words."""
    # the least count of a listed word comes from how many words have each count, so no more than the list is sent
    cut, above = SURE, 0
    for r in counts.where(F.col("n") >= SURE).groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(LISTED).collect():
        above += r.words
        if above > LISTED:
            cut = r.n + 1
            break
    listed = sorted(((bytes(r.token), r.n) for r in counts.where(F.col("n") >= cut).select("token", "n").collect()), key=lambda x: (-x[1], x[0]))
    total, types, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)).first()
    return Vocabulary(listed, total, types, once)


def averaged(trained: DataFrame, shapes: dict[str, tuple]) -> dict[str, np.ndarray]:
    """Weights averaged by words seen: blocks of a weight are summed in Spark, and come back once."""
    summed = trained.select("name", "block", "seen", F.posexplode("part").alias("i", "x")).groupBy("name", "block", "i").agg((F.sum(F.col("x") * F.col("seen")) / F.sum("seen")).alias("x"))
    blocks = summed.groupBy("name", "block").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("name", "block", F.col("v.x").alias("v"))
    got: dict[str, list] = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.name, r.block)):
        got.setdefault(r.name, []).append(np.array(r.v, np.float32))
    return {k: np.concatenate(got[k]).reshape(s) if k in got else np.zeros(s, np.float32) for k, s in shapes.items()} if got else {}


def train(rows: DataFrame, vocab: Vocabulary) -> dict[str, np.ndarray]:
    """Weights after PASSES rounds over every document's text."""
    w = vocab.start()
    shapes = {k: v.shape for k, v in w.items()}
    block = 4096
    for round_ in range(PASSES):

        def run(batches: Iterator[pd.DataFrame], w=w, round_=round_) -> Iterator[pd.DataFrame]:
            own, moments, seen, part, size = {k: v.copy() for k, v in w.items()}, {}, 0, [], 0
            inputs, classes = np.r_[vocab.input_of, vocab.inputs - 1].astype(np.int32), np.r_[vocab.class_of, vocab.rare].astype(np.int32)
            for b in batches:
                for t in b.text:
                    k = vocab.find(words_in(t))  # -1: the rare class, the last of both
                    part.append((inputs[k], classes[k]))
                    size += len(k)
                    if size > 1_500_000:  # so many that a long document leaves no streams idle
                        seen += train_documents(own, vocab, part, RATE / (1 + round_), moments)
                        part, size = [], 0
            if part:
                seen += train_documents(own, vocab, part, RATE / (1 + round_), moments)
            if seen:
                for k, v in own.items():
                    flat = v.ravel()
                    if not len(flat):
                        continue
                    cuts = range(0, len(flat), block)
                    yield pd.DataFrame({"name": k, "block": [c // block for c in cuts], "seen": float(seen), "part": [flat[c : c + block].astype(np.float64) for c in cuts]})

        trained = rows.select("text").mapInPandas(run, "name string, block int, seen double, part array<double>")
        w = averaged(trained, shapes) or w
    return w


def score_corpus(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = docs.sparkSession
    rows = docs.select(*id_columns(), text_of().alias("text"), held_out(HELD_REMAINDER, HELD_MODULUS).alias("held_out"))
    training = rows.where("not held_out")
    counts = materialise(counted(training).groupBy("word", "token").agg(F.sum("n").alias("n")))
    vocab = vocabulary(counts)
    release(spark)
    w = train(training, vocab)
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-chars // BUCKET_CHARS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)))

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, set[bytes]] = {}
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            for k, s in seen.items():
                rest = [x for x in s if x not in vocab.index]
                yield pd.DataFrame({"bucket": k, "word": names_of(rest)})
            seen.clear()

        for b in batches:
            for k, t in zip(b.bucket, b.text):
                own = seen.setdefault(k, set())
                size -= len(own)
                own.update(words_in(t))
                size += len(own)
                if size > 1_500_000:
                    yield from flush()
                    size = 0
        yield from flush()

    # what a bucket needs of the counts: its distinct words that are not in the head
    needed = rows.select("bucket", "text").mapInPandas(distinct, "bucket long, word long").distinct()
    known = needed.join(counts.select("word", "n"), "word").select("bucket", "word", "n")

    def score(key, texts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        frame = texts[["id", "no_id", "held_out"]].copy()
        count = dict(zip(counts.word.tolist(), counts.n.tolist()))
        n, v = vocab.total, vocab.types
        index, tokens = Numbered(), []
        for text in texts.text:
            words = words_in(text)
            tokens.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
        # by distinct word of the bucket: place in the list, count; from these input, class, share, base
        distinct = list(index)
        found = vocab.find(distinct)
        others = np.flatnonzero(found < 0)
        c = np.r_[vocab.counts, 0.0][found]
        c[others] = np.fromiter(map(count.get, names_of([distinct[k] for k in others.tolist()]).tolist(), repeat(0)), np.float64, len(others))
        inputs, classes, shares = (x.astype(t) for x, t in zip(vocab.places(found, c), (np.int32, np.int32, np.float32)))
        known, base = c > 0, np.log10((c + 1) / (n + v + 1))
        frame["n_tokens"] = [len(t) for t in tokens]
        frame["n_known"] = [int(np.count_nonzero(known.take(t))) for t in tokens]
        frame["train_tokens"] = n
        frame["base_score"] = [float(base.take(t).sum()) for t in tokens]
        frame["score"] = score_documents(w, vocab, [(inputs.take(t), classes.take(t), shares.take(t)) for t in tokens])
        return frame

    schema = "id long, no_id boolean, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = rows.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(score, schema)
    return scored.select(id_again(), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_corpus(documents(spark, sf_dir))
