"""Exact and near copies and repeated passages against brute force, with the awkward cases."""

import hashlib
import random
from collections import Counter

import pytest

from verbalign.llm import components as CC
from verbalign.llm import dartminhash, exact_dedup, recompression
from verbalign.llm.words import word_names, words_of

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, words int"


def docs(spark, texts):
    """texts: text, or (doc_id, text); with columns whose names the operators use themselves."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in rows], DOC)


WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base = [text(r.randint(1, 120)) for _ in range(25)]
    near = []
    for t in base[:8]:
        w = t.split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    passage = text(30)
    shared = [f"{text(9)} {passage} {text(5)}" for _ in range(6)]
    long_ = text(6000)
    odd = ["", None, " \n\t ", "...", "one", "a b c d", "AbC " * 30, "abc " * 30, "same " * 50, "same " * 50, long_, long_, long_ + " end", "É x", "é x", "x y z", base[3], base[3].upper()]
    return base + near + shared + odd


def test_exact(spark, corpus):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = Counter(map(low, corpus))
    last = {low(t): i for i, t in enumerate(corpus)}
    got = exact_dedup.exact_dedup(docs(spark, corpus)).collect()
    assert len(got) == len(corpus)
    for r in got:
        t = low(corpus[r.doc_id])
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (last[t], groups[t], last[t] == r.doc_id, hashlib.sha256(t.encode()).hexdigest())


def test_exact_odd_rows(spark):
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark, [(None, "a"), (None, "A"), (3, "b"), (3, "b")])).collect())
    assert got == [("3", "3", 2, True), ("3", "3", 2, True), ("None", "None", 2, True), ("None", "None", 2, True)]
    assert exact_dedup.exact_dedup(docs(spark, [])).collect() == []


def test_recipes_tell_clashes_apart(spark):
    """With a fingerprint forced to clash, verified identifiers still differ."""
    d = docs(spark, ["alpha", "beta", "alpha"])
    clash = spark.sql("select xxhash64('alpha') as fp, 'alpha' as chunk, 1 as variant union all select xxhash64('beta'), 'beta', 2")
    r = {x.doc_id: x.recipe for x in exact_dedup.recipes(d, clash).collect()}
    assert r[0] == r[2] and len(r[1]) > len(r[0]) and r[1] != r[0]


def removed(corpus, window=20):
    seen, out = set(), {}
    for i, t in enumerate(corpus):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_passages(spark, corpus):
    want = removed(corpus)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.remove_repeats(docs(spark, corpus)).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 500


def test_passages_random(spark):
    r = random.Random(11)
    texts = []
    for _ in range(60):
        t = [r.choice("ab") for _ in range(r.randint(0, 70))]
        texts.append(" ".join(t))
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in recompression.remove_repeats(docs(spark, texts)).collect()}
    assert got == removed(texts)


def test_passages_odd_rows(spark):
    t = " ".join(map(str, range(25)))
    got = sorted((str(x.doc_id), x.n_removed) for x in recompression.remove_repeats(docs(spark, [(1, t), (1, t), (None, t), (5, t)])).collect())
    assert got == [("1", 25), ("1", 25), ("5", 25), ("None", 0)]
    assert recompression.remove_repeats(docs(spark, [])).collect() == []


def test_passages_of_rows_that_share_an_id(spark):
    u, t, other = (" ".join(f"{k}{i}" for i in range(30)) for k in "utx")
    got = recompression.remove_repeats(docs(spark, [(0, u), (5, t), (7, t), (7, f"{u} {other}"), (2**60 + 1, other), (None, "a")])).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed) for r in got) == [(-1, 1, 0), (0, 30, 0), (5, 30, 0), (7, 30, 30), (7, 60, 30), (2**60 + 1, 30, 30)]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [64, 512, 4096])
def test_words_of_a_cancelling_pattern_differ(spark, n):
    a = thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    names, _ = word_names([f"{a} {b} {a}".encode()])
    assert names[0] == names[2] != names[1]
    rest = " ".join(map(str, range(25)))
    texts = [f"{rest[:20]} {a} {rest}", f"{rest[:20]} {b} {rest}", f"{b} {rest}"]
    got = {r.doc_id: r.n_removed for r in recompression.remove_repeats(docs(spark, texts)).collect()}
    assert got == {k: v[1] for k, v in removed(texts).items()}


def test_repeats_that_a_task_settles():
    """Batches of a few words: the same passage is met again and again by one task, in any order of ids."""
    r = random.Random(3)
    passage = " ".join(r.choice(WORDS) for _ in range(28))
    texts = [f"{' '.join(r.choice(WORDS) for _ in range(9))} {passage}" for _ in range(40)]
    order = list(enumerate(texts))
    r.shuffle(order)
    before = recompression.BATCH_BYTES
    try:
        recompression.BATCH_BYTES = 300
        rows = [(i, 1, t) for i, t in order]
        got = {k: [] for k in range(40)}
        import pandas as pd

        f = pd.DataFrame(rows, columns=["doc", "th", "text"])
        f["spans"] = [[{"a": 0, "b": 100}]] * 40
        made = pd.concat(list(_function_of(recompression.windows_of)(iter([f]))))
    finally:
        recompression.BATCH_BYTES = before
    first = made[~made.settled].groupby(["h1", "h2"])[["doc", "a"]].apply(lambda g: min(zip(g.doc, g.a)))
    for h1, h2, settled, doc, a, b in made[["h1", "h2", "settled", "doc", "a", "b"]].itertuples(index=False):
        if settled or (doc, a) > first[h1, h2]:
            got[doc] += range(a, b + 1)
    for i, t in enumerate(texts):
        w = t.split()
        want = [k for k in range(len(w) - 19) if any(w[k : k + 20] == x[m : m + 20] for x in map(str.split, texts[:i]) for m in range(len(x) - 19))]
        assert sorted(got[i]) == want
    assert len(made[~made.settled]) < 420


def _function_of(make):
    """The function that ``make`` hands to mapInPandas."""

    class Catch:
        def mapInPandas(self, f, schema):
            return f

    return make(Catch(), 20)


def near_classes(corpus, similarity=0.8):
    sets = []
    for t in corpus:
        w = words_of(t or "")
        sets.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    top = list(range(len(corpus)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(corpus)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if both and both / (sum(sets[i].values()) + sum(sets[j].values()) - both) >= similarity:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [find(i) for i in range(len(corpus))]


def test_near(spark, corpus):
    got = dartminhash.near_duplicates(docs(spark, corpus)).collect()
    assert len(got) == len(corpus)
    want = near_classes(corpus)
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))
    assert all(r.kept == (r.class_id == r.doc_id) and r.class_size == want.count(r.class_id) for r in got)


def test_near_odd_rows(spark):
    t = " ".join(WORDS)
    got = dartminhash.near_duplicates(docs(spark, [(None, t), (4, t), (4, t), (6, None)])).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == [("4", "None"), ("4", "None"), ("6", "6"), ("None", "None")]
    assert dartminhash.near_duplicates(docs(spark, [])).collect() == []


def test_rarest_units_meet_all_similar_pairs():
    import numpy as np

    r = np.random.default_rng(4)
    lists = []
    for k in range(60):
        if lists and k % 2:
            own = lists[r.integers(len(lists))].copy()
            own[r.integers(0, len(own), r.integers(1, 1 + len(own) // 6))] = r.integers(10**6, 10**7, 1)
            lists.append(np.unique(own))
        else:
            lists.append(np.unique(r.integers(0, 80, r.integers(1, 60))))
    owner, unit = dartminhash.prefixes(lists, 0.8)
    own = [set(unit[owner == k]) for k in range(len(lists))]
    similar = 0
    for i in range(len(lists)):
        for j in range(i):
            both = len(np.intersect1d(lists[i], lists[j]))
            if both >= 0.8 * (len(lists[i]) + len(lists[j]) - both):
                similar += 1
                assert own[i] & own[j]
    assert similar > 10


def test_recall_of_near_copies(spark):
    """Pairs at 0.8 to 0.9 and above, of documents of 200 words: measured against exact similarity."""
    r = random.Random(21)
    texts, near = [], []
    for k in range(120):
        w = [f"v{r.randrange(5000)}" for _ in range(200)]
        x = list(w)
        for at in r.sample(range(5, 195), 1 + k % 4):
            x[at] = "new"
        texts += [" ".join(w), " ".join(x)]
        a, b = ({tuple(t[i : i + 5]) for i in range(196)} for t in (w, x))
        near.append(len(a & b) / len(a | b))
    got = {x.doc_id: x.class_id for x in dartminhash.near_duplicates(docs(spark, texts)).collect()}
    for lo, hi in ((0.8, 0.9), (0.9, 1.0)):
        pairs = [k for k, s in enumerate(near) if lo <= s < hi]
        assert len(pairs) > 20 and sum(got[2 * k] == got[2 * k + 1] for k in pairs) >= 0.97 * len(pairs)
    assert all(got[2 * k] != got[2 * k + 1] for k, s in enumerate(near) if s < 0.8)


def test_signatures_estimate_weighted_similarity():
    r = random.Random(5)
    a = [r.choice(WORDS) for _ in range(400)]
    b = a[:300] + [r.choice(WORDS) for _ in range(100)]
    blobs = [" ".join(x).encode() for x in (a, b)]
    doc, unit = dartminhash.units_of(blobs)
    sa, sb = set(unit[doc == 0]), set(unit[doc == 1])
    sig = dartminhash.signatures(doc, unit, 2)
    assert abs((sig[0] == sig[1]).mean() - len(sa & sb) / len(sa | sb)) < 0.15


@pytest.mark.parametrize("share", [10**6, 40])
def test_components(spark, share):
    r = random.Random(2)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(110)] + [(200, x) for x in range(201, 230)] + [(200, 201)]
    top = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            top[b] = a
    got = {x.node: x.comp for x in CC.components(spark.createDataFrame(edges, "u long, v long"), share).collect()}
    assert got == {x: find(x) for x in top}


def test_word_names_part_at_ascii_space():
    names, counts = word_names([b"a b\tc\x0bd", b"", "x y \x1c".encode(), b"a"])
    assert counts.tolist() == [4, 0, 2, 1] and names[0] == names[-1] and len(set(names.tolist())) == 6


def test_near_duplicates_of_hot_groups(spark, monkeypatch):
    """A text with 1,500 copies and another with 1,300 changed copies, beside texts of their own: classes as they were made."""
    monkeypatch.setattr(dartminhash, "SPLIT", 100)
    words = lambda name: [f"{name}{i}" for i in range(60)]
    rows = [(k, " ".join(words("same"))) for k in range(1500)]
    rows += [(10_000 + k, " ".join([*words("near"), f"end{k}"])) for k in range(1300)]
    rows += [(20_000 + k, " ".join(words(f"own{k}x"))) for k in range(40)]
    rows += [(30_000, None), (30_001, ""), (30_002, "...")]
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in dartminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {}
    for k, _ in rows:
        first, size = (0, 1500) if k < 1500 else (10_000, 1300) if k < 20_000 else (k, 1)
        want[k] = (first, size, k == first)
    assert got == want
