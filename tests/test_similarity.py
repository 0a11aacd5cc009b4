import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verbalign.functions import similarity as S

#: By the published definitions: char, token_sort, partial, token_set, coverage, score.
EXPECTED = [
    ("hello world", "hello", [0.6250, 0.6250, 1, 1, 0.4545, 0.7505]),
    ("the quick brown fox", "the quick brown", [0.8824, 0.8824, 1, 1, 0.7895, 0.9178]),
    ("hello beautiful world", "world beautiful hello", [0.6190, 1, 0.6842, 1, 1, 0.8467]),
    ("completely different text", "xyz abc", [0.1250, 0.1875, 0.2857, 0.1875, 0.28, 0.2057]),
    ("hello", "helo", [0.8889, 0.8889, 0.8571, 0.8889, 0.8, 0.8730]),
    ("नमस्ते", "नमस्तै", [0.8333, 0.8333, 0.9091, 0.8333, 1, 0.8667]),
    ("kitten", "sitting", [0.6154, 0.6154, 0.6667, 0.6154, 0.8571, 0.6508]),
    ("", "", [1, 1, 1, 1, 1, 1]),
    ("hello", "", [0, 0, 0, 0, 0, 0]),
]


def test_known_values():
    got = S.base([a for a, _, _ in EXPECTED], [b for _, b, _ in EXPECTED])
    for row, (a, b, want) in zip(got, EXPECTED):
        assert row.tolist() == pytest.approx(want), (a, b)


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def ratio(a, b):
    return 2 * subsequence(a, b) / (len(a) + len(b)) if a or b else 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab c", max_size=90), st.text("ab cd", max_size=90)), min_size=1, max_size=4))
def test_indel_against_table(pairs):
    got = S.indel([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == pytest.approx([ratio(a, b) for a, b in pairs])


@settings(max_examples=60, deadline=None)
@given(st.text("ab c", min_size=1, max_size=9), st.text("ab c", min_size=1, max_size=12))
def test_partial_against_windows(a, b):
    def one(s, t):
        full = [ratio(s, t[i : i + len(s)]) for i in range(len(t) - len(s) + 1)]
        return max([*full, *(ratio(s, t[:m]) for m in range(1, len(s))), *(ratio(s, t[-m:]) for m in range(1, len(s)))])

    s, t = sorted((a, b), key=len)
    want = max(one(s, t), one(t, s)) if len(s) == len(t) else one(s, t)
    assert S.partial([a], [b])[0] == pytest.approx(want)


@settings(max_examples=40, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_properties(a, b):
    a, b = " ".join(a.split()), " ".join(b.split())
    (row,) = S.breakdown([a], [b])
    assert 0 <= row[5] <= 1
    assert S.breakdown([a], [a])[0][5] == 1
    assert S.indel([a], [b])[0] == pytest.approx(S.indel([b], [a])[0])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("ab cd ef gh a".split()), min_size=1, max_size=4), st.lists(st.sampled_from("ab cd ef gx b".split()), min_size=3, max_size=9))
def test_window_search_is_exact(a, b):
    a, b = " ".join(a), " ".join(b)
    best, text = S.base([a], [b])[0][5], None
    first = None
    for w in S.windows_of(a, b):
        x = S.base([a], [w])[0][5]
        if first is None or x > first[0]:
            first = x, w
    if first and first[0] > best:
        best, text = first
    (row,) = S.breakdown([a], [b])
    assert (row[5], row[7]) == (pytest.approx(best), text)


def test_other_profile():
    assert S.base(["abcd"], ["bcde"], "difflib")[0][0] == 0.75


def test_best_of_many_texts_is_the_best_pair():
    import random

    import numpy as np

    r = random.Random(5)
    for _ in range(40):
        a = [" ".join(r.choices("ab cd ef gh a".split(), k=r.randint(1, 6))) for _ in range(4)]
        owner = np.sort([r.randrange(4) for _ in range(12)])
        texts = [" ".join(r.choices("ab cd ef gx a b".split(), k=r.randint(0, 11))) for _ in owner]
        floor = np.array([r.choice([0, 0.5, 0.8]) for _ in a])
        want, least = {}, floor.copy()
        for k, row in enumerate(S.breakdown([a[i] for i in owner], texts)):
            if row[5] > least[owner[k]]:
                least[owner[k]], want[int(owner[k])] = row[5], k
        assert S.best_texts(a, owner, texts, floor) == want


def test_few_runs_are_measured_in_full(monkeypatch):
    """Pair by pair, every candidate had its base scores and the windows that might beat them."""
    import numpy as np

    a, measured = "one two three four five", []
    real = S.partial
    monkeypatch.setattr(S, "partial", lambda x, y: measured.append(len(x)) or real(x, y))
    other = [f"six seven{k} eight nine ten eleven twelve{k} other words here" for k in range(20)]
    assert S.best_texts([a], np.zeros(22, int), [*other[:10], a, *other[10:], a], np.array([0.3])) == {0: 10}
    assert sum(measured) == 0
    assert S.best_texts([a], np.zeros(21, int), [*other, "one two three five"], np.array([0.3])) == {0: 20}
    assert sum(measured) <= 5
