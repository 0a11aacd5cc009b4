import pandas as pd
import pytest
from pyspark.sql import functions as F

from verbalign.operators import align as A
from verbalign.operators import compare as C
from verbalign.operators import review
from verbalign.params import CompareParams


def frames(spark, speech, subtitles, media="m"):
    """speech: (id, start, end, text); subtitles: (id, ts, text)."""
    a = spark.createDataFrame([(media, k, i, s, e, (s + e) / 2, t) for k, (i, s, e, t) in enumerate(speech)], A.SPEECH)
    s = spark.createDataFrame([(media, k, i, ts, t) for k, (i, ts, t) in enumerate(subtitles)], A.SUBTITLE)
    return a, s


def pairs(spark, speech, subtitles, tolerance=1.5):
    a, s = frames(spark, [(i, t, t, "x") for i, t in speech], [(i, t, "x") for i, t in subtitles])
    return [(r.a_seq, r.s_seq) for r in A.align(a, s, tolerance).orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("speech", "subtitles", "want"),
    [
        ([(7, 1.0), (2, 1.2)], [(2, 1.1)], [(0, 0), (1, None)]),  # an earlier segment takes it
        ([(2, 1.2), (7, 1.0)], [(2, 1.1)], [(1, None), (0, 0)]),
        ([(1, 1.0)], [(1, 1.0), (1, 9.0)], [(0, 1), (None, 0)]),  # the last of an id
        ([(1, 1.0)], [(1, 500.0)], [(0, 0)]),
        ([(None, 1.0)], [(None, 2.5)], [(0, 0)]),
        ([(None, 2.0)], [(None, 1.0), (None, 3.0)], [(0, 0), (None, 1)]),
        ([(1, 1.0)], [(2, 50.0)], [(0, None), (None, 0)]),
        ([(2, 5.0), (1, 1.0)], [(1, 1.0), (2, 5.0)], [(1, 0), (0, 1)]),
        ([], [(1, 1.0)], [(None, 0)]),
        ([], [], []),
    ],
)
def test_align(spark, speech, subtitles, want):
    assert pairs(spark, speech, subtitles) == want


def test_fast_path_agrees_with_greedy(spark):
    import random

    r = random.Random(3)
    for _ in range(3):
        ids = r.sample(range(20), 8)
        speech = [(i, r.uniform(0, 20)) for i in ids]
        subtitles = [(i, r.uniform(0, 20)) for i in ids + r.sample(range(20), 4)]
        r.shuffle(subtitles)
        want = A.greedy(pd.DataFrame([(k, i, t) for k, (i, t) in enumerate(speech)], columns=["seq", "id", "ts"]), pd.DataFrame([(k, i, t) for k, (i, t) in enumerate(subtitles)], columns=["seq", "id", "ts"]), 1.5)
        assert set(pairs(spark, speech, subtitles)) == set(want)


def results(spark, speech, subtitles, **p):
    return C.compare(*frames(spark, speech, subtitles), CompareParams(**p)).orderBy("id").collect()


def test_match_and_missing(spark):
    (r,) = results(spark, [(1, 0.0, 2.0, "Hello world")], [(1, 1.0, "hello, world!")])
    assert (r.status, r.reason, r.score, r.metrics.match_source) == ("OK", "ok", 1.0, "aligned")
    (r,) = results(spark, [(1, 0.0, 2.0, "hello")], [])
    assert (r.status, r.reason) == ("REVIEW", "missing_subtitle")
    (r,) = results(spark, [], [(1, 1.0, "hello")])
    assert (r.status, r.reason, r.start) == ("REVIEW", "missing_speech", None)
    assert results(spark, [], []) == []
    (r,) = results(spark, [(1, 0.0, 2.0, "...")], [])
    assert (r.status, r.reason) == ("OK", "missing_subtitle")  # status and reason are told apart


def test_duplicate(spark):
    rows = results(spark, [(1, 0.0, 2.0, "first line here"), (2, 10.0, 12.0, "quite another sentence")], [(1, 1.0, "first line here"), (2, 11.0, "first line here")])
    assert [r.reason for r in rows] == ["ok", "duplicate"]


def test_nearby_and_joined(spark):
    (r, *_) = results(spark, [(1, 0.0, 2.0, "the right words to find")], [(1, 1.0, "zzz qqq"), (9, 1.4, "the right words to find")])
    assert (r.reason, r.metrics.match_source, r.score) == ("ok", "nearby", 1.0)
    (r, *_) = results(spark, [(1, 0.0, 10.0, "alpha beta gamma delta")], [(1, 2.0, "alpha beta"), (2, 6.0, "gamma delta")])
    assert (r.status, r.metrics.match_source) == ("OK", "nearby_2x")
    words = [f"word{k} item{k}" for k in range(4)]
    r = next(r for r in results(spark, [(1, 0.0, 10.0, " ".join(words))], [(k + 1, 1.0 + 2 * k, w) for k, w in enumerate(words)]) if r.audio_text)
    assert r.metrics.match_source == "nearby_4x" and r.score == 1.0


def test_noise_around(spark):
    (r,) = results(spark, [(1, 0.0, 2.0, "नमस्ते आज हम बात करेंगे")], [(1, 1.0, "xx yy नमस्ते आज हम बात करेंगे zz ww")])
    assert r.status == "OK" and r.metrics.window > 0.9 and r.metrics.matched_window_text == "नमस्ते आज हम बात करेंगे"


def test_summary_and_review(spark):
    rows = C.compare(*frames(spark, [(1, 0.0, 2.0, "hello there friend"), (9, 20.0, 22.0, "nothing shown")], [(1, 1.0, "hello there friend")]))
    media = spark.createDataFrame([("m",), ("empty",)], "media_id string")
    s = {r.media_id: r for r in C.summarize(rows, media).collect()}
    assert (s["m"].segment_count, s["m"].flagged_count, s["m"].avg_score, s["m"].missing_subtitle_count) == (2, 1, 0.5, 1)
    assert (s["empty"].segment_count, s["empty"].avg_score) == (0, 0.0)
    assert [r.id for r in review.review_filter(rows, status="REVIEW").collect()] == [2]
    assert [r.id for r in review.review_filter(rows, query="FRIEND").collect()] == [1]
    assert [r.id for r in review.review_filter(rows, low=0.5, high=1.0).collect()] == [1]
    assert [r.id for r in review.review_sort(rows, "score").collect()] == [2, 1]
    assert review.csv_rows(rows).columns[1:] == review.CSV_COLUMNS
    html = [r.h for r in rows.orderBy("id").select(review.row_html().alias("h")).collect()]
    assert 'data-status="OK"' in html[0] and "<i>none</i>" in html[1] and html[0].startswith("<li ") and html[0].endswith("</li>")
    with pytest.raises(ValueError):
        CompareParams(threshold=1.5)


def test_many_items_at_once(spark):
    a1, s1 = frames(spark, [(1, 0.0, 2.0, "one")], [(1, 1.0, "one")], "a")
    a2, s2 = frames(spark, [(None, 0.0, 2.0, "two")], [(None, 1.0, "two")], "b")
    rows = C.compare(a1.unionByName(a2), s1.unionByName(s2)).collect()
    assert sorted((r.media_id, r.score) for r in rows) == [("a", 1.0), ("b", 1.0)]


def test_nearest_within(spark):
    left = spark.createDataFrame([("u", 10.0, 1), ("u", 50.0, 2)], "k string, ts double, l long")
    right = spark.createDataFrame([("u", 8.0, 5), ("u", 12.0, 4), ("v", 50.0, 6)], "k string, ts double, r long")
    got = {r.l: (r.r, r.gap) for r in A.nearest_within(left, right, "k", 3.0, "l", "r").collect()}
    assert got == {1: (4, 2.0), 2: (None, None)}


def test_plan_scores_each_pair_once(spark):
    a, s = frames(spark, [(1, 0.0, 2.0, "x y")], [(1, 1.0, "x z")])
    plan = C.compare(a, s)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert F is not None


def test_segments_are_judged_in_one_pass(spark):
    """Scoring aligned pairs and candidates apart took the aligned rows, and their texts, through the plan several times."""
    a, s = frames(spark, [(1, 0.0, 2.0, "x y")], [(1, 1.0, "x z")])
    plan = C.compare(a, s)._jdf.queryExecution().executedPlan().toString()
    kernels = sum(plan.count(k) for k in ("MapInArrow", "ArrowEvalPython"))
    assert plan.count("MapInArrow") == 1 and kernels <= 5


def test_segments_cut_by_batches(spark):
    said = [(k, 4.0 * k, 4.0 * k + 3, f"word{k} and another{k % 3} thing{k}") for k in range(9)]
    shown = [(k + 1, 4.0 * k + 1, f"another{k % 3} thing{k} word{k}") for k in range(9)] + [(40, 9.0, "word2 and another2"), (41, 10.0, "thing2")]
    want = results(spark, said, shown)
    assert {r.metrics.match_source for r in want} >= {"aligned", "nearby_2x"}
    for size in (1, 2, 3):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert results(spark, said, shown) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
