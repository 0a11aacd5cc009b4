import pytest
from pyspark.sql import functions as F

from verbalign.operators import ocr_select as O
from verbalign.operators import segments as S

ROW = "media_id string, seq long, start double, end double, text string"


def seg(spark, rows):
    return spark.createDataFrame([("m", k, *r) for k, r in enumerate(rows)], ROW)


def test_build_and_noise(spark):
    raw = seg(spark, [(0.0, 0.3, ""), (1.0, 3.0, ""), (3.0, 5.0, " hello there "), (5.0, 6.0, "weak")]).withColumn("avg_logprob", F.when(F.col("seq") == 3, -2.0).otherwise(-0.3))
    b = S.build(raw).orderBy("seq").collect()
    assert [r.text for r in b] == ["", "", "hello there", ""] and b[2].midpoint == 4.0
    kept = S.filter_noise(S.build(raw)).orderBy("id").collect()
    assert [(r.id, r.start) for r in kept] == [(1, 1.0), (2, 3.0), (3, 5.0)]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(0.0, 3.0, "a"), (2.5, 5.0, "b")], [(0.0, 2.4), (2.5, 5.0)]),
        ([(0.0, 2.0, "a"), (2.05, 4.0, "b")], [(0.0, 1.95), (2.05, 4.0)]),
        ([(0.0, 0.1, "a"), (1.0, 2.0, "b"), (3.0, 4.0, " ")], [(1.0, 2.0)]),
        ([(0.0, 1.0, "a"), (0.05, 1.0, "b")], [(0.0, -0.05), (0.05, 1.0)]),
    ],
)
def test_overlaps(spark, rows, want):
    assert [(r.start, r.end) for r in S.fix_overlaps(seg(spark, rows)).orderBy("id").collect()] == want


def test_render(spark):
    s = seg(spark, [(0.0, 1.0, "one"), (2.0, 3.5, "two")])
    assert S.render_srt(s).first().srt == "1\n00:00:00,000 --> 00:00:01,000\none\n\n2\n00:00:02,000 --> 00:00:03,500\ntwo\n"
    meta = spark.createDataFrame([("m", "f.mp4", "en", "small")], "media_id string, input_file string, language string, model string")
    assert S.render_text(s, meta).first().text == "# Input: f.mp4\n# Language: en\n# Model: small\n\n[0.00s - 1.00s] one\n[2.00s - 3.50s] two\n"


@pytest.mark.parametrize(
    ("start", "end", "mid", "window", "n", "want"),
    [(None, None, 10.0, 0.5, 3, [9.5, 10.0, 10.5]), (None, None, 10.0, 0.5, 1, [10.0]), (10.0, 20.0, 15.0, 0.35, 3, [10.9, 15.0, 19.1]), (10.0, 20.0, 15.0, 0.35, 2, [10.9, 19.1]), (0.0, 0.5, 0.25, 0.35, 3, [0.0, 0.25, 0.6])],
)
def test_sample_times(spark, start, end, mid, window, n, want):
    d = spark.createDataFrame([(start, end, mid)], "s double, e double, m double")
    assert d.select(S.sample_times(F.col("s"), F.col("e"), F.col("m"), window, n)).first()[0] == want


def test_words(spark):
    w = spark.createDataFrame([("k", 0, "hello", "90"), ("k", 1, " ", "95"), ("k", 2, "low", "10"), ("k", 3, "odd", "x"), ("k", 4, "there", "70"), ("e", 0, "", "1")], "k string, pos int, text string, conf string")
    got = {r.k: (r.text, r.confidence) for r in O.filter_words(w, "k").collect()}
    assert got == {"k": ("hello odd there", 0.8), "e": ("", None)}


def test_variants(spark):
    r = spark.createDataFrame([("k", 0, "a", 6, "hello wor", 0.5), ("k", 1, "b", 6, "hello world", 0.75), ("k", 2, "c", 6, "hello world and more", 0.99), ("g", 0, "a", 6, "#!", 0.9)], "k string, ordinal int, variant string, psm int, text string, confidence double")
    got = O.best_variant(r, "k").collect()
    assert [(x.k, x.text, x.ocr_variant) for x in got] == [("k", "hello world", "b/psm6")]  # trying ends at the sure one


@pytest.mark.parametrize(("texts", "want"), [(["hello", "hello", "world"], "hello world"), (["hello world", "hello"], "hello world"), (["hello", "Hello World"], "hello"), ([], ""), (["", " a  b "], "a b")])
def test_merge(spark, texts, want):
    assert spark.createDataFrame([(texts,)], "t array<string>").select(O.merge_unique(F.col("t"))).first()[0] == want


def frame(spark, rows, audio):
    return spark.createDataFrame([("m", 1, 5.0, audio, k, 5.0 + k, t, c, 0.0, ok) for k, (t, c, ok) in enumerate(rows)], "media_id string, id int, mid double, audio_text string, frame int, ts double, text string, confidence double, sharpness double, readable boolean")


def test_frames(spark):
    r = O.best_frame(frame(spark, [("something else", 0.95, True), ("hello world", 0.5, True)], "hello world")).first()
    assert (r.subtitle_text, r.status, r.timestamp) == ("hello world", "ok", 6.0)
    r = O.best_frame(frame(spark, [("x", 0.9, False)], "")).first()
    assert (r.status, r.subtitle_text) == ("no_frame", "")
    assert O.best_frame(frame(spark, [("", None, True)], "")).first().status == "empty"
    r = O.best_frame(frame(spark, [("alpha beta", 0.9, True), ("gamma delta", 0.8, True)], "alpha beta gamma delta")).first()
    assert (r.status, r.subtitle_text) == ("merged", "alpha beta gamma delta")


def test_bounds_and_grid(spark):
    d = spark.createDataFrame([(100, 200)], "h int, w int")
    assert tuple(d.select(O.fixed_bounds(F.col("h"), F.col("w"), 0.20)).first()[0]) == (0, 80, 200, 20)
    assert O.effort_grid(spark, "fast").count() == 3 and O.effort_grid(spark, "accurate").count() == 18
    with pytest.raises(ValueError):
        O.effort_grid(spark, "slow")
    with pytest.raises(ValueError):
        O.fixed_bounds(F.col("h"), F.col("w"), 0.0)


def test_captions_are_counted_before_they_are_cut(spark):
    from verbalign.plans import fixtures as X

    long_ = " ".join(f"w{k}" for k in range(1500))
    rows = [(1, 0, long_), (1, 1, "a  b\tc d e f"), (1, 2, " "), (1, 3, "g"), (2, 5, long_), (None, 0, "x y"), (3, 0, None)]
    turns = lambda rows: spark.createDataFrame(rows, "k long, turn long, text string")
    want = lambda d: X.captions_in_turn(d.selectExpr("k as media", "turn as part", "text"))
    d = turns(rows)
    c = X.captions(d, "k", "turn")
    assert sorted(c.collect(), key=str) == sorted(want(d).collect(), key=str) and c.count() == 300 + 2 + 1 + 300 + 1
    # rows of one key and turn alternate; other keys are not touched
    both = turns([*rows, (2, 5, "h i j k l m")])
    assert sorted((r.media or 0, r.seq, r.ms) for r in X.captions(both, "k", "turn").collect() if r.media != 2) == sorted((r.media or 0, r.seq, r.ms) for r in c.collect() if r.media != 2)
    assert sorted(r.seq for r in X.captions(both, "k", "turn").where("media = 2").collect()) == list(range(1, 303))


def test_readings_of_a_caption_stay_together(spark):
    """Cut and grouped again, each word was a row to be shuffled, sorted and spilled."""
    from verbalign.plans import catalogue as K
    from verbalign.plans import fixtures as X

    d = X.captions(spark.createDataFrame([(1, "one two three four five six"), (2, "seven")], "doc_id long, text string"), "doc_id")
    words, made = K.read_words(d), K.readings(d)
    for out in (O.filter_words(words, "media", "seq"), O.best_variant(made, "media", "seq")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    apart = words.select("media", "seq", F.posexplode("words").alias("pos", "x")).select("media", "seq", "pos", "x.text", "x.conf")
    assert sorted(O.filter_words(words, "media", "seq").collect()) == sorted(O.filter_words(apart, "media", "seq").collect())
    apart = made.select("media", "seq", F.inline("readings"))
    assert sorted(O.best_variant(made, "media", "seq").collect()) == sorted(O.best_variant(apart, "media", "seq").collect())
