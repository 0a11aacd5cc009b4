import pytest
from pyspark.sql import functions as F

from verbalign.functions import languages
from verbalign.functions import text as T


def column(spark, f, values, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in d.orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("raw", "norm"),
    [("  Hello,  World!  ", "hello world"), ("a\n\nb\r\nc", "a b c"), (None, ""), ("चाँद", "चांद"), ("ड़", "ड"), ("राम।", "राम"), ("Straße", "strasse"), ("é", "é"), ("​x‍", "x"), ("...", "")],
)
def test_normalize(spark, raw, norm):
    assert column(spark, T.normalize_text, [raw]) == [norm]


def test_script_ratio(spark):
    assert column(spark, lambda c: T.script_ratio(c, "en"), ["abc", "abकख", "12", None]) == [1.0, 0.5, 0.0, 0.0]
    assert column(spark, lambda c: T.script_ratio(c, "multi"), ["abकख", "привет"]) == [1.0, 0.0]


def test_garbage(spark):
    assert column(spark, T.is_garbage, ["", "x", "#@!%", "12345", "hello world", "नमस्ते दुनिया"]) == [True, True, True, True, False, False]


def test_loops(spark):
    loops = ["ababababababababababab", "no no no no no no no no", "Thanks for watching!", "x" * 3 + "the quick brown fox jumps over a dog" + "x" * 3 + "the quick brown fox jumps over a dog"]
    assert column(spark, T.is_loop, loops) == [True] * 4
    assert column(spark, T.is_loop, ["", "hello", "नमस्ते, आज हम एक नई बात करेंगे", "a normal sentence of several words", None]) == [False] * 5


def test_times(spark):
    assert column(spark, T.srt_timestamp, [0.0, 3661.5, 1.0005], "double") == ["00:00:00,000", "01:01:01,500", "00:00:01,000"]
    assert column(spark, T.duration, [None, 45.0, 125.0, 3661.0], "double") == ["", "0m 45s", "2m 5s", "1h 1m 1s"]
    assert column(spark, T.clock, [None, 75.5, 3661.25], "double") == ["", "01:15.50", "1:01:01.25"]
    assert column(spark, T.elapsed, [12.34, 75.0], "double") == ["12.3s", "1m 15s"]
    with pytest.raises(Exception, match="negative"):
        column(spark, T.srt_timestamp, [-1.0], "double")


def test_names(spark):
    assert column(spark, T.output_stem, ["???", "folder/My Clip?.mp4", "कखग.mp4", "a/b.tar.gz"]) == ["media", "My Clip", "media", "b.tar"]
    one = column(spark, T.output_stem, ["https://example.com/x/clip.mp4?t=1"])[0]
    assert one.startswith("clip_") and len(one) == 17
    assert column(spark, T.video_id, ["https://youtu.be/abc", "https://www.youtube.com/watch?v=xyz&t=1", "https://example.com/watch?v=q"]) == ["abc", "xyz", None]


def test_scores(spark):
    assert column(spark, T.score_level, [0.95, 0.85, 0.7, 0.1], "double") == ["high", "good", "fair", "low"]
    assert column(spark, T.score_percent, [1.5, 0.999, -1.0], "double") == [100, 99, 0]
    assert column(spark, T.html_escape, ["<a href=\"x\">&'"]) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"]


def test_languages(spark):
    assert languages.screen_codes("multi") == "eng+hin+kan+tam+tel"
    assert languages.recommended_model("hi") == "medium" and languages.recommended_model("fr") == "small"
    assert languages.screen_language("ta") == "ta" and languages.screen_language("fr") == "multi" and languages.screen_language("fr", "en") == "en"
    assert languages.missing_packs("multi", {"eng"}) == ["hin", "kan", "tam", "tel"]
    assert languages.dimension(spark).count() == 5
    with pytest.raises(ValueError):
        languages.spec("xx")


def test_filters_evaluate_a_text_once(spark):
    """An expression copied into a filter would show its patterns there again."""
    from verbalign.operators import ocr_select, segments

    raw = spark.createDataFrame([], "media_id string, seq long, start double, end double, text string, avg_logprob double")
    read = spark.createDataFrame([], "k long, ordinal int, variant string, psm int, text string, confidence double")
    for d, most in ((segments.filter_noise(segments.build(raw)), 4), (segments.render_srt(segments.build(raw)), 4), (ocr_select.best_variant(read, "k"), 12)):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") + plan.count("RegExpReplace") <= most
