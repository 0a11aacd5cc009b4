import json

import pytest
from pyspark.sql import functions as F

from verbalign import cli
from verbalign.operators import compare as C
from verbalign.plans import pipeline
from verbalign.sources import adapters, sinks
from verbalign.sources import segments as S
from verbalign.streaming import payloads


def test_read(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "start": 0, "end": 2, "text": "hi"}, {"timestamp": 7.5, "text": "", "audio_text": "yo"}]))
    (tmp_path / "b.json").write_text(json.dumps({"metadata": {"x": 1}, "segments": [{"id": 3, "mid": 4.0, "ocr_text": "seen"}]}))
    rows = S.read_payloads(spark, str(tmp_path))
    assert rows.count() == 3
    said = {r.seq: (r.ts, r.text) for r in S.as_speech(rows.where("media_id like '%a.json'")).collect()}
    assert said == {0: (1.0, "hi"), 1: (7.5, "yo")}
    assert S.as_subtitles(rows.where("media_id like '%b.json'")).first().text == "seen"
    assert S.read_metadata(spark, str(tmp_path / "b.json")).first().metadata == {"x": "1"}
    with pytest.raises(Exception, match="not a segment payload"):
        S.read_payloads(spark, str(tmp_path / "a.json"), strict=True).collect()
    (tmp_path / "c.json").write_text(json.dumps({"segments": [{"text": "no time"}]}))
    with pytest.raises(Exception, match="no timestamp"):
        S.as_speech(S.read_payloads(spark, str(tmp_path / "c.json"))).collect()


def test_discovery(spark, tmp_path):
    for n in ("B.MP4", "a.wav", "note.txt", "in/c.mkv"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("x")
    names = lambda d: [r.path.rsplit("/", 1)[-1] for r in d.collect()]
    assert names(S.media_files(spark, str(tmp_path))) == ["a.wav", "B.MP4"]
    assert names(S.media_files(spark, str(tmp_path), recursive=True)) == ["a.wav", "B.MP4", "c.mkv"]
    assert len(names(S.media_files(spark, str(tmp_path), all_files=True))) == 3
    with pytest.raises(FileNotFoundError):
        S.media_files(spark, str(tmp_path / "none"))
    for n in ("x/transcription.json", "y.json", "results.json", "x/ocr_results.json"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("[]")
    found = S.payload_files(spark, str(tmp_path))
    assert names(found) == ["transcription.json", "y.json"]
    screen = S.payload_files(spark, str(tmp_path), "ocr_results.json", ("results.json", "y.json"))
    assert {r.other.rsplit("/", 2)[-2] for r in S.pair_files(found, screen).where("other is not null").collect()} == {"x"}
    want = spark.createDataFrame([("k", 1, "none"), ("k", 2, "there")], "key string, rank int, path string")
    assert S.first_existing(spark.createDataFrame([("there",)], "path string"), want).first().path == "there"


def test_reuse(spark, tmp_path):
    f = tmp_path / "t.json"
    f.write_text(json.dumps({"metadata": {"language": "hi", "temperature": 0.2}, "segments": []}))
    assert S.reusable(spark, str(f), {"language": "hi", "temperature": 0.2000001})
    assert S.reusable(spark, str(f), {"language": "en"}) is None
    assert S.reusable(spark, str(tmp_path / "none.json"), {}) is None


def test_end_to_end(spark, tmp_path):
    media = spark.createDataFrame([("/m/a.mp4",), ("/m/b.mp4",)], "path string")
    rows, _ = pipeline.run(media, adapters.FakeRecogniser, adapters.FakeReader)
    rows = spark.createDataFrame(rows.collect(), rows.schema)  # the plan runs once
    summary = spark.createDataFrame(C.summarize(rows, media.select(F.col("path").alias("media_id"))).collect())
    assert {r.media_id for r in summary.where("flagged_count = 0").collect()} == {"/m/a.mp4", "/m/b.mp4"}
    page = sinks.write_page(rows, summary, "/m/a.mp4", tmp_path / "a.html").read_text()
    assert 'data-status="OK"' in page and "/m/a.mp4" in page and "@rows@" not in page and page.count("<li ") == rows.where("media_id = '/m/a.mp4'").count()
    sinks.write_pages(rows, summary, str(tmp_path / "pages"))
    assert sorted(f.name for f in (tmp_path / "pages").iterdir()) == ["a.html", "b.html"]
    with pytest.raises(ValueError):
        sinks.render_page(rows, summary, "/m/a.mp4", asset_mode="x")
    sinks.write_csv_table(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.count() == rows.count()
    sinks.write_visible_csv(rows, str(tmp_path / "vis"))
    said = pipeline.speech(media, adapters.FakeRecogniser)
    meta = media.select(F.col("path").alias("media_id"), F.lit("f").alias("input_file"), F.lit("en").alias("language"), F.lit("m").alias("model"))
    paths = sinks.write_transcription(said, meta, "/m/a.mp4", tmp_path / "t")
    assert json.loads(paths["json"].read_text())["segments"] and paths["srt"].read_text().startswith("1\n")
    payload = sinks.payload_of(rows, C.summarize(rows), "/m/a.mp4")
    assert payload["metadata"]["segment_count"] == len(payload["segments"])


def test_commands(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "start": 0, "end": 2, "text": "hello"}]))
    (tmp_path / "s.json").write_text(json.dumps([{"id": 1, "timestamp": 1, "subtitle_text": "hello"}]))
    out = str(tmp_path / "out")
    assert cli.main(["compare", str(tmp_path / "a.json"), str(tmp_path / "s.json"), "--output-dir", out]) == 0
    assert spark.read.parquet(f"{out}/rows").first().status == "OK"
    assert cli.main(["report", out, "--output-dir", str(tmp_path / "html")]) == 0
    assert list((tmp_path / "html").glob("*.html"))
    assert cli.main(["compare", str(tmp_path / "a.json"), str(tmp_path / "s.json"), "--threshold", "2"]) == 2
    assert cli.main(["run", str(tmp_path / "nowhere")]) == 2
    (tmp_path / "v.mp4").write_text("x")
    assert cli.main(["run", str(tmp_path / "v.mp4"), "--output-dir", str(tmp_path / "r")]) == 2  # no engine, no words
    assert cli.main(["run", str(tmp_path / "v.mp4"), "--recogniser", "tests.engines:Nothing"]) == 2


def test_compare_of_folders(spark, tmp_path):
    for item in ("one", "two", "three"):
        for side, name, row in (("said", "transcription.json", {"id": 1, "start": 0, "end": 2, "text": item}), ("shown", "ocr_results.json", {"id": 1, "timestamp": 1, "subtitle_text": item})):
            (tmp_path / side / item).mkdir(parents=True)
            (tmp_path / side / item / name).write_text("{broken" if (side, item) == ("shown", "three") else json.dumps({"metadata": {}, "segments": [row, {**row, "id": 2, "start": 5, "end": 6, "timestamp": 5.5}]}))
    args = ["compare", str(tmp_path / "said"), str(tmp_path / "shown"), "--output-dir", str(tmp_path / "out")]
    assert cli.main(args) == 2
    assert cli.main([*args, "--continue-on-error"]) == 1
    rows = spark.read.parquet(str(tmp_path / "out/rows")).collect()
    assert sorted((r.audio_text, r.subtitle_text, r.status) for r in rows) == [("one", "one", "OK")] * 2 + [("two", "two", "OK")] * 2
    failures = json.loads((tmp_path / "out/run_manifest.json").read_text())["metadata"]["failures"]
    assert len(failures) == 1 and failures[0]["media_id"].endswith("three/transcription.json")


def test_run_of_a_folder(spark, tmp_path):
    for n in ("a.mp4", "b.mp4", "broken.mp4"):
        (tmp_path / n).write_text("x")
    out = str(tmp_path / "out")
    args = ["run", str(tmp_path), "--output-dir", out, "--recogniser", "tests.engines:Careful", "--reader", "tests.engines:Reader"]
    assert cli.main(args) == 2
    assert cli.main([*args, "--continue-on-error"]) == 1
    rows = spark.read.parquet(f"{out}/rows")
    assert {r.media_id.rsplit("/", 1)[-1] for r in rows.collect()} == {"a.mp4", "b.mp4"}
    assert len(list((tmp_path / "out/pages").glob("*.html"))) == 2
    # a second run takes both stages from the first: it needs no engine
    assert cli.main(["run", str(tmp_path), "--output-dir", out, "--resume"]) == 0
    assert cli.main(["run", str(tmp_path), "--output-dir", out, "--resume", "--language", "hi"]) == 2


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = {"media_id": "m", "seq": 0, "id": 1, "start": 0.0, "end": 2.0, "ts": 1.0, "text": "hello"}
    (src / "1.json").write_text(json.dumps({**row, "side": "speech"}))
    payloads.follow(spark, str(src), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    (src / "2.json").write_text(json.dumps({**row, "side": "screen"}))
    payloads.follow(spark, str(src), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert [r.status for r in spark.read.parquet(str(tmp_path / "t/results")).collect()] == ["OK"]
