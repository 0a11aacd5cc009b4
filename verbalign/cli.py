"""Commands: transcribe, ocr, compare, report, run. Folders are worked through as one plan.

Recognisers and readers are named ``module:factory``; the library has none of
its own, and a command that needs one ends with an error without it. An item
that fails ends the command, or with --continue-on-error is listed in the
manifest and makes the command end with 1.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from .params import EFFORTS, CompareParams, check_crop_ratio, check_temperature


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verbalign")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *inputs: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for i in inputs:
            c.add_argument(i)
        c.add_argument("--output-dir", default="out")
        c.add_argument("--continue-on-error", action="store_true")
        return c

    def media(c: argparse.ArgumentParser) -> None:
        c.add_argument("--recogniser", help="module:factory")
        c.add_argument("--recursive", action="store_true")
        c.add_argument("--include-all-files", "--all-files", action="store_true", dest="include_all_files")
        c.add_argument("--language", default="auto")
        c.add_argument("--model")
        c.add_argument("--beam-size", type=int, default=2)
        c.add_argument("--temperature", type=float, default=0.0)
        c.add_argument("--compute-type", default="int8")
        c.add_argument("--device", default="cpu")
        c.add_argument("--cpu-threads", type=int, default=0)
        c.add_argument("--no-vad", action="store_true")

    def screen(c: argparse.ArgumentParser) -> None:
        c.add_argument("--reader", help="module:factory")
        c.add_argument("--frames", help="module:factory of a source of frames; without one the reader fetches its own")
        c.add_argument("--fixed-region", action="store_true", help="read the bottom band, without looking for where the text is")
        c.add_argument("--ocr-language")
        c.add_argument("--crop-ratio", type=float, default=0.15)
        c.add_argument("--window-seconds", type=float, default=0.35)
        c.add_argument("--samples", "--samples-per-segment", type=int, default=3)
        c.add_argument("--effort", "--ocr-effort", choices=tuple(EFFORTS), default="balanced")

    def scores(c: argparse.ArgumentParser) -> None:
        c.add_argument("--threshold", type=float, default=0.80)
        c.add_argument("--tolerance", type=float, default=1.5)
        c.add_argument("--context", type=float, default=2.0)

    media(command("transcribe", "media"))
    screen(command("ocr", "media", "segments"))
    scores(command("compare", "speech", "screen"))
    r = command("report", "results")
    c = command("run", "media")
    for x in (r, c):
        x.add_argument("--video")
        x.add_argument("--asset-mode", choices=("link", "copy", "preview"), default="link")
    media(c)
    screen(c)
    scores(c)
    c.add_argument("--resume", action="store_true", help="reuse what an earlier run with the same settings left in the output folder")
    c.add_argument("--reuse-transcription", help="a transcript payload, or a folder of them")
    c.add_argument("--reuse-ocr", help="a payload of screen readings, or a folder of them")
    return p


def made(factory, settings: dict):
    """A factory of engines that know the command's settings, if the engine takes them."""

    def make():
        engine = factory()
        if hasattr(engine, "configure"):
            engine.configure(**settings)
        return engine

    return make


def named_engine(name: str | None, option: str, settings: dict):
    from .sources import adapters

    if not name:
        raise ValueError(f"this command needs an engine: --{option} module:factory")
    return made(adapters.engine(name), settings)


def settle(failures, args: argparse.Namespace) -> list[dict]:
    """Failed items (media_id, error); without --continue-on-error the first one is raised."""
    found = [r.asDict() for r in failures.orderBy("media_id").collect()]
    if found and not args.continue_on_error:
        raise RuntimeError("{media_id}: {error}".format(**found[0]))
    for f in found:
        print("error: {media_id}: {error}".format(**f), file=sys.stderr)
    return found


def dispatch(args: argparse.Namespace, spark) -> int:
    from pyspark.sql import functions as F

    from .operators import compare as C
    from .plans import pipeline
    from .sources import segments as S
    from .sources import sinks

    out, began, failures = args.output_dir.rstrip("/"), time.time(), []
    if args.command in ("transcribe", "run"):
        check_temperature(args.temperature)
    if args.command in ("ocr", "run"):
        check_crop_ratio(args.crop_ratio)
    hears = {k: getattr(args, k, None) for k in ("language", "model", "beam_size", "temperature", "compute_type", "device", "cpu_threads", "no_vad")}
    sees = {k: getattr(args, k, None) for k in ("ocr_language", "crop_ratio", "fixed_region")}
    look = {k: getattr(args, o, None) for k, o in (("effort", "effort"), ("window", "window_seconds"), ("samples", "samples"))}
    if args.command in ("ocr", "run"):
        look |= {"source": named_engine(args.frames, "frames", sees) if args.frames else None, "ratio": args.crop_ratio, "dynamic": not args.fixed_region}
    if args.command == "transcribe":
        files = S.media_files(spark, args.media, args.recursive, args.include_all_files)
        said, failed = pipeline.attempt(files, named_engine(args.recogniser, "recogniser", hears))
        failures = settle(failed, args)
        sinks.write_json_table(said, f"{out}/speech")
        sinks.write_srt_table(said, f"{out}/srt")
        sinks.write_manifest(Path(out) / S.MANIFEST, {"command": args.command, **hears, "failures": failures, "total_seconds": round(time.time() - began, 3)}, {"speech": f"{out}/speech", "srt": f"{out}/srt"})
    elif args.command == "ocr":
        # segments of many files keep apart: each file's are those of its own item
        rows = S.read_payloads(spark, args.segments, strict=not S._is_folder(spark, args.segments))
        item = F.lit(args.media) if not S._is_folder(spark, args.segments) else F.concat(F.lit(args.media.rstrip("/") + "/"), S.batch_stem(F.col("media_id")))
        said = rows.select(item.alias("media_id"), "seq", F.coalesce("id", F.col("seq").cast("int") + 1).alias("id"), "start", "end", S.as_speech(rows)["ts"].alias("midpoint"), "text")
        sinks.write_json_table(pipeline.screen(said, named_engine(args.reader, "reader", sees), **look), f"{out}/screen")
    elif args.command in ("compare", "run"):
        p = CompareParams(args.threshold, args.tolerance, args.context)
        if args.command == "run":
            rows, summary, failures = run(args, spark, p, hears, sees, look, out)
        else:
            pairs = S.matched(spark, args.speech, args.screen)
            lone = pairs.where("other is null").select(F.col("path").alias("media_id"), F.lit("no screen readings").alias("error"))
            pairs = pipeline.kept(pairs.where("other is not null"))
            own = lambda d, c: d.withColumn("file", F.regexp_replace("media_id", "^file:/*", "/")).join(pairs.select(F.regexp_replace(c, "^file:/*", "/").alias("file"), F.col("path").alias("item")), "file").drop("file")
            read = lambda c: own(S.read_payloads(spark, [r[c] for r in pairs.select(c).distinct().collect()], broken=True), c)
            if pairs.isEmpty():
                raise FileNotFoundError(f"nothing of {args.speech} has a partner in {args.screen}")
            a, s = pipeline.kept(read("path")), pipeline.kept(read("other"))
            bad = a.where("seq < 0").unionByName(s.where("seq < 0")).select(F.col("item").alias("media_id"), F.lit("not a segment payload").alias("error")).distinct()
            failures = settle(lone.unionByName(bad), args)
            gone = [f["media_id"] for f in failures]
            whole = lambda d: d.where(~F.col("item").isin(gone)).withColumn("media_id", F.col("item"))
            rows = C.compare(S.as_speech(whole(a)), S.as_subtitles(whole(s)), p)
            summary = C.summarize(rows, pairs.where(~F.col("path").isin(gone)).select(F.col("path").alias("media_id")))
        rows.write.mode("overwrite").parquet(f"{out}/rows")
        rows = spark.read.parquet(f"{out}/rows")
        sinks.write_csv_table(rows, f"{out}/csv")
        sinks.write_json_table(rows, f"{out}/json")
        summary.write.mode("overwrite").json(f"{out}/summary")
        if args.command == "run":
            sinks.write_pages(rows, C.summarize(rows), f"{out}/pages")
        meta = {"command": args.command, "threshold": args.threshold, "tolerance": args.tolerance, "context": args.context, "failures": failures, "total_seconds": round(time.time() - began, 3)}
        if args.command == "run":
            meta |= {"settings": settings_of(hears), "screen_settings": settings_of({**sees, **look, "source": args.frames})}
        sinks.write_manifest(Path(out) / S.MANIFEST, meta, {k: f"{out}/{k}" for k in ("rows", "csv", "json", "summary")})
    else:
        rows = spark.read.parquet(f"{args.results.rstrip('/')}/rows")
        if args.video:  # one item's page, with its video
            summary = C.summarize(rows)
            one = summary.select("media_id").limit(2).collect()
            if len(one) != 1:
                raise ValueError("--video needs the results of one item")
            sinks.write_page(rows, summary, one[0].media_id, Path(out) / f"{_stem(spark, one[0].media_id)}.html", args.video, args.asset_mode)
        else:
            sinks.write_pages(rows, C.summarize(rows), out)
    return 1 if failures else 0


def settings_of(settings: dict) -> dict:
    return {k: v for k, v in sorted(settings.items()) if v is not None}


def run(args: argparse.Namespace, spark, p: CompareParams, hears: dict, sees: dict, look: dict, out: str):
    """Rows, roll-up and failures of a run; stages whose output is there already are not run again."""
    from pyspark.sql import functions as F

    from .operators import compare as C
    from .plans import pipeline
    from .sources import segments as S

    earlier = {}
    if args.resume:
        try:
            earlier = json.loads((Path(out) / S.MANIFEST).read_text(encoding="utf-8"))["metadata"]
        except (OSError, ValueError, KeyError):
            earlier = {}
    same = S.metadata_matches({"metadata": earlier.get("settings")}, settings_of(hears))
    same_look = same and S.metadata_matches({"metadata": earlier.get("screen_settings")}, settings_of({**sees, **look, "source": args.frames}))
    folder = lambda name: f"{out}/stages/{name}"
    stored = lambda name: Path(folder(name), "_SUCCESS").exists()
    media, failed = S.media_files(spark, args.media, args.recursive, args.include_all_files), None
    if args.reuse_transcription:
        rows = S.read_payloads(spark, args.reuse_transcription, strict=not S._is_folder(spark, args.reuse_transcription))
        said = S.as_speech(rows).withColumnRenamed("ts", "midpoint").withColumn("stem", S.safe_name(S.batch_stem(F.col("media_id")))).drop("media_id")
        items = media.select(F.col("path").alias("media_id"), S.safe_name(S.path_stem(F.col("path"))).alias("stem"))
        said = items.select("media_id").crossJoin(said.drop("stem")) if not S._is_folder(spark, args.reuse_transcription) and media.count() == 1 else said.join(items, "stem").drop("stem")
    elif same and stored("speech"):
        said = spark.read.parquet(folder("speech"))
    else:
        said, failed = pipeline.attempt(media, named_engine(args.recogniser, "recogniser", hears))
        said.write.mode("overwrite").parquet(folder("speech"))
        said = spark.read.parquet(folder("speech"))
    failures = settle(failed, args) if failed is not None else []
    if args.reuse_ocr:
        rows = S.read_payloads(spark, args.reuse_ocr, strict=not S._is_folder(spark, args.reuse_ocr))
        shown = S.as_subtitles(rows).withColumn("stem", S.safe_name(S.batch_stem(F.col("media_id")))).drop("media_id")
        items = media.select(F.col("path").alias("media_id"), S.safe_name(S.path_stem(F.col("path"))).alias("stem"))
        shown = items.select("media_id").crossJoin(shown.drop("stem")) if not S._is_folder(spark, args.reuse_ocr) and media.count() == 1 else shown.join(items, "stem").drop("stem")
        shown = shown.select("media_id", "id", F.col("ts").alias("timestamp"), F.col("text").alias("subtitle_text"))
    elif same_look and stored("screen"):
        shown = spark.read.parquet(folder("screen"))
    else:
        if look["source"]:
            from .sources import adapters

            for bare in adapters.find_captions(media, look["source"], args.crop_ratio).where("not captioned").orderBy("media_id").limit(20).collect():
                print(f"warning: {bare.media_id}: no text in the frames looked at", file=sys.stderr)
        shown = pipeline.screen(said, named_engine(args.reader, "reader", sees), **look)
        shown.write.mode("overwrite").parquet(folder("screen"))
        shown = spark.read.parquet(folder("screen"))
    gone = [f["media_id"] for f in failures]
    rows, _ = pipeline.against_screen(media, said, shown, p)
    rows = pipeline.kept(rows)
    return rows, C.summarize(rows, media.where(~F.col("path").isin(gone)).select(F.col("path").alias("media_id"))), failures


def _stem(spark, value: str) -> str:
    from pyspark.sql import functions as F

    from .functions.text import output_stem

    return spark.range(1).select(output_stem(F.lit(value))).first()[0]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    try:
        return dispatch(args, SparkSession.builder.appName("verbalign").getOrCreate())
    except (RuntimeError, FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
