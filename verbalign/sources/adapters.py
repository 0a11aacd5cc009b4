"""Boundaries to outside engines: recognisers, readers, decoders, downloads.

The engines themselves are not part of the library. A recogniser, reader or
source of frames is any object with the methods named here; ``transcribe``,
``read_screen`` and ``find_captions`` run it inside the executors, one per
Python worker. The fakes are deterministic, for tests and for trying a pipeline
out.
"""

from __future__ import annotations

import shutil
import subprocess
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import image

RAW = "media_id string, seq long, start double, end double, text string, avg_logprob double, error string"
SEEN = (
    "media_id string, id int, frame int, ts double, readable boolean, sharpness double, "
    "crop_region struct<x:int,y:int,width:int,height:int>, "
    "words array<struct<variant:string,psm:int,ordinal:int,pos:int,text:string,conf:string>>"
)
#: Frames of one item within so many seconds are read by one task, in order of time.
STRETCH = 600


class Recogniser(Protocol):
    def segments(self, path: str) -> list[tuple[float, float, str, float]]:
        """start, end, text, mean log probability of what is said."""


class Reader(Protocol):
    """Either reads images, of a source of frames, or fetches its frames itself."""

    def read(self, picture: np.ndarray, psm: int) -> list[tuple[str, str]]:
        """Words and confidences of an image."""

    def words(self, path: str, ts: float, variant: str, psm: int) -> list[tuple[str, str]] | None:
        """Words and confidences of a frame's reading; None: no frame."""


class Frames(Protocol):
    def frame(self, path: str, ts: float) -> np.ndarray | None:
        """The frame shown at that second (uint8; grey, or blue, green, red); None: it can't be read."""

    def duration(self, path: str) -> float | None:
        """Length in seconds; None or 0: unknown."""


class Fetcher(Protocol):
    def fetch(self, url: str, directory: str) -> str:
        """Path of the fetched media."""


class FakeRecogniser:
    """Some words of the path, timed evenly."""

    def segments(self, path: str) -> list[tuple[float, float, str, float]]:
        n = 2 + zlib.crc32(path.encode()) % 4
        return [(2.0 * i, 2.0 * i + 1.8, f"segment {i} of {path.rsplit('/', 1)[-1]}", -0.2) for i in range(n)]


class FakeReader:
    """What the fake recogniser says at that time."""

    def words(self, path: str, ts: float, variant: str, psm: int) -> list[tuple[str, str]] | None:
        for start, end, text, _ in FakeRecogniser().segments(path):
            if start <= ts <= end:
                return [(w, str(60 + zlib.crc32(f"{w}{variant}".encode()) % 40)) for w in text.split()]
        return []


def transcribe(media: DataFrame, make: Callable[[], Recogniser]) -> DataFrame:
    """Raw segments of every media path; an item whose recognition fails has one row, seq -1, with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for b in batches:
            rows = []
            for p in b.path:
                try:
                    rows += [(p, i, *s, None) for i, s in enumerate(engine.segments(p))]
                except Exception as e:  # one item's failure is a row of its own
                    rows.append((p, -1, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])

    return media.select("path").mapInPandas(run, RAW)


def read_screen(frames: DataFrame, make: Callable[[], Reader], grid: list[tuple[str, int, int]], source: Callable[[], Frames] | None = None, ratio: float = 0.15, dynamic: bool = True) -> DataFrame:
    """What is read on frames (media_id, id, frame, ts): one row each, with every reading of ``grid`` (variant, psm, ordinal).

    With a ``source``, its frames are cut to the caption band, made into the
    variants and given to the reader's ``read``; else the reader fetches
    frames itself. A frame that can't be had is not readable and has no words.
    """

    def look(reader, show, path: str, ts: float) -> tuple:
        if show is None:
            got = [reader.words(path, ts, v, m) for v, m, _ in grid]
            whole, sharp, region = any(g is not None for g in got), 0.0, None
        else:
            picture = show.frame(path, ts)
            if picture is None:
                return False, 0.0, None, []
            region = (image.dynamic_bounds if dynamic else image.fixed_bounds)(picture, ratio)
            made = image.variants(image.crop(picture, region), tuple({v for v, _, _ in grid}))
            got = [reader.read(made[v], m) if v in made else [] for v, m, _ in grid]
            whole, sharp, region = True, image.sharpness(picture), dict(zip(("x", "y", "width", "height"), region, strict=True))
        words = [dict(variant=v, psm=m, ordinal=o, pos=k, text=t, conf=c) for (v, m, o), g in zip(grid, got, strict=True) for k, (t, c) in enumerate(g or [])]
        return whole, sharp, region, words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, show = make(), source() if source else None
        for b in batches:
            rows = [(r.media_id, r.id, r.frame, r.ts, *look(reader, show, r.media_id, r.ts)) for r in b.itertuples()]
            yield pd.DataFrame(rows, columns=["media_id", "id", "frame", "ts", "readable", "sharpness", "crop_region", "words"])

    stretch = F.floor(F.col("ts") / STRETCH)
    together = frames.select("media_id", "id", "frame", "ts").repartition("media_id", stretch).sortWithinPartitions("media_id", "ts")
    return together.mapInPandas(run, SEEN)


def find_captions(media: DataFrame, source: Callable[[], Frames], ratio: float = 0.15) -> DataFrame:
    """media_id, captioned, duration of media paths: whether frames spread over an item show text.

    It holds from one frame with text on, and two end the search; an item that can't be read counts as captioned.
    """

    def present(show, path: str) -> tuple[bool, float | None]:
        try:
            length = show.duration(path)
        except Exception:  # noqa: BLE001 - an engine's own errors
            length = None
        if not length or length <= 0:
            return True, None
        hits = 0
        for i in range(1, image.PRESENCE_FRAMES + 1):
            try:
                picture = show.frame(path, length * i / (image.PRESENCE_FRAMES + 1))
            except Exception:  # noqa: BLE001
                picture = None
            hits += picture is not None and image.captioned(picture, ratio)
            if hits == image.PRESENCE_HITS:
                break
        return hits > 0, round(float(length), 3)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        show = source()
        for b in batches:
            yield pd.DataFrame([(p, *present(show, p)) for p in b.path], columns=["media_id", "captioned", "duration"]).astype({"duration": "float64"})

    return media.select("path").mapInPandas(run, "media_id string, captioned boolean, duration double")


def probe_durations(media: DataFrame, command: str = "ffprobe") -> DataFrame:
    """media_id, duration: seconds to three places, null where the command is missing or can't tell."""

    def seconds(path: str) -> float | None:
        try:
            told = subprocess.run([command, "-v", "error", "-show_entries", "format=duration", "-of", "csv=p=0", path], capture_output=True, text=True, check=True, timeout=60)
            return round(float(told.stdout.strip()), 3)
        except (OSError, subprocess.SubprocessError, ValueError):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = shutil.which(command) is not None
        for b in batches:
            yield pd.DataFrame({"media_id": b.path, "duration": pd.Series([seconds(p) if there else None for p in b.path], index=b.index, dtype="float64")})

    return media.select("path").mapInPandas(run, "media_id string, duration double")


def engine(name: str) -> Callable:
    """What ``module:factory`` names: called without arguments in each worker, it makes an engine."""
    import importlib

    module, _, factory = name.partition(":")
    if not factory:
        raise ValueError(f"an engine is named module:factory, not {name!r}")
    try:
        made = getattr(importlib.import_module(module), factory)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"no engine {name!r}: {e}") from e
    return made


def resolve(value: str, fetcher: Fetcher | None, directory: str) -> str:
    """A local path as it is; a URL through the fetcher."""
    if not value.lower().startswith(("http:", "https:")):
        return value
    if fetcher is None:
        raise RuntimeError(f"no fetcher for {value}")
    return fetcher.fetch(value, directory)
