"""Languages whose scripts are known: a small dimension, as literals and as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Code, name, recogniser's code, character reader's code, script ranges, default model.
LANGUAGES = {
    "en": ("English", "en", "eng", ((0x41, 0x5A), (0x61, 0x7A)), "small"),
    "hi": ("Hindi", "hi", "hin", ((0x0900, 0x097F),), "medium"),
    "kn": ("Kannada", "kn", "kan", ((0x0C80, 0x0CFF),), "medium"),
    "ta": ("Tamil", "ta", "tam", ((0x0B80, 0x0BFF),), "medium"),
    "te": ("Telugu", "te", "tel", ((0x0C00, 0x0C7F),), "medium"),
}
MULTI = "multi"
SPEECH_CHOICES = ("auto", *LANGUAGES)
SCREEN_CHOICES = (*LANGUAGES, MULTI)
SCHEMA = "code string, name string, speech_code string, screen_code string, ranges array<struct<lo:int,hi:int>>, default_model string"


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(code, *spec) for code, spec in LANGUAGES.items()], SCHEMA)


def spec(code: str) -> tuple:
    if code not in LANGUAGES:
        raise ValueError(f"unknown language {code!r}; one of {sorted(LANGUAGES)}")
    return LANGUAGES[code]


def ranges(code: str) -> tuple[tuple[int, int], ...]:
    if code == MULTI:
        return tuple(r for s in LANGUAGES.values() for r in s[3])
    return spec(code)[3]


def range_class(code: str) -> str:
    """The scripts' code points as the inside of a regular-expression class."""
    return "".join(rf"\x{{{lo:04X}}}-\x{{{hi:04X}}}" for lo, hi in ranges(code))


def screen_codes(code: str) -> str:
    """The reader's language argument: several are joined by +."""
    return "+".join(s[2] for s in LANGUAGES.values()) if code == MULTI else spec(code)[2]


def recommended_model(language: str, explicit: str | None = None) -> str:
    return explicit or (LANGUAGES[language][4] if language in LANGUAGES else "small")


def screen_language(speech_language: str | None, explicit: str | None = None) -> str:
    """An explicit choice, else the spoken language if its script is known, else all scripts."""
    return explicit or (speech_language if speech_language in LANGUAGES else MULTI)


def missing_packs(code: str, installed: set[str]) -> list[str]:
    return sorted(set(screen_codes(code).split("+")) - installed)
