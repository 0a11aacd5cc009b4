"""Text functions as Column expressions: normalisation, predicates, formats and names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import languages

#: Fixed values of the normalisation.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
PUNCTUATION = ".,!?;:\"'()[]{}<>|/\\`~@#$%^&*_+=-—–…।॥"
FOLDS = {"ß": "ss", "µ": "μ", "ſ": "s", "ŉ": "ʼn"}
INDIC_FROM, INDIC_TO = "ँॉ़಼఼", "ंो"
#: Python's white space, spelled out: Java's \s is ASCII only.
WHITE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
#: Letters (and two that older character tables lack).
ALPHA = r"\p{L}\x{0C5D}\x{0CDD}"
#: Phrases that speech models make up in silence.
STOCK_PHRASES = ("thank you for watching", "thanks for watching", "please subscribe", "like and subscribe", "please like and subscribe", "subscribe to my channel", "subtitles by", "amara.org")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def once(c: Column) -> Column:
    """``c``, which the optimizer then neither copies into a filter nor evaluates for each use: it counts as not deterministic."""
    return F.when(F.spark_partition_id() >= 0, c)


def strip(c: Column) -> Column:
    """Python's strip: white space of any script at both ends."""
    return F.regexp_replace(c, rf"^{WHITE}+|{WHITE}+$", "")


def casefold(c: Column) -> Column:
    out = F.lower(c)
    for letter, folded in FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(folded))
    return out


#: What becomes one space: white space and punctuation.
BETWEEN = "[" + WHITE[1:-1] + "".join(f"\\{c}" if c.isascii() else c for c in PUNCTUATION) + "]+"


def normalize_composed(c: Column) -> Column:
    """Normalisation of text that is in composed form already: wholly inside code generation."""
    c = casefold(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{ZERO_WIDTH}]", ""))
    c = F.when(c.rlike(f"[{INDIC_FROM}]"), F.translate(c, INDIC_FROM, INDIC_TO)).otherwise(c)
    return F.trim(F.regexp_replace(c, BETWEEN, " "))


def normalize_text(c: Column) -> Column:
    """Comparable text. Below U+0300 all text is composed; the kernel gets the other texts alone, and nulls for these."""
    return normalize_composed(F.coalesce(_nfc(F.when(c.rlike(r"[^\x{0}-\x{2FF}]"), c)), c))


def script_ratio(c: Column, code: str) -> Column:
    """Letters of the language's scripts among all letters; 0 without letters."""
    letters = F.regexp_replace(F.coalesce(c, F.lit("")), f"[^{ALPHA}]+", "")
    inside = F.regexp_replace(letters, f"[^{languages.range_class(code)}]+", "")
    return F.coalesce(F.try_divide(F.length(inside).cast("double"), F.length(letters).cast("double")), F.lit(0.0))


def garbage(s: Column, script: Column) -> Column:
    """Of stripped text and its script ratio: shorter than 2, or under 40 % letters and digits, or under 25 % of the script."""
    alnum = F.length(F.regexp_replace(s, rf"[^{ALPHA}\p{{N}}]+", ""))
    return (F.length(s) < 2) | (alnum < 0.4 * F.length(s)) | (script < 0.25)


def is_garbage(c: Column, code: str = languages.MULTI) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    return garbage(s, script_ratio(s, code))


def is_loop(c: Column) -> Column:
    return loops(strip(F.coalesce(c, F.lit(""))))


def loops(s: Column) -> Column:
    """Of stripped text: a stock phrase, a period of 2 to 5 characters, few distinct words, or a doubled half."""
    n, low = F.length(s), F.lower(s)
    stock = F.lit(False)
    for phrase in STOCK_PHRASES:
        stock = stock | F.contains(low, F.lit(phrase))
    period = F.lit(False)
    for w in range(2, 6):
        # text of period w: without its first w characters it is its own beginning
        period = period | (F.substring(s, F.lit(w + 1), n) == F.substring(s, F.lit(1), n - w))
    words = F.split(s, rf"{WHITE}+")
    few = (F.size(words) > 5) & (F.size(F.array_distinct(words)) <= F.greatest(F.lit(2), F.floor(F.size(words) * F.lit(15) / F.lit(100)).cast("int")))
    half = F.floor(n / 2).cast("int")
    doubled = (n > 60) & (F.substring(s, F.lit(1), half) == F.substring(s, half + 1, half))
    return (n > 0) & (stock | ((n >= 20) & (period | few | doubled)))


def srt_timestamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm; a negative time is an error."""
    ms = F.bround(seconds * 1000, 0).cast("long")
    shown = F.format_string("%02d:%02d:%02d,%03d", F.expr("0L") + F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    return F.when(seconds < 0, F.raise_error(F.lit("SRT timestamps cannot be negative")).cast("string")).otherwise(shown)


def clock(seconds: Column) -> Column:
    """H:MM:SS.ss, or MM:SS.ss under an hour; null: empty."""
    minutes = F.floor(seconds / 60)
    rest = seconds - minutes * 60
    hours = F.floor(minutes / 60)
    long_ = F.format_string("%d:%02d:%05.2f", hours, minutes % 60, rest)
    return F.when(seconds.isNull(), "").when(hours > 0, long_).otherwise(F.format_string("%02d:%05.2f", minutes, rest))


def duration(seconds: Column) -> Column:
    """Hh Mm Ss, or Mm Ss; null: empty."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(seconds.isNull(), "").when(h > 0, F.format_string("%dh %dm %ds", h, m, s % 60)).otherwise(F.format_string("%dm %ds", m, s % 60))


def elapsed(seconds: Column) -> Column:
    """12.3s under a minute, then Mm Ss."""
    s = seconds.cast("long")
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).otherwise(F.format_string("%dm %ds", F.floor(s / 60), s % 60))


#: Levels of a score and the names under which a page styles them.
SCORE_LEVELS = ((0.9, "high"), (0.8, "good"), (0.65, "fair"), (0.0, "low"))


def score_level(score: Column) -> Column:
    out = None
    for least, name in SCORE_LEVELS[:-1]:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise(SCORE_LEVELS[-1][1])


def score_percent(score: Column) -> Column:
    return (F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))) * 100).cast("int")


def percent(x: Column) -> Column:
    """A share as a whole percentage, half to even; null: empty."""
    return F.coalesce(F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%")), F.lit(""))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def is_url(c: Column) -> Column:
    return c.rlike("^(?i)https?:")


def url_host(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


#: Hosts of one video site.
VIDEO_HOSTS = ("youtube.com", "youtu.be", "www.youtube.com", "m.youtube.com")
FETCHED_HOSTS = frozenset(VIDEO_HOSTS)  # pages of these hosts are fetched by a tool, not read as media


def is_video_host(c: Column) -> Column:
    return F.coalesce(url_host(c).isin(*VIDEO_HOSTS), F.lit(False))


def video_id(c: Column) -> Column:
    """The video's id on that site: the path of a short link, else the v parameter."""
    short = F.regexp_replace(F.try_parse_url(c, F.lit("PATH")), "^/+|/+$", "")
    return F.when(url_host(c) == "youtu.be", short).when(is_video_host(c), F.try_parse_url(c, F.lit("QUERY"), F.lit("v")))


def safe_name(c: Column, longest: int = 80) -> Column:
    """A file name of printable ASCII; 'media' if nothing is left."""
    s = F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_")
    s = F.regexp_replace(F.regexp_replace(s, r"[^\x20-\x7E]", ""), "_+", "_")
    s = F.regexp_replace(s, "^[_. ]+|[_. ]+$", "")
    return F.when(F.length(s) > 0, F.left(s, F.lit(longest))).otherwise("media")


def path_stem(c: Column) -> Column:
    """The last part of a path without its last suffix."""
    name = F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def stable_name(url: Column, suffix: str = "") -> Column:
    """A safe stem and the first 12 digits of the URL's SHA-256."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    stem = path_stem(path)
    return F.concat(safe_name(F.when(F.length(stem) > 0, stem).otherwise("media")), F.lit("_"), F.left(F.sha2(url, 256), F.lit(12)), F.lit(suffix))


def output_stem(value: Column) -> Column:
    stem = path_stem(value)
    return F.when(is_url(value), stable_name(value)).otherwise(safe_name(F.when(F.length(stem) > 0, stem).otherwise(value)))
