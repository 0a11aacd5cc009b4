"""DuckDB counterparts of the Column functions, as SQL text."""

from __future__ import annotations

#: Fixed values, written out here so that they check those of the library.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
PUNCTUATION = ".,!?;:\"'()[]{}<>|/\\`~@#$%^&*_+=-\u2014\u2013\u2026\u0964\u0965"
FOLDS = {"\u00df": "ss", "\u00b5": "\u03bc", "\u017f": "s", "\u0149": "\u02bcn"}
INDIC_FROM, INDIC_TO = "\u0901\u0949\u093c\u0cbc\u0c3c", "\u0902\u094b"
WHITE = r'[\s\x0B\x1C-\x1F\x85\p{Z}]'
ALPHA = r'\p{L}\x{0C5D}\x{0CDD}'
STOCK_PHRASES = ("thank you for watching", "thanks for watching", "please subscribe", "like and subscribe", "please like and subscribe", "subscribe to my channel", "subtitles by", "amara.org")
SCRIPTS = {"en": '\\x{0041}-\\x{005A}\\x{0061}-\\x{007A}', "multi": '\\x{0041}-\\x{005A}\\x{0061}-\\x{007A}\\x{0900}-\\x{097F}\\x{0C80}-\\x{0CFF}\\x{0B80}-\\x{0BFF}\\x{0C00}-\\x{0C7F}'}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def normalize(c: str) -> str:
    c = f"translate(nfc_normalize(coalesce({c}, '')), {q(ZERO_WIDTH)}, '')"
    c = f"lower(replace(replace({c}, chr(10), ' '), chr(13), ' '))"
    for a, b in FOLDS.items():
        c = f"replace({c}, {q(a)}, {q(b)})"
    c = f"translate({c}, {q(INDIC_FROM)}, {q(INDIC_TO)})"
    c = f"translate({c}, {q(PUNCTUATION)}, {q(' ' * len(PUNCTUATION))})"
    return f"trim(regexp_replace({c}, '{WHITE}+', ' ', 'g'))"


def casefold(c: str) -> str:
    c = f"lower({c})"
    for a, b in FOLDS.items():
        c = f"replace({c}, {q(a)}, {q(b)})"
    return c


def script_ratio(c: str, code: str) -> str:
    letters = f"regexp_replace(coalesce({c}, ''), '[^{ALPHA}]', '', 'g')"
    inside = f"regexp_replace({letters}, '[^{SCRIPTS[code]}]', '', 'g')"
    return f"coalesce(length({inside})::double / nullif(length({letters}), 0), 0.0)"


def is_garbage(c: str, code: str = "multi") -> str:
    s = strip(f"coalesce({c}, '')")
    alnum = rf"length(regexp_replace({s}, '[^{ALPHA}\p{{N}}]', '', 'g'))"
    return f"(length({s}) < 2 or {alnum} < 0.4 * length({s}) or {script_ratio(s, code)} < 0.25)"


def is_loop(s: str) -> str:
    """Of stripped text that is a plain column name."""
    stock = " or ".join(f"contains(lower({s}), {q(p)})" for p in STOCK_PHRASES)
    period = " or ".join(f"substr({s}, {w + 1}) = substr({s}, 1, length({s}) - {w})" for w in range(2, 6))
    words = f"string_split_regex({s}, '{WHITE}+')"
    few = f"(len({words}) > 5 and len(list_distinct({words})) <= greatest(2, cast(floor(len({words}) * 15 / 100.0) as bigint)))"
    half = f"(length({s}) > 60 and substr({s}, 1, length({s}) // 2) = substr({s}, length({s}) // 2 + 1, length({s}) // 2))"
    return f"(length({s}) > 0 and ({stock} or (length({s}) >= 20 and ({period} or {few} or {half}))))"


def safe_name(c: str) -> str:
    s = rf"""regexp_replace({c}, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')"""
    s = rf"regexp_replace(regexp_replace({s}, '[^\x20-\x7E]', '', 'g'), '_+', '_', 'g')"
    s = f"regexp_replace({s}, '^[_. ]+|[_. ]+$', '', 'g')"
    return f"case when length({s}) > 0 then left({s}, 80) else 'media' end"


def path_stem(c: str) -> str:
    name = f"list_extract(string_split(regexp_replace({c}, '/+$', ''), '/'), -1)"
    return rf"regexp_replace({name}, '([^.])\.[^.]+$', '\1')"


def stable_name(url: str) -> str:
    path = f"regexp_replace(regexp_replace({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')"
    stem = path_stem(path)
    return f"(case when length({stem}) > 0 then {safe_name(stem)} else 'media' end) || '_' || left(sha256({url}), 12)"


def common(a: str, b: str) -> str:
    """Length of the longest common subsequence: rows of the table of prefixes, one list_reduce inside another."""
    row = f"list_transform(range(0, length({b}) + 1), lambda i: 0::bigint)"
    codes = f"list_transform(string_split({a}, ''), lambda ch: [unicode(ch)::bigint])"
    places = f"list_transform(range(1, length({b}) + 1), lambda j: [j::bigint])"
    cell = f"case when unicode(substr({b}, place[1], 1)) = one[1] then row[place[1]] + 1 else greatest(row[place[1] + 1], acc[place[1]]) end"
    step = f"list_reduce(list_prepend([0::bigint], {places}), lambda acc, place: list_append(acc, {cell}))"
    return f"list_extract(list_reduce(list_prepend({row}, {codes}), lambda row, one: {step}), -1)"
