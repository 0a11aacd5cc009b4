"""Format-preserving Feistel pseudonyms of personal data, in DataFrame functions only.

Values are found by pattern, *validated* (Luhn and mod-97 checks, octet and
calendar ranges, number-plan rules), and replaced by a keyed permutation within
their own format: digits stay digits, letters keep their case, separators stay
in place, check digits are computed anew, and a date becomes another date. The
permutation works on an array of symbols with a radix each: rounds add a keyed
digest of one half to the other half, symbol by symbol. Where a format has
values that aren't valid, the permutation walks on until it meets a valid one.
So equal values get equal pseudonyms in every document, different values
different ones, and no table of values is kept.

| kind | found | permuted |
| card | 13 to 19 digits, Luhn | all digits but the check digit, which is set |
| iban | country, mod 97 | account part; check digits are set |
| phone | 10-digit plan, country code kept | area and line, both valid again |
| ssn | valid area, group, serial | all digits, valid again |
| ip | four octets | as a 32-bit address |
| date | 1900-2099; ISO, d/m/y, m/d/y, d.m.y | day of those two centuries |
| email | local part @ domain | the local part |
| secret | named password, token or key; access key ids | its value |

Defined results: a null text stays null, an empty one empty; a value that fails
its check is left alone; other columns are ignored; rows that repeat stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

ROUNDS = 8
FIRST, LAST = "1900-01-01", "2099-12-31"
DAYS = 73_049  # from FIRST to LAST
WALK = 200  # steps; a format's valid share is 0.16 at least, so this is never reached

PATTERNS = {
    "email": r"[A-Za-z0-9_][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?i:password|passwd|secret|token|api[_-]?key)[ ]?[=:][ ]?[\"']?[A-Za-z0-9_/+-]{8,}+",
    "access": r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2})(?![0-9A-Za-z])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "ip": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
ANY = r"(?<![A-Za-z0-9_])(?:" + "|".join(PATTERNS.values()) + ")"
PHONE_OK = r"[2-9][0-9]{2}[^0-9]*[2-9][0-9]{2}[^0-9]*[0-9]{4}$"
#: With a country code or parentheses a number is a phone number whatever its area code; these are the areas not in PHONE_OK.
PHONE_MARKED = r"^(?:\+[0-9]{1,3}[ .-]?\(?|\()[01][0-9]{2}[^0-9]+[2-9][0-9]{2}[^0-9]+[0-9]{4}$"
OTHER_AREA = r"^[01][0-9]{2}[2-9][0-9]{2}[0-9]{4}$"
SSN_OK = r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def permuted(symbols: Column, radices: Column, key: str, tweak: Column) -> Column:
    """The keyed permutation of an array<bigint>, each symbol below its radix."""

    def one_round(acc: Column, r: Column) -> Column:
        half, even = F.floor(F.size(acc) / 2).cast("int"), r % 2 == 0
        other = F.when(even, F.slice(acc, half + 1, F.size(acc))).otherwise(F.slice(acc, F.lit(1), half))
        word = F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(other.cast("array<string>"), ","))

        def symbol(w: Column) -> Callable[[Column, Column], Column]:
            def shift(x: Column, i: Column) -> Column:
                digest = F.sha2(F.concat_ws("|", w, F.floor(i / 4).cast("string")), 256)
                add = F.conv(F.substring(digest, (i % 4) * 15 + 1, F.lit(15)), 16, 10).cast("long")
                return F.when(even == (i < half), F.pmod(x + add, F.element_at(radices, i + 1))).otherwise(x)

            return shift

        return let(word, lambda w: F.transform(acc, symbol(w)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), symbols, one_round)


def permuted_text(s: Column, fixed: Callable[[Column], Column], key: str, tweak: str, hexadecimal: Column | None = None) -> Column:
    """``s`` with its letters and digits permuted within their classes, but for places where ``fixed``."""
    hexa = F.lit(False) if hexadecimal is None else hexadecimal

    def radix(c: Column, i: Column) -> Column:
        free = F.when(hexa & c.rlike("^[0-9a-f]$"), 16).when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26).otherwise(1)
        return F.when(fixed(i), 1).otherwise(free).cast("long")

    def body(cs: Column) -> Column:
        def with_radices(rs: Column) -> Column:
            def symbol(c: Column, i: Column) -> Column:
                r = F.element_at(rs, i + 1)
                base = F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[A-Z]$"), 65).otherwise(97)
                return F.when(r == 16, F.conv(c, 16, 10).cast("long")).when(r > 1, (F.ascii(c) - base).cast("long")).otherwise(0)

            def letter(x: Column, i: Column) -> Column:
                c, r = F.element_at(cs, i + 1), F.element_at(rs, i + 1)
                base = F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[A-Z]$"), 65).otherwise(97)
                return F.when(r == 16, F.lower(F.hex(x))).when(r > 1, F.char(x + base)).otherwise(c)

            shape = F.concat_ws(",", F.lit(tweak), rs.cast("array<string>"))
            return F.array_join(F.transform(permuted(F.transform(cs, symbol), rs, key, shape), letter), "")

        return let(F.transform(cs, radix), with_radices)

    return let(chars(s), body)


def walked(start: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """The first valid value after ``start`` on the permutation's cycle."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(start), lambda v, _: F.when(valid(v), v).otherwise(step(v)))


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column, start: int) -> Column:
    """Luhn sum; ``start`` 0: the last digit counts singly."""
    each = F.transform(F.reverse(chars(digits)), lambda c, i: let(c.cast("int") * (1 + (i + start) % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def mod97(account: Column) -> Column:
    """Of an IBAN's characters, without spaces, its first four moved behind."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    number = F.transform(chars(turned), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(number, F.lit(0), lambda a, x: F.pmod(a * F.when(x > 9, 100).otherwise(10) + x, F.lit(97)))


def refilled(m: Column, new: Column) -> Column:
    """``m`` with its letters and digits replaced in order by those of ``new``, separators kept."""
    nth = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    return let(new, lambda n: F.array_join(F.transform(chars(m), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(n, nth(i), F.lit(1))).otherwise(c)), ""))


def card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        new = permuted_text(body, lambda i: F.lit(False), key, "card")
        check = lambda b: F.concat(b, F.pmod(F.lit(10) - luhn(b, 1) % 10, F.lit(10)).cast("string"))
        return F.when(F.pmod(luhn(d, 0), F.lit(10)) == 0, refilled(m, let(new, check))).otherwise(m)

    return let(only_digits(m), made)


def iban(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        def check(b: Column) -> Column:
            zero = F.concat(F.substring(b, 1, 2), F.lit("00"), F.substring(b, F.lit(5), F.length(b)))
            return F.concat(F.substring(b, 1, 2), F.lpad((F.lit(98) - mod97(zero)).cast("string"), 2, "0"), F.substring(b, F.lit(5), F.length(b)))

        new = permuted_text(d, lambda i: i < 4, key, "iban")
        return F.when(mod97(d) == 1, refilled(m, let(new, check))).otherwise(m)

    return let(F.replace(m, F.lit(" "), F.lit("")), made)


def phone(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        step = lambda v: permuted_text(v, lambda i: F.lit(False), key, "phone")
        # the two kinds of areas are kept apart, so that each is permuted in itself
        new = F.when(m.rlike(PHONE_OK), walked(F.right(d, F.lit(10)), step, lambda v: v.rlike(PHONE_OK))).otherwise(walked(F.right(d, F.lit(10)), step, lambda v: v.rlike(OTHER_AREA)))
        return refilled(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), new))

    return F.when(m.rlike(PHONE_OK) | m.rlike(PHONE_MARKED), let(only_digits(m), made)).otherwise(m)


def ssn(m: Column, key: str) -> Column:
    step = lambda v: permuted_text(v, lambda i: F.lit(False), key, "ssn")
    return F.when(m.rlike(SSN_OK), walked(m, step, lambda v: v.rlike(SSN_OK))).otherwise(m)


def ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    made = permuted(octets, F.array_repeat(F.lit(256).cast("long"), 4), key, F.lit("ip"))
    return F.when(F.forall(octets, lambda x: x < 256), F.array_join(made.cast("array<string>"), ".")).otherwise(m)


def date(m: Column, key: str) -> Column:
    sizes = F.array(F.lit(270).cast("long"), F.lit(271).cast("long"))

    def moved(text: Column, form: str) -> Column:
        day = F.datediff(F.try_to_timestamp(text, F.lit(form)).cast("date"), F.to_date(F.lit(FIRST))).cast("long")
        number = lambda a: a[0] * 271 + a[1]
        split = lambda d: F.array(F.floor(d / 271).cast("long"), d % 271)
        to = walked(split(day), lambda a: permuted(a, sizes, key, F.lit("date")), lambda a: number(a) < DAYS)
        return F.when(day.between(0, DAYS - 1), F.date_format(F.date_add(F.to_date(F.lit(FIRST)), number(to).cast("int")), form))

    dots = F.when(m.rlike(r"^[0-9]{4}"), moved(m, "yyyy-MM-dd")).when(m.rlike(r"\..*\."), moved(m, "dd.MM.yyyy")).when(m.rlike("/.*/"), F.coalesce(moved(m, "dd/MM/yyyy"), moved(m, "MM/dd/yyyy")))
    return F.coalesce(dots, m)


def email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permuted_text(local, lambda i: F.lit(False), key, "email"), F.substring(m, F.length(local) + 1, F.length(m)))


def secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9_/+-]+$", 0)
    named = F.substring(m, F.lit(1), F.length(m) - F.length(value))
    return F.concat(named, permuted_text(value, lambda i: F.lit(False), key, "secret", value.rlike("^[0-9a-f]+$")))


def access(m: Column, key: str) -> Column:
    return permuted_text(m, lambda i: i < 4, key, "access")


MAKERS = {"email": email, "secret": secret, "access": access, "iban": iban, "date": date, "ssn": ssn, "phone": phone, "ip": ip, "card": card}


def pseudonym(m: Column, key: str) -> Column:
    """Of a value found by ``ANY``: by the first pattern that it is, whole."""
    out = None
    for kind, pattern in PATTERNS.items():
        rule = f"^(?:{pattern})$"
        out = F.when(m.rlike(rule), MAKERS[kind](m, key)) if out is None else out.when(m.rlike(rule), MAKERS[kind](m, key))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str = "example key", text: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_values: how many values were replaced."""
    d = docs.select("doc_id", F.col(text).cast("string").alias("raw"))
    d = d.withColumn("found", F.regexp_extract_all("raw", F.lit(ANY), F.lit(0)))
    d = d.withColumn("made", F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(m, key))).otherwise(F.col("found")))
    between = F.split("raw", ANY, -1)
    joined = F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("made"), i), F.lit("")))), "")
    changed = F.size(F.filter(F.arrays_zip("found", "made"), lambda z: z["found"] != z["made"]))
    return d.select("doc_id", F.when(F.size("found") > 0, joined).otherwise(F.col("raw")).alias("text"), F.when(F.size("found") > 0, changed).otherwise(0).cast("long").alias("n_values"))


def op7_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir))
