"""HTML extraction by equivalence classes of tokens over a host's pages.

A page is one sequence of tokens: start tags, end tags and runs of text. A
token's occurrence vector says how often it stands on each page of its host.
Tokens are told apart by their path of enclosing elements, so the second list on
a page is another token than the first. Tokens with the same vector over enough
pages form an equivalence class. A class is valid if on every page it
recurs in whole rounds, and these and the rounds of other classes lie within or
apart from each other, never across (a round within another lies in one gap
between its tokens). Tokens that do not keep their rank in the round leave the
class, so its tokens come in one order everywhere. The valid classes, nested, are
the host's template; what stands between their tokens are slots.

Text that belongs to the template is fixed and dropped. Slots that hold nothing
but links are menus. Of the other slots, those in page furniture by element or
by class and id names (navigation, header, footer, aside, forms, adverts,
notices, comments) are dropped; the rest is the main text, cut into blocks at
block-level tags. The template decides outside of article and main elements
also on pages that have them; without a template such a page's main text is what
the elements hold. Inside them nothing counts as fixed and links are text, nor is
anything fixed where a page would keep no text: copies are not a template.

Occurrence vectors are sums over pages of a keyed hash of the page times the
count, so that classes come from one group-by with map-side combining; order and
nesting are checked page by page and only verdicts are grouped. A host with a
third of all pages is dealt to many tasks.

Defined results: a line break is white space inside its block; null or empty html
gives an empty text; a page without a host is its own host ''; a host with fewer
than ``MIN_PAGES`` pages has no template, and only the furniture rules apply; rows
that repeat a page_id are done each; a null page_id stays null.
"""

from __future__ import annotations

import bisect
import functools
import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_GROUPS, id_again, materialise

MIN_PAGES = 5
#: A class is part of the template if it is on this share of a host's pages; a class with tags of its own needs less, for hosts of several layouts.
SUPPORT, LAYOUT, LAYOUT_TAGS = 0.9, 0.2, 3
PAGES_A_TASK = 1000
#: Elements without an end tag, without text of their own, of page furniture, and that part blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select option button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What names of classes, ids and roles say of page furniture.
FURNITURE_NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|aside|footer\w*|masthead|topbar|toolbar|cookies?|consent|notice\w*|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|comments?|commentlist|respond|replies|reply|related|recommended|widget\w*|pagination|pager|complementary|contentinfo|navigation|search|skip\w*|legal|copyright|disclaimer)(?=$|[\s_-])", re.I)
#: Inside an article only these do.
INNER_NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|aside|footer\w*|cookies?|consent|notice\w*|popup|modal|newsletter|subscribe|signup|login|comments?|commentlist|respond|replies|reply|pagination|pager|navigation|search)(?=$|[\s_-])", re.I)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: Elements that a start tag closes if they are open, as in HTML's own rules.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("html body div section article main table ul ol dl tr tbody thead tfoot blockquote figure details fieldset td th nav header footer aside form".split())
SPACE = re.compile(r"[ \t\n\r\f\v]+")


LISTS = frozenset("ul ol dl table select".split())
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)")
CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")  # of <a href=/> the slash is the address
END = 0x5BD1E9955BD1E995


class Run:
    """A stretch of text: its token, place in the page's tokens, raw text, block number, and where it stands."""

    __slots__ = ("token", "at", "text", "block", "furniture", "article", "link")

    def __init__(self, token: int, at: int, text: str, block: int, furniture: bool, article: bool, link: bool):
        self.token, self.at, self.text, self.block, self.furniture, self.article, self.link = token, at, text, block, furniture, article, link


@functools.lru_cache(4096)
def kinds_of(name: str) -> tuple[str, ...]:
    return name, *(k for k, names in (("#box", CONTAINERS), ("#list", LISTS), ("#heading", HEADING)) if name in names)


class Stack:
    """Open elements, with the places of each kind, so that no search walks the stack."""

    def __init__(self):
        self.open: list[tuple] = []  # name, path, silent, furniture, article, link
        self.places: dict[str, list[int]] = {}

    def push(self, element: tuple) -> None:
        for k in kinds_of(element[0]):
            if k in self.places:
                self.places[k].append(len(self.open))
            else:
                self.places[k] = [len(self.open)]
        self.open.append(element)

    def cut(self, to: int) -> None:
        while len(self.open) > to:
            for k in kinds_of(self.open.pop()[0]):
                self.places[k].pop()

    def last(self, *kinds: str) -> int:
        """The innermost open element of these kinds; -1: none."""
        found = -1
        for k in kinds:
            p = self.places.get(k)
            if p and p[-1] > found:
                found = p[-1]
        return found


def key64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - 2**63


def parsed(source: str) -> tuple[list[int], list[int], list[Run]]:
    """A page's tokens in order, their kinds (text 0, inline tag 1, block tag 2), and its runs of text (those in articles with 0 or 1 for a token)."""
    tokens: list[int] = []
    tags: list[int] = []
    runs: list[Run] = []
    stack, root = Stack(), ("", 0, False, False, False, False)
    block, at, n, kinds = 0, 0, len(source), {}

    def tag(key: int, name: str) -> None:
        tokens.append(key)
        tags.append(1 if name in INLINE else 2)

    def text_run(raw: str) -> None:
        _, path, silent, furniture, article, link = stack.open[-1] if stack.open else root
        if raw and not silent:
            text, token = htmllib.unescape(raw) if "&" in raw else raw, 0
            if article:  # nothing is fixed there, so its text makes no token
                token = int(not text.isspace())
            elif plain := SPACE.sub(" ", text).strip():
                token = key64(f"{path}>{plain}")
                tokens.append(token)
                tags.append(0)
            runs.append(Run(token, len(tokens) - 1, text, block, furniture, article, link))

    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            text_run(source[at:])
            break
        if m.start() > at:
            text_run(source[at : m.start()])
        at = m.end() if m.end() > m.start() else m.start() + 1
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text_run(m[0][9:-3].replace("&", "&amp;"))
            continue
        if name == "br":  # a line's end is white space inside its block
            text_run(" ")
            continue
        inline = name in INLINE
        if not inline:
            block += 1
        if m[1]:
            k = stack.last(name)
            if k >= 0 and not (inline and stack.last("#box") > k):
                tag(stack.open[k][1] ^ END, name)
                stack.cut(k)
            continue
        if not inline:  # a block ends an open paragraph or heading, with what is open in it
            k = stack.last("p", *(("#heading",) if name in HEADING else ()))
            if k > stack.last("#box"):
                stack.cut(k)
        if name in CLOSES:
            k = stack.last(*CLOSES[name])
            if k > stack.last("#list"):
                stack.cut(k)
        _, path, silent, furniture, article, link = stack.open[-1] if stack.open else root
        rest, kind, bad = m[3], name, False
        if rest and not rest.isspace():
            marks = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(rest)}
            kind = ".".join([name, *sorted((marks.get("class") or marks.get("id") or "").split())])
            bad = marks.get("aria-hidden") == "true" or bool(HIDDEN.search(rest)) or "display:none" in marks.get("style", "").replace(" ", "")
            label = " ".join(marks.get(a, "") for a in ("class", "id", "role"))
            if label.strip() and name not in ("html", "body", "article", "main"):
                bad = bad or bool((INNER_NAMES if article else FURNITURE_NAMES).search(label))
        if (path, kind) not in kinds:
            kinds[path, kind] = key64(f"{path}/{kind}")
        own = kinds[path, kind]
        bad = bad or furniture or (name in FURNITURE and not (name == "header" and article))
        tag(own, name)
        if name in VOID or CLOSED.search(rest):
            continue
        if name in RAW:  # its end tag alone ends it
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            at = end.end()
            block += not inline
            continue
        stack.push((name, own, silent or name in SILENT, bad, article or name in ("article", "main"), link or name == "a"))
    return tokens, tags, runs


def host_of():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token, tag, pages, vector: by token, summed over a host's pages (a task's batch at a time)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            sums: dict[tuple[str, int], list] = {}
            for host, page, source in zip(f.host, f.page, f.html):
                tokens, tags, _ = parsed(source)
                kind = dict(zip(tokens, tags))
                for token, count in Counter(tokens).items():
                    s = sums.setdefault((host, token), [kind[token] > 0, 0, 0])
                    s[1] += 1
                    s[2] = (s[2] + page * count) % 2**61
            yield pd.DataFrame([(*k, *s) for k, s in sums.items()], columns=["host", "token", "tag", "pages", "vector"])

    return pages.mapInPandas(run, "host string, token long, tag boolean, pages long, vector long")


def arranged(tokens: list[int], classes: dict[int, int]) -> dict[int, tuple[bool, dict[int, tuple[int, int]], int, int]]:
    """By class of a page: whether it recurs in whole rounds that cross no other class; each token's first and last rank within a round; the class and gap around it.

    The gap around is 0, 0 outside of all classes, and -1, -1 if the rounds stand in different ones.
    """
    places: dict[int, list[int]] = {}
    for at, t in enumerate(tokens):
        c = classes.get(t)
        if c is not None:
            places.setdefault(c, []).append(at)
    out, rounds = {}, []
    for c, own in places.items():
        k = len({tokens[p] for p in own})
        ranks: dict[int, tuple[int, int]] = {}
        fine = len(own) % k == 0
        for i, p in enumerate(own):
            lo, hi = ranks.get(tokens[p], (k, -1))
            ranks[tokens[p]] = min(lo, i % k), max(hi, i % k)
        fine = fine and all(len({tokens[p] for p in own[i : i + k]}) == k for i in range(0, len(own), k))
        out[c] = [fine, ranks, None, None]
        if fine:
            rounds += [(own[i], own[i + k - 1], c) for i in range(0, len(own), k)]
    rounds.sort(key=lambda r: (r[0], -r[1]))
    around: list[tuple[int, int, int]] = []
    for first, last, c in rounds:
        while around and around[-1][1] < first:
            around.pop()
        inside = around[-1] if around else None
        place = (0, 0)
        if inside:
            own = places[inside[2]]
            gap = bisect.bisect_left(own, first)
            if last > inside[1] or bisect.bisect_left(own, last) != gap:
                out[c][0] = False  # it goes across a token of the class around it
            place = (inside[2], gap - bisect.bisect_left(own, inside[0]))
        out[c][2:] = place if out[c][2] in (None, place[0]) and out[c][3] in (None, place[1]) else (-1, -1)
        around.append((first, last, c))
    return {c: (bool(v[0]), v[1], v[2] or 0, v[3] or 0) for c, v in out.items()}


def by_host(rows: DataFrame, facts: DataFrame, hosts: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with ``facts`` (one row for each host); a host of many pages is dealt to many tasks.

    Hosts of over one ``HOT_GROUPS``-th of all pages are fewer than that, so they are told to all tasks.
    """
    share = max(PAGES_A_TASK, (hosts.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]) // HOT_GROUPS)
    hot = F.broadcast(hosts.where(F.col("all") > share).select("host", F.ceil(F.col("all") / share).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(hot, "host", "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), parts.cast("long")).cast("int")).drop("__parts")
    right = facts.join(hot, "host", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, ["host", "__part"], how).drop("__part")


def template_classes(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, cls, tokens, inside, gap: the valid classes of every host, nested. A table.

    ``inside`` and ``gap``: the class around it and the gap between that one's
    tokens; 0: none, -1: not always the same.
    """
    sums = occurrences(pages).groupBy("host", "token").agg(F.any_value("tag").alias("tag"), F.sum("pages").alias("pages"), (F.sum(F.col("vector").cast("decimal(38,0)")) % (2**61)).cast("long").alias("cls"))
    often = sums.join(hosts.where(F.col("all") >= MIN_PAGES), "host").where((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= LAYOUT * F.col("all")))
    # no more than a few pages' tokens for each host
    classes = often.groupBy("host", "cls").agg(F.collect_list("token").alias("tokens"), F.count_if("tag").alias("tags"), F.min("pages").alias("pages"), F.any_value("all").alias("all"))
    classes = materialise(classes.where((F.col("pages") >= SUPPORT * F.col("all")) | (F.col("tags") >= LAYOUT_TAGS)).select("host", "cls", "tokens"))
    lists = classes.groupBy("host").agg(F.collect_list("cls").alias("cls"), F.collect_list("tokens").alias("tokens"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict[int, int]] = {}
        for f in batches:
            seen: dict[tuple[str, int], list] = {}
            for host, source, cls, own in zip(f.host, f.html, f.cls, f.tokens):
                if host not in known:
                    if len(known) > 200:
                        known.clear()
                    known[host] = {int(t): int(c) for c, ts in zip(cls, own) for t in ts}
                for c, (fine, ranks, inside, gap) in arranged(parsed(source)[0], known[host]).items():
                    for t, (lo, hi) in ranks.items():
                        s = seen.setdefault((host, c, t), [True, lo, hi, inside, gap])
                        s[0] &= fine
                        s[1], s[2] = min(s[1], lo), max(s[2], hi)
                        if (s[3], s[4]) != (inside, gap):
                            s[3] = s[4] = -1
            yield pd.DataFrame([(*k, *s) for k, s in seen.items()], columns=["host", "cls", "token", "fine", "low", "high", "inside", "gap"])

    seen = by_host(pages.select("host", "html"), lists, hosts, "inner").select("host", "html", "cls", "tokens").mapInPandas(check, "host string, cls long, token long, fine boolean, low long, high long, inside long, gap long")
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.lit(-1).cast("long")).alias(c)
    verdict = seen.groupBy("host", "cls", "token").agg(F.every("fine").alias("fine"), F.min("low").alias("low"), F.max("high").alias("high"), one("inside"), one("gap"))
    # a token that changes its rank leaves its class; the others stay
    in_order = F.array_sort(F.collect_list(F.struct("low", "token")))["token"].alias("tokens")
    return materialise(verdict.where("fine and low = high").groupBy("host", "cls").agg(in_order, F.first("inside").alias("inside"), F.first("gap").alias("gap")))


def blocks_of(source: str, template: frozenset[int] = frozenset()) -> list[str]:
    """The main text's blocks. ``template``: tokens of the host's valid classes."""
    tokens, tags, runs = parsed(source)
    # a slot is what stands between two block tags of the template
    slots, menus = [], set()
    if template:
        slots = np.cumsum([k == 2 and t in template for t, k in zip(tokens, tags)]).tolist()
        linked: dict[int, list[int]] = {}
        for r in runs:
            if r.token and not r.article and r.token not in template:
                linked.setdefault(slots[r.at], [0, 0])[r.link] += 1
        menus = {s for s, (words, links) in linked.items() if links > 1 and not words}
    kept = [r for r in runs if not r.furniture]
    if not template and any(r.article and r.token for r in kept):
        kept = [r for r in kept if r.article]

    def outside(r: Run) -> bool:
        return bool(template) and not r.article and bool(r.token) and (r.token in template or slots[r.at] in menus)

    if all(outside(r) for r in kept if r.token):
        menus, template = set(), frozenset()
    out: list[list] = []
    for r in kept:
        if not out or out[-1][0] != r.block:
            out.append([r.block, []])
        if not outside(r):
            out[-1][1].append(r.text)
    texts = (re.sub(r"\s+", " ", "".join(parts)).strip() for _, parts in out)
    return [t for t in texts if t]


def extract_main_text(pages: DataFrame, use_template: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    page_id = F.col("page_id").cast("long")
    rows = pages.select(F.coalesce(page_id, F.lit(0)).alias("id"), page_id.isNull().alias("no_id"), "url", host_of().alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.select("host", "html", F.pmod(F.xxhash64("id", "url"), F.lit(2**30)).alias("page"))
    hosts = materialise(rows.groupBy("host").agg(F.count("*").alias("all")))
    found = (template_classes(keyed, hosts) if use_template else keyed.select("host", F.lit(0).alias("cls"), F.array(F.lit(0).cast("long")).alias("tokens")).limit(0)).groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("template"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[str, frozenset[int]] = {}
        for f in batches:
            texts = []
            for host, source, template in zip(f.host, f.html, f.template):
                if host not in sets:
                    if len(sets) > 200:
                        sets.clear()
                    sets[host] = frozenset(template.tolist()) if template is not None else frozenset()
                texts.append("\n\n".join(blocks_of(source, sets[host])))
            yield pd.DataFrame({"id": f.id.to_numpy(), "no_id": f.no_id.to_numpy(), "url": f.url.to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]})

    joined = by_host(rows, found, hosts, "left").select("host", "id", "no_id", "url", "html", "template")
    return joined.mapInPandas(run, "id long, no_id boolean, url string, text string, n_chars long").select(id_again("page_id"), "url", "text", "n_chars")


def op2_main_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
