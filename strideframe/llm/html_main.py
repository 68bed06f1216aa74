"""Main text of pages by line-block distribution.

Markup is stripped to lines, one for each block of the page. A line's signal is the length of its text outside links, times the
weights of the parts it stands in. Signals are summed over sliding windows of WINDOW lines, which end at borders of parts. Text surges where the
sums reach SHARE of the page's highest one, and dives where they fall below it. From surge to dive the dense lines (those that carry such a window alone) are kept, and all
that stands between them; beside them the lines that stand in one of their containers (title, short last paragraphs, lists), but not what lies outside these. So a footer next to the text goes
by its length, whatever it is called. Dense lines of one container, and what is between them, belong together even if the sums dive in between. An article or main
part is kept with all its lines if any of its windows is that high.

Weights shift the signal, and length can outweigh them: parts marked as something else than main text (menus, page headers and footers,
sidebars, notices, adverts, forms; by their element, or by what a class, id or role names) weigh MARKED, and so once more in another: to be kept, their text must
be SHARE / MARKED = 10 times as dense as the rest. Text outside every article and main part weighs OUTSIDE where the page has such parts. A class that only
mentions such a thing (share-price, search-results), or stands beside one that names the text (sidebar article-body), weighs SOFT and
starts no part of its own. Only what is named as reader comments weighs nothing. Marked parts inside what is kept are peaks of their
own and go by their own sums; what follows one in the same element goes on with what stood before it.

Null html is empty and gives an empty text. Cut-off markup is read as far as it goes; elements that are not closed end where HTML
implies it (a paragraph at the next block, a list item at the next) or with what holds them. Repeated rows give equal results;
empty tables give empty results; other columns of the input are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SHARE, MARKED, SOFT, OUTSIDE = 3, 0.1, 0.01, 0.3, 0.35
#: Marks in marks in marks don't weigh less than this: only comments weigh nothing.
LEAST = 1e-12

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
OTHER_PARTS = frozenset("head nav header footer aside form menu dialog button select object audio video canvas".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that one of the same group ends, inside the named ones.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Ends of parts of tables, and of other blocks, don't reach beyond these; ends of inline elements don't reach beyond blocks.
TABLE_BORDERS, BORDERS = frozenset("article main table".split()), frozenset("article main td th table".split())
WHOLE, TABLE_PARTS = frozenset("article main section body html".split()), frozenset("table thead tbody tfoot tr".split())
#: Words of class, id and role that name reader comments, and other parts than the main text.
COMMENTS = frozenset("comment comments disqus reply replies".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side aside nav navbar navigation menu breadcrumb breadcrumbs header footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended widget toolbar pagination pager copyright disclaimer contentinfo complementary".split())
#: Words that name the main text, and words that only say what kind of box a thing stands in.
TEXTS = frozenset("article content body main post entry story text prose".split())
BOXES = frozenset("area articles author bar block body bottom box button buttons col column container content count form global group holder inner item items label left link links list lists meta news outer page panel posts primary region right row secondary section site slot stories thread title top unit wrap wrapper".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S | re.I)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9]*)")
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    signal: float
    article: int  # number of the article or main part, 0 outside
    part: int  # number of the marked or unmarked part that the line belongs to
    holder: int  # number of the element that holds the line's block, 0 for the body


class _Open(NamedTuple):
    name: str
    weight: float
    article: int
    part: int
    number: int


#: Sets of elements whose innermost open one is asked for.
_KINDS = {"#block": BLOCKS, "#table": TABLE_BORDERS, "#border": BORDERS, "#not p": BLOCKS - {"p"}, "#holder": BLOCKS - HEADINGS - {"p"}}


@lru_cache(maxsize=4096)
def _kinds(name: str) -> tuple[str, ...]:
    """What an open element is found by: its name, and the sets that have it."""
    return (name, *(k for k, names in _KINDS.items() if name in names))


def _named(token: str) -> str:
    """What a class names: comments, a mark, the text, or, if it only mentions a mark, hint; else nothing. The last word counts, apart from boxes and numbers."""
    words = [w for w in re.split(r"[^a-z0-9]+", token) if w and not w.isdigit()]
    if not words or words[0] in ("with", "has", "no"):
        return ""
    head = next((w for w in reversed(words) if w not in BOXES), words[-1])
    if head in COMMENTS:
        return "comments"
    if head in MARKS:
        return "mark"
    if {*words} & (MARKS | COMMENTS):
        return "hint"
    return "text" if {*words} & TEXTS else ""


def _weight(name: str, tag: str) -> float:
    """What the element multiplies the signal of its text by."""
    if name in HEADINGS or name in ("html", "body"):
        return 1.0
    named = {_named(t) for m in _MARKED.finditer(tag) for t in (m[1] or m[2] or m[3] or "").lower().split()}
    if "comments" in named:
        return 0.0
    if name in OTHER_PARTS:
        return MARKED
    if "mark" in named:
        return SOFT if "text" in named else MARKED
    return SOFT if "hint" in named and "text" not in named else 1.0


def page_lines(page: str) -> tuple[list[Line], dict[int, int]]:
    """The lines of a page, those without text left out; and of each element that isn't the last one within itself the number of the last element in it."""
    lines: list[Line] = []
    stack = [_Open("body", 1.0, 0, 0, 0)]
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements by name and kind
    text: list[str] = []
    ends: dict[int, int] = {}
    linked = number = at = 0

    def last(kind: str) -> int:
        known = places[kind]
        return known[-1] if known else 0

    def end_block() -> None:
        nonlocal linked
        if text:
            line = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if line:
                top = stack[-1]
                lines.append(Line(line, max(0, len(line) - linked) * top.weight, top.article, top.part, stack[last("#holder")].number))
            text.clear()
        linked = 0

    def pop_to(k: int) -> None:
        """Ends the open elements from number k of the stack on."""
        if any(e.name in BLOCKS or e.part != stack[k - 1].part for e in stack[k:]):
            end_block()
        for e in stack[k:]:
            if e.number < number:
                ends[e.number] = number
            for kind in _kinds(e.name):
                places[kind].pop()
        del stack[k:]

    def find(names: Iterable[str], borders: Iterable[str]) -> int:
        """The innermost open element of these names that no border (names or kinds) hides, or 0."""
        k = max(map(last, names))
        return k if k >= max(map(last, borders), default=0) else 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            if places["a"]:
                linked += len(_SPACE.sub(" ", entities.unescape(piece)).strip())

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m[0]
        name = None if m[1] or tag[1] in "!?" else _NAME.match(tag)
        if not name:
            continue
        name = name[1].lower()
        if tag[1] == "/":
            borders = () if name in WHOLE else ("#table",) if name in TABLE_PARTS else ("#border",) if name in BLOCKS else ("#block",)
            if k := find((name,), borders):
                pop_to(k)
            elif name in BLOCKS:
                end_block()
        elif name == "br":
            text.append(" ")
        elif name in VOID:
            if name == "hr":
                end_block()
        else:
            if name in BLOCKS:
                if k := find(("p",), ("#not p",)):
                    pop_to(k)
                if name in IMPLIED and (k := find(*IMPLIED[name])):
                    pop_to(k)
            top, number = stack[-1], number + 1
            weight = _weight(name, tag)
            marked = weight <= MARKED
            if name in BLOCKS or marked:
                end_block()
            article, part = top.article, top.part
            if marked:
                article, part = 0, number
            elif name in ("article", "main") and not article:
                article = part = number
            if not tag.endswith("/>"):
                for kind in _kinds(name):
                    places[kind].append(len(stack))
                stack.append(_Open(name, max(top.weight * weight, LEAST) if top.weight and weight else 0.0, article, part, number))
    add(page[at:])
    pop_to(1)
    end_block()
    return lines, ends


def peaks(signals: list[float]) -> list[tuple[int, int, float]]:
    """Surge, dive (excluded) and largest window sum of each stretch of lines whose window sums aren't zero, from its first to its last signal."""
    n, out, i = len(signals), [], 0
    sums = [sum(signals[k : k + WINDOW]) for k in range(n)]
    while i < n:
        if not sums[i]:
            i += 1
            continue
        surge = i
        while i < n and sums[i]:
            i += 1
        inside = [k for k in range(surge, i) if signals[k]]
        out.append((inside[0], inside[-1] + 1, max(sums[surge:i])))
    return out


def dense_lines(lines: list[Line], signals: list[float], least: float, ends: dict[int, int]) -> list[int]:
    """Numbers of the lines from surge to dive of a stretch of lines that is no article; least: what a window of text sums up to."""
    n = len(lines)
    sums = [sum(signals[k : k + WINDOW]) for k in range(n)]
    dense = {k for k in range(n) if signals[k] >= least}
    k = 0
    while k < n:  # from a surge to a dive without such a line its larger ones stand for it
        surge = k
        while k < n and sums[k] >= least:
            k += 1
        if k > surge and not dense & {*range(surge, min(n, k - 1 + WINDOW))}:
            dense |= {j for j in range(surge, min(n, k - 1 + WINDOW)) if signals[j] * WINDOW >= least}
        k += 1
    dense = sorted(dense)
    inside = lambda k, c: lines[k].holder == c if c == 0 else c <= lines[k].holder <= ends.get(c, c)
    kept: set[int] = set(dense)
    spans: dict[int, list[int]] = {}
    for k in dense:
        spans.setdefault(lines[k].holder, [k, k])[1] = k
    windows = {j for k in range(n) if sums[k] >= least for j in range(k, min(n, k + WINDOW))}
    for c, (first, last) in spans.items():
        kept.update(range(first, last + 1))
        for step, edge in ((-1, first - 1), (1, last + 1)):  # within the windows any line of the container, then such with a signal
            k = edge
            while 0 <= k < n and inside(k, c) and (k in windows or signals[k]):
                kept.add(k)
                k += step
    for a, b in zip(dense, dense[1:]):  # noqa: B905
        if all(k in windows for k in range(a, b)):
            kept.update(range(a, b))
    return sorted(kept)


def main_text(page: str) -> str:
    lines, ends = page_lines(page)
    has_article = any(x.article for x in lines)
    signals = [x.signal * (OUTSIDE if has_article and not x.article else 1.0) for x in lines]
    # stretches of lines of one article, or of one part and (where another came between) one element
    stretches: list[list[int]] = []
    at: dict[tuple[int, int], list[int]] = {}
    last: list[int] | None = None
    for k, x in enumerate(lines):
        key = (x.part, 0 if x.article else x.holder)
        if k and lines[k - 1].part == x.part:
            stretch = last
        else:
            stretch = at.get(key) if x.article or x.holder else None
        if stretch is None:
            stretches.append(stretch := [])
        stretch.append(k)
        at[key] = last = stretch
    found = [(s, max((p[2] for p in peaks([signals[k] for k in s])), default=0)) for s in stretches]
    least = SHARE * max((most for _, most in found), default=0)
    kept: list[int] = []
    for s, most in found:
        if not most or most < least:
            continue
        kept += s if lines[s[0]].article else [s[k] for k in dense_lines([lines[k] for k in s], [signals[k] for k in s], least, ends)]
    return "\n".join(lines[k].text for k in sorted(kept))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": [main_text(h) for h in pdf["html"]]})

    return pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInPandas(run, "page_id long, url string, text string")
