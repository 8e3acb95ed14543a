"""Main text of HTML pages by the maximum-scoring contiguous region.

A page is read as a sequence of words and tags. Words score above zero, tags below, with
weights learned from labelled pages, those of class and id names among them; one linear scan finds
the contiguous run with the highest sum. Elements that by their nature hold no main text (menus, page
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) are taken out
first. What their class, id or role says counts unless they hold the page's home: its largest article or main
element, one outside such elements if there is any, or are the head of its title in it; on a page without either, unless they hold more than half of its remaining words.
Outside of the home each element taken out leaves a penalty behind; inside it costs nothing, so that
an advert in an article doesn't part it. The blocks that the region touches are the text.

Reading a page takes time in proportion to its length, whatever it holds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bound of the fit: labelled pages (expected, by a hash of the page's text).
SAMPLE = 2000
WORD_RANGE, TAG_RANGE = (0.2, 3.0), (-6.0, -0.05)
REMOVED = -6.0

# Elements without main text; elements whose content is no markup; elements that end a block; elements without a content.
APART = {"nav", "footer", "aside", "menu", "dialog", "select", "button", "fieldset", "iframe", "object", "svg", "canvas", "head", "map", "audio", "video"}
RAW = ("script", "style", "noscript", "template", "textarea", "title", "xmp", "noframes")
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: A class or id says that an element is no main text if it consists of these words, or of these and words of place and form.
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "banner", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "sidenav", "widget", "footer", "header", "masthead",
    "cookie", "cookies", "consent", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup",
    "share", "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "login", "search",
}
PLACES = {
    "site", "main", "global", "top", "bottom", "left", "right", "primary", "secondary", "mobile", "desktop", "bar", "box", "block", "list", "area", "section",
    "container", "wrapper", "wrap", "inner", "outer", "item", "items", "link", "links", "button", "buttons", "icons", "panel", "form", "slot", "unit", "posts", "user", "reader",
}
#: Such elements hold an article's title if they are in it.
HEADS = {"header", "masthead", "banner"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
NEVER_APART = {"html", "body", *HEADINGS}
#: The share of the largest article's or main's words from which one inside it is the home; without either, the share of a page's words that a home holds.
HOME_SHARE = 0.6

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN_REST = re.compile(r"[^>\"']*")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")


def _tag_end(html: str, at: int) -> int:
    """The place of the ``>`` that ends a tag, those in quoted values left out; -1 if there is none."""
    while True:
        at = _PLAIN_REST.match(html, at).end()
        if at >= len(html):
            return -1
        if html[at] == ">":
            return at
        at = html.find(html[at], at + 1) + 1
        if not at:
            return -1


def tokens(html: str) -> list[tuple[str, str, str]]:
    """(kind, name, rest): kinds are text, open and close; scripts, comments and the like are left out.

    Once a tag with quotes has no end, quotes mean nothing for the rest of the page, so no part of it is
    searched twice.
    """
    found: list[tuple[str, str, str]] = []
    at, quotes, last = 0, True, html.rfind(">")
    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            start = len(html)
        if start > at:
            found.append(("text", "", html[at:start]))
            at = start
            continue
        if html.startswith("<!--", at):
            at = html.find("-->", at + 4) + 3
            if at < 3:
                break
            continue
        tag = _TAG.match(html, at + 1)
        if at > last or not tag and html[at + 1] not in "!?":
            found.append(("text", "", "<"))
            at += 1
            continue
        end = _tag_end(html, tag.end()) if tag and quotes else -1
        if end < 0:
            quotes &= not tag
            end = html.find(">", tag.end() if tag else at)
        if tag:
            name, rest = tag[2].lower(), html[tag.end() : end]
            if name in _RAW_END and not tag[1]:
                close = _RAW_END[name].search(html, end + 1)
                if not close:
                    break
                end = close.end() - 1
            else:
                found.append(("close" if tag[1] else "open", name, rest))
        at = end + 1
    return found


def names_of(rest: str) -> tuple[list[str], str]:
    """The class and id names of a tag, and its role."""
    if not rest.strip("/ "):
        return [], ""
    named, role = [], ""
    for m in _ATTRIBUTE.finditer(rest):
        key = m[1].lower()
        if key in ("class", "id"):
            named += (m[2] or m[3] or m[4] or "").lower().split()
        elif key == "role":
            role = (m[2] or m[3] or m[4] or "").lower().strip()
    return named, role


def _says_apart(name: str, rest: str) -> bool:
    """Whether an element's name, class, id or role says that it is no main text."""
    if name == "form":
        return True
    named, role = names_of(rest)
    if role in ROLES:
        return True
    for words in map(set, map(_WORD.findall, named)):
        if words & NAMES and words <= NAMES | PLACES:
            return True
    return False


@dataclass
class Layout:
    """What a page's elements are: their ends by their starts, those without main text, and the home (first and last token)."""

    ends: dict[int, int]
    apart: dict[int, int]
    home: tuple[int, int] | None
    declared: bool  # the home is an article or main element


def _says_head(rest: str) -> bool:
    """Whether class and id call an element the head of something, and no other thing without main text."""
    return {w for n in names_of(rest)[0] for w in _WORD.findall(n)} & NAMES <= HEADS


def _outermost(found: dict[int, int]) -> dict[int, int]:
    """Of intervals by their starts those inside no other; intervals are nested or apart."""
    kept, reach = {}, -1
    for start in sorted(found):
        if start > reach:
            kept[start] = reach = found[start]
    return kept


def layout(found: list[tuple[str, str, str]]) -> Layout:
    """An element reaches to its own end tag, nested elements of its name counted; if there is none, it is only its tag."""
    ends: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    for i, (kind, name, _) in enumerate(found):
        if kind == "open" and name not in VOID:
            ends[i] = i
            open_at.setdefault(name, []).append(i)
        elif kind == "close" and open_at.get(name):
            ends[open_at[name].pop()] = i
    # elements without main text whatever they hold
    gone, articles, reach = {}, 0, -1
    for i, (kind, name, _) in enumerate(found):
        if name in ("article", "main"):
            articles += {"open": 1, "close": -1}[kind]
        if i > reach and kind == "open" and (name in APART or name == "header" and articles <= 0):
            gone[i] = reach = ends.get(i, i)
    words = [0, *accumulate(n * left for n, left in zip((len(rest.split()) if kind == "text" else 0 for kind, _, rest in found), _outside(gone, len(found))))]
    count = lambda i: words[ends[i] + 1] - words[i]
    named = {i: ends.get(i, i) for i, (kind, name, rest) in enumerate(found) if kind == "open" and name not in NEVER_APART and _says_apart(name, rest)}
    # the home
    free = _outside(_outermost(gone | named), len(found))
    bodies = [i for i in ends if found[i][1] in ("article", "main") and count(i)]
    bodies = [i for i in bodies if free[i]] or bodies
    home = None
    if bodies:
        largest = max(bodies, key=lambda i: (count(i), -i))
        within = [i for i in bodies if largest <= i and ends[i] <= ends[largest] and count(i) >= HOME_SHARE * count(largest)]
        home = max(within, key=lambda i: (i, 0))
        kept = [i for i in named if i <= home and named[i] >= ends[home]]
        title = next((i for i, (kind, name, _) in enumerate(found) if kind == "open" and name == "h1"), -1)
        kept += [i for i in named if home < i < title <= named[i] and _says_head(found[i][2])]
    else:
        kept = [i for i in named if 2 * (words[named[i] + 1] - words[i]) > words[-1]]
        holders = [i for i in ends if words[-1] and count(i) >= HOME_SHARE * words[-1]]
        home = max(holders, default=None)
    for i in kept:
        del named[i]
    return Layout(ends, _outermost(gone | named), None if home is None else (home, ends[home]), bool(bodies))


def _outside(intervals: dict[int, int], size: int) -> list[bool]:
    """Of each token, whether it is outside all the intervals."""
    inside = np.zeros(size + 1, dtype=np.int64)
    for start, end in intervals.items():
        inside[start] += 1
        inside[end + 1] -= 1
    return (np.cumsum(inside[:-1]) == 0).tolist()


def without_apart(found: list[tuple[str, str, str]]) -> Iterator[tuple[str, str, str]]:
    """The tokens with each element that holds no main text as one token: of kind ``inner`` in the page's home, else ``apart``."""
    page = layout(found)
    first, last = page.home or (0, -1)
    i = 0
    while i < len(found):
        if i in page.apart:
            yield "inner" if first <= i <= last else "apart", found[i][1], ""
            i = page.apart[i]
        else:
            yield found[i]
        i += 1


def features(kind: str, name: str, rest: str) -> list[str]:
    """What a tag's score is the sum of: its name, and its class and id names."""
    return [name, *(f".{n}" for n in names_of(rest)[0])] if kind == "open" else [name]


@dataclass
class Weights:
    word: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)
    other: float = -0.5

    @staticmethod
    def of(inside: dict[str, int], outside: dict[str, int]) -> Weights:
        """Log odds of being main text, words kept above and tags below zero."""
        def odds(name: str) -> float:
            return float(np.log((inside.get(name, 0) + 1) / (outside.get(name, 0) + 1)))

        tags = {t: float(np.clip(odds(t), *TAG_RANGE)) for t in {*inside, *outside} - {""}}
        tags |= {t: min(0.0, odds(t)) for t in tags if t[0] == "."}
        return Weights(float(np.clip(odds(""), *WORD_RANGE)), tags)

    def extract(self, html: str | None) -> str:
        """The blocks of the best region, one to a line; empty if there are no words. Null counts as empty."""
        blocks: list[list[str]] = [[]]
        scores: list[float] = []
        owner: list[int] = []
        for kind, name, rest in without_apart(tokens(html or "")):
            if kind == "text":
                blocks[-1].append(rest)
                n = len(rest.split())
                if n:
                    scores.append(n * self.word)
                    owner.append(len(blocks) - 1)
                continue
            if kind in ("apart", "inner"):
                scores.append(REMOVED if kind == "apart" else 0.0)
            else:
                scores.append(max(TAG_RANGE[0], sum(self.tags.get(f, 0.0 if f[0] == "." else self.other) for f in features(kind, name, rest))))
            owner.append(-1)
            if name == "br":
                blocks[-1].append(" ")
            elif name in BLOCKS or kind in ("apart", "inner") and name in BLOCKS | APART:
                blocks.append([])
        if not scores:
            return ""
        total = np.concatenate([[0.0], np.cumsum(scores)])
        lowest = np.minimum.accumulate(total[:-1])
        end = int(np.argmax(total[1:] - lowest))
        start = int(np.flatnonzero(total[: end + 1] == lowest[end])[-1])
        touched = [b for b in owner[start : end + 1] if b >= 0]
        if not touched:
            return ""
        lines = (" ".join(unescape("".join(parts)).split()) for parts in blocks[touched[0] : touched[-1] + 1])
        return "\n".join(line for line in lines if line)


def label(html: str | None) -> tuple[Counter, Counter] | None:
    """Words ("") and tags inside and outside of main text, if the page labels it: its home is an article element. What is apart in it counts nowhere."""
    found = tokens(html or "")
    page = layout(found)
    if not page.declared or found[page.home[0]][1] != "article":
        return None
    counts, left = (Counter(), Counter()), _outside(page.apart, len(found))
    for i, (kind, name, rest) in enumerate(found):
        inside = page.home[0] < i < page.home[1]
        if inside and not left[i] or i in page.home:
            continue
        side = counts[0 if inside else 1]
        if kind == "text":
            side[""] += len(rest.split())
        else:
            side.update(features(kind, name, rest))
    return counts


def fit(pages: DataFrame) -> Weights:
    """Weights from pages whose main text is labelled by an article element.

    Pages enter by a hash of their rows, SAMPLE in the mean or all if there are fewer; equal pages with ids of their own enter
    on their own. Without a labelled page the default weights stay. Only html is learned from.
    """
    share = min(1.0, SAMPLE / max(1, pages.count()))
    draw = F.pmod(F.xxhash64(*pages.columns), F.lit(1_000_000)) / 1_000_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for html in batch.column("html"):
                if counts := label(html.as_py()):
                    inside += counts[0]
                    outside += counts[1]
        names = sorted({*inside, *outside})
        columns = [pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()), pa.array([outside[n] for n in names], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["name", "inside", "outside"])

    counted = pages.select("html").filter(F.col("html").isNotNull() & (draw < share)).mapInArrow(count, "name string, inside long, outside long")
    total = counted.groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = total.collect()  # names from SAMPLE pages
    if not rows:
        return Weights()
    return Weights.of({r["name"]: r["inside"] for r in rows}, {r["name"]: r["outside"] for r in rows})


def main_text(weights: Weights, html: Column) -> Column:
    """The main text of an html column; empty for null, for empty pages and for pages without words. Pages of any length are read whole, equal pages have equal texts."""
    shared = SparkSession.active().sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(shared.value.extract, na_action=None)

    return extract(html)
