"""Rewrites of pages before extraction, as an ordered list of passes over one parsed page.

``Pass(rule, apply)``: ``apply(page, source)`` changes the tree of the page at the URL ``source`` and says how often it did; the rule is
logged once for a page that it changed. A list of passes is data: callers may add passes, leave some out or give another order.
Passes run where a page is parsed, so rewriting costs no further parse or shuffle; what comes out is a
table of nodes like that of ``pages.page_nodes``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urldefrag, urljoin, urlsplit

from papershed.sources.elements import HEADINGS, TEXT, Node


@dataclass(frozen=True)
class Pass:
    rule: str
    apply: Callable[[Node, str], object]


def run(page: Node, source: str, passes: tuple[Pass, ...]) -> list[str]:
    """The rules of the passes that changed the page, in order; a pass may return a list of rules of its own."""
    rules: list[str] = []
    for p in passes:
        done = p.apply(page, source)
        rules += done if isinstance(done, list) else [p.rule] * bool(done)
    return rules


# Signs that icon names stand for.
GLYPHS = {"check": "✓", "done": "✓", "check_circle": "✓", "close": "✗", "clear": "✗", "block": "✗", "cancel": "✗", "remove": "–"}
ICON_FONT = re.compile(r"material-(icons|symbols)(-[\w-]+)?")


def icon_cells(page: Node, source: str) -> int:
    """Icon names in hidden spans of table cells become the signs they show."""
    icons = page.all(where=lambda n: n.get("aria-hidden") == "true" and n.up.inside("td", "th") and not n.elements())
    found = [(n, GLYPHS.get(n.text().strip())) for n in icons if any(map(ICON_FONT.fullmatch, n.classes()))]
    for icon, glyph in found:
        if glyph:
            icon.replace(Node(TEXT, data=glyph))
    return sum(glyph is not None for _, glyph in found)


# Boxes of pseudo elements, and what hides them.
PSEUDO = {"before", "after", "placeholder", "marker", "file", "first-letter", "first-line", "selection", "backdrop"}
HIDES = {"hidden", "invisible"}


def _hides_pseudo_box(name: str) -> bool:
    *variants, last = name.split(":")
    return last in HIDES and bool(PSEUDO & set(variants))


def _set_classes(node: Node, names: list[str]) -> None:
    node.attrs.pop("class", None)
    if names:
        node.attrs["class"] = " ".join(names)


def pseudo_element_classes(page: Node, source: str) -> int:
    """Class names go that hide nothing but a box before or after an element."""
    found = page.all(where=lambda n: ":" in n.get("class") and any(map(_hides_pseudo_box, n.classes())))
    for node in found:
        _set_classes(node, [c for c in node.classes() if not _hides_pseudo_box(c)])
    return len(found)


# What stands where only scripts put content, media that a server can put there, the ending of the label.
PREVIEW_CLASS, PREVIEW_TITLE = "sp-preview-iframe", "Sandpack Preview"
MEDIA = ("img", "picture", "svg", "canvas", "video", "audio", "iframe", "object", "embed")
OPEN_THERE = " — open in the original"


def _http(url: str, base: str = "") -> str | None:
    """The absolute form of a link, if it is one of http or https."""
    try:
        whole = urljoin(base, url.strip())
        return whole if url.strip() and urlsplit(whole).scheme in ("http", "https") and urlsplit(whole).netloc else None
    except ValueError:
        return None


def interactive_placeholders(page: Node, source: str) -> int:
    """Empty interactive figures and code playgrounds become links to their place on the page."""
    base, count = _http(source), 0
    for node in page.all("d-figure", "iframe") if base else []:
        if node.tag == "d-figure":
            label = None if node.text().strip() or node.has(*MEDIA) else "Interactive figure"
        else:
            label = "Code playground" if PREVIEW_CLASS in node.classes() or node.get("title") == PREVIEW_TITLE else None
        if label:
            link = Node("a", {"href": urldefrag(base)[0] + (f"#{node.get('id')}" if node.get("id") else "")})
            link.add(Node(TEXT, data=label + OPEN_THERE))
            node.replace(link if node.up.inside("p") else Node("p").add(link))
            count += 1
    return count


# Types of pictures that every browser shows, attributes that a picture takes over.
PICTURE_TYPES = {f"image/{kind}" for kind in ("avif", "gif", "jpeg", "jpg", "png", "svg+xml", "webp")}
TAKEN_OVER = ("id", "class", "width", "height", "title")
HIDDEN_STYLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def hidden(node: Node) -> bool:
    """Hidden by attribute or style, or a box of a pixel."""
    tiny = any(re.fullmatch(r"0*[01](?:px)?", node.get(side).strip()) for side in ("width", "height"))
    return "hidden" in node.attrs or tiny or bool(HIDDEN_STYLE.search(node.get("style")))


def image_objects(page: Node, source: str) -> int:
    """Objects of a picture's type become pictures."""
    count = 0
    for node in page.all("object"):
        attached = list(node.above())[-1] is page
        url = _http(node.get("data"), source)
        if not attached or node.get("type").split(";")[0].strip().lower() not in PICTURE_TYPES or hidden(node) or not url:
            continue
        says = node.words() or node.get("aria-label").strip() or node.get("title").strip()
        node.replace(Node("img", {"src": url, "alt": says} | {k: node.attrs[k] for k in TAKEN_OVER if k in node.attrs}))
        count += 1
    return count


# Kinds of callouts by class name; bounds; names of page furniture; names that hide.
CALLOUT_KINDS = {
    "note": "note", "info": "note", "tip": "tip", "hint": "tip", "success": "tip", "important": "important", "key-point": "key-point", "keypoint": "key-point", "takeaway": "key-point",
    "warning": "warning", "warn": "warning", "attention": "warning", "caution": "caution", "danger": "caution", "error": "caution",
}
DECLARES = {"admonition", "callout"} | set(CALLOUT_KINDS)
CANDIDATES = {"admonition", "callout", "note", "key-point"}
LONGEST_CALLOUT, SHORTEST_ASIDE, MOST_LINKED = 2500, 80, 0.5
FURNITURE = (
    "sidebar", "widget", "widgets", "toc", "related", "recirc", "read-next", "readnext", "read-more", "readmore", "share", "sharing", "social", "newsletter", "subscribe", "promo", "advert",
    "sponsor", "sponsored", "comment", "comments", "discuss", "discussion", "nav", "navigation", "menu", "breadcrumb", "breadcrumbs", "author", "bio", "tags", "search",
)
HIDING_CLASSES = {
    "hidden", "invisible", "d-none", "sr-only", "visually-hidden", "screen-reader-only", "screen-reader-text", "hide-on-print", "hide-for-print", "hide-print", "hidden-print", "noprint",
    "no-print", "print-none", "print:hidden",
}
SPOKEN_LABELS = {"screen-reader-only", "screen-reader-text", "sr-only", "visually-hidden"}
_FURNITURE = re.compile(r"(?:^|[\s_-])(?:" + "|".join(FURNITURE) + r")(?=$|[\s_-])", re.I)


def linked_share(node: Node) -> float:
    """The share of a node's text that links make up."""
    total = len(node.words())
    return sum(len(a.words()) for a in node.all("a")) / total if total else 0.0


def _is_furniture(node: Node) -> bool:
    if HIDING_CLASSES & {c.lower() for c in node.classes()} or HIDDEN_STYLE.search(node.get("style")):
        return True
    pull_quote = any("pullquote" in n.get("class").lower().replace("pull-quote", "pullquote") for n in (node, *node.all()))
    return pull_quote or bool(_FURNITURE.search(f"{node.get('class')} {node.get('id')}"))


def _is_callout(node: Node, page_text: str) -> bool:
    apart = any(n.tag in ("noscript", "nav", "header", "footer", "pre", "code", "table") or "hidden" in n.attrs or n.get("aria-hidden") == "true" for n in node.above())
    if apart or _is_furniture(node) or node.has("h1", "article", "main", "nav", "form", "aside"):
        return False
    text = node.words()
    if not text or len(text) > LONGEST_CALLOUT:
        return False
    if DECLARES & {c.lower() for c in node.classes()}:
        return True
    return len(text) >= SHORTEST_ASIDE and linked_share(node) <= MOST_LINKED and page_text.find(text) == page_text.rfind(text)


def callout_kind(node: Node) -> str:
    """The kind that the first telling class name says, whole or by a part of it; a note if none does."""
    for name in map(str.lower, node.classes()):
        said = [CALLOUT_KINDS[p] for p in (name, *re.split(r"[-_]+", name)) if p in CALLOUT_KINDS]
        if said:
            return said[0]
    return "note"


def callouts(page: Node, source: str) -> int:
    """Callouts and asides of the author become quotes marked with their kind."""
    page_text, count = page.words(), 0
    for node in page.all("aside", "div", "section", where=lambda n: n.tag == "aside" or CANDIDATES & set(n.classes())):
        if any(n.tag == "blockquote" and "data-callout" in n.attrs for n in node.up.above()) or not _is_callout(node, page_text):
            continue
        for label in node.all(where=lambda n: SPOKEN_LABELS & set(n.classes())):
            if label.words().lower() in CALLOUT_KINDS:
                label.remove()
        quote = Node("blockquote", {"data-callout": callout_kind(node)} | ({"id": node.get("id")} if node.get("id") else {}))
        node.replace(quote)
        quote.add(*list(node.kids))
        count += 1
    return count


def anchor_headings(page: Node, source: str) -> int:
    """A heading that is all of a link to the page itself stands without the link and takes its id."""
    count = 0
    for heading in page.all(*HEADINGS):
        link = heading.up
        if link.tag != "a" or not link.get("href").startswith("#") or link.inside("nav") or not all(n is heading or n.blank() for n in link.kids):
            continue
        if link.get("id") and not heading.get("id"):
            heading.attrs["id"] = link.get("id")
        link.replace(heading)
        count += 1
    return count


def _is_note(node: Node) -> bool:
    return node.tag == "div" and "footnote" in node.classes() and node.get("data-component-name") == "FootnoteToDOM"


def _part(node: Node, name: str) -> Node | None:
    return next((n for n in node.elements() if name in n.classes()), None)


def substack_footnotes(page: Node, source: str) -> int:
    """A run of footnotes that are each a div of their own becomes one list of notes."""
    count = 0
    for first in page.all("div", where=_is_note):
        if first.up is None:
            continue
        beside = first.up.kids
        run, gaps = [first], []
        for node in beside[beside.index(first) + 1 :]:
            if not node.blank() and not _is_note(node):
                break
            (gaps if node.blank() else run).append(node)
        numbers = [_part(note, "footnote-number") for note in run]
        if not all(n is not None and n.get("id") for n in numbers):
            continue
        notes = Node("ol")
        for note, number in zip(run, numbers):
            kept = [n for n in (_part(note, "footnote-content") or note).kids if n is not number]
            notes.add(Node("li", {"id": number.get("id")}).add(*kept))
        first.replace(Node("section", {"class": "footnotes"}).add(notes))
        for node in (*run[1:], *gaps):
            node.remove()
        count += 1
    return count


# Class names of footnote marks; parts of class names by which links are taken for permalinks; what points back.
MARKS = {"footnote-anchor", "footnoteRef", "footnote-ref"}
AS_PERMALINK, POINTS_BACK = re.compile(r"anchor|ref", re.I), re.compile(r"back|return|reverse", re.I)


def footnote_references(page: Node, source: str) -> int:
    """A mark of a footnote that the page holds is told from a permalink and stands in one sup."""
    ids, count = {n.get("id") for n in page.all()}, 0
    for mark in page.all(where=lambda n: MARKS & set(n.classes()) or n.get("role") == "doc-noteref" or n.get("rel").startswith("footnote")):
        link = mark if mark.tag == "a" else next(iter(mark.all("a", where=lambda n: n.get("href").startswith("#"))), None)
        if link is None or not link.get("href").startswith("#") or link.get("href")[1:] not in ids - {""} or "data-footnote-ref" in link.attrs:
            continue
        if link.get("role") == "doc-backlink" or POINTS_BACK.search(f"{link.get('rel')} {link.get('class')}"):
            continue
        _set_classes(link, [c for c in link.classes() if not AS_PERMALINK.search(c)])
        link.attrs["data-footnote-ref"] = ""
        only = link.elements()
        if len(only) == 1 and only[0].tag == "sup" and only[0].words() == link.words():
            only[0].unwrap()
        if not link.inside("sup"):
            sup = Node("sup")
            link.replace(sup)
            sup.add(link)
        count += 1
    return count


PREEXTRACTION = (
    Pass("article.preextract.icon-cells@1", icon_cells),
    Pass("article.preextract.pseudo-element-classes@1", pseudo_element_classes),
    Pass("article.preextract.interactive-placeholders@1", interactive_placeholders),
    Pass("article.preextract.image-objects@1", image_objects),
    Pass("article.preextract.callouts@1", callouts),
    Pass("article.preextract.anchor-headings@1", anchor_headings),
    Pass("article.preextract.substack-footnotes@1", substack_footnotes),
    Pass("article.preextract.footnote-references@1", footnote_references),
)
