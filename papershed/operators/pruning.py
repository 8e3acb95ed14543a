"""Chrome that is left in an article, taken out by twelve ordered passes over its tree.

Each pass is a small rule on elements; they run one after another on one parsed page (see ``rewrites``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from functools import partial
from urllib.parse import unquote, urldefrag, urljoin

from papershed.operators.rewrites import Pass
from papershed.sources.elements import HEADINGS, TEXT, Node, collapsed, text_before

# Wordings of headings and lines, and bounds in characters or shares.
CONTENTS = r"(?:table of )?contents?|目录|目次|in this (?:article|post)|on this page"
COMMENTS = r"comments?|comment on this (?:article|post)|leave a (?:comment|reply)"
CHROME_HEADINGS = (
    r"related(?: (?:posts?|articles?|content|reading|stories))?:?", r"share(?: this)?(?: (?:post|article))?:?", r"newsletter", r"subscribe(?: to .*)?", COMMENTS, r"(?:read|you might) (?:next|also like)",
    r"you may also like", r"more (?:from|like this|by) .*", r"more (?:from|like this)", r"recommended.*", r"sponsored.*", r"tags?", r"footer", r"about the author", r"written by.*", r"explore more.*",
    r"also in .*", r"next (?:article|post|up)", r"year in review", r"all (?:articles|content|posts)", r"discuss", r"discuss (?:on|this)\b.*", r"read my book", r"my book", r"buy (?:my|the) book",
    r"support (?:me|this|my work).*", r"sponsors?",
)
REFERENCE_HEADINGS = ("references", "bibliography", "notes", "footnotes", "sources", "citations", "acknowledg", "links", "resources", "参考", "链接", "引用", "注释", "脚注", "文献")
PROMO_STARTS = (
    "written by", "about the author", "share( this)?", "subscribe", "related", "explore more", "more from", "more by", "next article", "also in", "read next", "you may also like", "sign up",
    "get (the newsletter|highlights|the latest)", r"join \d", "view all", "here'?s another", "if you (liked|enjoyed)", "thanks for reading", "enjoyed this", "liked this", "follow (me|us)",
)
PROMO_ANYWHERE = (r"delivered to your inbox", r"newsletter", r"^©", r"^copyright\b", r"all rights reserved")
CHROME_WORDS = (
    "tags?", "categories", "post-tags", "post-meta", "entry-meta", "share", "social", "author-box", "author-card", "bio", "related", "promo", "newsletter", "subscribe", "cta", "breadcrumbs?", "kicker",
    "eyebrow",
)
CHROME_PARTS = ("aside", "recirc", "teaser", "sidebar", "widget", "read-next", "more-stories", "recommend")
MEANS = (
    "footnote", "reference", "bibliograph", "toc", "figure", "code", "highlight", "table", "math", "katex", "caption", "gallery", "embed", "callout", "admonition", "note", "warning", "tip",
)
META_WORDS = (r"\b\d+ min(?:ute)? read\b", r"\bcomments?\b", r"\bshare\b", r"\bposted (?:on|in|by)\b", r"\bpublished\b", r"\bupdated\b", r"\bestimated reading time\b", r"\btweet\b")
PERMALINK_PARTS = ("anchor", "permalink", "headerlink", "heading-link", "hash-link", "zola-anchor", "header-link", "section-link")
DATE_LABELS = ("发表日期", "发布日期", "日期", "date", r"published(?: on)?", r"updated(?: on)?", r"posted(?: on)?")
FIRST_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
LINK_SHARE, OWN_SHARE, TAIL_SHARE, TAIL_FROM, DENSE = 0.7, 0.8, 0.4, 0.6, 0.5
MOST_PROSE, TITLE_WITHIN, LAYOUT_LEAST = 800, 200, 300
REFERENCE_NAMES, REFERENCE_ROLES = {"references", "bibliography", "footnotes"}, {"doc-bibliography", "doc-endnotes"}
STRUCTURE = {"table", "pre", "figure", "blockquote", "dl", "details", "ul", "ol", "code", "math"}
MEDIA = {"br", "img", "picture", "figure", "svg", "video", "audio", "iframe", "canvas", "hr", "math"}
LAYOUT_BLOCKS = ("p", "div", "h1", "h2", "h3", "h4", "br", "ul", "ol", "table", "pre", "blockquote")


def _whole(*forms: str) -> re.Pattern:
    return re.compile(f"(?:{'|'.join(forms)})", re.I)


CONTENTS_RE, COMMENTS_RE, CHROME_RE = _whole(CONTENTS), _whole(COMMENTS), _whole(*CHROME_HEADINGS)
REFERENCES_RE = _whole(*REFERENCE_HEADINGS)
PROMO_RE = _whole(*(f"^(?:{s})" for s in PROMO_STARTS), *PROMO_ANYWHERE)
CHROME_CLASS_RE = _whole(rf"\b(?:{'|'.join(CHROME_WORDS)})\b", *CHROME_PARTS)
MEANS_RE, META_RE, PERMALINK_CLASS_RE = _whole(*MEANS), _whole(*META_WORDS), _whole(*PERMALINK_PARTS)
PERMALINK_RE = re.compile(r"[\s#¶§🔗∞︎⚓]*|link to this (?:heading|section)", re.I)
LOADING_RE = re.compile(r"(?:loading|正在加载|加载中|please wait)[.…]*", re.I)
NOTE_LINK_RE = re.compile(r"#(?:fn|fnref|footnote|footnote-anchor|note|endnote|ref|cite[_-](?:note|ref))[-_:]?\d[\w-]*$", re.I)
NOTE_SIGNS_RE = re.compile(r"[\s\[\]()\d↩↵⤴^↑*†‡︎]+")
BACK_RE = re.compile(r"[\s↩↵⤴^↑]*︎?|\[?(?:return|back)\]?", re.I)
CITED_RE = re.compile(r"\[\d{1,3}\]\s")
YEAR, DAY = r"(?:19|20)\d{2}", r"\d{1,2}(?:st|nd|rd|th)?"
DATE_RE = re.compile(rf"(?:\S+,\s*)?(?:{YEAR}[-/.年]\s*\d{{1,2}}[-/.月]\s*\d{{1,2}}\s*日?|{DAY}\s+[A-Z][a-z]+\.?,?\s+{YEAR}|[A-Z][a-z]+\.?\s+{DAY},?\s+{YEAR})(?:\s*[·•|—–-].{{0,40}})?")
MONTH = rf"(?:{'|'.join(FIRST_MONTHS)})[a-z]*\.?"
SIGNALS_RE = re.compile(rf"{YEAR}|\d+\s*min|\b(?:by|author|published|updated|posted|share|comments?|作者|发表日期|日期)\b", re.I)
META_PARTS = (
    rf"{YEAR}\s*年\s*\d{{1,2}}\s*月\s*\d{{1,2}}\s*日", rf"\b{YEAR}-\d{{2}}-\d{{2}}\b", r"\b(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,?\s*", rf"\b{MONTH}\s+{DAY},?\s+{YEAR}", rf"\b{DAY}\s+{MONTH},?\s+{YEAR}",
    r"\b\d+\s*min(?:ute)?s?(?:\s+read)?\b", r"\b(?:by|author|written by|posted by|published|updated|posted|on|in|read|share|comments?|作者|发表日期|日期|阅读)\b", r"[·•|—–\-:：,.()\s]+",
)


# What elements are


def _tight(text: str) -> int:
    return len("".join(text.split()))


def _links(node: Node) -> list[Node]:
    return [node] * (node.tag == "a") + node.all("a")


def density(node: Node) -> float:
    """The share of a node's text inside links."""
    total = len(node.text().strip())
    if node.tag == "a" or not total:
        return float(bool(total))
    return min(1.0, sum(len(a.text().strip()) for a in node.all("a")) / total)


def _is_note_link(link: Node) -> bool:
    marks = f"{link.get('class')} {link.get('role')} {link.get('rel')}".lower()
    told = NOTE_LINK_RE.search(link.get("href")) or NOTE_SIGNS_RE.fullmatch(link.text()) or link.inside("sup")
    return bool(told) or any(m in marks for m in ("footnote", "fnref", "noteref", "backlink"))


def _holds_references(node: Node) -> bool:
    return node.tag in ("d-citation-list", "d-footnote-list") or bool(REFERENCE_NAMES & set(node.classes())) or node.get("id") in ("references", "bibliography") or node.get("role") in REFERENCE_ROLES


def is_anchor_list(node: Node | None, source: str) -> bool:
    """A list of which seven tenths of the text are links, four fifths of them to places of one page: this one, where its URL is known."""
    if node is None or node.tag not in ("ul", "ol", "nav") or any(map(_holds_references, node.above())):
        return False
    links = [a for a in node.all("a") if "href" in a.attrs and not _is_note_link(a)]
    size = _tight(node.text())
    if len(links) < 2 or size and sum(_tight(a.text()) for a in links) / size < LINK_SHARE:
        return False
    places = Counter(base for base, hash_, place in (a.get("href").partition("#") for a in links) if place and _same_page(base, source))
    return max(places.values(), default=0) / len(links) >= OWN_SHARE


def _same_page(base: str, source: str) -> bool:
    try:
        return not base or not source or urljoin(source, base) == urldefrag(source)[0]
    except ValueError:
        return False


def _is_contents_part(node: Node, source: str) -> bool:
    if node.tag == "hr" or is_anchor_list(node, source):
        return True
    if node.tag == "p":
        return not node.text().strip() and not node.all("a", where=lambda a: "href" in a.attrs)
    if node.tag == "a":
        return "#" in node.get("href")
    if node.tag in ("div", "nav", "section", "aside", "details"):
        inner = next(iter(node.all("ul", "ol")), None)
        return is_anchor_list(inner, source) and len(node.text().strip()) <= len(inner.text().strip()) + 40
    return False


def _drop_while(nodes: Iterable[Node], holds: Callable[[Node], bool]) -> int:
    count = 0
    for node in nodes:
        if not holds(node):
            break
        node.remove()
        count += 1
    return count


def _is_card_list(node: Node) -> bool:
    """A list whose every item is a link and little else, or a card with a picture, a heading or a date."""
    items = [n for n in node.elements() if n.tag == "li"] if node.tag in ("ul", "ol") else []

    def card(item: Node) -> bool:
        link = next(iter(item.all("a", where=lambda a: "href" in a.attrs)), None)
        if link is None:
            return False
        text = item.words()
        rest = text.replace(link.text(), "", 1).strip()
        dated = bool(re.search(YEAR, rest))
        if len(items) == 1 and len(rest.split(" ")) >= 6 and not dated:
            return False
        prose = len(rest) > 120 and re.search(r"[.!?。！？]\s", rest)
        shown = dated or item.has("h1", "h2", "h3", "h4", "img", "picture", "time")
        return not prose and (len(rest) <= 80 or shown and len(text) <= 240)

    return bool(items) and all(map(card, items))


def _is_structure(node: Node) -> bool:
    if _is_card_list(node):
        return False
    names = re.search(r"\b(?:footnotes?|footnote-list|references|bibliography)\b", node.get("class"), re.I) or re.fullmatch(r"footnotes?|references|bibliography", node.get("id"), re.I)
    return node.tag in STRUCTURE or node.get("role") == "doc-endnotes" or bool(names)


def _is_chrome_class(node: Node) -> bool:
    return bool(CHROME_CLASS_RE.search(f"{node.get('class')} {node.get('id')}")) and not node.has("h1", "h2", "h3", "pre", "table", "figure", "blockquote")


def _is_date(text: str) -> bool:
    return len(text) < 60 and bool(DATE_RE.fullmatch(re.sub(rf"^(?:{'|'.join(DATE_LABELS)})[\s:：]*", "", text, flags=re.I)))


def _is_meta_only(text: str, byline: str) -> bool:
    """A byline, dates and reading times with nothing of six characters beside them."""
    if len(text) >= 200 or not (SIGNALS_RE.search(text) or byline and byline.lower() in text.lower()):
        return False
    rest = re.sub(re.escape(byline), " ", text, flags=re.I) if byline else text
    for part in META_PARTS:
        rest = re.sub(part, " ", rest, flags=re.I)
    return len(rest.strip()) < 6


# The passes


def unwrap_font(page: Node, source: str) -> int:
    found = page.all("font", "center")
    for node in found:
        node.unwrap()
    return len(found)


def anchor_targets(page: Node, source: str) -> int:
    """A link without an address is a place to link to."""
    found = page.all("a", where=lambda a: "href" not in a.attrs)
    for node in found:
        name = node.get("id") or node.get("name")
        node.tag, node.attrs = "span", {"id": name} if name else {}
    return len(found)


def code_blockquotes(page: Node, source: str) -> int:
    """A quote of nothing but code is code."""
    count = 0
    for node in page.all("blockquote"):
        inner = node.elements()
        if inner and all(n.tag == "pre" for n in inner) and node.text().strip() == "".join(n.text().strip() for n in inner):
            node.replace(*inner)
            count += 1
    return count


def footnote_backrefs(page: Node, source: str) -> int:
    """Ways back from a note go, with the paragraph if it holds no more."""
    def points_back(a: Node) -> bool:
        names = a.get("class")
        named = {"footnote-backref", "reversefootnote"} & set(a.classes()) or "footnote" in names and "return" in names
        return bool(named) or "#fnref" in a.get("href") or a.get("role") == "doc-backlink" or a.get("rel") == "footnote-backref"

    count = 0
    for link in page.all("a", where=points_back):
        if BACK_RE.fullmatch(link.text().strip()):
            up = link.up
            link.remove()
            if not up.text().strip() and not up.has("img", "pre", "table"):
                up.remove()
            count += 1
    return count


def layout_tables(page: Node, source: str) -> list[str]:
    """One column of prose in a table becomes the flow; up to five levels of such tables."""
    def is_layout(table: Node) -> bool:
        rows = [r for n in table.elements() for r in (n.elements() if n.tag == "tbody" else [n]) if r.tag == "tr"]
        if table.has("th", "caption") or not rows or not all(len(r.elements()) == 1 and r.elements()[0].tag == "td" for r in rows):
            return False
        return len(table.text().strip()) >= LAYOUT_LEAST or table.has(*LAYOUT_BLOCKS)

    rules = []
    for _ in range(5):
        found = page.all("table", where=is_layout)
        for table in found:
            flow = Node("div")
            for cell in table.all("td"):
                flow.add(*list(cell.kids))
            table.replace(flow)
        rules += ["article.prune.layout-table@1"] * bool(found)
        if not found:
            break
    return rules


def heading_anchors(page: Node, source: str) -> int:
    """Permalinks and icons in headings go; a heading that is a link is unwrapped; the link's id moves to the heading."""
    letters = lambda value: re.sub(r"[\W_]", "", value.lower())

    def is_permalink(link: Node, heading: Node, text: str) -> bool:
        href, place = link.get("href"), unquote(link.get("href").partition("#")[2])
        own = place and (place in (link.get("id"), link.get("name")) or href.startswith("#") and place == heading.get("id"))
        said = letters(text) and letters(text) in letters(place)
        return bool(PERMALINK_RE.fullmatch(text) or PERMALINK_CLASS_RE.search(link.get("class")) or link.get("aria-hidden") == "true" or own and not said)

    count = 0
    for heading in page.all(*HEADINGS):
        whole = heading.text().strip()
        for link in heading.all("a"):
            text = link.text().strip()
            permalink = is_permalink(link, heading, text)
            if (link.get("id") or link.get("name")) and not heading.get("id"):
                heading.attrs["id"] = link.get("id") or link.get("name")
            if permalink and text != whole:
                link.remove()
                count += 1
            elif len(text) >= 0.9 * len(whole):
                link.unwrap()
                count += 1
        if heading.text().strip():
            icons = heading.all("img", "svg")
            for icon in icons:
                icon.remove()
            count += len(icons)
    return count


def title_headings(page: Node, source: str, title: str = "", sites: Iterable[str] = ()) -> list[str]:
    """Among the first three headings that which says the title goes, and those that name the site; any h1 left becomes an h2."""
    def plain(text: str) -> str:
        return collapsed(re.sub(r"[\s¶#🔗]+$", "", text)).lower()

    letters = lambda value: re.sub(r"[\W_]+", "", value)
    wanted, rules, done = plain(title), [], False
    for heading in page.all("h1", "h2")[:3]:
        text = plain(heading.text())
        if not text:
            continue
        padded = f"{wanted} ".startswith(f"{text} ") or f"{text} ".startswith(f"{wanted} ")
        if not done and wanted and (text == wanted or padded and text_before(page, heading) < TITLE_WITHIN):
            heading.remove()
            rules.append("article.prune.duplicate-title@1")
            done = True
        elif text in sites or any(len(s) >= 6 and letters(s) in letters(text) for s in sites):
            heading.remove()
            rules.append("article.prune.site-heading@1")
    firsts = page.all("h1")
    for heading in firsts:
        heading.tag = "h2"
    return rules + ["article.prune.demote-h1@1"] * bool(firsts)


def table_of_contents(page: Node, source: str) -> int:
    """The first list of contents, under its heading or in an element of that name."""
    for heading in page.all(*HEADINGS):
        if CONTENTS_RE.fullmatch(heading.words()) and _drop_while(heading.after(), lambda n: _is_contents_part(n, source)):
            heading.remove()
            return 1
    names = {"table-of-contents", "toc"}
    for node in page.all(where=lambda n: names & set(n.classes()) or n.get("id") in ("table-of-contents", "TableOfContents") or n.tag == "nav" and n.get("id") == "toc" or n.get("role") == "doc-toc"):
        if is_anchor_list(node, source) or is_anchor_list(next(iter(node.all("ul", "ol")), None), source):
            before = node.previous()
            if before and CONTENTS_RE.fullmatch(before.words()):
                before.remove()
            node.remove()
            return 1
    return 0


def _attached(node: Node, page: Node) -> bool:
    return list(node.above())[-1] is page


def navigation_lists(page: Node, source: str) -> int:
    """Lists of links into the page, but for those under a heading like "References", and signs of loading."""
    count = 0
    for node in page.all("ul", "ol"):
        if _attached(node, page) and is_anchor_list(node, source):
            before = node.previous()
            if not (before and before.tag in HEADINGS and REFERENCES_RE.search(before.text())):
                node.remove()
                count += 1
    for node in page.all("p", "div", "span", where=lambda n: not n.elements() and LOADING_RE.fullmatch(n.text().strip())):
        node.remove()
        count += 1
    return count


def _section(heading: Node) -> list[Node]:
    """What a heading heads: all up to the next of its level or above."""
    found = []
    for node in heading.after():
        if node.level() and node.level() <= heading.level():
            break
        found.append(node)
    return found


def _links_only(nodes: list[Node]) -> bool:
    """Whether rules and then a list of nothing but links comes first."""
    first = next((n for n in nodes if n.tag != "hr"), None)
    items = first.all("li") if first and first.tag in ("ul", "ol") else []
    return bool(items) and all(any("href" in a.attrs for a in i.all("a")) for i in items)


def trailing_chrome(page: Node, source: str) -> list[str]:
    """Sections under chrome headings in the last two fifths of the text, or with nothing but a list of links, unless the author wrote them."""
    total, rules = len(page.text()), []
    for heading in page.all(*HEADINGS):
        words = heading.words()
        if not CHROME_RE.fullmatch(words):
            continue
        if not _links_only(heading.after()) and total and _attached(heading, page) and text_before(page, heading) / total < TAIL_FROM:
            continue
        section = _section(heading) if heading.up else []
        if any(_holds_references(n) or n.all(where=_holds_references) for n in section):
            continue
        prose = sum(len(n.text().strip()) for n in section if n.tag in ("p", "blockquote") and density(n) < DENSE)
        if prose > MOST_PROSE and not COMMENTS_RE.fullmatch(words):
            continue
        for node in (heading, *section):
            node.remove()
        rules.append("article.prune.trailing-chrome@1")
    return rules


def _own_text(node: Node) -> str:
    return "".join(n.data or "" for n in node.kids if n.tag == TEXT).strip()


def _flow(page: Node) -> Node:
    """The element whose children are the article, below wrappers; wrappers in it that mean nothing are taken off."""
    flow = page
    while len(flow.elements()) == 1 and not _own_text(flow) and flow.elements()[0].tag in ("article", "div", "section", "main"):
        flow = flow.elements()[0]
    for _ in range(3):
        wrappers = [
            n for n in flow.elements()
            if n.tag in ("div", "section", "article", "header", "footer", "main") and not (_is_chrome_class(n) or n.get("role") or n.get("id") or MEANS_RE.search(n.get("class")))
            and not _own_text(n) and any(k.tag not in MEDIA for k in n.elements())
        ]
        for node in wrappers:
            node.unwrap()
        if not wrappers:
            break
    return flow


def _empty(node: Node) -> bool:
    return node.tag == "hr" or not node.text().strip() and not node.has("img", "picture", "svg", "video", "iframe")


def _under_references(node: Node) -> bool:
    """Right below a heading like "References"; a paragraph also after other paragraphs below it."""
    before = node.previous()
    while node.tag == "p" and before and before.tag == "p":
        before = before.previous()
    return bool(before) and before.tag in HEADINGS and bool(REFERENCES_RE.search(before.text()))


def trailing_cards(page: Node, source: str) -> int:
    """Cards, promotions and dates at the end, up to two fifths of the text, and a heading that they leave bare."""
    flow, gone, count = _flow(page), 0, 0
    total = len(flow.text().strip())
    while flow.elements():
        node = flow.elements()[-1]
        if node.tag in MEDIA - {"hr"}:
            break
        if _empty(node):
            node.remove()
            continue
        text, heading = node.words(), node.tag in HEADINGS
        if node.tag in ("ul", "ol", "p") and _under_references(node) or node.tag == "p" and CITED_RE.match(text) or _is_structure(node):
            break
        short = len(text) < 40 and not re.search(r"[.!?。！？]", text) and not _links(node) and not heading
        leads_in = count and len(text) < 120 and (text[-1:] in ":：" or short)
        cards = sum(a.has("img", "picture", "svg") for a in _links(node))
        promo = len(text) < 600 and (density(node) >= DENSE or PROMO_RE.search(text)) or cards >= 2 and len(text) < 400
        meta = _is_date(text) or _is_meta_only(text, "") or len(text) < 300 and _is_chrome_class(node)
        if not (leads_in or _is_card_list(node) or promo or meta or heading and CHROME_RE.fullmatch(text)):
            break
        if total and (gone + len(text)) / total > TAIL_SHARE:
            break
        gone += len(text)
        node.remove()
        count += 1
    if count and flow.elements() and flow.elements()[-1].tag in HEADINGS:
        flow.elements()[-1].remove()
    return count


def leading_meta(page: Node, source: str, byline: str = "") -> int:
    """Bylines, dates, crumbs and contents before the first paragraph."""
    flow, count, name = _flow(page), 0, collapsed(byline).lower()
    while flow.elements():
        node = flow.elements()[0]
        if node.tag in MEDIA - {"hr"}:
            break
        if _empty(node):
            node.remove()
            continue
        text = node.words()
        if node.tag in HEADINGS and not CONTENTS_RE.fullmatch(text):
            break
        summary = next(iter(node.all("summary")), None)
        if node.tag == "details" and summary and CONTENTS_RE.fullmatch(summary.text().strip()):
            node.remove()
            count += 1
            continue
        if _is_structure(node):
            break
        low = text.lower()
        crumbs = len(text) < 160 and (density(node) >= DENSE or META_RE.search(text) or re.match(r"(?:home|menu|blog|articles)\b", low))
        repeats = name and name in (low, low.removeprefix("by "), re.sub(r"^(?:作者|by|author)[\s:：]*", "", low))
        following = node.next()
        contents = CONTENTS_RE.fullmatch(text) and following is not None and _is_contents_part(following, "")
        if not (crumbs or _is_date(text) or repeats or _is_meta_only(text, byline) or len(text) < 300 and _is_chrome_class(node) or contents):
            break
        node.remove()
        if contents:
            _drop_while(flow.elements(), lambda n: _is_contents_part(n, ""))
        count += 1
    return count


def passes(title: str = "", sites: Iterable[str] = (), byline: str = "") -> tuple[Pass, ...]:
    """The passes in order, for an article with this title and byline on a site with these names (lower-case)."""
    named = "article.prune."
    return (
        Pass(named + "unwrap-font@1", unwrap_font),
        Pass(named + "anchor-targets@1", anchor_targets),
        Pass(named + "code-blockquote@1", code_blockquotes),
        Pass(named + "footnote-backrefs@1", footnote_backrefs),
        Pass(named + "layout-table@1", layout_tables),
        Pass(named + "heading-anchors@1", heading_anchors),
        Pass(named + "duplicate-title@1", partial(title_headings, title=title, sites=frozenset(sites))),
        Pass(named + "table-of-contents@1", table_of_contents),
        Pass(named + "navigation-lists@1", navigation_lists),
        Pass(named + "trailing-chrome@1", trailing_chrome),
        Pass(named + "trailing-cards@1", trailing_cards),
        Pass(named + "leading-meta@1", partial(leading_meta, byline=byline)),
    )
