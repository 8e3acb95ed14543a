"""Reader documents: pages as trees of a small vocabulary, their grammar, and their Markdown.

A document is a table of nodes, one row each in document order: ``page_id, node, last, parent, depth, kind, role, value, props``. ``kind`` is
a word of the vocabulary, ``role`` says which part of its parent a node is (the caption of a figure, the head of a table), ``props`` are
its other values as texts. A document's first row has kind ``root``, and ``losses``: what the page held
that the vocabulary can't say, and what came in its place. ``reader_nodes`` makes the table in the pass that parses a page.

The grammar speaks of a node, its parent and the links around it, so ``violations`` checks it as one join of nodes with
their parents, one window and two groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import quote, urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papershed.sources.elements import HEADINGS, TEXT, Node, grown
from papershed.sources.pages import ROWS, inside, tree

# The vocabulary.
PARENTS = {
    "b": "strong", "cite": "cite", "del": "delete", "em": "emphasis", "i": "emphasis", "ins": "insert", "kbd": "keyboard", "mark": "mark", "q": "quote", "s": "delete", "strong": "strong", "sub": "subscript",
    "sup": "superscript",
}
PHRASING_PARENTS = ("abbreviation", "cite", "delete", "emphasis", "heading", "insert", "keyboard", "link", "mark", "paragraph", "quote", "strong", "subscript", "superscript")
FLOW_PARENTS = ("root", "blockquote", "footnoteDefinition", "listItem", "section", "tableCell")
PHRASING = ("abbreviation", "break", "cite", "delete", "emphasis", "footnoteReference", "image", "inlineCode", "insert", "keyboard", "link", "mark", "quote", "strong", "subscript", "superscript", "text")
FLOW = ("blockquote", "code", "figure", "footnoteDefinition", "heading", "list", "paragraph", "section", "table", "thematicBreak")
OTHERS = ("listItem", "tableSection", "tableRow", "tableCell", "math", "root")
CALLOUTS = ("note", "tip", "important", "key-point", "warning", "caution")
ALIGNMENTS, SCOPES, FALLBACKS = ("left", "center", "right"), ("col", "colgroup", "row", "rowgroup"), ("children", "omitted", "text")
ACTIVE = ("audio", "button", "embed", "form", "iframe", "input", "object", "script", "style", "svg", "video")
CONTAINERS = ("font", "span", "b", "i", "em", "strong", "small", "big", "center")
WRAPPERS = ("address", "article", "aside", "dd", "details", "div", "dl", "dt", "fieldset", "footer", "header", "main", "nav", "section", "summary")
FOOTNOTE_LINK = re.compile(r"#(?:reader-)?(?:user-content-)?(?:fn|footnote)(?:[-_:\d]|$)", re.I)
#: Pages deeper than this, with more nodes, or with more text have no document but the loss ``SOURCE_REPRESENTATION_BUDGET_EXCEEDED``.
DEEPEST, MOST_NODES, MOST_CHARS = 128, 200_000, 8 << 20
MOST_INLINE, LARGEST_SIDE, LARGEST_SPAN = 2 << 20, 20_000, 1_000
INLINE_IMAGE = r"^data:image/(?:avif|gif|jpeg|png|webp);base64,[A-Za-z\d+/]+={0,2}$"
DISPLAY_MATH = re.compile(r"\s*(?:\$\$(?P<a>.+?)(?<!\\)\$\$|\\\[(?P<b>.+?)\\\]|(?P<c>\\begin\{(?P<e>(?:equation|align|gather|multline|flalign|alignat)\*?)\}.+?\\end\{(?P=e)\}))\s*", re.S)
INLINE_MATH = re.compile(r"(?<!\\)\\\((?P<a>.+?)\\\)|(?<![\\$\w])\$(?P<b>[^\s$](?:[^$\n]*?[^\s\\$])?)\$(?![\d$])", re.S)


@dataclass
class Doc:
    """A node of a reader document; ``kids`` are its children in order, each with its role."""

    kind: str
    value: str | None = None
    props: dict[str, str] = field(default_factory=dict)
    kids: list[tuple[str, Doc]] = field(default_factory=list)
    losses: list[tuple[str, str, str]] = field(default_factory=list)

    def add(self, nodes: Iterable[Doc], role: str = "") -> Doc:
        self.kids += [(role, n) for n in nodes]
        return self

    def part(self, role: str) -> list[Doc]:
        return [n for r, n in self.kids if r == role]

    def plain(self) -> str:
        return self.value or "" if self.kind != "break" and not self.kids else "\n" if self.kind == "break" else "".join(n.plain() for _, n in self.kids)


def _identifier(value: str) -> str:
    return re.sub(r"^(?:reader-|user-content-)+", "", value.strip())


class Builder:
    """Makes a document of a page's tree; ``losses`` are (code, fallback, tag)."""

    def __init__(self, source: str) -> None:
        self.source, self.losses = source, []

    def lose(self, code: str, fallback: str, node: Node) -> None:
        self.losses.append((code, fallback, node.tag))

    def url(self, value: str, mail: bool = False) -> str | None:
        """An absolute link of http(s) without a user, or of mailto where that is allowed."""
        try:
            whole = urljoin(self.source, value.strip())
            parts = urlsplit(whole)
            fine = parts.scheme in ("http", "https") and parts.netloc and "@" not in parts.netloc
            return quote(whole, safe=";/?:@&=+$,#%[]!'()*~|-._") if value.strip() and (fine or mail and parts.scheme == "mailto") else None
        except ValueError:
            return None

    def target(self, href: str) -> str | None:
        """The place that a link names on its own page."""
        base, _, place = href.partition("#")
        same = not base or bool(self.source) and urljoin(self.source, base) == urldefrag(self.source)[0]
        return _identifier(place) or None if same else None

    # Phrasing

    def text(self, value: str) -> list[Doc]:
        found, at = [], 0
        for m in INLINE_MATH.finditer(value):
            found += [Doc("text", value[at : m.start()])] * (m.start() > at)
            found.append(Doc("math", (m["a"] or m["b"]).strip(), {"display": "false", "format": "tex"}))
            at = m.end()
        return found + [Doc("text", value[at:])] * (at < len(value))

    def phrasing(self, nodes: Iterable[Node], linked: bool = False) -> list[Doc]:
        return [d for n in nodes for d in (self.text(re.sub(r"\s+", " ", n.data or "")) if n.tag == TEXT else self.inline(n, linked))]

    def inline(self, node: Node, linked: bool) -> list[Doc]:
        tag = node.tag
        if tag in ACTIVE:
            self.lose("ACTIVE_CONTENT_DROPPED", "omitted", node)
            return []
        reference = self.reference(node)
        if reference:
            return [reference]
        if tag == "br":
            return [Doc("break")]
        if tag == "code":
            return [Doc("inlineCode", node.text())]
        if tag == "img":
            image = self.image(node)
            return [image] if image else [Doc("text", node.get("alt").strip())] if node.get("alt").strip() else []
        if tag == "math" or {"math", "katex"} & set(node.classes()):
            tex = self.formula(node)
            return [Doc("math", tex, {"display": "false", "format": "tex"})] if tex else []
        if tag == "a":
            return self.link(node, linked)
        if tag == "abbr":
            return [Doc("abbreviation", props={"title": node.get("title")} if node.get("title") else {}).add(self.phrasing(node.kids, linked))]
        if tag in PARENTS:
            return [Doc(PARENTS[tag]).add(self.phrasing(node.kids, linked))]
        if tag not in ("span", "font", "small", "big", "u", "time", "p", "wbr"):
            self.lose("UNSUPPORTED_ELEMENT", "children", node)
        return self.phrasing(node.kids, linked)

    def reference(self, node: Node) -> Doc | None:
        marked = lambda a: a.get("role") == "doc-noteref" or "data-footnote-ref" in a.attrs
        if node.tag == "a" and marked(node):
            link = node
        elif node.tag == "sup":
            link = next(iter(node.all("a", where=lambda a: marked(a) or FOOTNOTE_LINK.search(a.get("href")))), None)
        else:
            return None
        name = self.target(link.get("href")) if link else None
        return Doc("footnoteReference", link.text().strip() or name, {"identifier": name}) if name else None

    def link(self, node: Node, linked: bool) -> list[Doc]:
        if node.get("role") == "doc-backlink" or "data-footnote-backref" in node.attrs:
            return []
        inner = self.phrasing(node.kids, True)
        url = self.url(node.get("href"), mail=True)
        if linked or not url:
            self.lose("NESTED_LINK_FLATTENED" if linked else "UNSAFE_LINK_DROPPED", "children", node)
            return inner
        props = {"url": url, "title": node.get("title"), "targetAnchor": self.target(node.get("href")) or ""}
        return [Doc("link", props={k: v for k, v in props.items() if v}).add(inner)]

    def image(self, node: Node) -> Doc | None:
        raw = node.get("src").strip()
        url = raw if len(raw) <= MOST_INLINE * 4 // 3 + 64 and re.match(INLINE_IMAGE, raw) else self.url(raw) if not raw.startswith("data:") else None
        if not url:
            self.lose("UNSAFE_IMAGE_DROPPED", "text" if node.get("alt").strip() else "omitted", node)
            return None
        sides = {s: node.get(s) for s in ("width", "height") if node.get(s).isdecimal() and 1 <= int(node.get(s)) <= LARGEST_SIDE}
        return Doc("image", node.get("alt").strip(), {"url": url} | ({"title": node.get("title")} if node.get("title") else {}) | sides)

    def formula(self, node: Node) -> str:
        source = next((n.text() for n in node.all("annotation", where=lambda n: "tex" in n.get("encoding"))), "")
        return (source or node.get("alttext") or node.text()).strip()

    # Flow

    def flow(self, nodes: Iterable[Node]) -> list[Doc]:
        found: list[Doc] = []
        pending: list[Doc] = []

        def flush() -> None:
            found.extend(paragraphs(pending))
            pending.clear()

        for node in nodes:
            if node.tag == TEXT:
                display = display_math(node.data or "")
                blocks = display or None
            else:
                blocks = self.block(node)
            if blocks is None:
                pending += self.phrasing([node])
            else:
                flush()
                found += blocks
        flush()
        return found

    def block(self, node: Node) -> list[Doc] | None:
        """What a block element becomes; None if the element is phrasing."""
        tag = node.tag
        if tag in ACTIVE:
            self.lose("ACTIVE_CONTENT_DROPPED", "omitted", node)
            return []
        if tag in HEADINGS:
            return [Doc("heading", props={"depth": tag[1]} | self.anchor(node)).add(compact(self.phrasing(node.kids)))]
        if node.get("role") == "doc-endnotes" or {"footnotes", "footnote-list"} & set(node.classes()) or _identifier(node.get("id")).lower() == "footnotes":
            return [Doc("footnoteDefinition", _identifier(li.get("id")), {"identifier": _identifier(li.get("id"))}).add(self.flow(li.kids)) for li in node.all("li") if _identifier(li.get("id"))]
        if (tag == "p" or tag in WRAPPERS) and (display := display_math(node.text())):
            return display
        if tag == "p":
            return paragraphs(self.phrasing(node.kids))
        if tag == "blockquote":
            said = node.get("data-callout").strip().lower()
            kind = {"callout": said if said in CALLOUTS else "note"} if "data-callout" in node.attrs else {}
            return [Doc("blockquote", props=kind).add(self.flow(node.kids))]
        if tag == "section":
            return [Doc("section", props=self.anchor(node)).add(self.flow(node.kids))]
        if tag in ("ul", "ol"):
            start = {"start": node.get("start")} if tag == "ol" and re.fullmatch(r"-?[1-9]\d{0,8}", node.get("start")) else {}
            return [Doc("list", props={"ordered": str(tag == "ol").lower()} | start).add(Doc("listItem").add(self.flow(n.kids)) for n in node.elements() if n.tag == "li")]
        if tag == "pre" or tag == "code" and "\n" in node.text().strip():
            code = next((n for n in node.elements() if n.tag == "code"), node) if tag == "pre" else node
            lang = language_of(code) or language_of(node)
            return [Doc("code", code.text().removesuffix("\n"), {"lang": lang} if lang else {})]
        if tag in CONTAINERS and any(n.tag == "p" or n.tag in WRAPPERS for n in node.elements()):
            return self.flow(node.kids)
        if tag == "figure":
            return self.figure(node)
        if tag == "table":
            return self.table(node)
        if tag == "hr":
            return [Doc("thematicBreak")]
        if tag == "math" or {"math", "katex-display"} & set(node.classes()) and {"display", "katex-display"} & set(node.classes()):
            tex = self.formula(node)
            return [Doc("math", tex, {"display": "true", "format": "tex"})] if tex else []
        if tag in WRAPPERS:
            self.lose("UNSUPPORTED_ELEMENT", "children", node)
            return self.flow(node.kids)
        return None

    def anchor(self, node: Node) -> dict[str, str]:
        return {"anchor": _identifier(node.get("id"))} if _identifier(node.get("id")) else {}

    def figure(self, node: Node) -> list[Doc]:
        """Pictures with caption and credit; what else is in it, if it has no picture, stands on its own."""
        media = [i for n in node.all("img") if (i := self.image(n))]
        said = next(iter(node.all("figcaption")), None)
        if not media:
            self.lose("FIGURE_WITHOUT_MEDIA_FLATTENED", "children", node)
            return self.flow([k for n in node.kids for k in (n.kids if n.tag == "figcaption" else [n])])
        credits = said.all("cite", "small", where=lambda n: {"credit", "attribution"} & set(n.classes()) or n.tag == "small") if said else []
        for c in credits:
            c.remove()
        made = Doc("figure").add(media, "media").add(compact(self.phrasing(said.kids)) if said else [], "caption")
        return [made.add(compact([d for c in credits for d in self.phrasing(c.kids)]), "credit")]

    def table(self, node: Node) -> list[Doc]:
        parts = {t: [n for n in node.elements() if n.tag == t] for t in ("caption", "thead", "tbody", "tfoot", "tr")}
        if not any(parts[t] for t in ("thead", "tbody", "tfoot", "tr")):
            self.lose("EMPTY_TABLE_FLATTENED", "children", node)
            return self.flow(node.kids)
        section = lambda rows: Doc("tableSection").add(self.row(r) for r in rows if r.tag == "tr")
        made = Doc("table").add(compact(self.phrasing(parts["caption"][0].kids)) if parts["caption"] else [], "caption")
        made.add((section(n.elements()) for n in parts["thead"][:1]), "head").add((section(n.elements()) for n in parts["tbody"]), "body")
        return [made.add([section(parts["tr"])] if parts["tr"] else [], "body").add((section(n.elements()) for n in parts["tfoot"][:1]), "foot")]

    def row(self, node: Node) -> Doc:
        def cell(n: Node) -> Doc:
            span = {k: n.get(k.lower()) for k in ("colSpan", "rowSpan") if n.get(k.lower()).isdecimal() and 1 <= int(n.get(k.lower())) <= LARGEST_SPAN}
            align, scope = n.get("align").lower(), n.get("scope").lower()
            props = {"header": str(n.tag == "th").lower()} | ({"align": align} if align in ALIGNMENTS else {}) | ({"scope": scope} if n.tag == "th" and scope in SCOPES else {})
            return Doc("tableCell", props=props | span).add(self.flow(n.kids))

        return Doc("tableRow").add(cell(n) for n in node.elements() if n.tag in ("td", "th"))


def language_of(node: Node) -> str:
    return next((c.split("-", 1)[1] for c in node.classes() if re.match(r"lang(?:uage)?-.", c)), "")


def display_math(text: str) -> list[Doc] | None:
    """Formulas, if a text is nothing but formulas that are set apart."""
    at, found = 0, []
    while at < len(text) and (m := DISPLAY_MATH.match(text, at)):
        found.append(Doc("math", (m["a"] or m["b"] or m["c"]).strip(), {"display": "true", "format": "tex"}))
        at = m.end()
    return found if found and at == len(text) else None


def compact(nodes: list[Doc]) -> list[Doc]:
    """Texts side by side joined, white space collapsed, none at the ends."""
    out: list[Doc] = []
    for n in nodes:
        if n.kind == "text" and out and out[-1].kind == "text":
            out[-1] = Doc("text", re.sub(r"\s+", " ", (out[-1].value or "") + (n.value or "")))
        else:
            out.append(n)
    for k, strip in ((0, str.lstrip), (-1, str.rstrip)):
        while out and out[k].kind == "text":
            out[k] = Doc("text", strip(out[k].value or ""))
            if out[k].value:
                break
            del out[k]
    return [n for n in out if n.kind != "text" or n.value]


def paragraphs(nodes: list[Doc]) -> list[Doc]:
    """Paragraphs of phrasing nodes: two breaks in a row part them, breaks at their ends and blank ones go. Pictures alone are a figure."""
    groups: list[list[Doc]] = [[]]
    for n in compact(nodes):
        blank = n.kind == "text" and not (n.value or "").strip()
        ends = next((k for k in range(len(groups[-1]) - 1, -1, -1) if groups[-1][k].kind != "text" or (groups[-1][k].value or "").strip()), -1)
        if n.kind == "break" and ends >= 0 and groups[-1][ends].kind == "break":
            groups[-1] = groups[-1][:ends]
            groups.append([])
        elif not (n.kind == "break" or blank) or groups[-1]:
            groups[-1].append(n)
    found = []
    for group in groups:
        while group and (group[-1].kind == "break" or group[-1].kind == "text" and not (group[-1].value or "").strip()):
            group.pop()
        group = compact(group)
        if group and all(n.kind == "image" for n in group):
            found.append(Doc("figure").add(group, "media"))
        elif group:
            found.append(Doc("paragraph").add(group))
    return found


def reader_document(html: str | None, source: str, title: str = "") -> Doc:
    """The document of a page at ``source``; a leading heading that says ``title`` goes."""
    rows = tree(html)
    root = Doc("root")
    if len(rows) > MOST_NODES or len(html or "") > MOST_CHARS or max((r[3] for r in rows), default=0) > DEEPEST:
        root.losses = [("SOURCE_REPRESENTATION_BUDGET_EXCEEDED", "omitted", "html")]
        return root
    page = grown(rows)
    for head in page.all("head", "title"):
        head.remove()
    builder = Builder(source)
    body = next(iter(page.all("body")), next(iter(page.all("html")), page))
    kids = builder.flow(body.kids)
    plain = lambda value: re.sub(r"[\W_]+", "", value.lower())
    if title and kids and kids[0].kind == "heading" and plain(kids[0].plain()) == plain(title):
        builder.losses.append(("DUPLICATE_TITLE_REMOVED", "omitted", f"h{kids[0].props['depth']}"))
        kids = kids[1:]
    seen: set[str] = set()
    root.add(kids)
    root.losses = builder.losses
    _unique_notes(root, seen)
    return root


def _unique_notes(node: Doc, seen: set[str]) -> None:
    """Of notes with one identifier the first stays."""
    kept = []
    for role, n in node.kids:
        name = n.props.get("identifier") if n.kind == "footnoteDefinition" else None
        if name is None or name not in seen:
            seen |= {name} - {None}
            kept.append((role, n))
            _unique_notes(n, seen)
    node.kids = kept


# Markdown


def _escaped(text: str) -> str:
    return re.sub(r"([\\`*_\[\]<>|#~])", r"\\\1", text)


MARKS = {"strong": "**", "emphasis": "*", "delete": "~~"}


def phrase_markdown(nodes: list[Doc]) -> str:
    out = []
    for n in nodes:
        inner = phrase_markdown([k for _, k in n.kids])
        if n.kind == "text":
            out.append(_escaped(n.value or ""))
        elif n.kind == "break":
            out.append("\\\n")
        elif n.kind == "inlineCode":
            ticks = "`" * (max(map(len, re.findall("`+", n.value or "")), default=0) + 1)
            pad = " " if (n.value or "")[:1] == "`" or (n.value or "")[-1:] == "`" else ""
            out.append(f"{ticks}{pad}{n.value}{pad}{ticks}")
        elif n.kind == "link":
            out.append(f"[{inner}]({n.props['url']})")
        elif n.kind == "image":
            out.append(f"![{_escaped(n.value or '')}]({n.props['url']})")
        elif n.kind == "math":
            out.append(f"${n.value}$")
        elif n.kind == "footnoteReference":
            out.append(f"[^{n.props['identifier']}]")
        elif n.kind in MARKS and inner.strip():
            lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
            out.append(f"{lead}{MARKS[n.kind]}{inner.strip()}{MARKS[n.kind]}{tail}")
        else:
            out.append(inner)
    return "".join(out)


def _indented(text: str, first: str, rest: str) -> str:
    return "\n".join((first if k == 0 else rest) + line if line or k == 0 else rest.rstrip() for k, line in enumerate(text.split("\n")))


def flow_markdown(nodes: list[Doc]) -> str:
    return "\n\n".join(b for b in map(block_markdown, nodes) if b)


def block_markdown(n: Doc) -> str:
    inner = [k for _, k in n.kids]
    if n.kind == "heading":
        return f"{'#' * int(n.props['depth'])} {phrase_markdown(inner)}"
    if n.kind == "paragraph":
        return phrase_markdown(inner)
    if n.kind == "code":
        fence = "`" * max(3, max(map(len, re.findall("`+", n.value or "")), default=0) + 1)
        return f"{fence}{n.props.get('lang', '')}\n{n.value}\n{fence}"
    if n.kind == "math":
        return f"$$\n{n.value}\n$$"
    if n.kind == "thematicBreak":
        return "---"
    if n.kind == "blockquote":
        said = f"[!{n.props['callout'].upper()}]\n" if "callout" in n.props else ""
        return _indented(said + flow_markdown(inner), "> ", "> ")
    if n.kind == "list":
        first = int(n.props.get("start", 1))
        marks = [f"{first + k}. " if n.props["ordered"] == "true" else "- " for k in range(len(inner))]
        return "\n".join(_indented(flow_markdown([k for _, k in item.kids]), mark, " " * len(mark)) for mark, item in zip(marks, inner))
    if n.kind == "figure":
        caption = phrase_markdown(n.part("caption") + [Doc("text", " ")] * bool(n.part("credit")) + n.part("credit")).strip()
        return "\n\n".join([phrase_markdown([m]) for m in n.part("media")] + [caption] * bool(caption))
    if n.kind == "footnoteDefinition":
        return _indented(flow_markdown(inner), f"[^{n.props['identifier']}]: ", "    ")
    if n.kind == "table":
        return _table_markdown(n)
    return flow_markdown(inner)


def _table_markdown(n: Doc) -> str:
    """A table with a bar between cells; the head's first row, or the first of all, is its head."""
    rows = [r for role in ("head", "body", "foot") for s in n.part(role) for _, r in s.kids]
    cells = [[re.sub(r"\s*\n\s*", " ", flow_markdown([k for _, k in c.kids])) for _, c in r.kids] for r in rows]
    width = max(map(len, cells), default=0)
    if not width:
        return phrase_markdown(n.part("caption"))
    lines = [f"| {' | '.join(row + [''] * (width - len(row)))} |" for row in cells]
    lines.insert(1, f"|{' --- |' * width}")
    caption = phrase_markdown(n.part("caption"))
    return "\n\n".join([caption] * bool(caption) + ["\n".join(lines)])


# Tables of nodes

READER = "node int, last int, parent int, depth int, kind string, role string, value string, props map<string,string>, losses array<struct<code:string,fallback:string,tag:string>>, markdown string"
_LOSS = pa.list_(pa.struct([("code", pa.string()), ("fallback", pa.string()), ("tag", pa.string())]))
_READER = [*[pa.int32()] * 4, *[pa.string()] * 3, pa.map_(pa.string(), pa.string()), _LOSS, pa.string()]


def document_rows(root: Doc, markdown: bool = True) -> list[list]:
    rows: list[list] = []

    def walk(n: Doc, role: str, parent: int | None, depth: int) -> None:
        at = len(rows)
        rows.append([at, at, parent, depth, n.kind, role, n.value, sorted(n.props.items()), None, None])
        for r, k in n.kids:
            walk(k, r, at, depth + 1)
        rows[at][1] = len(rows) - 1

    walk(root, "", None, 0)
    rows[0][8] = [dict(zip(("code", "fallback", "tag"), x)) for x in root.losses]
    rows[0][9] = flow_markdown([k for _, k in root.kids]) if markdown else None
    return rows


def reader_nodes(pages: DataFrame, key: str = "page_id", title: str | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """The reader documents of pages ``key, url, html`` (and a column of titles), parsed and mapped where they lie; some ROWS rows a batch.

    ``only`` names the columns that are wanted, all without it; what isn't wanted isn't made.
    """
    columns = [key, "url", "html", *([title] if title else [])]
    fields = [c.split()[0] for c in re.split(r", (?=\w+ )", READER)]
    wanted = [k for k, c in enumerate(fields) if only is None or c in only]
    names, markdown = [key, *(fields[k] for k in wanted)], fields.index("markdown") in wanted

    def run(batches):
        for batch in batches:
            keys: list = []
            rows: list[list] = []

            def out() -> pa.RecordBatch:
                cells = list(zip(*rows))
                made = pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), *(pa.array(cells[k], _READER[k]) for k in wanted)], names)
                keys.clear()
                rows.clear()
                return made

            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in columns}
                found = document_rows(reader_document(row["html"], row["url"] or "", (row[title] or "") if title else ""), markdown)
                rows += found
                keys += [row[key]] * len(found)
                if len(rows) >= ROWS:
                    yield out()
            if rows:
                yield out()

    types = re.split(r", (?=\w+ )", READER)
    return pages.select(*columns).mapInArrow(run, ", ".join([f"{key} {pages.schema[key].dataType.simpleString()}", *(types[k] for k in wanted)]))


# Grammar


def prop(name: str) -> Column:
    return F.col("props")[name]


def _whole(name: str, least: int, most: int) -> Column:
    """Whether a property is missing or a whole number within bounds."""
    return prop(name).isNull() | F.coalesce(prop(name).rlike(r"^\d{1,6}$") & prop(name).try_cast("int").between(least, most), F.lit(False))


def _one_of(name: str, values: tuple[str, ...]) -> Column:
    return prop(name).isNull() | prop(name).isin(*values)


def _own_rules() -> dict[str, Column]:
    """Which rules a node keeps that speak of it alone."""
    kind = F.col("kind")
    http = prop("url").rlike(r"^https?://[^/?#@]+([/?#]|$)")
    image = (F.char_length(prop("url")) <= MOST_INLINE * 4 // 3 + 64) & prop("url").rlike(INLINE_IMAGE) | http
    safe = F.when(kind == "image", image).when(kind == "link", http | prop("url").startswith("mailto:")).otherwise(True)
    in_range = (
        F.when(kind == "heading", _whole("depth", 1, 6) & prop("depth").isNotNull())
        .when(kind == "image", _whole("width", 1, LARGEST_SIDE) & _whole("height", 1, LARGEST_SIDE))
        .when(kind == "tableCell", _whole("colSpan", 1, LARGEST_SPAN) & _whole("rowSpan", 1, LARGEST_SPAN) & _one_of("align", ALIGNMENTS) & _one_of("scope", SCOPES))
        .when(kind == "blockquote", _one_of("callout", CALLOUTS))
        .when(kind == "list", F.coalesce(prop("ordered").isin("true", "false"), F.lit(False)))
        .otherwise(True)
    )
    named = ~kind.isin("footnoteReference", "footnoteDefinition") | (F.coalesce(prop("identifier"), F.lit("")) != "")
    losses_fine = F.coalesce(F.forall("losses", lambda x: (x["code"] != "") & (x["tag"] != "") & x["fallback"].isin(*FALLBACKS)), F.lit(True))
    return {
        "unknown_kind": kind.isin(*PHRASING, *FLOW, *OTHERS), "unsafe_url": F.coalesce(safe, F.lit(False)), "bad_value": in_range,
        "empty_math": (kind != "math") | (F.coalesce("value", F.lit("")) != ""), "no_identifier": named, "bad_loss": losses_fine,
    }


def violations(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, node, rule``: where documents break the grammar; none for a document that follows it.

    unknown_kind; misplaced (a kind that its parent, or that part of it, can't hold); nested_link; unsafe_url; bad_value (a property out of
    its range); empty_math; no_identifier; duplicate_footnote; empty_figure and empty_table (without media or sections); bad_loss.
    """
    kind, above = F.col("kind"), F.col("above")
    nodes = nodes.select(key, "node", "last", "parent", "kind", "role", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in _own_rules().items()], prop("identifier").alias("identifier"), F.coalesce(prop("display") == "true", F.lit(False)).alias("display"))
    parents = nodes.select(key, F.col("node").alias("parent"), F.col("kind").alias("above"), (F.col("kind") == "link").alias("in_link"))
    placed = inside(nodes, kind == "link", "linked", key).join(parents, [key, "parent"], "left")
    phrasing, flow = kind.isin(*PHRASING) | ((kind == "math") & ~F.col("display")), kind.isin(*FLOW) | ((kind == "math") & F.col("display"))
    role = F.coalesce("role", F.lit(""))
    fits = (
        F.when(above.isNull(), kind == "root")
        .when(above.isin(*PHRASING_PARENTS) | role.isin("caption", "credit"), phrasing)
        .when(above.isin(*FLOW_PARENTS), flow)
        .when(above == "list", kind == "listItem")
        .when(above == "figure", (role == "media") & (kind == "image"))
        .when(above == "table", role.isin("head", "body", "foot") & (kind == "tableSection"))
        .when(above == "tableSection", kind == "tableRow")
        .when(above == "tableRow", kind == "tableCell")
        .otherwise(False)
    )
    rules = {n: F.col(n) for n in _own_rules()} | {"misplaced": fits, "nested_link": ~((kind == "link") & F.col("linked"))}
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(fine, F.lit(False)), F.lit(rule)) for rule, fine in rules.items()]))
    single = placed.select(key, "node", F.explode(broken).alias("rule"))
    notes = nodes.filter("kind = 'footnoteDefinition'").groupBy(key, F.col("identifier").alias("id")).agg(F.count("*").alias("n"), F.max("node").alias("node")).filter("n > 1")
    filled = placed.filter(above.isin("figure", "table") & role.isin("media", "head", "body", "foot")).select(key, F.col("parent").alias("node")).distinct()
    hollow = nodes.filter("kind in ('figure', 'table')").join(filled, [key, "node"], "left_anti")
    return single.union(notes.select(key, "node", F.lit("duplicate_footnote"))).union(hollow.select(key, "node", F.concat(F.lit("empty_"), "kind")))


def within_limits(nodes: DataFrame, most_nodes: int = 20_000, deepest: int = 64, most_bytes: int = 4 << 20, key: str = "page_id") -> DataFrame:
    """``key, fits, n_nodes, depth, bytes``: which documents are small enough to be shown: nodes, depth and bytes of their texts and properties."""
    size = F.octet_length(F.coalesce("value", F.lit(""))) + F.aggregate(F.map_values("props"), F.lit(0), lambda n, v: n + F.octet_length(v))
    sums = nodes.groupBy(key).agg(F.count("*").alias("n_nodes"), F.max("depth").alias("depth"), F.sum(size).alias("bytes"))
    return sums.withColumn("fits", (F.col("n_nodes") <= most_nodes) & (F.col("depth") <= deepest) & (F.col("bytes") <= most_bytes))
