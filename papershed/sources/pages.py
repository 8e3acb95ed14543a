"""HTML pages as a table of nodes, so that everything after the parse is joins, groups and windows.

``page_nodes`` has a row for each element and text of a page in document order: ``page_id, node`` (from 0), ``last`` (the last
node inside it), ``parent, depth, tag`` ("#text" for text), ``attrs`` (map), ``text``, ``flow``. Texts of one flow have no
start or end of a block element between them. A node is inside an element if it lies in (node, last].
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papershed.sources.folders import kept

# Elements without content; elements that end a paragraph; what a start tag closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: What the start of an element ends, and the elements across which it doesn't.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES |= dict.fromkeys(("thead", "tbody", "tfoot"), ("thead", "tbody", "tfoot", "tr", "td", "th"))
ACROSS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)} | dict.fromkeys(("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",))
ACROSS_P = ("button", "caption", "html", "object", "table", "td", "template", "th")
#: Elements of form that go on in the next block when a block ends them, each three times at most.
FORM = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}

COLUMNS = "node int, last int, parent int, depth int, tag string, attrs map<string,string>, text string, flow int"
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32()]
ROWS = 20_000

# Elements whose content is no markup; those of them whose character references count.
RAW = ("script", "style", "xmp", "title", "textarea")
READ = ("title", "textarea")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class _Scan:
    """The tags and texts of a page. Every search goes on from where the last one ended or is not made again, so time is linear."""

    def __init__(self, html: str) -> None:
        self.html, self.at, self.last = html, 0, html.rfind(">")
        self.unclosed = {q for q in "\"'" if q not in html}

    def events(self) -> Iterator[tuple[str, str, list | str]]:
        """("open", tag, attributes), ("close", tag, ""), ("text", "", text) in order; comments and doctypes are left out."""
        html, size = self.html, len(self.html)
        while self.at < size:
            start = html.find("<", self.at)
            start = size if start < 0 else start
            if start > self.at:
                yield "text", "", unescape(html[self.at : start])
                self.at = start
                continue
            if start > self.last:
                yield "text", "", unescape(html[start:])
                return
            following = html[start + 1]
            closing = following == "/"
            name = _NAME.match(html, start + 1 + closing)
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                self.at = size if end < 0 else end + 3
            elif name:
                tag, self.at = name[0].lower(), name.end()
                attrs = self._attributes()
                yield ("close", tag, "") if closing else ("open", tag, attrs)
                if tag in RAW and not closing:
                    yield from self._raw(tag)
            elif following in "!?/":
                self.at = html.find(">", start) + 1
            else:
                yield "text", "", "<"
                self.at += 1

    def _attributes(self) -> list[tuple[str, str]]:
        """The attributes of a tag; afterwards ``at`` stands behind it. A quote that never ends is part of a bare value."""
        html, found = self.html, []
        while True:
            self.at = _GAP.match(html, self.at).end()
            if self.at >= len(html) or html[self.at] == ">":
                self.at += 1
                return found
            key = _KEY.match(html, self.at)
            self.at, value = key.end(), ""
            if equals := _EQUALS.match(html, self.at):
                self.at = equals.end()
                quote = html[self.at : self.at + 1]
                end = html.find(quote, self.at + 1) if quote in ('"', "'") and quote not in self.unclosed else -1
                if end >= 0:
                    value, self.at = html[self.at + 1 : end], end + 1
                else:
                    self.unclosed |= {quote} & {'"', "'"}
                    bare = _BARE.match(html, self.at)
                    value, self.at = bare[0], bare.end()
            found.append((key[0].lower(), unescape(value)))

    def _raw(self, tag: str) -> Iterator[tuple[str, str, str]]:
        end = _RAW_ENDS[tag].search(self.html, self.at)
        stop = end.start() if end else len(self.html)
        if stop > self.at:
            text = self.html[self.at : stop]
            yield "text", "", unescape(text) if tag in READ else text
        self.at = stop


class _Rows:
    """Collects rows [node, last, parent, depth, tag, attrs, text, flow] of elements and texts in document order."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.open: list[int] = []
        self.at: dict[str, list[int]] = {}  # the depths of open elements by tag
        self.flow = 0

    def add(self, tag: str, attrs: dict[str, str], text: str | None) -> int:
        if tag in BLOCKS:
            self.flow += 1
        self.rows.append([len(self.rows), len(self.rows), self.open[-1] if self.open else None, len(self.open), tag, list(attrs.items()), text, self.flow])
        return len(self.rows) - 1

    def down(self, tag: str, attrs: dict[str, str]) -> None:
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(self.add(tag, attrs, None))

    def up(self) -> list:
        row = self.rows[self.open.pop()]
        self.at[row[4]].pop()
        row[1] = len(self.rows) - 1
        if row[4] in BLOCKS:
            self.flow += 1
        return row

    def deepest(self, tags: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def end(self, tags: tuple[str, ...], across: tuple[str, ...]) -> list[list]:
        """Closes the open elements with these tags that no element of ``across`` parts from here; the rows of elements of form that went with them."""
        wall, gone = self.deepest(across), []
        while self.deepest(tags) > wall:
            row = self.up()
            if row[4] in FORM and sum(g[4] == row[4] for g in gone) < 3:
                gone.append(row)
        return gone[::-1]


def tree(html: str | None) -> list[list]:
    """The rows of one page, whatever it holds; none for null. Of an attribute's values the first counts. Nothing is dropped: what is no markup is text."""
    out = _Rows()
    for kind, tag, rest in _Scan(html or "").events():
        if kind == "text":
            out.add("#text", {}, rest)
        elif kind == "open":
            form = out.end(CLOSES[tag], ACROSS[tag]) if tag in CLOSES else []
            form = [] if "table" in ACROSS.get(tag, ()) else form  # what is set in a cell ends with it
            form += out.end(("p",), ACROSS_P) if tag in BLOCKS else []
            attrs = dict(reversed(rest))
            if tag in VOID:
                out.add(tag, attrs, None)
            else:
                out.down(tag, attrs)
            for row in form:
                out.down(row[4], dict(row[5]))
        elif out.at.get(tag):
            while out.up()[4] != tag:
                pass
    while out.open:
        out.up()
    return out.rows


def _emitted(pages: DataFrame, key: str, columns: list[str], made: Callable[[dict], list[list]], extra: list[tuple[str, str, pa.DataType]], only: tuple[str, ...] | None = None) -> DataFrame:
    """Rows that ``made`` gives for each page of ``columns``, one Arrow pass, some ROWS rows a batch; ``extra`` columns stand behind those of a node. ``only`` names the columns that are wanted, all without it."""
    kind = pages.schema[key].dataType.simpleString()
    fields = [*zip((c.split()[0] for c in COLUMNS.split(", ")), (c.split()[1] for c in COLUMNS.split(", ")), _KINDS), *extra]
    wanted = [k for k, f in enumerate(fields) if only is None or f[0] in only]
    names = [key, *(fields[k][0] for k in wanted)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_type = batch.schema.field(key).type
            keys: list = []
            rows: list[list] = []

            def out() -> pa.RecordBatch:
                cells = list(zip(*rows))
                made_now = pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array(cells[k], fields[k][2]) for k in wanted)], names)
                keys.clear()
                rows.clear()
                return made_now

            for page in range(batch.num_rows):
                row = {c: batch.column(c)[page].as_py() for c in columns}
                found = made(row)
                rows += found
                keys += [row[key]] * len(found)
                if len(rows) >= ROWS:
                    yield out()
            if rows:
                yield out()

    return pages.select(*columns).mapInArrow(run, ", ".join([f"{key} {kind}", *(f"{fields[k][0]} {fields[k][1]}" for k in wanted)]))


def page_nodes(pages: DataFrame, key: str = "page_id", only: tuple[str, ...] | None = None) -> DataFrame:
    """The nodes of pages ``key, html``, parsed where they lie, one page at a time. ``only`` names the columns that are wanted, all without it."""
    return _emitted(pages, key, [key, "html"], lambda row: tree(row["html"]), [], only)


#: Depth and characters beyond which pages aren't rewritten: passes look at what elements hold, level by level.
DEEPEST, LONGEST = 512, 8 << 20


def rewritten_nodes(pages: DataFrame, passes: Callable[[dict], tuple], key: str = "page_id", context: tuple[str, ...] = ()) -> DataFrame:
    """The nodes of pages ``key, url, html`` after passes (see ``operators.rewrites``), with ``rules`` on each page's first node: what changed it.

    ``passes`` gives the passes of a page by its row, in which the columns ``context`` are as well. Page and passes
    share one parse. Pages deeper than DEEPEST levels or longer than LONGEST stay as they are and have the rule ``unchanged.too-large``; a page of which nothing is left has no rows.
    """
    from papershed.operators.rewrites import run
    from papershed.sources.elements import grown

    def made(row: dict) -> list[list]:
        rows = tree(row["html"])
        if len(row["html"] or "") > LONGEST or max((r[3] for r in rows), default=0) > DEEPEST:
            rules = ["unchanged.too-large"]
        else:
            page = grown(rows)
            rules = run(page, row["url"] or "", passes(row))
            rows = regrown(page)
        return [[*r, rules if k == 0 else None] for k, r in enumerate(rows)]

    return _emitted(pages, key, [key, "url", "html", *context], made, [("rules", "array<string>", pa.list_(pa.string()))])


def regrown(page) -> list[list]:
    """The rows of a tree of elements (see ``elements``); texts that came to lie side by side stay texts of their own."""
    out, stack = _Rows(), [(k, False) for k in reversed(page.kids)]
    while stack:
        node, leave = stack.pop()
        if leave:
            out.up()
        elif node.tag == "#text" or node.tag in VOID and not node.kids:
            out.add(node.tag, node.attrs, node.data)
        else:
            out.down(node.tag, node.attrs)
            stack.append((node, True))
            stack += [(k, False) for k in reversed(node.kids)]
    return out.rows


def kept_nodes(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Nodes dealt by page and kept, so that a query parses its pages once."""
    return kept(nodes, key)


def _before(key: str) -> Window:
    return Window.partitionBy(key).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)


def inside(nodes: DataFrame, owner: Column, name: str, key: str = "page_id") -> DataFrame:
    """Nodes with ``name``: whether an element for which ``owner`` holds encloses them. One window over a page's nodes."""
    return nodes.withColumn(name, F.coalesce(F.max(F.when(owner, F.col("last"))).over(_before(key)) >= F.col("node"), F.lit(False)))


def without(nodes: DataFrame, gone: Column, key: str = "page_id") -> DataFrame:
    """Nodes without the elements for which ``gone`` holds and all that is inside them."""
    marked = nodes.withColumn("_gone", F.coalesce(gone, F.lit(False)))
    return inside(marked, F.col("_gone"), "_inside", key).filter(~F.col("_gone") & ~F.col("_inside")).drop("_gone", "_inside")


def owned(nodes: DataFrame, owner: Column, key: str = "page_id") -> DataFrame:
    """Nodes inside elements for which ``owner`` holds, with ``owner`` (its node). Owners must not hold each other."""
    last = F.last(F.when(owner, F.struct("node", "last")), ignorenulls=True).over(_before(key))
    found = nodes.withColumn("_o", last).filter(F.col("_o.last") >= F.col("node"))
    return found.withColumn("owner", F.col("_o.node")).drop("_o")


def texts(nodes: DataFrame, by: list[str], breaks: bool = False) -> DataFrame:
    """``by, content``: the texts of each group in document order, white space collapsed; ``breaks`` makes a space of each br."""
    parts = F.array_sort(F.collect_list(F.struct("node", "text")))
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    parted = nodes.withColumn("text", F.when(F.col("tag") == "br", " ").otherwise(F.col("text"))) if breaks else nodes
    return parted.filter("tag in ('#text', 'br')" if breaks else "tag = '#text'").groupBy(*by).agg(F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("content"))


def attr(name: str) -> Column:
    return F.col("attrs")[name]


# Byte order marks by encoding; names of encodings that browsers read as others.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
AS_1252 = {"ascii", "us-ascii", "iso-8859-1", "iso8859-1", "latin1", "latin-1", "cp1252", "windows-1252"}


def decoded(raw: bytes | None, declared: str | None) -> tuple[str | None, str, str | None]:
    """(html, encoding, problem): by byte order mark, the declared charset, a meta tag in the first 1,024 bytes, strict UTF-8, else windows-1252."""
    import codecs
    import re

    if raw is None:
        return None, "", None
    label = next((name for mark, name in MARKS if raw.startswith(mark)), None) or declared
    if not label:
        meta = re.search(rb"<meta\b[^>]*?charset\s*=\s*[\"']?\s*([\w.:-]+)", raw[:1024], re.I)
        label = meta[1].decode("ascii", "replace") if meta else None
    problem = None
    if label:
        try:
            name = "cp1252" if label.lower() in AS_1252 else codecs.lookup(label.strip()).name
            return raw.decode(name).removeprefix("﻿"), name, None
        except LookupError:
            problem = "charset_unsupported"
        except UnicodeDecodeError:
            return raw.decode(name, "replace").removeprefix("﻿"), name, "charset_replaced"
    try:
        return raw.decode("utf-8"), "utf-8", problem
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace"), "cp1252", "charset_guessed"


def decode_page(raw: Column, declared: Column) -> Column:
    """struct<html, encoding, problem> of a page's bytes and the charset of its media type."""

    @F.pandas_udf("html string, encoding string, problem string")
    def decode(raws: pd.Series, labels: pd.Series) -> pd.DataFrame:
        rows = [decoded(None if r is None else bytes(r), d) for r, d in zip(raws, labels)]
        return pd.DataFrame(rows, columns=["html", "encoding", "problem"])

    return decode(raw, declared)
