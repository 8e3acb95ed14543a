"""Sources besides pages and feeds: Markdown files, dropped files, release lists, paper listings; what their heads say."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papershed.functions.dates import atom_millis
from papershed.functions.text import arxiv_id, collapsed
from papershed.sources.feeds import ATOM, parsed

HEAD_CHARS = 64 * 1024
NEWEST_PAPERS, PAPER_MINUTES = 50, 20
# Types of files by ending.
ENDINGS = {"pdf": "application/pdf", "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html"}


def markdown_title(text: Column, file: Column) -> Column:
    """The first heading of level 1, else the file's name without its ending."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?m)^# +(.+?)\s*$", 1)), F.lit("")), F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"\.[A-Za-z0-9]+$", ""))


def file_type(file: Column, content: Column) -> Column:
    """By the file's ending, else by its first bytes; null if neither says one."""
    ending = F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1))
    head = F.lower(F.trim(F.decode(F.substring(content, 1, 64), "ISO-8859-1")))
    by_bytes = F.when(head.startswith("%pdf-"), "application/pdf").when(head.startswith("<!doctype html") | head.startswith("<html"), "text/html")
    return F.coalesce(*[F.when(ending == e, t) for e, t in ENDINGS.items()], by_bytes)


def dropped_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """``id, file, media_type, existing`` of files ``file, content``, one for the same bytes; the id is 16 hex digits of their SHA-256."""
    named = files.withColumn("id", F.substring(F.sha2("content", 256), 1, 16)).withColumn("media_type", file_type(F.col("file"), F.col("content")))
    first = named.groupBy("id").agg(F.min_by(F.struct("file", "media_type"), "file").alias("f"))
    marked = first.join(known.select("id", F.lit(True).alias("_known")), "id", "left")
    return marked.select("id", "f.file", "f.media_type", F.coalesce("_known", F.lit(False)).alias("existing"))


ARXIV_SPACE = "{http://arxiv.org/schemas/atom}"


def _from_entries(feeds: DataFrame, of: Callable[[ElementTree.Element], tuple], columns: str, most: int | None = None) -> DataFrame:
    """``feed_id, problem, ord`` and what ``of`` gives for each entry of Atom documents ``feed_id, xml``, read strictly where they lie; a document
    that can't be read, or is no Atom feed, is one row with its problem."""
    kind = feeds.schema["feed_id"].dataType.simpleString()
    names = ["feed_id", "problem", "ord", *(c.split()[0] for c in columns.split(", "))]
    types = [pa.string(), pa.int32(), *(pa.list_(pa.string()) if c.split()[1].startswith("array") else pa.string() for c in columns.split(", "))]

    def rows(xml: bytes | None) -> list[tuple]:
        nothing = (None,) * (len(types) - 1)
        try:
            root = parsed(xml or b"")
        except (expat.ExpatError, ValueError) as e:
            return [("dtd" if "dtd" in str(e) else "malformed", *nothing)]
        if root.tag != f"{ATOM}feed":
            return [("no feed", *nothing)]
        return [(None, k, *of(e)) for k, e in enumerate(root.findall(f"{ATOM}entry")[:most])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i.as_py(), *r) for i, xml in zip(batch.column("feed_id"), batch.column("xml")) for r in rows(xml.as_py())]
            arrays = [pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * len(names), [batch.schema.field("feed_id").type, *types])]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return feeds.select("feed_id", F.col("xml").cast("binary").alias("xml")).mapInArrow(read, f"feed_id {kind}, problem string, ord int, {columns}")


def _said(entry: ElementTree.Element, name: str) -> str:
    node = entry.find(name)
    return "".join(node.itertext()).strip() if node is not None else ""


def _release(entry: ElementTree.Element) -> tuple:
    link = next((x.get("href") for x in entry.findall(f"{ATOM}link") if x.get("href")), None)
    return _said(entry, f"{ATOM}id").rsplit("/", 1)[-1] or None, link, _said(entry, f"{ATOM}content"), _said(entry, f"{ATOM}updated")


def releases(feeds: DataFrame) -> DataFrame:
    """``feed_id, problem, tag, url, notes, published_ms`` of release lists ``feed_id, xml``; a list that can't be read or whose entries are all of no use is one row with its problem."""
    read = _from_entries(feeds, _release, "tag string, url string, notes string, updated string")
    usable = F.col("tag").isNotNull() & F.col("url").isNotNull()
    useless = read.groupBy("feed_id").agg(F.count_if(F.col("ord").isNotNull()).alias("n"), F.count_if(usable).alias("good")).filter("n > 0 and good = 0")
    rows = read.filter(usable | F.col("problem").isNotNull()).select("feed_id", "problem", "tag", "url", "notes", atom_millis(F.col("updated")).alias("published_ms"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("tag", "string"), ("url", "string"), ("notes", "string"), ("published_ms", "bigint"))]
    return rows.union(useless.select("feed_id", F.lit("no usable entry").alias("problem"), *none))


def _paper(entry: ElementTree.Element) -> tuple:
    names = [" ".join(_said(a, f"{ATOM}name").split()) for a in entry.findall(f"{ATOM}author")]
    category = entry.find(f"{ARXIV_SPACE}primary_category")
    text = (" ".join(_said(entry, f"{ATOM}{n}").split()) for n in ("title", "summary"))
    return _said(entry, f"{ATOM}id"), *text, [n for n in names if n], category.get("term") if category is not None else None


def papers(listings: DataFrame) -> DataFrame:
    """``feed_id, ord, arxiv_id, title, authors, abstract, category, minutes, math`` of the 50 newest entries of paper listings; ids without version. A listing that can't be read has none."""
    read = _from_entries(listings, _paper, "link string, title string, abstract string, authors array<string>, category string", NEWEST_PAPERS)
    fixed = [F.lit(PAPER_MINUTES).alias("minutes"), F.lit(True).alias("math")]
    return read.filter("problem is null").select("feed_id", "ord", arxiv_id(F.col("link")).alias("arxiv_id"), "title", "authors", "abstract", F.nullif("category", F.lit("")).alias("category"), *fixed)


def feed_language(text: Column) -> Column:
    """xml:lang of an Atom feed, else the language of an RSS channel, in the first 64 Ki characters; null if neither is given."""
    head = F.substring(text, 1, HEAD_CHARS)
    code = r"([A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*)"
    return F.coalesce(F.nullif(F.regexp_extract(head, rf'<feed\b[^>]*\sxml:lang="{code}"', 1), F.lit("")), F.nullif(F.regexp_extract(head, rf"<language>\s*{code}\s*</language>", 1), F.lit("")))


def feed_site(text: Column) -> Column:
    """The site that a feed is of: an Atom feed's alternate link, an RSS channel's link; null if there is none."""
    head = F.substring(text, 1, HEAD_CHARS)
    get = lambda form: F.nullif(F.regexp_extract(head, form, 1), F.lit(""))
    atom = F.coalesce(get(r'<link\b[^>]*\brel="alternate"[^>]*\bhref="(https?://[^"]+)"'), get(r'<link\b[^>]*\bhref="(https?://[^"]+)"[^>]*\brel="alternate"'))
    return F.when(head.rlike(r"<feed\b"), atom).otherwise(get(r"(?s)<channel>.*?<link>\s*(https?://[^<\s]+)\s*</link>"))


def announced_feed(html: Column) -> Column:
    """The feed that a page's head announces, Atom before RSS; null if there is none."""
    links = F.regexp_extract_all(F.substring(html, 1, 4 * HEAD_CHARS), F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    of = lambda kind: F.get(F.filter(links, lambda t: t.rlike(r"(?i)rel\s*=\s*[\"']?alternate") & F.contains(F.lower(t), F.lit(kind))), F.lit(0))
    return F.nullif(F.regexp_extract(F.coalesce(of("application/atom+xml"), of("application/rss+xml")), r"(?i)href\s*=\s*[\"']([^\"']*)", 1), F.lit(""))


def looks_like_page(text: Column) -> Column:
    head = F.lower(F.ltrim(F.regexp_replace(F.substring(text, 1, 2048), "^﻿", "")))
    return head.startswith("<!doctype html") | head.startswith("<html")


def entry_signals(markdown: Column, plain: Column, figures: Column, lang: Column) -> Column:
    """struct<code, math, figures, lang> of an entry's content; what isn't there is null."""
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), True)
    return F.struct(flag(F.contains(markdown, F.lit("```"))).alias("code"), flag(plain.rlike(r"\$[^$\n]{1,200}\$") | F.contains(plain, F.lit("\\("))).alias("math"), flag(figures).alias("figures"), F.nullif(lang, F.lit("")).alias("lang"))


def same_members(a: Column, b: Column) -> Column:
    """Whether two arrays without repeats have the same members."""
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0)


def repaired_layer(stored: Column, unpaged: Column, again: Column) -> Column:
    """A layer of metadata (maps of texts) extracted again without its page: fields that came from the page stay, the others are those found again."""
    keys = F.array_sort(F.array_union(F.map_keys(stored), F.map_keys(again)))
    entries = F.transform(keys, lambda k: F.struct(k.alias("key"), F.when(stored[k].eqNullSafe(unpaged[k]), again[k]).otherwise(stored[k]).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def material_source(stored: Column, readable: Column, html: Column, pdf: Column, copy: Column) -> Column:
    """What an item is read from: the stored material, its page, its PDF, the feed's copy; a stored copy gives way to a page, a readable page never to a copy."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(has(stored) & readable, "stored").when(has(html), "page").when(has(pdf), "pdf").when(has(stored), "stored").when(has(copy), "copy")


def annotations_markdown(materials: DataFrame, annotations: DataFrame) -> DataFrame:
    """``material, markdown``: title, source line, then every quote with its note in reading order."""
    quote = F.concat(F.lit("\n> "), collapsed(F.col("quote")), F.lit("\n"), F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n"), F.col("note"), F.lit("\n"))).otherwise(""))
    listed = annotations.groupBy("material").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "id", quote.alias("q")))), lambda a: a["q"]), "").alias("body"))
    head = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("title"), F.lit(" ("), F.col("url"), F.lit(")\n"))
    return materials.join(listed, "material", "left").select("material", F.concat(head, F.coalesce("body", F.lit(""))).alias("markdown"))
