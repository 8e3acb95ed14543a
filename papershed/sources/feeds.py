"""RSS 2.0 and Atom feeds as a source: one row per feed in, one row per entry out."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papershed.functions.dates import atom_millis, rss_millis
from papershed.functions.text import collapsed, gist, word_count

#: Limits of one feed: bytes, entries.
FEED_BYTES, FEED_ENTRIES = 8 * 1024 * 1024, 200
SUMMARY_WORDS = 150
# Words that make a feed a newsletter.
NEWSLETTER = r"(?i)newsletter|weekly|周刊|digest"
ATOM, CONTENT, DUBLIN = "{http://www.w3.org/2005/Atom}", "{http://purl.org/rss/1.0/modules/content/}", "{http://purl.org/dc/elements/1.1/}"
ENTRY = "feed_id string, ok boolean, problem string, feed_title string, ord int, external_id string, title string, link string, rss_date string, atom_date string, content string"
FIELDS = [f.split() for f in ENTRY.split(", ")]
KINDS = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}


def parsed(xml: bytes) -> ElementTree.Element:
    """The root of a document without DTD or entity declarations."""
    builder = ElementTree.TreeBuilder()
    reader = expat.ParserCreate(namespace_separator="}")
    named = lambda n: "{" + n if "}" in n else n

    def refuse(*_) -> None:
        raise ValueError("dtd")

    reader.StartDoctypeDeclHandler = refuse
    reader.EntityDeclHandler = refuse
    reader.StartElementHandler = lambda name, attrs: builder.start(named(name), {named(k): v for k, v in attrs.items()})
    reader.EndElementHandler = lambda name: builder.end(named(name))
    reader.CharacterDataHandler = builder.data
    reader.Parse(xml, True)
    return builder.close()


def _text(node: ElementTree.Element | None) -> str | None:
    found = "".join(node.itertext()).strip() if node is not None else ""
    return found or None


def entries(feed_id: str, xml: bytes | None) -> list[tuple]:
    """Rows of one feed; a feed that can't be read is one row with its problem."""
    failed = lambda problem: [(feed_id, False, problem, *[None] * 8)]
    if not xml:
        return failed("empty")
    if len(xml) > FEED_BYTES:
        return failed("too_large")
    try:
        root = parsed(xml)
    except (expat.ExpatError, ValueError) as e:
        return failed("dtd" if "dtd" in str(e) else "malformed")
    rows = []
    if root.tag == "rss" and (channel := root.find("channel")) is not None:
        title, found = _text(channel.find("title")), channel.findall("item")
        for k, e in enumerate(found):
            link, guid = _text(e.find("link")), _text(e.find("guid"))
            content = _text(e.find(f"{CONTENT}encoded")) or _text(e.find("description"))
            rows.append((feed_id, True, None, title, k, guid or link, _text(e.find("title")), link, _text(e.find("pubDate")), _text(e.find(f"{DUBLIN}date")), content))
    elif root.tag == f"{ATOM}feed":
        title, found = _text(root.find(f"{ATOM}title")), root.findall(f"{ATOM}entry")
        for k, e in enumerate(found):
            links = {x.get("rel", "alternate"): x.get("href") for x in reversed(e.findall(f"{ATOM}link"))}
            date = _text(e.find(f"{ATOM}published")) or _text(e.find(f"{ATOM}updated"))
            content = _text(e.find(f"{ATOM}content")) or _text(e.find(f"{ATOM}summary"))
            rows.append((feed_id, True, None, title, k, _text(e.find(f"{ATOM}id")), _text(e.find(f"{ATOM}title")), links.get("alternate"), None, date, content))
    else:
        return failed("no_feed")
    return failed("too_many_entries") if len(rows) > FEED_ENTRIES else rows


def read_feeds(feeds: DataFrame) -> DataFrame:
    """Entries of feeds ``feed_id, xml`` (binary or string), ``published_s`` in seconds since 1970. Feeds are parsed where they lie, one at a time."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for feed_id, xml in zip(batch.column("feed_id"), batch.column("xml")):
                if rows := entries(feed_id.as_py(), xml.as_py()):
                    columns = [pa.array(c, KINDS[kind]) for c, (_, kind) in zip(zip(*rows), FIELDS)]
                    yield pa.RecordBatch.from_arrays(columns, [name for name, _ in FIELDS])

    found = feeds.select("feed_id", F.col("xml").cast("binary").alias("xml")).mapInArrow(parse, ENTRY)
    seconds = F.floor(F.coalesce(rss_millis(F.col("rss_date")), atom_millis(F.col("atom_date"))) / 1000).cast("long")
    return found.withColumn("published_s", seconds).drop("rss_date", "atom_date")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def numbered(rows: DataFrame, by: str, order: str, parts: int = 64) -> DataFrame:
    """Rows with ``nth``, their place (from 0) in their group, ``order`` being an integer that tells them apart.

    Only keys are ranked: in ranges of ``order`` within a group, with the counts of earlier ranges added. So no task
    sorts a whole group, however large, and other columns don't travel. Ranges end at quantiles, so that numbers far off don't put all in one.
    """
    ends = sorted(set(rows.approxQuantile(order, [k / parts for k in range(1, parts)], 0.002)))
    nth_range = F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e < F.col(order))) if ends else F.lit(0)
    dealt = rows.select(by, order).withColumn("_range", nth_range)
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(by, "_range").agg(F.count("*").alias("n")).select(by, "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy(by, "_range").orderBy(order)) - 1
    return dealt.withColumn("nth", nth).join(bases, [by, "_range"]).select(by, order, (F.col("nth") + F.col("_base")).alias("nth"))


def write_feeds(items: DataFrame, entries_each: int = FEED_ENTRIES) -> DataFrame:
    """RSS feeds ``feed_id, xml`` of items ``feed, doc_id, title, content, published_s``, split where a feed would be too long.

    A feed's items are cut into numbered parts, so no feed is too large for a row; the numbers come from doc_ids
    alone (each feed's own), so texts meet only the other texts of their part.
    """
    date = F.date_format(F.timestamp_seconds("published_s"), "EEE, dd MMM yyyy HH:mm:ss")
    item = F.concat(
        F.lit("<item><title>"), escaped(F.col("title")), F.lit("</title><link>https://example.org/"), F.col("doc_id").cast("string"), F.lit("</link><guid>"), F.col("doc_id").cast("string"), F.lit("</guid>"),
        F.coalesce(F.concat(F.lit("<pubDate>"), date, F.lit(" GMT</pubDate>")), F.lit("")), F.lit("<description>"), escaped(F.col("content")), F.lit("</description></item>"),
    )
    placed = items.join(numbered(items, "feed", "doc_id"), ["feed", "doc_id"])
    parts = placed.withColumn("part", F.floor(F.col("nth") / entries_each)).groupBy("feed", "part").agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("x")))).alias("x"))
    head = F.concat(F.lit("<rss version=\"2.0\"><channel><title>"), escaped(F.col("feed")), F.lit("</title>"))
    body = F.array_join(F.transform("x", lambda e: e["x"]), "")
    return parts.select(F.concat_ws("/", "feed", F.col("part").cast("string")).alias("feed_id"), F.concat(head, body, F.lit("</channel></rss>")).alias("xml"))


def feed_items(rows: DataFrame) -> DataFrame:
    """Entries as items: a summary if there are under 150 words, a newsletter if the feed's name says so."""
    content = F.coalesce("content", F.lit(""))
    return rows.filter("ok").select(
        "feed_id", "external_id", F.coalesce(F.nullif(collapsed(F.col("title")), F.lit("")), F.lit("Untitled")).alias("title"), "link", "published_s", gist(content).alias("gist"),
        (word_count(content) < SUMMARY_WORDS).alias("summary_only"), F.coalesce(F.col("feed_title").rlike(NEWSLETTER), F.lit(False)).alias("newsletter"),
    )
