"""Feed, page metadata and page structure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from papershed.functions import html as H
from papershed.sources import feeds
from papershed.sources.tables import EPOCH, read


def _dated(docs):
    return F.when(docs["doc_id"] % 11 != 0, F.lit(EPOCH) + docs["doc_id"] % 60 * 86400).cast("long").alias("published_s")


def feed_round_trip(spark, sf_dir):
    """Every document written as an RSS item of its source and read back through the feed source."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("feed"), "doc_id", F.concat(F.lit("Doc & <"), "doc_id", F.lit("> weekly")).alias("title"), F.trim("text").alias("content"), _dated(docs))
    found = feeds.read_feeds(feeds.write_feeds(rows.filter("content is not null")))
    return found.select(F.col("external_id").cast("long").alias("doc_id"), "feed_title", "title", "published_s", F.char_length(F.regexp_replace("content", r"\s+", "")).alias("n_chars"))


def feed_items(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.when(F.char_length("source") % 2 == 0, F.concat(F.lit("Weekly "), "source")).otherwise(F.col("source")).alias("feed"), "doc_id", F.lit("A weekly title").alias("title"), F.trim("text").alias("content"), _dated(docs))
    items = feeds.feed_items(feeds.read_feeds(feeds.write_feeds(rows.filter("content is not null"))))
    return items.groupBy("summary_only", "newsletter").agg(F.count("*").alias("n"))


def page_metadata(spark, sf_dir):
    """Page metadata under head tags that follow from the page's id: precedence, several authors, canonical link."""
    i = F.col("page_id")
    head = F.concat(
        F.when(i % 2 == 0, F.concat(F.lit('<meta name="citation_title" content="Cited '), i, F.lit('">'))).otherwise(""),
        F.when(i % 3 == 0, F.concat(F.lit("<meta property='og:title' content='Shared "), i, F.lit("'>"))).otherwise(""),
        F.when(i % 5 == 0, '<META NAME="citation_author" CONTENT="Ada A"><meta content="Bob B" name="citation_author">').otherwise(""),
        F.concat(F.lit('<link rel="canonical" href="https://example.org/'), i % 100, F.lit('">')),
    )
    pages = read(spark, sf_dir, "pages").withColumn("html", F.replace(F.col("html"), F.lit("</head>"), F.concat(head, F.lit("</head>"))))
    tags = pages.select("page_id", H.meta_tags(F.col("html")).alias("m"), H.title_of(F.col("html")).alias("t"), H.canonical_link(F.col("html")).alias("canonical"))
    title = F.coalesce(H.first_meta(F.col("m"), "citation_title", "dc.title", "og:title"), F.lit("plain"))
    return tags.select("page_id", title.alias("title"), F.array_join(H.meta_values(F.col("m"), "citation_author"), "; ").alias("authors"), "canonical", (F.char_length("t") > 0).alias("has_title"))


def page_structure(spark, sf_dir):
    """Elements of whole pages and of their article regions."""
    html = F.col("html")
    pages = read(spark, sf_dir, "pages").select("page_id", H.element_counts(html, "p", "a", "li", "nav").alias("e"), F.char_length(H.article_region(html)).alias("article_chars"), H.generator(html).alias("generator"))
    return pages.select("page_id", "e.p", "e.a", "e.li", "e.nav", "article_chars", "generator")


def page_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(H.flattened(F.col("html"))).alias("md5"))


QUERIES = {f.__name__: f for f in (feed_round_trip, feed_items, page_metadata, page_structure, page_text)}
ORACLE_SQL = {
    "feed_round_trip": f"""SELECT doc_id, source AS feed_title, 'Doc & <' || doc_id || '> weekly' AS title,
        CAST(CASE WHEN doc_id % 11 <> 0 THEN {EPOCH} + doc_id % 60 * 86400 END AS BIGINT) AS published_s, CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS INTEGER) AS n_chars FROM documents WHERE text IS NOT NULL""",
    "feed_items": """SELECT len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 150 AS summary_only, length(source) % 2 = 0 AS newsletter, count(*) AS n
        FROM documents WHERE text IS NOT NULL GROUP BY ALL""",
    "page_metadata": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Cited ' || page_id WHEN page_id % 3 = 0 THEN 'Shared ' || page_id ELSE 'plain' END AS title,
        CASE WHEN page_id % 5 = 0 THEN 'Ada A; Bob B' ELSE '' END AS authors, 'https://example.org/' || page_id % 100 AS canonical, contains(html, '<title>') AS has_title FROM pages""",
    "page_structure": """SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<p[\\s>/]')) AS INTEGER) AS p, CAST(len(regexp_extract_all(html, '(?i)<a[\\s>/]')) AS INTEGER) AS a,
        CAST(len(regexp_extract_all(html, '(?i)<li[\\s>/]')) AS INTEGER) AS li, CAST(len(regexp_extract_all(html, '(?i)<nav[\\s>/]')) AS INTEGER) AS nav,
        CAST(length(regexp_extract(html, '(?s)<article>(.*)</article>', 1)) AS INTEGER) AS article_chars, '' AS generator FROM pages""",
    "page_text": """SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!--.*?-->|<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS md5 FROM pages""",
}
