"""Queries of files, release lists, paper listings and what heads announce."""

from __future__ import annotations

from pyspark.sql import functions as F

from papershed.functions.urls import canonical_url
from papershed.sources import captures as C
from papershed.sources.feeds import escaped
from papershed.sources.tables import read


def markdown_files(spark, sf_dir):
    """Documents as Markdown files, some with a heading, and their titles."""
    i = F.col("doc_id")
    text = F.when(i % 3 == 0, F.concat(F.lit("intro\n# Title "), i.cast("string"), F.lit("  \n# Second\n"), "text")).otherwise(F.col("text"))
    file = F.concat(F.lit("/notes/"), "source", F.lit("-"), i.cast("string"), F.when(i % 2 == 0, ".md").otherwise(".tar.gz"))
    return read(spark, sf_dir, "documents").select("doc_id", C.markdown_title(text, file).alias("title"))


def dropped_files(spark, sf_dir):
    """Pages dropped as files under several names, a part of them known already."""
    i = F.col("page_id")
    pages = read(spark, sf_dir, "pages")
    content = F.encode(F.when(i % 5 == 0, F.concat(F.lit("%PDF-1.7"), "html")).otherwise(F.col("html")), "UTF-8")
    files = pages.select(F.concat(F.lit("f"), i.cast("string"), F.when(i % 2 == 0, ".bin").otherwise(".md")).alias("file"), content.alias("content"))
    known = pages.filter("page_id % 3 = 0").select(F.substring(F.sha2(content, 256), 1, 16).alias("id"))
    return C.dropped_files(files.unionByName(files.withColumn("file", F.concat(F.lit("z"), "file"))), known.distinct())


def _atom(spark, sf_dir):
    """One Atom feed of each source's documents, at most 60 of them."""
    i = F.col("doc_id")
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/2401."), F.lpad(i.cast("string"), 5, "0"), F.lit("v2</id><link rel=\"alternate\" href=\"https://e.org/r/v1."), i.cast("string"), F.lit("\"/><title> A &amp; B\n "), i.cast("string"),
        F.lit("</title><updated>2024-01-02T03:04:05Z</updated><author><name>Ada A</name></author><author><name> Bob &lt;B&gt;</name></author><arxiv:primary_category term=\"cs.CL\"/><summary>"), escaped(F.substring("text", 1, 80)), F.lit("</summary><content>&lt;p&gt;"), i.cast("string"), F.lit("</content></entry>"),
    )
    docs = read(spark, sf_dir, "documents").filter("text is not null and doc_id % 50 < 30")
    feeds = docs.groupBy("source", F.floor(i / 3000).alias("k")).agg(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("x")))).alias("e"))
    return feeds.select(F.concat_ws("/", "source", "k").alias("feed_id"), F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom" xml:lang="en-GB"><link href="https://e.org/" rel="alternate"/>'), F.array_join(F.transform("e", lambda e: e["x"]), ""), F.lit("</feed>")).alias("xml"))


def release_list(spark, sf_dir):
    """Releases with the number of their entries; a tag may name several releases, each with an address and notes of its own."""
    return C.releases(_atom(spark, sf_dir)).groupBy("tag", "url", "notes", "published_ms").agg(F.count("*").alias("n"))


def paper_listing(spark, sf_dir):
    """Papers of listings by id, with their authors."""
    found = C.papers(_atom(spark, sf_dir))
    return found.select("feed_id", "ord", "arxiv_id", "title", F.array_join("authors", "; ").alias("authors"), "category", "minutes", C.feed_language(F.lit('<feed x="1" xml:lang="de">')).alias("lang"))


def announced_feeds(spark, sf_dir):
    """The feeds that pages announce, Atom before RSS."""
    i = F.col("page_id")
    rss = F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/rss'), i.cast("string"), F.lit('">'))
    atom = F.concat(F.lit("<LINK href='/atom"), i.cast("string"), F.lit("' REL=alternate type='application/atom+xml'>"))
    head = F.when(i % 3 == 0, F.concat(rss, atom)).when(i % 3 == 1, rss).otherwise("")
    html = F.replace(F.col("html"), F.lit("</head>"), F.concat(head, F.lit("</head>")))
    return read(spark, sf_dir, "pages").select("page_id", C.announced_feed(html).alias("feed"), C.looks_like_page(html).alias("is_page"))


def entry_signals(spark, sf_dir):
    """How many documents of each language have code, formulas and figures."""
    i = F.col("doc_id")
    markdown = F.when(i % 4 == 0, F.concat(F.lit("```\nx\n```"), "text")).otherwise(F.col("text"))
    plain = F.when(i % 5 == 0, F.concat(F.regexp_replace("text", r"\$", ""), F.lit(" $x^2$"))).otherwise(F.regexp_replace("text", r"[\$\\]", ""))
    s = C.entry_signals(markdown, plain, i % 6 == 0, F.col("lang"))
    return read(spark, sf_dir, "documents").filter("text is not null").groupBy(s["lang"].alias("lang")).agg(F.count_if(s["code"]).alias("code"), F.count_if(s["math"]).alias("math"), F.count_if(s["figures"]).alias("figures"))


def material_sources(spark, sf_dir):
    """What documents as items are read from, and whether two ways to list their related ids agree."""
    i = F.col("doc_id")
    some = lambda n: F.when(i % n == 0, F.col("text"))
    source = C.material_source(some(2), i % 4 == 0, some(3), some(5), F.when(i % 7 != 0, F.col("text")))
    same = C.same_members(F.array(i % 3, i % 5 + 10), F.array(i % 5 + 10, i % 2))
    return read(spark, sf_dir, "documents").filter("text <> ''").groupBy(source.alias("source"), same.alias("same")).agg(F.count("*").alias("n"))


def repaired_layers(spark, sf_dir):
    """Metadata layers of documents extracted again without their pages."""
    i = F.col("doc_id")
    text = lambda c: c.cast("string")
    stored = F.create_map(F.lit("title"), F.md5("text"), F.lit("date"), text(i % 3), F.lit("lang"), F.col("lang"))
    unpaged = F.create_map(F.lit("title"), F.when(i % 2 == 0, F.md5("text")).otherwise("none"), F.lit("date"), text(i % 2))
    again = F.create_map(F.lit("title"), F.lit("found"), F.lit("date"), F.when(i % 5 != 0, "now"))
    fixed = C.repaired_layer(stored, unpaged, again)
    return read(spark, sf_dir, "documents").select("doc_id", fixed["title"].alias("title"), fixed["date"].alias("date"), fixed["lang"].alias("lang"))


def annotations_export(spark, sf_dir):
    """Highlights of pages' words as Markdown."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("material"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), canonical_url(F.col("url")).alias("url"), F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), " ").alias("w"))
    notes = pages.select("material", F.posexplode("w").alias("start", "quote")).filter("quote <> ''").withColumn("id", -F.col("start")).withColumn("note", F.when(F.col("start") % 2 == 0, F.concat(F.lit("n"), F.col("start").cast("string"))))
    return C.annotations_markdown(pages, notes).select("material", F.md5("markdown").alias("md5"))


def judged_blocks(spark, sf_dir):
    """Totals of an evaluation by source: blocks, those asked about and changed, and their shares; every source's address from the catalog."""
    rows = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("blocks"), F.count_if(F.col("doc_id") % 5 < 3).alias("asked"), F.count_if(F.col("doc_id") % 25 == 0).alias("changed"), F.sum("n_chars").alias("chars"))
    catalog = read(spark, sf_dir, "pages").filter("page_id < 10").select(F.concat(F.lit("src"), F.when(F.col("page_id") > 0, F.col("page_id").cast("string")).otherwise("")).alias("source"), "url")
    share = lambda a, b: F.floor(100 * a / F.greatest(b, F.lit(1)) + 0.5).cast("int")
    return rows.join(catalog, "source", "left").select("source", "blocks", share(F.col("asked"), F.col("blocks")).alias("asked_share"), share(F.col("changed"), F.col("asked")).alias("changed_share"), F.ceil(F.col("chars") / 4).alias("tokens"), F.coalesce("url", F.lit("")).alias("url"))


QUERIES = {f.__name__: f for f in (
    markdown_files, dropped_files, release_list, paper_listing, announced_feeds, entry_signals, material_sources, repaired_layers, annotations_export, judged_blocks,
)}

FEEDS_SQL = """f AS (SELECT source || '/' || CAST(doc_id // 3000 AS VARCHAR) AS feed_id, doc_id, row_number() OVER (PARTITION BY source, doc_id // 3000 ORDER BY doc_id) - 1 AS ord FROM documents WHERE text IS NOT NULL AND doc_id % 50 < 30)"""
ORACLE_SQL = {
    "markdown_files": r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id ELSE coalesce(nullif(regexp_extract(text, '(?m)^# +(.+?)\s*$', 1), ''), source || '-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '.tar' END) END AS title FROM documents""",
    "dropped_files": """WITH c AS (SELECT page_id AS i, CASE WHEN page_id % 5 = 0 THEN '%PDF-1.7' || html ELSE html END AS c FROM pages), d AS (SELECT substr(sha256(c), 1, 16) AS id, 'f' || i || CASE WHEN i % 2 = 0 THEN '.bin' ELSE '.md' END AS file,
             CASE WHEN i % 2 = 1 THEN 'text/markdown' WHEN i % 5 = 0 THEN 'application/pdf' ELSE 'text/html' END AS media_type, i % 3 = 0 AS k FROM c)
        SELECT id, min(file) AS file, arg_min(media_type, file) AS media_type, bool_or(k) AS existing FROM d GROUP BY id""",
    "release_list": f"""WITH {FEEDS_SQL} SELECT '2401.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || 'v2' AS tag, 'https://e.org/r/v1.' || doc_id AS url, '<p>' || doc_id AS notes, CAST(1704164645000 AS BIGINT) AS published_ms, count(*) AS n FROM f GROUP BY ALL""",
    "paper_listing": f"""WITH {FEEDS_SQL} SELECT feed_id, CAST(ord AS INTEGER) AS ord, '2401.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS arxiv_id, 'A & B ' || doc_id AS title, 'Ada A; Bob <B>' AS authors, 'cs.CL' AS category, CAST(20 AS INTEGER) AS minutes, 'de' AS lang FROM f WHERE ord < 50""",
    "announced_feeds": """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/atom' || page_id WHEN 1 THEN '/rss' || page_id END AS feed, true AS is_page FROM pages""",
    "entry_signals": """SELECT nullif(lang, '') AS lang, count(*) FILTER (doc_id % 4 = 0 OR contains(text, '```')) AS code, count(*) FILTER (doc_id % 5 = 0) AS math, count(*) FILTER (doc_id % 6 = 0) AS figures FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "material_sources": """SELECT CASE WHEN doc_id % 4 = 0 THEN 'stored' WHEN doc_id % 3 = 0 THEN 'page' WHEN doc_id % 5 = 0 THEN 'pdf' WHEN doc_id % 2 = 0 THEN 'stored' WHEN doc_id % 7 <> 0 THEN 'copy' END AS source, doc_id % 3 = doc_id % 2 AS same, count(*) AS n
        FROM documents WHERE text <> '' GROUP BY ALL""",
    "repaired_layers": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'found' ELSE md5(text) END AS title, CASE WHEN doc_id % 3 = doc_id % 2 THEN CASE WHEN doc_id % 5 <> 0 THEN 'now' END ELSE CAST(doc_id % 3 AS VARCHAR) END AS date, lang FROM documents""",
    "judged_blocks": """WITH r AS (SELECT source, count(*) AS blocks, count(*) FILTER (doc_id % 5 < 3) AS asked, count(*) FILTER (doc_id % 25 = 0) AS changed, sum(n_chars) AS chars FROM documents GROUP BY source),
        c AS (SELECT 'src' || CASE WHEN page_id > 0 THEN CAST(page_id AS VARCHAR) ELSE '' END AS source, url FROM pages WHERE page_id < 10)
        SELECT source, blocks, CAST(floor(100 * asked / greatest(blocks, 1) + 0.5) AS INTEGER) AS asked_share, CAST(floor(100 * changed / greatest(asked, 1) + 0.5) AS INTEGER) AS changed_share, CAST(ceil(chars / 4) AS BIGINT) AS tokens, coalesce(url, '') AS url FROM r LEFT JOIN c USING (source)""",
}
