"""Queries of dates, identifiers, links, pictures, titles and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from papershed.functions import dates as D
from papershed.functions import names as N
from papershed.functions import text as X
from papershed.functions import urls as U
from papershed.sources.tables import read


def _one_of(n, *values):
    """The value for the remainder of ``n``."""
    return F.get(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))).cast("int"))


def date_parts(spark, sf_dir):
    """Dates of orders in all the forms that pages declare, brought to one."""
    d, i = F.col("o_orderdate"), F.col("o_orderkey")
    form = lambda f: F.date_format(d, f)
    raw = _one_of(i, form("yyyy"), form("yyyy/M"), form("' 'yyyy.MM.d"), form("MMMM d, yyyy"), form("d MMM yyyy"), form("yyyy-MM-dd'T10:00:00+02:00'"), form("'on 'yyyy-MM-dd"))
    return read(spark, sf_dir, "orders").select("o_orderkey", D.normal_date(raw).alias("date")).withColumn("published", D.published_day(F.col("date")))


FEED_ZONES = ("GMT", "EST", "+0530", "M", "Y", "XYZ", "-0060", "Z")


def feed_dates(spark, sf_dir):
    """Dates of orders written the RSS way, in named, military, numeric and unknown zones, some at times that don't exist."""
    i = F.col("o_orderkey")
    time = F.when(i % 11 == 0, " 25:99:00 ").otherwise(" 08:05:09 ")
    text = F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy"), time, _one_of(i, *FEED_ZONES))
    return read(spark, sf_dir, "orders").select("o_orderkey", (D.rss_millis(text) / 1000).cast("long").alias("seconds"))


def atom_dates(spark, sf_dir):
    """Dates of orders written the Atom way: offsets, fractions, leap seconds, hours that don't exist."""
    time = _one_of(F.col("o_orderkey"), "T08:05:09Z", "T08:05:09.25+02:30", "T23:59:60Z", "T24:00:00Z", "T08:05:09", "T18:59:60-05:00")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), time)
    return read(spark, sf_dir, "orders").select("o_orderkey", D.iso_of_millis(D.atom_millis(text)).alias("instant"))


def shown_dates(spark, sf_dir):
    """Dates in prose: the first form in order of rank counts, not the first in the text; days that don't exist give none."""
    d, i = F.col("o_orderdate"), F.col("o_orderkey")
    form = lambda f: F.date_format(d, f)
    text = _one_of(
        i, form("'Posted 'MMMM d, yyyy' by A. 2001-02-03 2015年1月9日'"), form("'Posted 'yyyy-MM-dd', not May 1, 2003'"), form("'On 'MMM d, yyyy' I'"),
        form("'On 'd MMMM yyyy"), form("MMMM yyyy' essay'"), form("'Seen 2024-99-99 and 'yyyy/MM/dd"),
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", D.shown_day(text).alias("shown"))


def url_dates(spark, sf_dir):
    """Days in permalinks of orders, and the declared day that agrees with the shown one."""
    d, i = F.col("o_orderdate"), F.col("o_orderkey")
    form = lambda f: F.date_format(d, f)
    path = _one_of(i, form("yyyy/MM/dd'/slug'"), form("yyyy/MM'/'"), form("yyyy'/'MMM'/'d'/slug'"), form("yyyy-MM-dd'-slug'"), form("'p/'yyyyMMdd"))
    shown = D.url_day(F.concat(F.lit("https://example.org/"), path, F.lit("?at=2001/01/01")))
    declared = F.array(F.when(i % 3 == 0, "1990-01-01"), F.date_add(d, F.when(i % 2 == 0, 1).otherwise(2)).cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"), D.declared_or_shown(declared, shown).alias("published"))


def identifiers(spark, sf_dir):
    """DOIs and arXiv ids of documents in the forms that pages give them, and the version that a text stamps."""
    i = F.col("doc_id")
    number = F.concat(F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad((i % 100000).cast("string"), 5, "0"))
    link = F.concat(F.lit("https://"), _one_of(i, "arxiv.org/abs/24", "www.arxiv.org/pdf/24", "example.org/abs/24"), number, F.when(i % 5 == 0, "v2").otherwise(""))
    old = F.concat(F.lit("arXiv: hep-th/99"), F.lpad((i % 100000).cast("string"), 5, "0"), F.lit("v3"))
    given = _one_of(i, F.concat(F.lit("https://doi.org/10.1234/AB."), i.cast("string")), F.concat(F.lit("doi:11/"), i.cast("string")), F.concat(F.lit(" DOI: 10.99999/X"), i.cast("string")))
    stamped = F.concat(F.coalesce("text", F.lit("")), F.lit(" 24"), number, F.lit("v"), (i % 4).cast("string"), F.lit(" 24"), number, F.lit("v1"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", X.arxiv_id(link).alias("arxiv"), X.normal_arxiv_id(old).alias("old_arxiv"), X.doi(given).alias("doi"), X.arxiv_version(link, stamped).alias("version")
    )


def newest_versions(spark, sf_dir):
    """The highest version of each source: numbers as numbers however long, prereleases before their release."""
    i = F.col("doc_id")
    tail = _one_of(i, "-rc.10", "", "-rc.9", "-alpha", "+build.7", "-1", "-")
    tag = F.concat(F.lit("v"), (i % 3).cast("string"), F.lit("."), (i % 4 + 8).cast("string"), F.lit("."), F.when(i % 10 == 0, "20240102030405").otherwise((i % 7).cast("string")), tail)
    rows = read(spark, sf_dir, "documents").select("source", tag.alias("tag"), X.version_key(tag).alias("k")).filter("k is not null")
    return rows.groupBy("source").agg(F.max(F.struct("k", "tag"))["tag"].alias("newest"))


def canonical_links(spark, sf_dir):
    """What pages could declare as their canonical link: kept if it is of the same site and names another page."""
    i, url = F.col("page_id"), F.col("url")
    host = F.regexp_extract(url, "//([^/]+)", 1)
    href = _one_of(i, F.concat(F.lit("https://www."), host, F.lit("/story?id="), i.cast("string"), F.lit("&utm_x=1")), "/", "../a", F.concat(F.lit("//amp."), host, F.lit("/x")), "https://other.example/x", "javascript:void(0)", url)
    return read(spark, sf_dir, "pages").select("page_id", U.canonical_link(href, url).alias("canonical"))


def safe_links(spark, sf_dir):
    """Links of pages in safe and unsafe forms; an unsafe one is null."""
    url = F.regexp_replace("url", r"\?.*$", "")
    rest = F.regexp_extract(url, r"//(.*)$", 1)
    given = _one_of(F.col("page_id"), url, F.concat(F.lit("HTTP://user:pw@"), rest), F.concat(F.lit("MAILTO:"), rest), F.concat(F.lit("ftp://"), rest), F.concat(F.lit("HTTPS://EX.org"), F.lit("?q=1")), F.concat(url, F.lit("\u0007")), F.concat(url, F.repeat(F.lit("x"), 9000)))
    return read(spark, sf_dir, "pages").select("page_id", U.safe_link(given).alias("link"))


def image_keys(spark, sf_dir):
    """Keys of pictures named after words of the pages' titles, behind proxies and in several sizes."""
    i = F.col("page_id")
    word = F.lower(F.regexp_extract("html", r"<title>([A-Za-z]+)", 1))
    plain = F.concat(F.lit("https://cdn.example.org/a/"), word, F.lit("-"), i.cast("string"))
    src = _one_of(
        i, F.concat(plain, F.lit(".jpg")), F.concat(plain, F.lit("-1024x768.PNG?w=9")), F.concat(F.lit("https://img.example/image/fetch/w_9,c_limit/https%3A%2F%2Fwww.cdn.example.org%2Fa%2F"), word, F.lit("-"), i.cast("string"), F.lit(".webp")),
        F.concat(F.lit("https://next.example/_next/image?url=https%3A%2F%2Fcdn.example.org%2Fa%2F"), word, F.lit("-"), i.cast("string"), F.lit(".jpg&w=640")), "https://cdn.example.org/max/1400/image.png",
        F.concat(F.lit("https://cdn.example.org/w_640,c_limit/v1/A/resize:fit/"), word, F.lit("-"), i.cast("string"), F.lit("%C3%89@2x.jpg")),
    )
    return read(spark, sf_dir, "pages").select("page_id", U.image_path(src).alias("path"), U.image_stem(src).alias("stem"))


def srcset_picks(spark, sf_dir):
    """The biggest picture of srcset values built from pages' ids."""
    i = F.col("page_id").cast("string")
    value = _one_of(
        F.col("page_id"), F.concat(F.lit("a"), i, F.lit(".jpg 320w, b"), i, F.lit(".jpg 1280w, c"), i, F.lit(".jxl 4000w")), F.concat(F.lit("a"), i, F.lit(".png, b"), i, F.lit(".png 2x, d"), i, F.lit(".png 2x")),
        F.concat(F.lit("https://x/w_1456,c_limit/a"), i, F.lit(" 1456w, data:image/png;base64,AA 9000w")), F.concat(F.lit("e"), i, F.lit(".jpg 5q, f"), i, F.lit(".jpg 0w")),
    )
    return read(spark, sf_dir, "pages").select("page_id", U.largest_in_srcset(value).alias("src"))


def embed_kinds(spark, sf_dir):
    """What embedded frames show, by their address."""
    i = F.lpad(F.col("page_id").cast("string"), 11, "a")
    src = _one_of(F.col("page_id"), F.concat(F.lit("https://www.youtube-nocookie.com/embed/"), i, F.lit("?rel=0")), F.concat(F.lit("https://player.vimeo.com/video/"), F.col("page_id").cast("string")), F.concat(F.lit("https://open.spotify.com/embed/track/"), i), "https://disqus.com/embed/comments/", F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", U.embed_kind(src).alias("e")).select("page_id", "e.*")


def _creators(spark, sf_dir):
    """Bylines made of words of the texts: three names and what pages put around them."""
    w = lambda k: F.initcap(F.regexp_replace(F.get("w", F.lit(k)), "[^A-Za-z]", ""))
    two = lambda a, b: F.concat(F.lit("X"), w(a), F.lit(" Y"), w(b))
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.split(F.coalesce("text", F.lit("")), r"\s+").alias("w"))
    i = F.col("doc_id")
    line = _one_of(i, F.concat(F.lit("By "), two(0, 1), F.lit(", "), two(2, 3), F.lit(" and "), two(4, 5)), F.concat(F.lit("Posted by: "), two(0, 1), F.lit(", View all posts by X")), F.concat(two(0, 1), F.lit(" & "), two(2, 3), F.lit(" · "), two(4, 5), F.lit(" & "), two(6, 7)), "by", "")
    return docs.select("doc_id", "source", F.get("w", F.lit(0)).alias("word"), N.clean_byline(line).alias("byline"))


def bylines(spark, sf_dir):
    """Bylines cleaned and taken apart."""
    rows = _creators(spark, sf_dir).withColumn("creators", N.creators_of_byline(F.col("byline")))
    return rows.select("doc_id", "byline", F.size(F.coalesce("creators", F.array().cast(rows.schema["creators"].dataType))).alias("n"), N.byline_of(F.col("creators")).alias("joined"), N.citation_names(F.col("creators")).alias("cited"))


def _entries(spark, sf_dir):
    i = F.col("doc_id")
    people = F.array_compact(F.array(N.creator(F.concat(F.lit("Müller-"), F.col("source"), F.lit(", Ada"))), F.when(i % 3 == 0, N.creator(F.lit("Consortium X"))), F.when(i % 4 == 1, N.creator(F.lit("Ed Itor"), "editor"))))
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    meta = F.struct(
        _one_of(i, "journalArticle", "preprint", "webpage", "thesis", "book").alias("kind"), F.concat(F.lit("On 50% of "), F.coalesce(F.regexp_extract("text", r"(\p{L}+)", 1), F.lit(""))).alias("title"), F.when(i % 5 != 4, people).otherwise(F.slice(people, 1, 0)).alias("creators"),
        F.when(i % 2 == 0, F.col("source")).alias("publication"), text(i % 9).alias("volume"), none.alias("issue"), F.concat(text(i), F.lit("-"), text(i + 9)).alias("pages"), F.lit("Press & Co").alias("publisher"), none.alias("place"), none.alias("edition"), none.alias("series"),
        F.concat(F.lit("20"), F.lpad(text(i % 30), 2, "0"), F.lit("-"), F.lpad(text(i % 12 + 1), 2, "0")).alias("date"), none.alias("doi"), none.alias("isbn"), none.alias("issn"), F.concat(F.lit("2401."), F.lpad(text(i), 5, "0")).alias("arxiv_id"),
        F.concat(F.lit("https://example.org/"), text(i)).alias("url"), F.lit("arXiv: x [cs.CL]").alias("extra"), F.lit("2024-02-03T00:00:00Z").alias("accessed"),
    )
    return read(spark, sf_dir, "documents").select("doc_id", meta.alias("meta"))


def bibtex_entries(spark, sf_dir):
    """One BibTeX entry a document, of five kinds."""
    return _entries(spark, sf_dir).select("doc_id", N.bibtex(F.col("meta"), F.concat(F.lit("id"), F.col("doc_id").cast("string"))).alias("entry"))


def citation_lines(spark, sf_dir):
    m = F.col("meta")
    return _entries(spark, sf_dir).select("doc_id", N.citation_line(m["creators"], m["date"], m["title"], m["publication"], m["url"]).alias("line"))


def page_titles(spark, sf_dir):
    """Titles of pages declared with their site's name, h1 and og:title among the candidates."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    host = F.regexp_extract("url", r"//(?:www\.)?([^/]+)", 1)
    i = F.col("page_id")
    declared = _one_of(i, F.concat(title, F.lit(" | "), host), F.concat(host, F.lit(" – "), title), title, F.concat(F.lit("# "), title, F.lit(" ¶")), host)
    site = F.array(host, F.regexp_extract(host, r"^([^.]+)", 1))
    h1 = F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1)
    extracted = F.when(i % 2 == 0, h1).otherwise("")
    return read(spark, sf_dir, "pages").select(
        "page_id", N.chosen_title(F.array(declared, F.when(i % 3 == 0, F.lit("42")), h1), site).alias("title"), N.without_site(F.concat(h1, F.lit(" » "), host), extracted, host).alias("kept"), N.heading_key(h1).alias("heading")
    )


def decoded_entities(spark, sf_dir):
    """Pages' html with every entity that feeds decode, written twice escaped, decoded once."""
    raw = F.concat(F.replace(F.col("html"), F.lit("&"), F.lit("&amp;")), F.lit(" &#39;&#x4E2D;&lt;b&gt;&nope;&#xD800; &amp;lt;"))
    return read(spark, sf_dir, "pages").select("page_id", F.md5(X.entities_decoded(raw)).alias("md5"))


def byte_cuts(spark, sf_dir):
    """Texts cut to 1,000 bytes between code points."""
    cut = X.cut_to_bytes(F.col("text"), 1000)
    return read(spark, sf_dir, "documents").select("doc_id", F.octet_length(cut).cast("long").alias("n_bytes"), F.startswith("text", cut).alias("is_beginning"))


QUERIES = {f.__name__: f for f in (
    date_parts, feed_dates, atom_dates, shown_dates, url_dates, identifiers, newest_versions, canonical_links, safe_links, image_keys, srcset_picks, embed_kinds,
    bylines, bibtex_entries, citation_lines, page_titles, decoded_entities, byte_cuts,
)}

ORACLE_SQL = {
    "date_parts": """WITH d AS (SELECT o_orderkey, o_orderkey % 7 AS r, CAST(o_orderdate AS DATE) AS d FROM orders),
        n AS (SELECT o_orderkey, CASE r WHEN 0 THEN strftime(d, '%Y') WHEN 1 THEN strftime(d, '%Y-%m') WHEN 5 THEN strftime(d, '%Y-%m-%d') || 'T08:00:00.000Z' WHEN 6 THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS date FROM d)
        SELECT o_orderkey, date, CASE length(date) WHEN 10 THEN date || 'T00:00:00.000Z' WHEN 24 THEN date END AS published FROM n""",
    "feed_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) + 29109
        + CASE o_orderkey % 8 WHEN 0 THEN 0 WHEN 1 THEN 18000 WHEN 2 THEN -19800 WHEN 3 THEN -43200 WHEN 4 THEN 43200 WHEN 7 THEN 0 END END AS seconds FROM orders""",
    "atom_dates": """WITH d AS (SELECT o_orderkey, o_orderkey % 6 AS r, CAST(o_orderdate AS DATE) AS d FROM orders)
        SELECT o_orderkey, CASE r WHEN 0 THEN strftime(d, '%Y-%m-%d') || 'T08:05:09.000Z' WHEN 1 THEN strftime(d, '%Y-%m-%d') || 'T05:35:09.250Z'
          WHEN 2 THEN CASE WHEN strftime(d, '%m-%d') IN ('06-30', '12-31') THEN strftime(d + 1, '%Y-%m-%d') || 'T00:00:00.000Z' END
          WHEN 5 THEN CASE WHEN strftime(d, '%m-%d') IN ('06-30', '12-31') THEN strftime(d + 1, '%Y-%m-%d') || 'T00:00:00.000Z' END END AS instant FROM d""",
    "shown_dates": """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '2015-01-09' WHEN 4 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS shown FROM orders""",
    "url_dates": """WITH d AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders),
        s AS (SELECT k, d, CASE k % 5 WHEN 1 THEN date_trunc('month', d) WHEN 4 THEN NULL ELSE d END AS shown FROM d),
        c AS (SELECT *, list_filter([CASE WHEN k % 3 = 0 THEN DATE '1990-01-01' END, CAST(d + CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS DATE)], lambda x: x IS NOT NULL) AS l FROM s)
        SELECT k AS o_orderkey, strftime(shown, '%Y-%m-%d') AS shown, strftime(coalesce(list_filter(l, lambda x: abs(date_diff('day', x, CAST(shown AS DATE))) <= 1)[1], l[1]), '%Y-%m-%d') AS published FROM c""",
    "identifiers": """WITH n AS (SELECT doc_id AS i, lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') AS n FROM documents)
        SELECT i AS doc_id, CASE WHEN i % 3 <> 2 THEN '24' || n END AS arxiv, 'hep-th/99' || lpad(CAST(i % 100000 AS VARCHAR), 5, '0') AS old_arxiv,
               CASE i % 3 WHEN 0 THEN '10.1234/ab.' || i WHEN 2 THEN '10.99999/x' || i END AS doi,
               CAST(CASE WHEN i % 3 = 2 THEN NULL WHEN i % 5 = 0 THEN 2 ELSE greatest(i % 4, 1) END AS INTEGER) AS version FROM n""",
    "newest_versions": """WITH t AS (SELECT source, doc_id AS i, CAST(doc_id % 3 AS BIGINT) AS a, CAST(doc_id % 4 + 8 AS BIGINT) AS b, CASE WHEN doc_id % 10 = 0 THEN 20240102030405 ELSE doc_id % 7 END AS c,
             (['-rc.10', '', '-rc.9', '-alpha', '+build.7', '-1', '-'])[doc_id % 7 + 1] AS tail, ([['1rc', '00210'], [], ['1rc', '0019'], ['1alpha'], [], ['0011'], []])[doc_id % 7 + 1] AS pre FROM documents WHERE doc_id % 7 <> 6)
        SELECT source, arg_max('v' || a || '.' || b || '.' || c || tail, {'a': a, 'b': b, 'c': c, 'final': CASE WHEN len(pre) = 0 THEN 1 ELSE 0 END, 'pre': pre, 'tag': 'v' || a || '.' || b || '.' || c || tail}) AS newest FROM t GROUP BY source""",
    "canonical_links": """WITH p AS (SELECT page_id AS i, regexp_extract(url, '//([^/]+)', 1) AS h, regexp_extract(url, '^(.*/)[^/]*$', 1) AS folder FROM pages)
        SELECT i AS page_id, CASE i % 7 WHEN 0 THEN 'https://www.' || lower(h) || '/story?id=' || i WHEN 2 THEN lower(folder) || '../a' WHEN 3 THEN regexp_extract(folder, '^([a-z]+:)', 1) || '//amp.' || lower(h) || '/x' END AS canonical FROM p""",
    "safe_links": """SELECT page_id, CASE page_id % 7 WHEN 0 THEN regexp_replace(url, '\\?.*$', '') WHEN 2 THEN 'mailto:' || regexp_extract(url, '//([^?]*)', 1) WHEN 4 THEN 'https://ex.org/?q=1' END AS link FROM pages""",
    "image_keys": """WITH p AS (SELECT page_id AS i, lower(regexp_extract(html, '<title>([A-Za-z]+)', 1)) || '-' || page_id AS w FROM pages)
        SELECT i AS page_id, CASE i % 6 WHEN 0 THEN 'cdn.example.org/a/' || w || '.jpg' WHEN 1 THEN 'cdn.example.org/a/' || w || '-1024x768.png' WHEN 2 THEN 'cdn.example.org/a/' || w || '.webp' WHEN 3 THEN 'cdn.example.org/a/' || w || '.jpg'
               WHEN 5 THEN 'cdn.example.org/a/' || w || 'é@2x.jpg' ELSE 'cdn.example.org/image.png' END AS path, CASE WHEN i % 6 < 4 THEN w WHEN i % 6 = 5 THEN w || 'é' END AS stem FROM p""",
    "srcset_picks": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'b' || page_id || '.jpg' WHEN 1 THEN 'b' || page_id || '.png' WHEN 2 THEN 'https://x/w_1456,c_limit/a' || page_id END AS src FROM pages""",
    "embed_kinds": """SELECT page_id, (['video', 'video', 'audio', 'noise', 'frame'])[page_id % 5 + 1] AS kind, CASE page_id % 5 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || lpad(CAST(page_id AS VARCHAR), 11, 'a')
        WHEN 1 THEN 'https://vimeo.com/' || page_id WHEN 2 THEN 'https://open.spotify.com/track/' || lpad(CAST(page_id AS VARCHAR), 11, 'a') WHEN 4 THEN url END AS page,
        CASE WHEN page_id % 5 = 0 THEN 'https://i.ytimg.com/vi/' || lpad(CAST(page_id AS VARCHAR), 11, 'a') || '/hqdefault.jpg' END AS poster FROM pages""",
    "byte_cuts": """SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN strlen(text) ELSE (SELECT max(strlen(substr(d.text, 1, k))) FROM range(250, 1001) r(k) WHERE strlen(substr(d.text, 1, k)) <= 1000) END AS n_bytes, true AS is_beginning FROM documents d""",
    "decoded_entities": r"""SELECT page_id, md5(html || ' ''中<b>&nope;&#xD800; &lt;') AS md5 FROM pages""",
}
