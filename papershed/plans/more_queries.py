"""Further queries: candidates, occurrences, phrases, codecs, facts, hits and views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papershed.sources.tables import CASES_SQL, ISSUES_SQL, ITEMS_SQL, cases, issues, items, read

PHRASE_LIMIT = 2000


def best_candidates(spark, sf_dir):
    """Each page address's best candidate: full before summary before external, then the first."""
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", (F.col("doc_id") % 4 + 1).alias("rank"))
    best = F.max_by(F.struct("doc_id", "rank"), F.struct("rank", -F.col("doc_id")))
    return rows.groupBy("source").agg(best.alias("b")).select("source", "b.doc_id", "b.rank")


def occurrences(spark, sf_dir):
    """Words of a text's start with the number of times they came before."""
    words = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "word"))
    before = Window.partitionBy("doc_id", "word").orderBy("pos")
    return words.select("doc_id", "pos", "word", (F.row_number().over(before) - 1).alias("occurrence"))


def phrase_hits(spark, sf_dir):
    """How often a phrase stands in each whole text, whatever the case and the white space between its words."""
    n = F.least(F.regexp_count("text", F.lit(r"(?i)\bof\s+the\b")), F.lit(PHRASE_LIMIT))
    return read(spark, sf_dir, "documents").select("doc_id", n.alias("n")).filter("n > 0")


def citations(spark, sf_dir):
    """Ids of 16 hex digits cited in brackets, distinct and in order."""
    i = F.col("doc_id")
    cite = lambda k: F.concat(F.lit("["), F.substring(F.sha2((i % k).cast("string"), 256), 1, 16), F.lit("]"))
    text = F.concat(F.lit("See "), cite(5), F.lit(" and "), cite(3), F.lit(", again "), cite(5), F.lit(", not [0123]."))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([0-9a-f]{16})\]"), F.lit(1)))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("ids"))


def locators(spark, sf_dir):
    """Page regions written as a locator, coded as base64 JSON, and read back."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 50).alias("page"), (F.col("l_quantity") / 100).cast("double").alias("x"))
    coded = rows.withColumn("locator", F.base64(F.encode(F.to_json(F.struct(F.lit(2).alias("v"), "page", F.array("x", F.lit(0.5)).alias("rect"))), "UTF-8")))
    read_back = F.from_json(F.decode(F.unbase64("locator"), "UTF-8"), "v int, page long, rect array<double>")
    return coded.select("l_orderkey", "l_linenumber", read_back.alias("p")).groupBy("p.page").agg(F.count("*").alias("n"), F.sum(F.col("p.rect")[0]).cast("decimal(18,4)").cast("double").alias("sum_x"))


def merged_boxes(spark, sf_dir):
    """The box around all boxes of a group, clamped to the page, four decimals."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    x, y = F.col("l_linenumber") / 8.0, F.col("l_orderkey") % 100 / 90.0
    clamp = lambda c: F.round(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)), 4)
    return l.groupBy("l_orderkey").agg(clamp(F.min(x)).alias("x0"), clamp(F.max(x + 0.2)).alias("x1"), clamp(F.min(y)).alias("y0"), clamp(F.max(y + 0.1)).alias("y1"))


def capture_facts(spark, sf_dir):
    """Totals of page facts, and in how many pages each occurs."""
    html = F.col("html")
    facts = read(spark, sf_dir, "pages").select(F.regexp_count(html, F.lit("<br>")).alias("breaks"), F.regexp_count(html, F.lit("&amp;")).alias("entities"), F.regexp_count(html, F.lit(r"<img\b")).alias("images"))
    return facts.agg(*[f(c).alias(f"{n}_{c}") for c in facts.columns for n, f in (("sum", F.sum), ("cases", lambda c: F.count_if(F.col(c) > 0)))])


def opinion_statistics(spark, sf_dir):
    """Each opinion's cases, issues, kinds in order, and share of major issues."""
    return issues(spark, sf_dir).groupBy("opinion").agg(
        F.countDistinct("slug").alias("n_cases"), F.count("*").alias("n_issues"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        F.count_if(F.col("severity") == "major").alias("n_major"),
    )


def search_hits(spark, sf_dir):
    """Pages, then items, that match a word: one list with its order, 50 at most."""
    pages = read(spark, sf_dir, "pages").filter(F.contains(F.lower("html"), F.lit("tion"))).orderBy("page_id").limit(50)
    hits = pages.select(F.lit(0).alias("part"), F.col("page_id").alias("key"), F.regexp_extract("url", "//([^/]+)", 1).alias("subtitle"))
    found = items(spark, sf_dir).filter(F.contains(F.lower("title"), F.lit("tion"))).orderBy("doc_id").limit(50)
    both = hits.union(found.select(F.lit(1).alias("part"), F.col("doc_id").alias("key"), F.concat_ws(" · ", "source_id", F.date_format(F.timestamp_seconds("published_s"), "yyyy-MM-dd")).alias("subtitle")))
    return both.orderBy("part", "key").limit(50)


def shown_views(spark, sf_dir):
    """The remembered view if it is ready, else the primary one, and the view that follows it."""
    i = F.col("doc_id")
    ready = F.filter(F.array(F.lit("reader"), F.when(i % 2 == 0, "pdf"), F.when(i % 3 == 0, "text")), lambda v: v.isNotNull())
    wanted = F.when(i % 5 == 0, "text").when(i % 5 == 1, "pdf")
    rows = read(spark, sf_dir, "documents").select("doc_id", ready.alias("ready"), wanted.alias("wanted"))
    shown = F.when(F.array_contains("ready", F.coalesce("wanted", F.lit(""))), F.col("wanted")).otherwise("reader")
    rows = rows.withColumn("shown", shown)
    return rows.select("doc_id", "shown", F.get("ready", F.array_position("ready", F.col("shown")).cast("int") % F.size("ready")).alias("following"))


def reading_progress(spark, sf_dir):
    """Pages of a text, minutes to read them, and how far a reader at some place is."""
    pages = F.greatest(F.ceil(F.col("n_chars") / 3000), F.lit(1))
    at = (F.col("doc_id") % 7 + 0.5) / pages
    return read(spark, sf_dir, "documents").select("doc_id", pages.cast("int").alias("pages"), F.greatest(F.floor(pages * 2.5 + 0.5), F.lit(1)).cast("int").alias("minutes"),
                                                   F.round(F.least(F.greatest(at, F.lit(0.0)), F.lit(1.0)), 4).alias("progress"))


def one_sided_majors(spark, sf_dir):
    """Major issues that one opinion alone has stand only on a fact: a case whose content was judged worse than a pass."""
    key = ["slug", "layer", "kind", "ref"]
    seen = issues(spark, sf_dir).groupBy(*key).agg(F.countDistinct("opinion").alias("n"), F.bool_or(F.col("severity") == "major").alias("major"))
    facts = cases(spark, sf_dir).filter("content > 0").select("slug", F.lit(True).alias("fact"))
    severity = F.when(~F.col("major"), "minor").when((F.col("n") > 1) | F.coalesce("fact", F.lit(False)), "major").otherwise("downgraded")
    return seen.join(facts, "slug", "left").groupBy(severity.alias("severity")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    best_candidates, occurrences, phrase_hits, citations, locators, merged_boxes, capture_facts, opinion_statistics, search_hits, shown_views, reading_progress, one_sided_majors,
)}

ORACLE_SQL = {
    "best_candidates": "SELECT source, doc_id, doc_id % 4 + 1 AS rank FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id % 4 DESC, doc_id) = 1",
    "occurrences": """WITH w AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS a FROM documents))
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, word, CAST(row_number() OVER (PARTITION BY doc_id, word ORDER BY pos) - 1 AS INTEGER) AS occurrence FROM w""",
    "phrase_hits": "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\\bof\\s+the\\b')) AS INTEGER) AS n FROM documents WHERE n > 0",
    "citations": """SELECT doc_id, CASE WHEN doc_id % 5 = doc_id % 3 THEN substr(sha256(CAST(doc_id % 5 AS VARCHAR)), 1, 16)
        ELSE substr(sha256(CAST(doc_id % 5 AS VARCHAR)), 1, 16) || ',' || substr(sha256(CAST(doc_id % 3 AS VARCHAR)), 1, 16) END AS ids FROM documents""",
    "locators": "SELECT l_orderkey % 50 AS page, count(*) AS n, CAST(CAST(sum(CAST(l_quantity AS DOUBLE) / 100) AS DECIMAL(18, 4)) AS DOUBLE) AS sum_x FROM lineitem GROUP BY 1",
    "merged_boxes": """WITH b AS (SELECT l_orderkey, l_linenumber / 8.0::DOUBLE AS x, l_orderkey % 100 / 90.0::DOUBLE AS y FROM lineitem)
        SELECT l_orderkey, round(greatest(least(min(x), 1.0), 0.0), 4) AS x0, round(greatest(least(max(x + 0.2), 1.0), 0.0), 4) AS x1,
               round(greatest(least(min(y), 1.0), 0.0), 4) AS y0, round(greatest(least(max(y + 0.1), 1.0), 0.0), 4) AS y1 FROM b GROUP BY l_orderkey""",
    "capture_facts": """WITH f AS (SELECT len(regexp_extract_all(html, '<br>')) AS b, len(regexp_extract_all(html, '&amp;')) AS e, len(regexp_extract_all(html, '<img\\b')) AS i FROM pages)
        SELECT CAST(sum(b) AS BIGINT) AS sum_breaks, count(*) FILTER (b > 0) AS cases_breaks, CAST(sum(e) AS BIGINT) AS sum_entities, count(*) FILTER (e > 0) AS cases_entities,
               CAST(sum(i) AS BIGINT) AS sum_images, count(*) FILTER (i > 0) AS cases_images FROM f""",
    "opinion_statistics": f"""WITH {ISSUES_SQL} SELECT opinion, count(DISTINCT slug) AS n_cases, count(*) AS n_issues, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds,
        count(*) FILTER (severity = 'major') AS n_major FROM issues GROUP BY opinion""",
    "search_hits": f"""WITH {ITEMS_SQL}, p AS (SELECT 0 AS part, page_id AS key, regexp_extract(url, '//([^/]+)', 1) AS subtitle FROM pages WHERE contains(lower(html), 'tion')),
        i AS (SELECT 1 AS part, doc_id AS key, source_id || CASE WHEN published_s IS NULL THEN '' ELSE ' · ' || strftime(make_timestamp(published_s * 1000000), '%Y-%m-%d') END AS subtitle FROM items WHERE contains(lower(title), 'tion'))
        SELECT * FROM (SELECT * FROM p UNION ALL SELECT * FROM i) ORDER BY part, key LIMIT 50""",
    "shown_views": """WITH r AS (SELECT doc_id, list_filter(['reader', CASE WHEN doc_id % 2 = 0 THEN 'pdf' END, CASE WHEN doc_id % 3 = 0 THEN 'text' END], lambda v: v IS NOT NULL) AS ready,
             CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' END AS wanted FROM documents),
        s AS (SELECT *, CASE WHEN list_contains(ready, coalesce(wanted, '')) THEN wanted ELSE 'reader' END AS shown FROM r)
        SELECT doc_id, shown, ready[list_position(ready, shown) % len(ready) + 1] AS following FROM s""",
    "reading_progress": """WITH p AS (SELECT doc_id, greatest(ceil(n_chars / 3000), 1) AS pages FROM documents)
        SELECT doc_id, CAST(pages AS INTEGER) AS pages, CAST(greatest(floor(pages * 2.5 + 0.5), 1) AS INTEGER) AS minutes, round(least(greatest((doc_id % 7 + 0.5) / pages, 0.0), 1.0), 4) AS progress FROM p""",
    "one_sided_majors": f"""WITH {CASES_SQL}, {ISSUES_SQL}, s AS (SELECT slug, layer, kind, ref, count(DISTINCT opinion) AS n, bool_or(severity = 'major') AS major FROM issues GROUP BY ALL)
        SELECT CASE WHEN NOT major THEN 'minor' WHEN n > 1 OR coalesce(content, 0) > 0 THEN 'major' ELSE 'downgraded' END AS severity, count(*) AS n FROM s LEFT JOIN cases USING (slug) GROUP BY 1""",
}
