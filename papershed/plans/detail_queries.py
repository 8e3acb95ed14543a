"""Queries of the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from papershed.operators import details as D
from papershed.sources.tables import ISSUES_SQL, ITEMS_SQL, issues, items, read


def review_flags(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("source"))
    flags = D.review_flags(F.col("text"), title, F.col("doc_id") % 13, F.regexp_count("text", F.lit("\n")) + 1)
    return docs.select("doc_id", F.array_join(flags, ",").alias("flags"))


def quality_labels(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select(D.quality_label(F.when(F.col("quality") == 0, "summary").otherwise("full"), F.col("toxic") == 0, F.col("doc_id") % 3).alias("q"))
    return rows.groupBy("q.label", "q.low").agg(F.count("*").alias("n"))


def day_groups(spark, sf_dir):
    log = read(spark, sf_dir, "events")
    now = log.agg(F.max("ts").alias("now"))  # one row
    return log.join(F.broadcast(now)).groupBy(D.day_label(F.col("ts"), F.col("now")).alias("day")).agg(F.count("*").alias("n"))


def nearest_views(spark, sf_dir):
    """Each purchase with the user's nearest view, before or after."""
    log = read(spark, sf_dir, "events").filter("event_type in ('view', 'purchase')").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return D.nearest(log, "user_id", "at", F.col("event_type") == "view", "event_id").select("user_id", "event_id", "nearest")


def matched_embeds(spark, sf_dir):
    """Words of a text's first half matched one to one with those of its second half, as embeds with reader links."""
    halves = read(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), r"\s+").alias("a")).withColumn("h", F.floor(F.size("a") / 2).cast("int"))
    first = halves.select("doc_id", F.explode(F.slice("a", F.lit(1), F.col("h"))).alias("w"))
    second = halves.select("doc_id", F.explode(F.slice("a", F.col("h") + 1, F.size("a"))).alias("w"))
    return D.matched_counts(first, second, ["doc_id", "w"]).groupBy("doc_id").agg(F.sum("matched").alias("matched"), F.sum("dropped").alias("dropped"))


def carried_system_text(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return D.carried(turns, "conv_id", "turn", F.when(F.col("role") == "user", F.md5("text")), "asked").select("conv_id", "turn", "asked")


def citation_numbers(spark, sf_dir):
    return D.listed_citations(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.split("text", r"\s+").alias("refs")))


def joined_hyphens(spark, sf_dir):
    text = F.regexp_replace("text", "([a-z])([a-z]) ", "$1-\n$2 ")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(D.hyphens_joined(text)).alias("md5"))


def page_tiles(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return D.tiles(docs, "n_chars").select("doc_id", "tile", "top", "tile_height")


def capture_types(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.col("html").alias("t"))
    docs = read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("%PDF-1.7 "), "text")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("<svg>"), "text")).otherwise(F.concat(F.lit("# "), "text")).alias("t"))
    return pages.union(docs).groupBy(D.sniffed(F.encode("t", "UTF-8")).alias("type")).agg(F.count("*").alias("n"))


def annotations(spark, sf_dir):
    """Annotations of users as materials after a second save of some, at most 2,000 each."""
    log = read(spark, sf_dir, "events").select(F.col("user_id").alias("material"), F.col("event_id").alias("id"), F.col("event_type").alias("note"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created"))
    again = log.filter("id % 4 = 0").withColumn("note", F.lit("changed")).withColumn("created", F.col("created") + 1)
    return D.annotation_upsert(log.filter("id % 6 <> 0"), again)


def issue_reasons(spark, sf_dir):
    """Why an issue isn't valid, the first reason that holds."""
    text = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("slug"), "n_chars")
    rows = issues(spark, sf_dir).join(text, "slug")
    reason = D.first_reason(
        ("outside_boundary", F.col("ref") == "p5"),
        ("no_capture", (F.col("layer") == "rendering") & (F.col("slug") % 4 == 0)),
        ("not_verbatim", (F.col("n_chars") < 300) & (F.col("kind") == "missing_content")),
        ("against_facts", (F.col("kind") == "broken_image") & (F.col("severity") == "major")),
    )
    return rows.groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def golden_differences(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.struct("quality", "toxic", (F.col("doc_id") % 3).alias("words")).alias("a"))
    other = labels.select("doc_id", "a", F.struct(F.when(F.col("doc_id") % 5 != 0, F.col("a.quality")).alias("quality"), F.lit(0).alias("toxic"), F.col("a.words")).alias("b"))
    return other.select("doc_id", F.array_join(D.differing("a", "b", ["quality", "toxic", "words"]), ",").alias("fields"))


def answers(spark, sf_dir):
    """Properties parsed strictly; a wrong one keeps its text."""
    raw = F.when(F.col("event_id") % 10 == 0, F.concat("props", F.lit("}{"))).otherwise(F.col("props"))
    bad = F.from_json(F.when(F.col("event_id") % 10 != 0, raw), "k int")
    rows = read(spark, sf_dir, "events").select("event_id", bad["k"].alias("k"), F.when(bad.isNull() | bad["k"].isNull(), raw).alias("raw"))
    return rows


def token_batches(spark, sf_dir):
    """Turns of each conversation split into requests of at most 1,200 characters, or one turn."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.char_length("text").cast("long").alias("n")))).alias("t"))
    return turns.select("conv_id", F.array_join(D.batched(F.col("t.n"), 1200).cast("array<string>"), ",").alias("requests"))


def undecided_removed(spark, sf_dir):
    """Removing two sources deletes their undecided items and keeps the decided ones."""
    from papershed.operators.inbox import state

    rows = items(spark, sf_dir)
    gone = F.col("source_id").isin("src0", "src1") & (state() == "undecided")
    return rows.filter(~gone).groupBy("source_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    review_flags, quality_labels, day_groups, nearest_views, matched_embeds, carried_system_text, citation_numbers, joined_hyphens, page_tiles, capture_types,
    annotations, issue_reasons, golden_differences, answers, token_batches, undecided_removed,
)}

ORACLE_SQL = {
    "review_flags": """SELECT doc_id, array_to_string(list_filter([CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 150 THEN 'short' END,
        CASE WHEN doc_id % 9 = 0 THEN 'no_title' END, CASE WHEN doc_id % 13 > 3 * greatest(len(regexp_extract_all(text, '\\n')) + 1, 1) THEN 'many_links' END], lambda f: f IS NOT NULL), ',') AS flags FROM documents""",
    "quality_labels": """SELECT CASE WHEN toxic <> 0 THEN 'unsafe' WHEN quality = 0 THEN 'summary' WHEN doc_id % 3 > 0 THEN 'checked' ELSE 'full' END AS label,
        toxic <> 0 OR quality = 0 AS low, count(*) AS n FROM labels GROUP BY ALL""",
    "day_groups": """WITH m AS (SELECT max(ts) AS now FROM events), d AS (SELECT ts, date_diff('day', CAST(ts AS DATE), CAST(now AS DATE)) AS k FROM events, m)
        SELECT CASE WHEN k = 0 THEN 'Today' WHEN k = 1 THEN 'Yesterday' WHEN k < 7 THEN strftime(ts, '%A') ELSE strftime(ts, '%Y-%m-%d') END AS day, count(*) AS n FROM d GROUP BY ALL""",
    "nearest_views": """WITH v AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'), p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase')
        SELECT p.user_id, p.event_id, arg_min(v.event_id, (abs(epoch_us(p.ts) - epoch_us(v.ts)), v.ts, v.event_id)) AS nearest FROM p LEFT JOIN v ON p.user_id = v.user_id GROUP BY ALL""",
    "matched_embeds": """WITH d AS (SELECT doc_id, regexp_split_to_array(lower(text), '\\s+') AS w FROM documents),
        a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w[1 : len(w) // 2]) AS w FROM d) GROUP BY ALL), b AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w[len(w) // 2 + 1 :]) AS w FROM d) GROUP BY ALL)
        SELECT doc_id, CAST(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS BIGINT) AS matched, CAST(sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0)) AS BIGINT) AS dropped FROM a FULL JOIN b USING (doc_id, w) GROUP BY doc_id""",
    "carried_system_text": """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations""",
    "citation_numbers": """WITH w AS (SELECT doc_id AS doc, unnest(a) AS ref, generate_subscripts(a, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS a FROM documents)),
        f AS (SELECT doc, ref, min(pos) AS pos FROM w GROUP BY doc, ref) SELECT doc, ref, CAST(row_number() OVER (PARTITION BY doc ORDER BY pos) AS INTEGER) AS number FROM f""",
    "joined_hyphens": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "page_tiles": """WITH t AS (SELECT doc_id, n_chars, unnest(range(0, greatest(n_chars, 1), 4096)) AS top FROM documents)
        SELECT doc_id, CAST(top // 4096 AS INTEGER) AS tile, top, least(4096, n_chars - top) AS tile_height FROM t""",
    "capture_types": """SELECT 'text/html' AS type, count(*) AS n FROM pages UNION ALL
        SELECT CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/svg+xml' ELSE 'text/plain' END, count(*) FROM documents GROUP BY 1""",
    "annotations": """WITH s AS (SELECT user_id AS material, event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'changed' ELSE event_type END AS note,
             epoch_us(ts) + CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END AS created FROM events WHERE event_id % 6 <> 0 OR event_id % 4 = 0)
        SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY material ORDER BY created, id) <= 2000""",
    "issue_reasons": f"""WITH {ISSUES_SQL} SELECT CASE WHEN ref = 'p5' THEN 'outside_boundary' WHEN layer = 'rendering' AND slug % 4 = 0 THEN 'no_capture'
        WHEN n_chars < 300 AND kind = 'missing_content' THEN 'not_verbatim' WHEN kind = 'broken_image' AND severity = 'major' THEN 'against_facts' ELSE 'valid' END AS reason, count(*) AS n
        FROM issues JOIN documents ON doc_id = slug GROUP BY 1""",
    "token_batches": """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(text) AS n FROM conversations),
        g AS (SELECT conv_id, k, n AS used, 0 AS b FROM t WHERE k = 1 UNION ALL
              SELECT t.conv_id, t.k, CASE WHEN used + n > 1200 AND used > 0 THEN n ELSE used + n END, b + CASE WHEN used + n > 1200 AND used > 0 THEN 1 ELSE 0 END FROM g JOIN t ON t.conv_id = g.conv_id AND t.k = g.k + 1)
        SELECT conv_id, string_agg(CAST(b AS VARCHAR), ',' ORDER BY k) AS requests FROM g GROUP BY conv_id""",
    "golden_differences": """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'quality' END, CASE WHEN toxic <> 0 THEN 'toxic' END], lambda f: f IS NOT NULL), ',') AS fields FROM labels""",
    "answers": """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
        CASE WHEN event_id % 10 = 0 THEN props || '}{' WHEN json_extract(props, '$.k') IS NULL THEN props END AS raw FROM events""",
    "undecided_removed": f"""WITH {ITEMS_SQL} SELECT source_id, count(*) AS n FROM items
        WHERE NOT (source_id IN ('src0', 'src1') AND queued_s IS NULL AND dismissed_s IS NULL AND opened_s IS NULL AND kept_s IS NULL) GROUP BY source_id""",
}
