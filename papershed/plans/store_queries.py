"""Queries of the kept tables and of the checks on what agents write and judges say."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papershed.functions.text import capitals
from papershed.operators import review as R
from papershed.operators import store as S
from papershed.sources.folders import new_folder
from papershed.sources.tables import CASES_SQL, ISSUES_SQL, ITEMS_SQL, NOW, cases, issues, items, read


def record_store(spark, sf_dir):
    """Items saved as records, a third of them saved again with another title, read back."""
    path = new_folder(spark, "records")
    rows = items(spark, sf_dir).select("id", "title", "lang", "fetched_s", F.lit(1).alias("saved_at"))
    S.save(rows, path, ["id"])
    S.save(rows.filter("fetched_s % 3 = 0").withColumn("title", F.upper("title")).withColumn("saved_at", F.lit(2)), path, ["id"])
    return S.load(spark, path).select("id", "title", "saved_at")


def _library(spark, sf_dir):
    """Items as materials: their kind, media type and origin follow from language, source and length."""
    kind = F.when(F.col("n_chars") % 5 == 0, "preprint").when(F.col("n_chars") % 5 == 1, "blogPost").when(F.col("n_chars") % 5 == 2, "note").otherwise("webpage")
    media = F.when(F.col("n_chars") % 7 == 0, "application/pdf").when(F.col("n_chars") % 7 == 1, "text/markdown").otherwise("text/html")
    origin = F.when(F.col("lang") == "fr", "agent").when(F.col("lang") == "de", "feed").otherwise("web")
    return items(spark, sf_dir).select("id", "title", "source_id", "fetched_s", "published_s", kind.alias("kind"), media.alias("media_type"), origin.alias("origin"))


def library_cuts(spark, sf_dir):
    """How many materials each filter and cut of the library shows."""
    rows = _library(spark, sf_dir)
    kinds = [F.count_if(F.coalesce(S.is_kind(k), F.lit(False))).alias(f"kind_{k}") for k in ("all", "articles", "pdf", "artifact", "feed")]
    cuts = [F.count_if(F.coalesce(S.in_cut(k), F.lit(False))).alias(f"cut_{k}") for k in ("all", "artifacts", "articles", "papers")]
    return rows.groupBy("source_id").agg(*kinds, *cuts)


def oldest_materials(spark, sf_dir):
    """The 100 oldest of the newest-first list, ties the other way round as well."""
    rows = _library(spark, sf_dir)
    return rows.orderBy(F.asc("fetched_s"), F.desc("id")).limit(100).select("id", "fetched_s")


def metadata_patches(spark, sf_dir):
    """Patches of documents' metadata, valid ones and others, by the first reason against them."""
    i = F.col("doc_id")
    value = F.get(F.array(F.lit("10.1234/A b"), F.lit(" 10.1234/AB "), F.lit("2024-13"), F.lit("May"), F.lit(""), F.lit("podcast"), F.repeat(F.lit("x"), 2001), F.lit("v")), (i % 8).cast("int"))
    key = F.get(F.array(F.lit("doi"), F.lit("doi"), F.lit("date"), F.lit("date"), F.lit("kind"), F.lit("kind"), F.lit("publisher"), F.lit("shelf")), (i % 8).cast("int"))
    patch = F.create_map(key, value, F.lit("title"), F.coalesce(F.substring("text", 1, 50), F.lit("")))
    known = ["title", "doi", "date", "accessed", "kind", "publisher", "abstract", "note", "extra", "arxiv_id", "isbn", "issn"]
    problem = S.patch_problem(patch, known)
    return read(spark, sf_dir, "documents").select("doc_id", problem.alias("problem"), F.when(problem.isNull(), S.patched(patch)["doi"]).alias("doi"))


def source_failures(spark, sf_dir):
    """The state of each user as a source after the log's events as syncs: an error event is a failed one."""
    log = read(spark, sf_dir, "events").select("user_id", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id").alias("at"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), "event_id")).alias("error"))
    found = S.health(log, "user_id", "at")
    return found.select("user_id", F.col("last_sync.event_id").alias("last_sync"), F.col("last_success.event_id").alias("last_success"), "last_error", "failure_count")


def session_log(spark, sf_dir):
    """Sessions after their last turns were appended and every fifth was deleted, most recently touched first in ``nth``."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", (F.col("conv_id") % 97 * 100 + F.col("turn")).alias("at"))
    first = turns.filter("turn < 2")
    sessions = turns.groupBy("session_id").agg(F.min("at").alias("updated_at"))
    deleted = sessions.filter("session_id % 5 = 0").select("session_id")
    now, left = S.sessions_after(sessions, first, turns.filter("turn >= 2"), deleted)
    counts = left.groupBy("session_id").agg(F.count("*").alias("n_turns"), F.max_by("role", F.struct("at", "turn")).alias("last_role"))
    return now.join(counts, "session_id", "left").select("session_id", "updated_at", "n_turns", "last_role")


def view_lists(spark, sf_dir):
    """View lists after a view was fetched, well, badly or though it is stored already."""
    i = F.col("doc_id")
    entry = lambda id, status: F.struct(F.lit(id).alias("id"), F.lit(status).alias("status"))
    views = F.when(i % 2 == 0, F.array(entry("reader", "ready"), entry("text", "available"))).otherwise(F.array(entry("reader", "ready")))
    new = F.when(i % 3 == 0, entry("pdf", "ready")).when(i % 3 == 1, entry("text", "ready")).otherwise(entry("reader", "failed"))
    fetched = S.fetch_outcome(F.when(i % 3 == 0, "available").when(i % 3 == 1, "ready"), F.col("text"), F.when(i % 2 == 0, "HTTP 500"))
    shown = lambda a: F.array_join(F.transform(a, lambda v: F.concat(v["id"], F.lit(":"), v["status"])), ",")
    return read(spark, sf_dir, "documents").select("doc_id", shown(S.views_after(views, new)).alias("views"), fetched["status"].alias("status"), fetched["error"].alias("error"), fetched["bytes"].alias("bytes"))


def promoted_views(spark, sf_dir):
    """Records and views after the text view of every record that has one became primary."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("content"), F.md5(F.concat("text", F.lit("!"))).alias("other"))
    record = docs.select("id", F.lit("reader").alias("view"), "content")
    views = docs.filter("id % 3 <> 0").select("id", F.lit("text").alias("view"), F.col("other").alias("content")).unionByName(docs.filter("id % 2 = 0").select("id", F.lit("pdf").alias("view"), "content"))
    now, left = S.promoted(record, views, "text")
    return now.select("id", F.lit(True).alias("is_primary"), "view", "content").unionByName(left.select("id", F.lit(False).alias("is_primary"), "view", "content"))


def image_cache(spark, sf_dir):
    """Pages' bytes as pictures of several types, cached by address, some forgotten again."""
    i = F.col("page_id")
    types = F.get(F.array(F.lit("image/png"), F.lit("text/html"), F.lit("image/svg+xml"), F.lit("image/x-icon")), (i % 4).cast("int"))
    fetched = read(spark, sf_dir, "pages").select("page_id", "url", types.alias("media_type"), F.encode("html", "UTF-8").alias("bytes"))
    left = S.forgotten(S.cached_images(fetched), fetched.filter("page_id % 8 = 0").select("url"))
    return left.select("key", "media_type", F.octet_length("bytes").alias("n_bytes")).distinct()


def captures(spark, sf_dir):
    """Captures of pages that are records: HTML is not kept, PDFs always are."""
    pages = read(spark, sf_dir, "pages").select(F.substring(F.sha2("url", 256), 1, 16).alias("id"), "page_id", "url", F.when(F.col("page_id") % 3 == 0, "application/pdf").otherwise("text/html").alias("media_type"), F.encode("html", "UTF-8").alias("bytes"))
    found = S.with_capture(pages.filter("page_id % 2 = 0"), pages, keep_html=False)
    return found.select("id", "media_type", F.col("sha256").alias("content_sha256"), F.col("length").cast("long").alias("n_bytes"))


def item_materials(spark, sf_dir):
    """Items after reading was finished and some materials were deleted."""
    rows = items(spark, sf_dir).select("doc_id", "finished_s", F.concat(F.lit("m"), (F.col("doc_id") % 50).cast("string")).alias("material_id"))
    done = read(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.concat(F.lit("m"), (F.col("user_id") % 80).cast("string")).alias("material_id"), F.col("event_id").alias("at"))
    gone = rows.filter("doc_id % 50 < 5").select("material_id").distinct()
    return S.unlinked(S.finished(rows, done), gone)


def record_json(spark, sf_dir):
    """Items as the documents that leave the library: camel case, nulls left out."""
    rows = S.as_columns(items(spark, sf_dir).select("id", "published_s", "queued_s"))
    return rows.select("id", "json")


def artifact_checks(spark, sf_dir):
    """Whether texts can be saved as artifacts of a type, and an edit of a passage that must occur once."""
    i = F.col("doc_id")
    source = F.when(i % 5 == 0, " ").when(i % 5 == 1, F.concat(F.lit("<svg>"), "text")).when(i % 5 == 2, F.repeat("text", 2)).otherwise(F.col("text"))
    kind = F.when(i % 2 == 0, "svg").otherwise("html")
    edit = R.edited_once(source, F.substring("text", 1, 12), F.lit("NEW"))
    return read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", R.source_problem(kind, source).alias("problem"), edit["problem"].alias("edit_problem"), F.md5(edit["text"]).alias("edited"))


def editor_notes(spark, sf_dir):
    """What an editor would ask to fix in documents as artifacts."""
    i = F.col("doc_id")
    title = F.when(i % 4 == 0, "Summary").otherwise(F.substring("text", 1, 40))
    source = F.concat(F.lit("# T\n\n"), F.when(i % 3 == 0, "## Notes\n\n").otherwise(""), F.col("text"), F.when(i % 5 == 0, " In conclusion").otherwise(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(R.editor_notes(title, source, i % 2 == 0), ",").alias("notes"))


def judge_inputs(spark, sf_dir):
    """Texts as a judge gets them, and the key under which its answer is kept."""
    cut = R.shortened_input(F.repeat(F.col("text"), 20))
    key = R.case_key(F.col("text"), F.concat("text", F.lit("!")), "v6", R.policy_key("screen-then-confirm", ["a/b", "c/d"], ["MINOR", "MAJOR"]))
    return read(spark, sf_dir, "documents").select("doc_id", F.char_length(cut).alias("n_chars"), F.endswith(cut, F.lit("[truncated]")).alias("was_cut"), key.alias("key"))


def found_evidence(spark, sf_dir):
    """Quotes of documents with other white space and markup, true and made-up ones, looked up in the texts."""
    i = F.col("doc_id")
    words = F.split(F.coalesce("text", F.lit("")), r"\s+")
    part = F.array_join(F.slice(words, 2, 8), "  ")
    quote = F.when(i % 3 == 0, part).when(i % 3 == 1, F.concat(F.lit("**"), part, F.lit("** …"))).otherwise(F.concat(part, F.lit(" never")))
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", R.evidence_occurs(quote, F.col("text")).alias("occurs"), R.find_text(quote).alias("find"), (F.char_length(R.prompt_context(F.col("text"), F.get(words, F.lit(5)), 100)) > 0).alias("has_context"), R.beyond_article(F.lit("missing_content"), F.concat(quote, F.when(i % 7 == 0, " © 2024").otherwise(""))).alias("beyond"))


def normal_issues(spark, sf_dir):
    """Issues as the rules set them and as they were reported, by layer and severity."""
    subject = F.when(F.col("kind") == "metadata_wrong", F.when(F.col("slug") % 3 == 0, "title").when(F.col("slug") % 3 == 1, "date"))
    raw = F.struct("layer", F.when(F.col("kind") == "noise", "extra_content").otherwise(F.col("kind")).alias("kind"), "severity", subject.alias("subject"), F.array("ref").alias("refs"))
    rows = issues(spark, sf_dir).withColumn("n", R.normal_issue(raw, F.array(F.lit("p1")), F.array(F.lit("p2")))).withColumn("raw", raw)
    same = (R.reported_issue(F.col("n"))["layer"] == F.col("raw.layer")) & (R.reported_issue(F.col("n"))["severity"] == F.col("raw.severity"))
    return rows.groupBy("n.layer", "n.kind", "n.severity").agg(F.count("*").alias("n_issues"), F.count_if(F.col("n.was_layer").isNotNull()).alias("n_moved"), F.count_if(~same).alias("n_lost"))


def resolved_cases(spark, sf_dir):
    """Cases by their verdict when a good screening stands and another is confirmed."""
    rows = cases(spark, sf_dir).select("slug", F.col("content").alias("screen"), F.when(F.col("slug") % 5 != 0, F.col("metadata")).alias("confirm"), F.greatest("content", "metadata").alias("both"))
    r = R.resolved_case("screen-then-confirm", F.col("screen"), F.col("confirm"), F.col("both"), [1, 2])
    return rows.groupBy(r["verdict"].alias("verdict"), r["source"].alias("source"), r["disputed"].alias("disputed")).agg(F.count("*").alias("n"))


def matched_pictures(spark, sf_dir):
    """Lines of orders as pictures of two sides, matched one to one by part, then by size, then by brand."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("string").alias("path"), F.when(F.col("p_size") % 4 != 0, F.substring("p_brand", 1, 8)).alias("stem"))
    lines = read(spark, sf_dir, "lineitem").join(parts, "l_partkey").select((F.col("l_orderkey") % 500).alias("case"), "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("url"), "path", "stem")
    ranked = lines.withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    side = lambda k: ranked.filter(F.col("l_linenumber") % 2 == k).select("case", "ord", "url", "path", "stem")
    return R.matched_images(side(0), side(1)).groupBy("case", "tier").agg(F.count("*").alias("n"), F.sum("ref").alias("refs"), F.sum("image").alias("images"))


def aligned_pictures(spark, sf_dir):
    """Pictures of pages in order: known addresses advance through the payload, unknown ones take the next."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), r"\s+").alias("payload"))
    known = F.transform("payload", lambda w, k: F.when(k % 3 != 1, w))
    return docs.select("doc_id", F.md5(F.array_join(R.aligned_sources(F.slice(known, 1, 40), F.col("payload")), " ")).alias("aligned"))


def mirrored_notes(spark, sf_dir):
    """Notes on words of a document's text as its other view, in capitals or with words left out, shows them."""
    words = F.split("text", r"\s+")
    docs = read(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("material"), "text", words.alias("w"))
    quote = F.array_join(F.slice("w", 3, 3), " ")
    notes = docs.filter(F.size("w") >= 6).select("material", F.lit(1).alias("id"), F.lit("reader").alias("view"), quote.alias("quote"), F.lit(7).alias("start"), F.lit(9).alias("stop"))
    other = F.when(F.col("material") % 2 == 0, F.array_join(F.slice("w", 2, 9), " ")).otherwise(capitals(F.col("text")))
    views = docs.select("material", F.lit("reader").alias("view"), "text").unionByName(docs.select("material", F.lit("text").alias("view"), other.alias("text")))
    return R.mirrored(notes, views).select("material", "shown", "start", "stop")


def report_links(spark, sf_dir):
    """Links that carry a report's text as far as it fits."""
    link = R.fitted_link(F.lit("https://example.org/new?body="), F.col("text"), 600)
    return read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", (F.char_length(link) <= 620).alias("fits"), F.endswith(link, F.lit("%E2%80%A6")).alias("was_cut"))


def newest_sources(spark, sf_dir):
    """Each source's newest item by publication, undated ones last, then by fetch."""
    order = Window.partitionBy("source_id").orderBy(F.desc_nulls_last("published_s"), F.desc("fetched_s"), "id")
    return _library(spark, sf_dir).withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("source_id", "id")


QUERIES = {f.__name__: f for f in (
    record_store, library_cuts, oldest_materials, metadata_patches, source_failures, session_log, view_lists, promoted_views, image_cache, captures, item_materials, record_json,
    artifact_checks, editor_notes, judge_inputs, found_evidence, normal_issues, resolved_cases, matched_pictures, aligned_pictures, mirrored_notes, report_links, newest_sources,
)}

LIBRARY_SQL = f"""{ITEMS_SQL}, lib AS (SELECT *, CASE n_chars % 5 WHEN 0 THEN 'preprint' WHEN 1 THEN 'blogPost' WHEN 2 THEN 'note' ELSE 'webpage' END AS kind,
    CASE n_chars % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/markdown' ELSE 'text/html' END AS media, CASE lang WHEN 'fr' THEN 'agent' WHEN 'de' THEN 'feed' ELSE 'web' END AS origin FROM items)"""
ORACLE_SQL = {
    "record_store": f"WITH {ITEMS_SQL} SELECT id, CASE WHEN fetched_s % 3 = 0 THEN upper(title) ELSE title END AS title, CAST(CASE WHEN fetched_s % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS saved_at FROM items",
    "library_cuts": f"""WITH {LIBRARY_SQL} SELECT source_id, count(*) AS kind_all, count(*) FILTER (media <> 'application/pdf' AND origin <> 'agent') AS kind_articles, count(*) FILTER (media = 'application/pdf') AS kind_pdf,
        count(*) FILTER (origin = 'agent') AS kind_artifact, count(*) FILTER (origin = 'feed') AS kind_feed, count(*) AS cut_all, count(*) FILTER (origin = 'agent') AS cut_artifacts,
        count(*) FILTER (origin <> 'agent' AND (kind IN ('webpage', 'blogPost', 'newsletter', 'newsArticle') OR media = 'text/markdown')) AS cut_articles, count(*) FILTER (kind = 'preprint' OR media = 'application/pdf') AS cut_papers FROM lib GROUP BY source_id""",
    "oldest_materials": f"WITH {ITEMS_SQL} SELECT id, fetched_s FROM items ORDER BY fetched_s, id DESC LIMIT 100",
    "newest_sources": f"WITH {ITEMS_SQL} SELECT source_id, id FROM items QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY published_s DESC NULLS LAST, fetched_s DESC, id) = 1",
    "metadata_patches": """SELECT doc_id, CASE doc_id % 8 WHEN 2 THEN NULL WHEN 3 THEN 'date is no date' WHEN 5 THEN 'kind is unknown' WHEN 6 THEN 'publisher is too long' WHEN 7 THEN 'unknown field shelf'
        WHEN 0 THEN 'doi is malformed' END AS problem, CASE WHEN doc_id % 8 = 1 THEN '10.1234/ab' END AS doi FROM documents""",
    "source_failures": """WITH e AS (SELECT user_id AS u, (ts, event_id) AS t, event_id AS id, event_type <> 'error' AS ok FROM events),
        s AS (SELECT u, arg_max(id, t) AS last_sync, arg_max(id, t) FILTER (ok) AS last_success, max(t) FILTER (ok) AS good, arg_max(ok, t) AS ok_now FROM e GROUP BY u)
        SELECT s.u AS user_id, last_sync, last_success, CASE WHEN NOT ok_now THEN 'failed ' || last_sync END AS last_error, CAST(count(e.id) FILTER (NOT ok AND (good IS NULL OR t > good)) AS INTEGER) AS failure_count
        FROM s JOIN e ON e.u = s.u GROUP BY ALL""",
    "session_log": """SELECT conv_id AS session_id, CAST(CASE WHEN max(turn) >= 2 THEN max(conv_id % 97 * 100 + turn) ELSE min(conv_id % 97 * 100 + turn) END AS BIGINT) AS updated_at, count(*) AS n_turns, arg_max(role, turn) AS last_role
        FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id""",
    "view_lists": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'reader:ready,pdf:ready,text:available' ELSE 'reader:ready,pdf:ready' END
          WHEN doc_id % 3 = 1 THEN 'reader:ready,text:ready' WHEN doc_id % 2 = 0 THEN 'reader:failed,text:available' ELSE 'reader:failed' END AS views,
        CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'failed' ELSE 'ready' END WHEN 1 THEN 'ready' ELSE 'unknown' END AS status,
        CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'HTTP 500' END WHEN 1 THEN 'stored already' ELSE 'no such view' END AS error,
        CAST(CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN strlen(text) END AS INTEGER) AS bytes FROM documents""",
    "promoted_views": """WITH d AS (SELECT doc_id AS id, md5(text) AS c, md5(text || '!') AS o FROM documents)
        SELECT id, true AS is_primary, CASE WHEN id % 3 <> 0 THEN 'text' ELSE 'reader' END AS view, CASE WHEN id % 3 <> 0 THEN o ELSE c END AS content FROM d
        UNION ALL SELECT id, false, 'reader', c FROM d WHERE id % 3 <> 0 UNION ALL SELECT id, false, 'pdf', c FROM d WHERE id % 2 = 0""",
    "image_cache": """SELECT DISTINCT sha256(url) AS key, (['image/png', '', 'image/svg+xml', ''])[page_id % 4 + 1] AS media_type, CAST(strlen(html) AS INTEGER) AS n_bytes FROM pages WHERE page_id % 4 IN (0, 2) AND url NOT IN (SELECT url FROM pages WHERE page_id % 8 = 0)""",
    "captures": """SELECT substr(sha256(url), 1, 16) AS id, 'application/pdf' AS media_type, sha256(html) AS content_sha256, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages
        WHERE page_id % 3 = 0 AND url IN (SELECT url FROM pages WHERE page_id % 2 = 0)""",
    "item_materials": f"""WITH {ITEMS_SQL}, f AS (SELECT 'm' || user_id % 80 AS m, min(event_id) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1)
        SELECT doc_id, coalesce(finished_s, t) AS finished_s, CASE WHEN doc_id % 50 >= 5 THEN 'm' || doc_id % 50 END AS material_id FROM items LEFT JOIN f ON m = 'm' || doc_id % 50""",
    "record_json": f"""WITH {ITEMS_SQL} SELECT id, '{{"id":"' || id || '"' || coalesce(',"publishedS":' || published_s, '') || coalesce(',"queuedS":' || queued_s, '') || '}}' AS json FROM items""",
    "artifact_checks": """WITH d AS (SELECT doc_id AS i, text, substr(text, 1, 12) AS o, CASE doc_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN '<svg>' || text WHEN 2 THEN text || text ELSE text END AS s FROM documents),
        e AS (SELECT *, CASE WHEN o = '' THEN 'empty' WHEN NOT contains(s, o) THEN 'absent' WHEN contains(substr(s, strpos(s, o) + 1), o) THEN 'repeated' END AS ep FROM d)
        SELECT i AS doc_id, CASE WHEN trim(s) = '' THEN 'empty' WHEN length(s) > 400000 THEN 'too long' WHEN i % 2 = 0 AND NOT regexp_matches(s, '(?i)<svg[\\s>]') THEN 'no svg element' WHEN i % 2 = 1 AND NOT regexp_matches(s, '(?is)<[a-z].*>') THEN 'no markup' END AS problem,
               ep AS edit_problem, CASE WHEN ep IS NULL THEN md5(substr(s, 1, strpos(s, o) - 1) || 'NEW' || substr(s, strpos(s, o) + length(o))) END AS edited FROM e""",
    "judge_inputs": """SELECT doc_id, CAST(least(length(text) * 20, 60012) AS INTEGER) AS n_chars, length(text) * 20 > 60000 AS was_cut,
        sha256(text || chr(0) || text || '!' || chr(0) || 'v6' || chr(0) || 'screen-then-confirm a/b > c/d on MAJOR,MINOR') AS key FROM documents""",
    "normal_issues": f"""WITH {ISSUES_SQL}, n AS (SELECT layer AS old, severity, CASE WHEN kind = 'noise' THEN 'extra_content' ELSE kind END AS kind,
             CASE WHEN kind = 'metadata_wrong' THEN CASE slug % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'date' END END AS subject, ref FROM issues),
        m AS (SELECT *, CASE WHEN subject IS NOT NULL THEN 'metadata' WHEN ref = 'p1' THEN 'content' WHEN ref = 'p2' THEN 'rendering' ELSE old END AS layer,
             CASE WHEN subject = 'title' THEN 'major' WHEN subject IS NOT NULL OR kind = 'extra_content' THEN 'minor' ELSE severity END AS sev FROM n)
        SELECT layer, kind, sev AS severity, count(*) AS n_issues, count(*) FILTER (layer <> old) AS n_moved, CAST(0 AS BIGINT) AS n_lost FROM m GROUP BY ALL""",
    "resolved_cases": f"""WITH {CASES_SQL}, r AS (SELECT CASE WHEN content = 0 THEN {{'v': content, 's': 'screen', 'd': false}} WHEN slug % 5 <> 0 THEN {{'v': greatest(content, metadata), 's': 'merged', 'd': content <> metadata}} END AS r FROM cases)
        SELECT r.v AS verdict, r.s AS source, r.d AS disputed, count(*) AS n FROM r GROUP BY ALL""",
    "matched_pictures": """WITH l AS (SELECT l_orderkey % 500 AS c, l_orderkey * 10 + l_linenumber AS o, l_linenumber % 2 AS side, CAST(l_partkey AS VARCHAR) AS url, CAST(p_size AS VARCHAR) AS path, CASE WHEN p_size % 4 <> 0 THEN substr(p_brand, 1, 8) END AS stem FROM lineitem JOIN part ON p_partkey = l_partkey),
        u AS (SELECT *, row_number() OVER (PARTITION BY c, side, url ORDER BY o) AS n FROM l), p1 AS (SELECT a.c, a.o AS r, b.o AS i, 'url' AS tier FROM u a JOIN u b ON a.c = b.c AND a.url = b.url AND a.n = b.n AND a.side = 0 AND b.side = 1),
        l2 AS (SELECT * FROM l WHERE (c, o) NOT IN (SELECT c, r FROM p1 UNION ALL SELECT c, i FROM p1)), v AS (SELECT *, row_number() OVER (PARTITION BY c, side, path ORDER BY o) AS n FROM l2),
        p2 AS (SELECT a.c, a.o AS r, b.o AS i, 'path' AS tier FROM v a JOIN v b ON a.c = b.c AND a.path = b.path AND a.n = b.n AND a.side = 0 AND b.side = 1),
        l3 AS (SELECT * FROM l2 WHERE stem IS NOT NULL AND (c, o) NOT IN (SELECT c, r FROM p2 UNION ALL SELECT c, i FROM p2)), w AS (SELECT *, row_number() OVER (PARTITION BY c, side, stem ORDER BY o) AS n FROM l3),
        p3 AS (SELECT a.c, a.o AS r, b.o AS i, 'stem' AS tier FROM w a JOIN w b ON a.c = b.c AND a.stem = b.stem AND a.n = b.n AND a.side = 0 AND b.side = 1)
        SELECT c AS "case", tier, count(*) AS n, CAST(sum(r) AS BIGINT) AS refs, CAST(sum(i) AS BIGINT) AS images FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) GROUP BY ALL""",
    "mirrored_notes": """WITH d AS (SELECT doc_id AS m, text, regexp_split_to_array(text, '\\s+') AS w FROM documents), q AS (SELECT *, array_to_string(w[3:5], ' ') AS q,
             CASE WHEN m % 2 = 0 THEN array_to_string(w[2:10], ' ') ELSE upper(text) END AS o FROM d WHERE len(w) >= 6)
        SELECT m AS material, 'reader' AS shown, CAST(7 AS INTEGER) AS start, CAST(9 AS INTEGER) AS stop FROM q
        UNION ALL SELECT m, 'text', CAST(strpos(o, q) - 1 AS INTEGER), CAST(strpos(o, q) - 1 + length(q) AS INTEGER) FROM q WHERE contains(o, q)""",
}
