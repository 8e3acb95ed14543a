"""Library, identity, metadata, session and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from papershed.functions import text as X
from papershed.functions import urls as U
from papershed.operators import identity as I
from papershed.operators import library as L
from papershed.operators import turns as T
from papershed.sources.tables import ITEMS_SQL, items, items_of, read


def _tagged(spark, sf_dir):
    """Every item with the words of its whole text as raw tags."""
    docs = read(spark, sf_dir, "documents")
    tags = docs.select(F.col("doc_id"), L.normal_tags(F.split("text", r"\s+")).alias("tags"))
    return tags.join(items(spark, sf_dir).select("id", "doc_id"), "doc_id")


def tag_counts(spark, sf_dir):
    return L.tag_counts(_tagged(spark, sf_dir))


def tagged_items(spark, sf_dir):
    """Normal tags of all items and whether a tag is among them, whatever its case."""
    return _tagged(spark, sf_dir).select("id", F.array_join("tags", "|").alias("tags"), L.has_tag(F.col("tags"), " THE ").alias("has_the"))


def library_search(spark, sf_dir):
    """All-words search over the whole texts: every word a substring, newest first, 50 at most."""
    hits = read(spark, sf_dir, "documents").filter(L.has_all_words(F.col("text"), "The  AND ing"))
    return items_of(hits).orderBy(F.desc_nulls_last("published_s"), "id").limit(50).select("id", "title", "published_s")


def library_titles(spark, sf_dir):
    """The first 100 titles in natural order."""
    numbered = items(spark, sf_dir).select("id", F.concat(F.lit("Vol "), F.col("doc_id").cast("string"), F.lit(" "), "source_id").alias("title"))
    return numbered.orderBy(X.natural_key(F.col("title")), "id").limit(100)


def effective_metadata(spark, sf_dir):
    """Extracted metadata under overrides: an override wins unless it is empty."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("Edited "), "doc_id")).otherwise("").alias("title"), F.when(F.col("toxic") == 1, F.lit("note")).alias("kind"))
    found = items(spark, sf_dir).select("id", "doc_id", "title").join(labels.alias("o").select("doc_id", F.struct("title", "kind").alias("o")), "doc_id", "left")
    layers = found.withColumn("x", F.struct("title", F.lit("webpage").alias("kind")))
    return layers.select("id", L.layered(["o", "x"], "title"), L.layered(["o", "x"], "kind"))


def _visited(spark, sf_dir):
    """Pages under the links by which readers come: other hosts and more parameters."""
    host = F.coalesce(F.get(F.array(*[F.lit(h) for h in VISITED_HOSTS]), (F.col("page_id") % 7).cast("int")), F.regexp_extract("url", "//([^/]+)", 1))
    url = F.concat(F.lit("HTTPS://"), host, F.regexp_extract("url", "//[^/]+(.*)$", 1), F.lit("&ref=hn&b=%2F&yclid=1&s=2&_hsenc=x&si=3&Ref=4&mkt_tok=5&c#top"))
    return read(spark, sf_dir, "pages").select("page_id", url.alias("url"))


#: Hosts for the first remainders of page_id by 7; the others keep their own.
VISITED_HOSTS = ("Gist.GitHub.com", "x.com", "music.youtube.com", "[fd00::1]", "10.1.2.3")


def canonical_urls(spark, sf_dir):
    url = F.col("url")
    return _visited(spark, sf_dir).select("page_id", U.canonical_url(url).alias("canonical"), U.host_of(url).alias("host"), U.slug(url).alias("slug"),
                                          U.is_public_url(url).alias("is_public"), F.substring(F.sha2(U.canonical_url(url), 256), 1, 16).alias("id"))


def identity_lookup(spark, sf_dir):
    """Pages asked for by variants of their URL, resolved to the page that was fetched first."""
    pages = _visited(spark, sf_dir).select("page_id", U.canonical_url(F.col("url")).alias("c"), U.slug(F.col("url")).alias("s"))
    key = lambda *parts: F.array(*[F.struct(F.lit(k).alias("priority"), F.concat(F.lit(f"{name}:"), c).alias("key")) for k, (name, c) in enumerate(parts)])
    known = pages.select(F.col("page_id").alias("id"), (F.col("page_id") * 37 % 1009).alias("fetched_s"), key(("url", F.col("c")), ("slug", F.col("s"))).alias("keys"))
    asked = pages.select(F.col("page_id").alias("request_id"), key(("url", F.when(F.col("page_id") % 3 != 0, F.col("c")).otherwise("none")), ("slug", F.col("s"))).alias("keys"))
    return L.resolve(asked, known)


def identified_pages(spark, sf_dir):
    """Fetched pages, half of them under other URLs, found among every second one by URL, declared link, DOI or arXiv id."""
    i = F.col("page_id")
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    doi, arxiv = F.concat(F.lit("10.1000/"), F.floor(i / 3).cast("string")), F.when(i % 5 == 1, F.concat(F.lit("2401."), F.lpad(F.floor(i / 10).cast("string"), 5, "0")))
    none = F.lit(None).cast("string")
    stored = pages.filter("page_id % 2 = 0").select(i.alias("id"), (i * 37 % 1009).alias("fetched_s"), I.record_keys(F.col("url"), none, F.array(F.concat(F.lit("https://alias.org/"), i.cast("string"))), none, doi, arxiv).alias("keys"))
    final = F.when(i % 4 < 2, F.col("url")).otherwise(F.concat(F.lit("https://moved.org/"), i.cast("string")))
    declared = F.when(i % 7 == 3, F.concat(F.lit("https://alias.org/"), (i - 1).cast("string")))
    return I.identified(pages.select(i.alias("request_id"), I.page_keys(final, declared, F.when(i % 3 > 0, doi), arxiv).alias("keys")), stored)


def missing_relations(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array(F.col("doc_id") * 3, F.col("doc_id") + F.col("doc_id") % 2).alias("related"))
    return L.missing_references(docs, "related", docs)


def freed_images(spark, sf_dir):
    """Images that only deleted materials refer to."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 701).alias("ref"))
    return L.unreferenced(docs, docs.filter("id % 3 = 0").select("id"))


def override_merge(spark, sf_dir):
    """Overrides after a patch that clears, replaces and adds keys."""
    labels = read(spark, sf_dir, "labels")
    current = F.create_map(F.lit("title"), F.concat(F.lit("t"), "doc_id"), F.lit("note"), F.lit("old"))
    patch = F.create_map(F.lit("note"), F.when(F.col("quality") == 1, "").otherwise("new"), F.lit("kind"), F.when(F.col("toxic") == 1, "report").otherwise(""))
    merged = labels.select("doc_id", L.merge_overrides(current, patch).alias("m"))
    return merged.select("doc_id", F.col("m")["title"].alias("title"), F.col("m")["note"].alias("note"), F.col("m")["kind"].alias("kind"), F.size(F.map_keys("m")).alias("n_keys"))


def artifact_versions(spark, sf_dir):
    """Conversations as artifacts with a version for each turn: the newest, and as of version 2."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("version"), F.col("text").alias("body"))
    then = L.as_of(turns, 2).select("id", F.col("version").alias("old_version"), F.char_length("body").alias("old_chars"))
    return L.as_of(turns).join(then, "id").select("id", "version", F.char_length("body").alias("chars"), "old_version", "old_chars")


def session_list(spark, sf_dir):
    return T.sessions(read(spark, sf_dir, "conversations"))


def folded_turns(spark, sf_dir):
    return T.folded(read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.char_length("text") > 300).cast("int").alias("long")), "conv_id", "turn", "long")


def answered_calls(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.struct("ts", "event_id").alias("ord"))
    return T.answered(calls, "user_id", "event_type", "ord").groupBy("user_id", "event_type").agg(F.count_if("answered").alias("n_answered"), F.count("*").alias("n_calls"))


def gists(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", X.gist(text).alias("gist"), X.reading_minutes(text).alias("minutes"))


def comparison_keys(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(X.comparison_key(F.col("text")), 256).alias("key"))


def text_windows(spark, sf_dir):
    """Pages of 24,000 characters of every text, with the place where the next one starts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.char_length("text").alias("total"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(24000))
    parts = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substr("text", s + 1, F.lit(24000)).alias("part")))
    cut = docs.select("doc_id", "total", F.explode(parts).alias("w")).select("doc_id", "total", "w.start", "w.part")
    part = F.col("part")
    following = F.when(F.col("start") + 24000 < F.col("total"), F.col("start") + 24000)
    return cut.select("doc_id", "start", F.char_length(part).alias("n_chars"), F.md5(part).alias("md5"), following.alias("next"), "total")


def overlapping_spans(spark, sf_dir):
    """Anchors and annotations of a document that overlap: a range join on binned intervals."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    starts = lambda a, z, step: F.explode(F.when(z >= a, F.sequence(F.lit(a).cast("long"), z, F.lit(step).cast("long")))).alias("start")
    anchors = docs.select("doc_id", starts(0, F.col("n_chars") - 1, 500)).withColumn("stop", F.col("start") + 450)
    notes = docs.select("doc_id", starts(100, F.col("n_chars"), 1700)).withColumn("stop", F.col("start") + 600)
    return L.overlapping(anchors, notes, "doc_id", 1024).groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.sum("l_start").alias("sum_start"))


def storage_usage(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text")).alias("bytes")).select(F.lit("records").alias("category"), "bytes")
    pages = read(spark, sf_dir, "pages").agg(F.sum(F.octet_length("html")).alias("bytes")).select(F.lit("captures").alias("category"), "bytes")
    turns = read(spark, sf_dir, "conversations").agg(F.sum(F.octet_length("text")).alias("bytes")).select(F.lit("sessions").alias("category"), "bytes")
    return docs.union(pages).union(turns)


QUERIES = {f.__name__: f for f in (
    tag_counts, tagged_items, library_search, library_titles, effective_metadata, canonical_urls, identity_lookup, identified_pages, missing_relations, freed_images,
    override_merge, artifact_versions, session_list, folded_turns, answered_calls, gists, comparison_keys, text_windows, overlapping_spans, storage_usage,
)}

TAGS_SQL = f"""{ITEMS_SQL},
    parts AS (SELECT id, generate_subscripts(a, 1) AS i, unnest(a) AS t FROM (SELECT substr(sha256(source || chr(0) || CAST(doc_id AS VARCHAR)), 1, 16) AS id, regexp_split_to_array(text, '\\s+') AS a FROM documents)),
    clean AS (SELECT id, i, trim(substr(trim(t), 1, 40)) AS tag FROM parts),
    first AS (SELECT * FROM clean WHERE tag <> '' QUALIFY row_number() OVER (PARTITION BY id, lower(tag) ORDER BY i) = 1),
    tags AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) <= 20)"""
CANONICAL_SQL = r"""
    u AS (SELECT page_id, 'HTTPS://' || coalesce((['Gist.GitHub.com', 'x.com', 'music.youtube.com', '[fd00::1]', '10.1.2.3'])[page_id % 7 + 1], regexp_extract(url, '//([^/]+)', 1))
                 || regexp_extract(url, '//[^/]+([^#]*)', 1) || CASE WHEN contains(url, '#') THEN '' ELSE '&ref=hn&b=%2F&yclid=1&s=2&_hsenc=x&si=3&Ref=4&mkt_tok=5&c' END AS bare FROM pages),
    v AS (SELECT *, regexp_extract(bare, '^([^?]*)', 1) AS base, lower(regexp_extract(bare, '//(\[[^\]]*\]|[^/:?#]*)', 1)) AS h FROM u),
    w AS (SELECT *, list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: NOT (CASE regexp_extract(p, '^([^=]*)', 1)
                   WHEN 'ref' THEN NOT regexp_matches(h, '(^|\.)(github|gitlab)\.com$') WHEN 's' THEN regexp_matches(h, '(^|\.)(x|twitter)\.com$')
                   WHEN 'si' THEN regexp_matches(h, '(^|\.)(youtube\.com|youtu\.be|spotify\.com)$')
                   ELSE regexp_matches(p, '^(utm_[^=]*|ref_src|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|_hsenc|_hsmi|mkt_tok|yclid|spm|share)(=|$)') END)) AS kept FROM v),
    c AS (SELECT page_id, h, 'https://' || h || regexp_extract(base, '//[^/]+(.*)$', 1) || CASE WHEN contains(bare, '?') AND len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical,
                 regexp_replace(substr(regexp_replace(regexp_replace(lower(regexp_replace(bare, '^[a-zA-Z]+://(www\.)?|[?#].*$', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+', ''), 1, 80), '-+$', '') AS slug FROM w)"""
ORACLE_SQL = {
    "gists": r"""WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM documents),
        h AS (SELECT *, substr(p, 1, 300) AS head FROM t), e AS (SELECT *, regexp_extract(head, '(?s)^(.*[.!?]) ', 1) AS s, regexp_extract(head, '^(.*) [^ ]*$', 1) AS w FROM h)
        SELECT doc_id, CASE WHEN length(p) <= 300 THEN p WHEN length(s) > 100 THEN s ELSE trim(CASE WHEN w <> '' THEN w ELSE head END) || '…' END AS gist,
               CAST(greatest(1, floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) / 240 + 0.5)) AS INTEGER) AS minutes FROM e""",
    "tag_counts": f"WITH {TAGS_SQL} SELECT tag, count(*) AS n FROM tags GROUP BY tag",
    "tagged_items": f"""WITH {TAGS_SQL} SELECT items.id, coalesce(string_agg(tag, '|' ORDER BY i), '') AS tags, coalesce(bool_or(lower(tag) = 'the'), false) AS has_the
        FROM items LEFT JOIN tags ON tags.id = items.id GROUP BY items.id""",
    "library_search": f"""WITH {ITEMS_SQL} SELECT id, title, published_s FROM items WHERE doc_id IN
        (SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND contains(lower(text), 'ing'))
        ORDER BY published_s DESC NULLS LAST, id LIMIT 50""",
    "library_titles": f"""WITH {ITEMS_SQL} SELECT id, 'Vol ' || doc_id || ' ' || source_id AS title FROM items
        ORDER BY doc_id, CAST(substr(source_id, 4) AS INTEGER), id LIMIT 100""",
    "effective_metadata": f"""WITH {ITEMS_SQL} SELECT id, CASE WHEN quality = 1 THEN 'Edited ' || items.doc_id ELSE nullif(title, '') END AS title,
        CASE WHEN toxic = 1 THEN 'note' ELSE 'webpage' END AS kind FROM items LEFT JOIN labels USING (doc_id)""",
    "canonical_urls": f"""WITH {CANONICAL_SQL} SELECT page_id, canonical, h AS host, slug, substr(sha256(canonical), 1, 16) AS id,
        page_id % 7 NOT IN (3, 4) AS is_public FROM c""",
    "identity_lookup": f"""WITH {CANONICAL_SQL},
        k AS (SELECT page_id AS id, page_id * 37 % 1009 AS f, 'url:' || canonical AS key FROM c UNION ALL SELECT page_id, page_id * 37 % 1009, 'slug:' || slug FROM c),
        r AS (SELECT page_id AS request_id, 0 AS p, 'url:' || CASE WHEN page_id % 3 <> 0 THEN canonical ELSE 'none' END AS key FROM c
              UNION ALL SELECT page_id, 1, 'slug:' || slug FROM c)
        SELECT request_id, id FROM r JOIN k USING (key) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY p, f, id) = 1""",
    "identified_pages": """WITH p AS (SELECT page_id AS i, regexp_replace(regexp_replace(url, '#.*$', ''), '[?&](utm_[a-z]+|ref)=[^&]*', '', 'g') AS url, '10.1000/' || (page_id // 3) AS doi, CASE WHEN page_id % 5 = 1 THEN '2401.' || lpad(CAST(page_id // 10 AS VARCHAR), 5, '0') END AS arxiv FROM pages),
        k AS (SELECT i AS id, i * 37 % 1009 AS f, unnest(['url:' || url, 'url:https://alias.org/' || i, 'doi:' || doi, 'arxiv:' || arxiv]) AS key FROM p WHERE i % 2 = 0),
        r AS (SELECT i, unnest([0, 3, 4, 5]) AS o, unnest(['url:' || CASE WHEN i % 4 < 2 THEN url ELSE 'https://moved.org/' || i END, CASE WHEN i % 7 = 3 THEN 'url:https://alias.org/' || (i - 1) END,
                 CASE WHEN i % 3 > 0 THEN 'doi:' || doi END, 'arxiv:' || arxiv]) AS key FROM p)
        SELECT r.i AS request_id, id FROM r JOIN k USING (key) QUALIFY row_number() OVER (PARTITION BY r.i ORDER BY o, f, id) = 1""",
    "missing_relations": """WITH d AS (SELECT doc_id AS id, unnest([doc_id * 3, doc_id + doc_id % 2]) AS ref FROM documents)
        SELECT DISTINCT id, ref FROM d WHERE id = ref OR ref NOT IN (SELECT doc_id FROM documents)""",
    "freed_images": """SELECT DISTINCT doc_id % 701 AS ref FROM documents WHERE doc_id % 3 = 0
        AND doc_id % 701 NOT IN (SELECT doc_id % 701 FROM documents WHERE doc_id % 3 <> 0)""",
    "override_merge": """SELECT doc_id, 't' || doc_id AS title, CASE WHEN quality = 1 THEN NULL ELSE 'new' END AS note,
        CASE WHEN toxic = 1 THEN 'report' END AS kind, CAST(1 + (1 - quality) + toxic AS INTEGER) AS n_keys FROM labels""",
    "artifact_versions": """WITH o AS (SELECT conv_id, max(turn) AS v, arg_max(text, turn) AS b FROM conversations WHERE turn <= 2 GROUP BY conv_id)
        SELECT conv_id AS id, max(turn) AS version, CAST(length(arg_max(text, turn)) AS INTEGER) AS chars, any_value(v) AS old_version, CAST(length(any_value(b)) AS INTEGER) AS old_chars
        FROM conversations JOIN o USING (conv_id) GROUP BY conv_id""",
    "session_list": """WITH s AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS t, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id)
        SELECT conv_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS title, n_turns, n_chars FROM s""",
    "folded_turns": """WITH t AS (SELECT conv_id, turn, CAST(length(text) > 300 AS INTEGER) AS long FROM conversations),
        c AS (SELECT *, CASE WHEN lag(long) OVER w IS NOT DISTINCT FROM long THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c)
        SELECT conv_id, CAST(run AS BIGINT) AS run, long, min(turn) AS first, count(*) AS n FROM r GROUP BY conv_id, run, long""",
    "answered_calls": "SELECT user_id, event_type, least(count(*), 2) AS n_answered, count(*) AS n_calls FROM events GROUP BY user_id, event_type",
    "comparison_keys": "SELECT doc_id, sha256(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')) AS key FROM documents",
    "text_windows": """WITH w AS (SELECT doc_id, text, length(text) AS total, unnest(range(0, greatest(length(text), 1), 24000)) AS start FROM documents)
        SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(length(substr(text, start + 1, 24000)) AS INTEGER) AS n_chars, md5(substr(text, start + 1, 24000)) AS md5,
               CAST(CASE WHEN start + 24000 < total THEN start + 24000 END AS INTEGER) AS next, CAST(total AS INTEGER) AS total FROM w""",
    "overlapping_spans": """WITH d AS (SELECT doc_id, n_chars FROM documents),
        a AS (SELECT doc_id, unnest(range(0, n_chars, 500)) AS s FROM d), n AS (SELECT doc_id, unnest(range(100, n_chars + 1, 1700)) AS s FROM d)
        SELECT a.doc_id, count(*) AS n_pairs, CAST(sum(a.s) AS BIGINT) AS sum_start FROM a JOIN n ON a.doc_id = n.doc_id AND a.s < n.s + 600 AND a.s + 450 > n.s GROUP BY a.doc_id""",
    "storage_usage": """SELECT 'records' AS category, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents UNION ALL SELECT 'captures', CAST(sum(strlen(html)) AS BIGINT) FROM pages
        UNION ALL SELECT 'sessions', CAST(sum(strlen(text)) AS BIGINT) FROM conversations""",
}
