"""Inbox, queue, source and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papershed.operators import inbox as I
from papershed.sources.tables import ITEMS_SQL, NOW, items, read, reading_events

STATE_SQL = """CASE WHEN queued_s IS NOT NULL THEN 'queued' WHEN dismissed_s IS NOT NULL THEN 'dismissed'
  WHEN opened_s IS NOT NULL THEN 'opened' WHEN kept_s IS NOT NULL THEN 'kept' ELSE 'undecided' END"""
SOURCES_SQL = f"""
    sources AS (
      SELECT source AS source_id, count(*) AS n, CAST(CASE WHEN max(doc_id) % 3 <> 0 THEN {NOW} - max(doc_id) * 37 % 7200 END AS BIGINT) AS last_sync_s,
             CAST(30 + min(doc_id) % 90 AS INTEGER) AS interval_minutes,
             CAST(CASE WHEN count(*) % 7 = 0 THEN {NOW} END AS BIGINT) AS paused_s FROM documents GROUP BY source)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest, oldest = F.max("doc_id"), F.min("doc_id")
    return read(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_id")).agg(
        F.when(newest % 3 != 0, F.lit(NOW) - newest * 37 % 7200).cast("long").alias("last_sync_s"),
        (F.lit(30) + oldest % 90).cast("int").alias("interval_minutes"),
        F.when(F.count("*") % 7 == 0, F.lit(NOW)).cast("long").alias("paused_s"),
    )


def item_states(spark, sf_dir):
    return items(spark, sf_dir).groupBy("source_id", I.state().alias("state")).agg(F.count("*").alias("n"))


def inbox_top(spark, sf_dir):
    return I.inbox(items(spark, sf_dir)).select("id", "doc_id", "source_id", "title", "published_s")


def inbox_per_source(spark, sf_dir):
    return I.inbox(items(spark, sf_dir)).groupBy("source_id").agg(F.count("*").alias("n_undecided"))


def reading_queue(spark, sf_dir):
    return I.queue(items(spark, sf_dir)).select("id", "source_id", "section", "queue_position", "nth")


def queue_next(spark, sf_dir):
    return I.next_positions(items(spark, sf_dir))


def queue_move(spark, sf_dir):
    queued = items(spark, sf_dir).filter("queued_s is not null")
    return I.moved(queued, F.col("doc_id") % 2 == 1, 40).select("id", "source_id", "new_position")


def source_health(spark, sf_dir):
    return I.source_health(sources(spark, sf_dir).select("source_id"), items(spark, sf_dir), NOW)


def due_sources(spark, sf_dir):
    return I.due(sources(spark, sf_dir), NOW).select("source_id", "last_sync_s", "interval_minutes")


def item_upsert(spark, sf_dir):
    """A second sync of a third of the items, some twice, and items of a new source."""
    stored = items(spark, sf_dir).select("source_id", "doc_id", "title", "published_s", "fetched_s", "kept_s")
    again = stored.filter("doc_id % 3 = 0").select("source_id", "doc_id", F.concat("title", F.lit(" (new)")).alias("title"), (F.col("published_s") + 60).alias("published_s"),
                                                  F.lit(NOW).cast("long").alias("fetched_s"), F.lit(None).cast("long").alias("kept_s"), F.lit(1).alias("ord"))
    twice = again.filter("doc_id % 9 = 0").withColumn("title", F.concat("title", F.lit("!"))).withColumn("ord", F.lit(2))
    fresh = again.filter("doc_id % 15 = 0").withColumn("source_id", F.lit("fresh"))
    return I.upsert(stored, again.union(twice).union(fresh), ["source_id", "doc_id"], ["title", "published_s"], "ord")


def week_statistics(spark, sf_dir):
    """Distinct refs of each kind in the week of the last event and in the week before."""
    log = reading_events(spark, sf_dir)
    week = log.agg(F.date_trunc("week", F.max("at")).alias("w"))  # one row
    both = log.join(F.broadcast(week))
    this, last = F.col("at") >= F.col("w"), (F.col("at") < F.col("w")) & (F.col("at") >= F.expr("w - interval 168 hours"))
    return both.groupBy("kind").agg(
        F.countDistinct(F.when(this, F.col("ref"))).alias("this_week"), F.countDistinct(F.when(last, F.col("ref"))).alias("last_week")
    )


def weekly_events(spark, sf_dir):
    weeks = reading_events(spark, sf_dir).groupBy(F.date_trunc("week", "at").alias("w"), "kind")
    return weeks.agg(F.count("*").alias("n"), F.countDistinct("ref").alias("n_refs")).select(F.date_format("w", "yyyy-MM-dd").alias("week"), "kind", "n", "n_refs")


def debounced_events(spark, sf_dir):
    """The last value of each burst of a user's events: bursts end after an hour without one."""
    log = read(spark, sf_dir, "events")
    bursts = log.groupBy("user_id", F.session_window("ts", "60 minutes").alias("w"))
    return bursts.agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id"))["event_id"].alias("last_event")).select(
        "user_id", F.unix_timestamp("w.start").alias("start_s"), "n", "last_event"
    )


def decision_fold(spark, sf_dir):
    """Decisions folded from the log: the first time of each kind sticks; a signup clears an earlier click."""
    log = reading_events(spark, sf_dir)
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.unix_timestamp("at")))
    cleared = F.max(F.when(F.col("kind") == "signup", F.unix_timestamp("at"))).alias("cleared")
    folded = log.groupBy("ref").agg(first("view").alias("opened_s"), first("purchase").alias("kept_s"), first("error").alias("dismissed_s"), cleared)
    after = log.join(folded.select("ref", "cleared"), "ref").filter((F.col("kind") == "click") & (F.unix_timestamp("at") > F.coalesce("cleared", F.lit(0))))
    queued = after.groupBy("ref").agg(F.min(F.unix_timestamp("at")).alias("queued_s"))
    return folded.join(queued, "ref", "left").select("ref", "opened_s", "kept_s", "dismissed_s", "queued_s")


QUERIES = {f.__name__: f for f in (
    item_states, inbox_top, inbox_per_source, reading_queue, queue_next, queue_move, source_health, due_sources, item_upsert,
    week_statistics, weekly_events, debounced_events, decision_fold,
)}

INBOX_SQL = f"WITH {ITEMS_SQL}, box AS (SELECT * FROM items WHERE {STATE_SQL} = 'undecided' ORDER BY published_s DESC NULLS LAST, id LIMIT 500)"
ORACLE_SQL = {
    "item_states": f"WITH {ITEMS_SQL} SELECT source_id, {STATE_SQL} AS state, count(*) AS n FROM items GROUP BY ALL",
    "inbox_top": f"{INBOX_SQL} SELECT id, doc_id, source_id, title, published_s FROM box",
    "inbox_per_source": f"{INBOX_SQL} SELECT source_id, count(*) AS n_undecided FROM box GROUP BY source_id",
    "reading_queue": f"""WITH {ITEMS_SQL}, q AS (SELECT *, CASE WHEN opened_s IS NOT NULL THEN 'continuing' ELSE 'up_next' END AS section
        FROM items WHERE {STATE_SQL} = 'queued')
        SELECT id, source_id, section, queue_position,
               CAST(row_number() OVER (PARTITION BY source_id, section ORDER BY queue_position, id) AS INTEGER) AS nth FROM q""",
    "queue_next": f"WITH {ITEMS_SQL} SELECT source_id, coalesce(max(queue_position), -1) + 1 AS next_position FROM items GROUP BY source_id",
    "queue_move": f"""WITH {ITEMS_SQL} SELECT id, source_id, CAST(row_number() OVER (PARTITION BY source_id
        ORDER BY CASE WHEN doc_id % 2 = 1 THEN 1 WHEN queue_position < 40 THEN 0 ELSE 2 END, queue_position, id) - 1 AS INTEGER) AS new_position
        FROM items WHERE queued_s IS NOT NULL""",
    "source_health": f"""WITH {ITEMS_SQL} SELECT source_id, count(*) AS n_items, count(kept_s) AS n_materials,
        count(*) FILTER (published_s >= {NOW - 28 * 86400}) AS n_recent,
        floor(CAST(count(*) FILTER (published_s >= {NOW - 28 * 86400}) AS DOUBLE) / 4 * 10 + 0.5) / 10 AS weekly_rate FROM items GROUP BY source_id""",
    "due_sources": f"""WITH {SOURCES_SQL} SELECT source_id, last_sync_s, interval_minutes FROM sources
        WHERE paused_s IS NULL AND (last_sync_s IS NULL OR {NOW} - last_sync_s >= interval_minutes * 60)""",
    "item_upsert": f"""WITH {ITEMS_SQL}, s AS (SELECT source_id, doc_id, title, published_s, fetched_s, kept_s FROM items),
        b AS (SELECT source_id, doc_id, title || ' (new)' || CASE WHEN doc_id % 9 = 0 THEN '!' ELSE '' END AS title, published_s + 60 AS published_s FROM s WHERE doc_id % 3 = 0
              UNION ALL SELECT 'fresh', doc_id, title || ' (new)', published_s + 60 FROM s WHERE doc_id % 15 = 0)
        SELECT coalesce(s.source_id, b.source_id) AS source_id, coalesce(s.doc_id, b.doc_id) AS doc_id,
               CASE WHEN b.doc_id IS NOT NULL THEN b.title ELSE s.title END AS title,
               CASE WHEN b.doc_id IS NOT NULL THEN b.published_s ELSE s.published_s END AS published_s,
               CASE WHEN s.doc_id IS NULL THEN {NOW} ELSE s.fetched_s END AS fetched_s, s.kept_s
        FROM s FULL JOIN b ON s.source_id = b.source_id AND s.doc_id = b.doc_id""",
    "week_statistics": """WITH w AS (SELECT CAST(date_trunc('week', max(ts)) AS TIMESTAMP) AS w FROM events)
        SELECT event_type AS kind, count(DISTINCT user_id) FILTER (ts >= w) AS this_week,
               count(DISTINCT user_id) FILTER (ts < w AND ts >= w - INTERVAL 168 HOURS) AS last_week FROM events, w GROUP BY event_type""",
    "weekly_events": """SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS n_refs
        FROM events GROUP BY ALL""",
    "debounced_events": """WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
        s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 60 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e)
        SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event FROM s GROUP BY user_id, g""",
    "decision_fold": """WITH e AS (SELECT user_id AS ref, event_type AS kind, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
        f AS (SELECT ref, min(s) FILTER (kind = 'view') AS opened_s, min(s) FILTER (kind = 'purchase') AS kept_s,
                     min(s) FILTER (kind = 'error') AS dismissed_s, max(s) FILTER (kind = 'signup') AS cleared FROM e GROUP BY ref),
        q AS (SELECT e.ref, min(s) AS queued_s FROM e JOIN f USING (ref) WHERE kind = 'click' AND s > coalesce(cleared, 0) GROUP BY e.ref)
        SELECT f.ref, opened_s, kept_s, dismissed_s, queued_s FROM f LEFT JOIN q USING (ref)""",
}
