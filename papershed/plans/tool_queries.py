"""Queries through the reading tools, and the guards of their calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from papershed.operators import tools as T
from papershed.sources.tables import ITEMS_SQL, items, read


def _id(n):
    return F.lpad(F.lower(F.hex(n)), 16, "0")


def _registered(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    materials = docs.select(_id(F.col("doc_id")).alias("id"), F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") * 37 % 1009).alias("saved_s"))
    notes = docs.select(_id(F.col("doc_id")).alias("material"), F.lit(3).alias("start"), F.substring("text", 4, 9).alias("quote"), F.lit("n").alias("note"))
    T.register(spark, {"materials": materials, "annotations": notes, "inbox": items(spark, sf_dir).select("id", "title", "source_id", "published_s")})


def tool_search(spark, sf_dir):
    """What the search finds for three words, materials and items, 20 of each."""
    _registered(spark, sf_dir)
    return T.call(spark, "library_search", {"query": "The  and ING"})


def tool_lists(spark, sf_dir):
    """The newest materials and the newest items of the inbox."""
    _registered(spark, sf_dir)
    recent = T.call(spark, "library_recent", {"how_many": 30}).select(F.lit("recent").alias("list"), "id")
    return recent.union(T.call(spark, "inbox_list", {}).select(F.lit("inbox").alias("list"), "id"))


def guarded_calls(spark, sf_dir):
    """Outcomes of calls: a user's events are a turn, an event's kind is the read that it repeats, errors write."""
    calls = read(spark, sf_dir, "events").withColumn("reads", F.col("event_type") != "error")
    return T.guarded(calls, "user_id", ["ts", "event_id"], ["event_type"], "reads").groupBy("user_id", "outcome").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


QUERIES = {f.__name__: f for f in (tool_search, tool_lists, guarded_calls)}

_HEX = "lpad(lower(to_hex(doc_id)), 16, '0')"
ORACLE_SQL = {
    "tool_search": f"""WITH {ITEMS_SQL}, a AS (SELECT {_HEX} AS id, 'Title ' || doc_id AS title, 'material' AS kind, doc_id * 37 % 1009 AS s, lower('Title ' || doc_id || ' ' || coalesce(text, '')) AS said FROM documents
          UNION ALL SELECT id, title, 'item', published_s, lower(concat_ws(' ', title, source_id)) FROM items)
        SELECT id, title, kind FROM a WHERE contains(said, 'the') AND contains(said, 'and') AND contains(said, 'ing') QUALIFY row_number() OVER (PARTITION BY kind ORDER BY s DESC NULLS LAST, id) <= 20""",
    "tool_lists": f"""WITH {ITEMS_SQL} SELECT 'recent' AS list, id FROM (SELECT {_HEX} AS id FROM documents ORDER BY doc_id * 37 % 1009 DESC, 1 LIMIT 30)
        UNION ALL SELECT 'inbox', id FROM (SELECT id FROM items ORDER BY published_s DESC NULLS LAST, id LIMIT 20)""",
    "guarded_calls": """WITH c AS (SELECT *, CASE WHEN event_type <> 'error' THEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) ELSE 1 END AS nth,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        s AS (SELECT user_id, min(k) AS stop FROM c WHERE nth = 12 OR k = 300 GROUP BY user_id),
        o AS (SELECT c.*, CASE WHEN k = stop THEN 'stopped' WHEN k > stop THEN 'ended' WHEN nth > 2 OR k > 250 THEN 'refused' ELSE 'answered' END AS outcome FROM c LEFT JOIN s USING (user_id))
        SELECT user_id, outcome, count(*) AS n, min(event_id) AS first FROM o GROUP BY ALL""",
}
