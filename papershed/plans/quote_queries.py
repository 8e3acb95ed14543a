"""Queries on quotes: where they were captured and where they lie in texts that changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from papershed.operators import quotes as Q
from papershed.sources.tables import read


def _captured(spark, sf_dir):
    """A stored quote of 60 code points from the second third of every text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at = F.floor(F.char_length("text") / 3)
    return Q.captures(docs.select(F.col("doc_id").alias("quote_id"), F.col("doc_id").alias("text_id"), "text", at.alias("start"), F.lit(60).alias("length")))


def _changed(spark, sf_dir):
    """Every text as it is found later: the same, without its first 100 code points, or after a copy of itself."""
    text = F.coalesce("text", F.lit(""))
    later = F.when(F.col("doc_id") % 3 == 0, text).when(F.col("doc_id") % 3 == 1, F.substr(text, F.lit(101))).otherwise(F.concat(text, F.lit(" * "), text))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), later.alias("text"))


def captured_quotes(spark, sf_dir):
    return _captured(spark, sf_dir)


def placed_quotes(spark, sf_dir):
    """Exact places of stored quotes in texts that were cut or doubled."""
    found = Q.placed(_captured(spark, sf_dir), _changed(spark, sf_dir))
    return found.filter("match = 'exact'").select("quote_id", "start", "end")


def approximate_quotes(spark, sf_dir):
    """Places of stored quotes in texts of which every letter before an "s" reads "e"; most quotes no longer stand there as they were."""
    edited = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\pL(?=s)", "e").alias("text"))
    return Q.placed(_captured(spark, sf_dir), edited)


def misquoted_passages(spark, sf_dir):
    """Texts that hold a benchmark passage with up to an edit in eight characters: each passage has a letter changed in every 40."""
    plain = Q.squashed(F.col("text"))
    wrong = F.regexp_replace(plain, r"(?s)(.{39}).", "$1~")
    quotes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), wrong.alias("text"))
    return Q.approximate_anchors(quotes, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"))


def quote_anchors(spark, sf_dir):
    quotes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    return Q.anchors(quotes, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"))


QUERIES = {f.__name__: f for f in (captured_quotes, placed_quotes, approximate_quotes, misquoted_passages, quote_anchors)}

CAPTURED_SQL = r"""
    s AS (SELECT doc_id, text, length(text) // 3 AS begin FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    b AS (SELECT doc_id, text, regexp_replace(substr(text, begin + 1, 60), '\s+', '', 'g') AS quote,
                 regexp_replace(substr(text, 1, begin), '\s+', '', 'g') AS before, regexp_replace(substr(text, begin + 61), '\s+', '', 'g') AS after FROM s),
    q AS (SELECT doc_id AS quote_id, doc_id AS text_id, text, quote, CAST((length(before) - length(replace(before, quote, ''))) // length(quote) AS INTEGER) AS occurrence,
                 CAST(length(before) AS INTEGER) AS position, right(before, 32) AS prefix, left(after, 32) AS suffix FROM b WHERE quote <> '')"""
ORACLE_SQL = {
    "captured_quotes": f"WITH {CAPTURED_SQL} SELECT quote_id, text_id, quote, occurrence, position, prefix, suffix FROM q",
    "placed_quotes": rf"""WITH {CAPTURED_SQL},
        t AS (SELECT *, regexp_replace(CASE quote_id % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 101) ELSE text || ' * ' || text END, '\s+', '', 'g') AS p FROM q),
        parts AS (SELECT *, string_split(p, quote) AS pieces FROM t WHERE contains(p, quote)),
        places AS (SELECT quote_id, quote, occurrence, prefix, suffix, p, i, CAST(list_sum(list_transform(pieces[1 : i + 1], lambda x: length(x))) + i * length(quote) AS INTEGER) AS start
                   FROM (SELECT *, unnest(range(0, len(pieces) - 1)) AS i FROM parts)),
        fit AS (SELECT *, i = occurrence AS stored, substr(p, greatest(0, start - length(prefix)) + 1, least(start, length(prefix))) = prefix
                       AND substr(p, start + length(quote) + 1, length(suffix)) = suffix AS agrees FROM places),
        best AS (SELECT *, bool_or(stored) OVER (PARTITION BY quote_id) AS any_stored, count(*) FILTER (agrees) OVER (PARTITION BY quote_id) AS n_agree FROM fit)
        SELECT quote_id, start, CAST(start + length(quote) AS INTEGER) AS "end" FROM best WHERE stored OR (NOT any_stored AND agrees AND n_agree = 1)""",
    "quote_anchors": """WITH q AS (SELECT item_id AS quote_id, regexp_replace(text, '\\s+', '', 'g') AS q FROM benchmark),
        t AS (SELECT doc_id AS text_id, regexp_replace(text, '\\s+', '', 'g') AS p FROM documents)
        SELECT quote_id, text_id, CAST(strpos(p, q) - 1 AS INTEGER) AS position, CAST((length(p) - length(replace(p, q, ''))) // length(q) AS BIGINT) AS n
        FROM q JOIN t ON contains(p, q) WHERE q <> ''""",
}
