"""The library's tables, derived from the tables at hand.

Documents stand for collected items and materials, their ``source`` for subscriptions, pages for
captures, events for the reading log and conversations for agent sessions. Times are seconds
since 1970 in UTC. What the tables lack (decisions, publication times) follows from the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200  # 2024-01-01T00:00:00Z
NOW = EPOCH + 60 * 86400


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(n: int, rest: int, seconds: int):
    """A time for ids with that remainder, else null."""
    return F.when(F.col("doc_id") % n == rest, F.lit(EPOCH + seconds) + F.col("doc_id") % 5000).cast("long")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their decision times; ``id`` is 16 hex digits of the hash of source, NUL and external id."""
    return items_of(read(spark, sf_dir, "documents"))


def items_of(documents: DataFrame) -> DataFrame:
    """The items of documents that may be filtered already, so that one scan is enough."""
    return documents.select(
        F.substring(F.sha2(F.concat("source", F.char(F.lit(0)), F.col("doc_id").cast("string")), 256), 1, 16).alias("id"),
        "doc_id",
        F.col("source").alias("source_id"),
        F.substring(F.regexp_replace("text", r"\s+", " "), 1, 60).alias("title"),
        "lang",
        "n_chars",
        F.when(F.col("doc_id") % 11 != 0, F.lit(EPOCH) + F.col("doc_id") % 60 * 86400 + F.col("doc_id") % 1440 * 60).cast("long").alias("published_s"),
        (F.lit(EPOCH + 100) + F.col("doc_id") % 1000 * 60).cast("long").alias("fetched_s"),
        _every(7, 0, 1000).alias("queued_s"),
        F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") % 97).cast("long").alias("queue_position"),
        _every(5, 1, 2000).alias("dismissed_s"),
        _every(3, 0, 3000).alias("opened_s"),
        _every(4, 2, 4000).alias("kept_s"),
        _every(6, 0, 9000).alias("finished_s"),
    )


ITEMS_SQL = f"""
    items AS (
      SELECT substr(sha256(source || chr(0) || CAST(doc_id AS VARCHAR)), 1, 16) AS id, doc_id, source AS source_id,
             substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 60) AS title, lang, n_chars,
             CAST(CASE WHEN doc_id % 11 <> 0 THEN {EPOCH} + doc_id % 60 * 86400 + doc_id % 1440 * 60 END AS BIGINT) AS published_s,
             CAST({EPOCH + 100} + doc_id % 1000 * 60 AS BIGINT) AS fetched_s,
             CAST(CASE WHEN doc_id % 7 = 0 THEN {EPOCH + 1000} + doc_id % 5000 END AS BIGINT) AS queued_s,
             CAST(CASE WHEN doc_id % 7 = 0 THEN doc_id % 97 END AS BIGINT) AS queue_position,
             CAST(CASE WHEN doc_id % 5 = 1 THEN {EPOCH + 2000} + doc_id % 5000 END AS BIGINT) AS dismissed_s,
             CAST(CASE WHEN doc_id % 3 = 0 THEN {EPOCH + 3000} + doc_id % 5000 END AS BIGINT) AS opened_s,
             CAST(CASE WHEN doc_id % 4 = 2 THEN {EPOCH + 4000} + doc_id % 5000 END AS BIGINT) AS kept_s,
             CAST(CASE WHEN doc_id % 6 = 0 THEN {EPOCH + 9000} + doc_id % 5000 END AS BIGINT) AS finished_s
      FROM documents)"""


def reading_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only log: ``id, kind, ref, at``."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("ref"), F.col("ts").alias("at")
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged cases: a slug with a verdict rank for each layer (0 pass, 1 minor, 2 major)."""
    return read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("slug"),
        (F.lit(1) - F.col("quality") + F.col("toxic")).cast("int").alias("content"),
        F.col("toxic").cast("int").alias("metadata"),
        F.when(F.col("doc_id") % 4 != 0, F.lit(1) - F.col("quality")).cast("int").alias("rendering"),
    )


CASES_SQL = """
    cases AS (
      SELECT doc_id AS slug, CAST(1 - quality + toxic AS INTEGER) AS content, CAST(toxic AS INTEGER) AS metadata,
             CAST(CASE WHEN doc_id % 4 <> 0 THEN 1 - quality END AS INTEGER) AS rendering FROM labels)"""

KINDS = ("missing_content", "noise", "order", "metadata_wrong", "broken_image")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of two opinions of each case: slug, opinion, layer, kind, severity, refs, ord."""
    labels = read(spark, sf_dir, "labels")
    several = labels.select("doc_id", "quality", "toxic", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int"))).alias("ord"))
    both = several.select("*", F.explode(F.array(F.lit("screen"), F.lit("confirm"))).alias("opinion"))
    number = F.col("doc_id") * 7 + F.col("ord") * 3 + F.when(F.col("opinion") == "confirm", F.col("ord") % 2).otherwise(0)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return both.select(
        F.col("doc_id").alias("slug"),
        "opinion",
        F.when(number % 5 == 3, "metadata").when(number % 5 == 4, "rendering").otherwise("content").alias("layer"),
        F.get(kinds, (number % 5).cast("int")).alias("kind"),
        F.when((number + F.col("toxic")) % 3 == 0, "major").otherwise("minor").alias("severity"),
        F.concat(F.lit("p"), (number % 6).cast("string")).alias("ref"),
        "ord",
    )


ISSUES_SQL = """
    several AS (SELECT doc_id, quality, toxic, CAST(unnest(range(0, doc_id % 4 + 1)) AS INTEGER) AS ord FROM labels),
    bothops AS (SELECT *, doc_id * 7 + ord * 3 + CASE WHEN opinion = 'confirm' THEN ord % 2 ELSE 0 END AS number
                FROM several, (VALUES ('screen'), ('confirm')) AS o(opinion)),
    issues AS (
      SELECT doc_id AS slug, opinion,
             CASE number % 5 WHEN 3 THEN 'metadata' WHEN 4 THEN 'rendering' ELSE 'content' END AS layer,
             ['missing_content', 'noise', 'order', 'metadata_wrong', 'broken_image'][number % 5 + 1] AS kind,
             CASE WHEN (number + toxic) % 3 = 0 THEN 'major' ELSE 'minor' END AS severity,
             'p' || CAST(number % 6 AS VARCHAR) AS ref, ord FROM bothops)"""
