"""Streaming queries, run over the tables until they are used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from papershed.streaming import library as S
from papershed.streaming import stateful as T


def streamed_weeks(spark, sf_dir):
    """Weekly counts; the last weeks stay open until later events close them."""
    weeks = S.drained(spark, S.weekly_counts(S.events(spark, sf_dir)))
    return weeks.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "event_type", "n")


def streamed_bursts(spark, sf_dir):
    rows = S.drained(spark, S.bursts(S.events(spark, sf_dir)))
    return rows.select("user_id", F.unix_timestamp("start").alias("start_s"), "n")


def streamed_first_seen(spark, sf_dir):
    return S.drained(spark, S.first_seen(S.events(spark, sf_dir)))


STICKS = {"view": "opened", "purchase": "kept", "error": "dismissed"}
INTERVAL_MS = 6 * 3_600_000


def _log(spark, sf_dir):
    """Events as a log: the user stands for an item, a source or a session."""
    return S.events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", F.col("event_type").alias("kind"), F.col("event_id").alias("id"))


def streamed_decisions(spark, sf_dir):
    """The decision on each item after its events so far: first times stick, a signup clears an earlier click."""
    return T.latest(S.drained(spark, T.decisions(_log(spark, sf_dir), STICKS, "click", "signup")))


def streamed_runs(spark, sf_dir):
    """Runs of equal events of a user, each once it has ended."""
    return S.drained(spark, T.runs(_log(spark, sf_dir)))


def streamed_polls(spark, sf_dir):
    """When a source became due, six hours after a sync; an error pauses it until the next sync."""
    return S.drained(spark, T.polls(_log(spark, sf_dir), INTERVAL_MS, "error"))


QUERIES = {f.__name__: f for f in (streamed_weeks, streamed_bursts, streamed_first_seen, streamed_decisions, streamed_runs, streamed_polls)}

_LOG = """log AS (SELECT user_id AS key, ts, event_type AS kind, event_id AS id FROM events WHERE epoch_us(ts) // 1000 < (SELECT epoch_us(max(ts)) // 1000 - 2 * 86400000 FROM events))"""
ORACLE_SQL = {
    "streamed_decisions": f"""WITH {_LOG}, f AS (SELECT key, min(epoch_us(ts) // 1000000) FILTER (kind = 'view') AS opened, min(epoch_us(ts) // 1000000) FILTER (kind = 'purchase') AS kept,
          min(epoch_us(ts) // 1000000) FILTER (kind = 'error') AS dismissed, max((ts, id)) FILTER (kind = 'signup') AS cleared FROM log GROUP BY key HAVING count(*) FILTER (kind <> 'signup') > 0),
        q AS (SELECT key, min(epoch_us(ts) // 1000000) AS queued FROM log JOIN f USING (key) WHERE kind = 'click' AND (cleared IS NULL OR (ts, id) > cleared) GROUP BY key)
        SELECT key, opened, kept, dismissed, queued FROM f LEFT JOIN q USING (key)""",
    "streamed_runs": f"""WITH {_LOG}, c AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS new FROM log WINDOW w AS (PARTITION BY key ORDER BY ts, id)),
        r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY key ORDER BY ts, id) AS BIGINT) AS run FROM c), g AS (SELECT key, run, kind, arg_min(id, (ts, id)) AS first, count(*) AS n FROM r GROUP BY key, run, kind)
        SELECT * FROM g QUALIFY run < max(run) OVER (PARTITION BY key)""",
    "streamed_polls": f"""WITH {_LOG}, l AS (SELECT *, epoch_us(ts) // 1000 + {INTERVAL_MS} AS due_ms, coalesce(epoch_us(lead(ts) OVER (PARTITION BY key ORDER BY ts, id)) // 1000, (SELECT epoch_us(max(ts)) // 1000 - 2 * 86400000 FROM events)) AS ends FROM log)
        SELECT key, due_ms FROM l WHERE kind <> 'error' AND due_ms < ends""",
    "streamed_weeks": """WITH m AS (SELECT max(ts) - INTERVAL 2 DAYS AS m FROM events)
        SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n FROM events, m GROUP BY ALL
        HAVING any_value(date_trunc('week', ts)) + INTERVAL 7 DAYS <= any_value(m)""",
    "streamed_bursts": """WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
        s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 60 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e),
        b AS (SELECT user_id, min(ts) AS a, max(ts) AS z, count(*) AS n FROM s GROUP BY user_id, g)
        SELECT user_id, CAST(floor(epoch(a)) AS BIGINT) AS start_s, n FROM b WHERE z + INTERVAL 60 MINUTES <= (SELECT max(ts) - INTERVAL 2 HOURS FROM events)""",
    "streamed_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
}
