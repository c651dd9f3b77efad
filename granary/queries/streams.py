"""Queries of streaming/events.py, run on the whole table at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.queries.base import query
from granary.streaming import events as S


@query("st_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(t):
    return S.tumbling(t.events, "1 hour").withColumn("total", F.round("total", 4))


@query("st_sliding", "SELECT time_bucket(INTERVAL '30 minutes', ts) - i * INTERVAL '30 minutes' AS start, event_type, count(*) AS n FROM events, range(2) r(i) GROUP BY 1, 2")
def sliding(t):
    return S.sliding(t.events, "1 hour", "30 minutes")


@query(
    "st_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS \"end\", count(*) AS n FROM s GROUP BY user_id, s",
)
def sessions(t):
    return S.sessions(t.events, "6 hours")
