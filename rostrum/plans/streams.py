"""Streaming-style behaviour over events; batch SQL is the oracle of the streams' complete mode."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.plans.registry import query
from rostrum.streaming import windows as S


def _events(t):
    return t("events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(t):
    """The same rows as a stream: one micro-batch per file."""
    e = t("events")
    folder = e.inputFiles()[0].rsplit("/", 1)
    reader = e.sparkSession.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet" if folder[1] == "events.parquet" else "*.parquet")
    return reader.parquet(folder[0]).withColumn("ts", F.col("ts").cast("timestamp"))


@query("X1_rate_limit", """
SELECT event_id, user_id, n FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 2""")
def rate_limit(t):
    return S.over_limit(t("events"), "user_id", "event_id", 21_600, 2)


@query("X3_rolling_refusals", """
SELECT event_id, event_type, n FROM (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 6""")
def rolling_refusals(t):
    return S.over_limit(t("events"), "event_type", "event_id", 3_600, 6)


@query("X4_late_revisions", """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 21 DAY) WHERE rn = 1""")
def late_revisions(t):
    recent = t("events").filter(F.col("ts") >= F.expr("timestamp_ntz '2024-01-30' - interval 21 days"))
    return S.latest(recent.select("user_id", "event_id", "value"), "user_id", "event_id")


@query("X10_tumbling_stream", """
SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling(t):
    return S.drain(S.counts(_stream(t), "event_type", "1 day")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("X10_session_stream", """
SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""")
def session(t):
    return S.sessions(_events(t), "user_id", "4 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("X2_tracked_bound", """
SELECT user_id FROM (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1) ORDER BY seen DESC, user_id LIMIT 100""")
def tracked_bound(t):
    seen = t("events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    return seen.orderBy(F.desc("seen"), "user_id").limit(100).select("user_id")


@query("Z42_limiter_state", """
SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-29 12:00:00') AS accepted, count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-29 12:00:00') AS tracked FROM events""")
def limiter_state(t):
    recent = F.col("ts") >= F.expr("timestamp_ntz '2024-01-29 12:00:00'")
    return t("events").agg(F.count_if(recent).alias("accepted"), F.countDistinct(F.when(recent, F.col("user_id"))).alias("tracked"))
