"""Batch runs of the streaming operators over the event table: the same plans that a stream runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.plans import views
from driftmark.plans.base import register
from driftmark.plans.q_tracks import r6
from driftmark.streaming import live


def _events(spark, d):
    e = views.table(spark, d, "events")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 20).alias("video_id"), F.col("value").alias("step"), F.col("event_id").alias("frame_idx"))


@register("live_activity", """SELECT video_id, b AS window_start, round(sum(value), 6) AS distance, count(*) AS frames FROM (SELECT user_id % 20 AS video_id, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts) - INTERVAL 2 DAY]) AS b FROM events) GROUP BY 1, 2""")
def live_activity(spark, d):
    return r6(live.activity(_events(spark, d), ("video_id",), length="3 days", slide="1 day")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("live_coverage", "SELECT user_id % 20 AS video_id, date_trunc('hour', ts) AS window_start, count(*) AS frames, max(event_id) AS last_frame FROM events GROUP BY 1, 2")
def live_coverage(spark, d):
    return live.coverage(_events(spark, d), ("video_id",), length="1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("live_sessions", """WITH g AS (SELECT user_id % 20 AS video_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id % 20 ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY ts) AS k FROM g)
SELECT video_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS frames FROM s GROUP BY video_id, k""")
def live_sessions(spark, d):
    out = live.sessions(_events(spark, d), ("video_id",), gap="1 hour")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
