"""Queries that run as Structured Streaming over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.plans.config import BatchLimits
from voxloom.plans.registry import query
from voxloom.streaming import pipeline

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.read_stream(spark, d, "events.parquet", EVENTS)


@query("""
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOURS FROM events)""")
def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of the windows that the watermark has closed."""
    made = pipeline.run_to_table(pipeline.windowed_counts(_events(spark, d), "ts", "1 hour", "2 hours", ["event_type"]), spark)
    return made.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """One delivery of every (user, type); the state of a key is dropped 30 days behind the newest event."""
    rows = pipeline.first_deliveries(_events(spark, d), "ts", "30 days", "user_id", "event_type")
    return pipeline.run_to_table(rows.select("user_id", "event_type"), spark)


@query("""WITH RECURSIVE o AS (SELECT event_type, event_id::VARCHAR AS uid, length(props)::BIGINT AS c, row_number() OVER (PARTITION BY event_type ORDER BY event_id::VARCHAR) AS rn FROM events),
f AS (SELECT event_type, rn, uid, c AS widest, 1 AS held, 0 AS batch FROM o WHERE rn = 1 UNION ALL
  SELECT o.event_type, o.rn, o.uid, CASE WHEN s.fresh THEN o.c ELSE greatest(f.widest, o.c) END, CASE WHEN s.fresh THEN 1 ELSE f.held + 1 END, CASE WHEN s.fresh THEN f.batch + 1 ELSE f.batch END
  FROM f JOIN o ON o.event_type = f.event_type AND o.rn = f.rn + 1, LATERAL (SELECT f.held >= 16 OR (f.held + 1) * greatest(f.widest, o.c) > 200 AS fresh) s)
SELECT event_type, batch::BIGINT AS batch, uid FROM f WHERE batch < (SELECT max(g.batch) FROM f g WHERE g.event_type = f.event_type)""")
def stream_batches(spark: SparkSession, d: str) -> DataFrame:
    """Closed batches of a live stream with one open batch per event type in the state."""
    rows = _events(spark, d).select("event_type", F.col("event_id").cast("string").alias("uid"), F.length("props").cast("bigint").alias("cost"))
    made = pipeline.live_batches(rows, "event_type", "uid", ["cost"], BatchLimits(max_cost=200, max_samples=16))
    return pipeline.run_to_table(made, spark)
