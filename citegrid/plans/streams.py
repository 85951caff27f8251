"""Streaming queries over the events table; their SQL is the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.streaming import logs


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.read(spark, sf_dir, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts that come twice count once."""
    events = _events(spark, sf_dir).select("event_id", "ts", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    once = logs.once(events, "event_id", "ts", "10 minutes").select("event_id", "event_type")
    return logs.run_to_table(once, "receipts").groupBy("event_type").agg(F.count("*").alias("receipts"))


STREAM_RECEIPTS = "SELECT event_type, count(DISTINCT event_id) AS receipts FROM events GROUP BY 1"


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.run_to_table(logs.tumbling(_events(spark, sf_dir), "ts", "6 hours", "10 minutes", "event_type"), "windows")
    return rows.select(F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begin"), "event_type", "n")


STREAM_WINDOWS = """
SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS begin, event_type, count(*) AS n FROM events
WHERE time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2"""


def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).where("event_type IN ('error', 'purchase')")
    rows = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("ident"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("failed"))
    return logs.run_to_table(logs.clean_again(rows), "transitions").select(F.col("key").alias("user_id"), F.col("ident").alias("event_id"))


STREAM_TRANSITIONS = """
SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type IN ('error', 'purchase'))
WHERE event_type = 'purchase' AND before = 'error'"""


def stream_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors within two hours after a signup of the same user."""
    events = _events(spark, sf_dir)
    errors = events.where("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("event_id").alias("access"), F.col("ts").alias("at"))
    opens = _events(spark, sf_dir).where("event_type = 'signup'")
    opens = opens.select(F.col("user_id").alias("key"), F.col("event_id").alias("window"), F.col("ts").alias("begin"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end"))
    found = logs.run_to_table(logs.inside(errors, opens, "10 minutes"), "inside")
    return found.select(F.col("key").alias("user_id"), F.col("access").alias("event_id"), F.col("window").alias("signup_id"))


STREAM_INSIDE = """
SELECT e.user_id, e.event_id, s.event_id AS signup_id FROM events e JOIN events s ON s.user_id = e.user_id AND s.event_type = 'signup' AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 2 HOUR
WHERE e.event_type = 'error'"""

QUERIES = {f.__name__: f for f in (stream_receipts, stream_windows, stream_transitions, stream_inside)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
