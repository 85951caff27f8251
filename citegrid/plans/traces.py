"""Ordered queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegrid.operators import ordered
from citegrid.tables import table

ORDER = ["ts", "event_id"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long").alias("cents")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", cents)


E = "(SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


def segment_wraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.wraps(_events(spark, sf_dir), "user_id", ORDER, "cents", F.col("event_type") == "signup")


SEGMENT_WRAPS = f"""
WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM {E}),
f AS (SELECT user_id, segment, CASE WHEN cents < lag(cents) OVER (PARTITION BY user_id, segment ORDER BY ts, event_id) THEN 1 ELSE 0 END AS fell FROM s WHERE cents <> 0)
SELECT user_id, CAST(segment AS BIGINT) AS segment, CAST(sum(fell) AS BIGINT) AS wraps FROM f GROUP BY 1, 2"""


def reset_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microseconds from each error to the user's next event."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = _events(spark, sf_dir).withColumn("gap_us", F.lead(at).over(w) - at)
    return rows.where("event_type = 'error'").select("event_id", "gap_us")


RESET_GAPS = f"""
SELECT event_id, gap_us FROM (SELECT event_id, event_type, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap_us FROM {E}) WHERE event_type = 'error'"""


def state_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the user's last purchase since the last signup, at each event."""
    state = F.when(F.col("event_type") == "purchase", F.col("cents"))
    rows = ordered.last_known(_events(spark, sf_dir), "user_id", ORDER, state, F.col("event_type") == "signup", "last_purchase")
    return rows.select("event_id", "last_purchase")


STATE_AT_EVENT = f"""
WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM {E})
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN cents END IGNORE NULLS) OVER (PARTITION BY user_id, segment ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM s"""


def noop_reruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that repeat the user's last one: the same type, and the value in the same tenth."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    key = F.concat_ws("/", "event_type", F.floor(F.col("cents") / 1000).cast("string"))
    rows = _events(spark, sf_dir).withColumn("again", F.lag(key).over(w) == key)
    return rows.groupBy("user_id").agg(F.count("*").alias("runs"), F.count_if("again").alias("noops"))


NOOP_RERUNS = f"""
WITH k AS (SELECT *, event_type || '/' || CAST(floor(cents / 1000) AS BIGINT) AS key FROM {E}),
a AS (SELECT user_id, key = lag(key) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS again FROM k)
SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE again) AS noops FROM a GROUP BY 1"""


def edit_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a user's first error to the first purchase after it: events and distinct values on the way."""
    rows = _events(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("failed", F.max((F.col("event_type") == "error").cast("int")).over(w) == 1)
    rows = rows.withColumn("cleaned", F.sum((F.col("failed") & (F.col("event_type") == "purchase")).cast("int")).over(w))
    inside = rows.where("failed AND cleaned = 0")
    done = rows.groupBy("user_id").agg(F.max("cleaned").alias("done")).where("done > 0").select("user_id")
    return inside.join(done, "user_id").groupBy("user_id").agg(F.count("*").alias("steps"), F.countDistinct("cents").alias("edits"))


EDIT_CYCLES = f"""
WITH r AS (SELECT *, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w = 1 AS failed FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, sum(CASE WHEN failed AND event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cleaned FROM r)
SELECT user_id, count(*) AS steps, count(DISTINCT cents) AS edits FROM c WHERE failed AND cleaned = 0 AND user_id IN (SELECT user_id FROM c WHERE cleaned > 0) GROUP BY 1"""


def session_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.sessions(_events(spark, sf_dir), "user_id", "ts", 1800)
    counts = [F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in ("click", "error", "purchase")]
    return rows.groupBy("user_id", "session").agg(F.min("ts").cast("string").alias("first_ts"), F.count("*").alias("n"), *counts)


SESSION_PHASES = f"""
WITH o AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM {E}),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM o)
SELECT user_id, CAST(session AS BIGINT) AS session, CAST(min(ts) AS VARCHAR) AS first_ts, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS n_click,
count(*) FILTER (WHERE event_type = 'error') AS n_error, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase FROM s GROUP BY 1, 2"""


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event, and whether it is at most seven days older than the table's."""
    events = _events(spark, sf_dir)
    last = ordered.latest(events, "user_id", [F.col("ts"), F.col("event_id")])
    newest = events.agg(F.max("ts")).scalar()
    fresh = F.col("ts") >= newest - F.expr("INTERVAL 7 DAYS")
    return last.select("user_id", "event_id", "event_type", fresh.alias("fresh"))


LATEST_SNAPSHOT = f"""
SELECT user_id, event_id, event_type, ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS fresh FROM {E} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""

QUERIES = {f.__name__: f for f in (segment_wraps, reset_gaps, state_at_event, noop_reruns, edit_cycles, session_phases, latest_snapshot)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
