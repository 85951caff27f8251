"""Operators over ordered event traces: wraps, gaps, last known states, reruns, edit cycles, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(df: DataFrame, key: str, order: list[str], resets: Column) -> DataFrame:
    """``df`` with segment: how many resets a key has had up to and with each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("segment", F.sum(resets.cast("int")).over(w))


def wraps(df: DataFrame, key: str, order: list[str], value: str, resets: Column) -> DataFrame:
    """(key, segment, wraps): how often the value falls from one row to the next, zeros skipped, within a segment."""
    rows = segments(df, key, order, resets).where(F.col(value) != 0)
    before = F.lag(value).over(Window.partitionBy(key, "segment").orderBy(*order))
    return rows.withColumn("_fell", (F.col(value) < before).cast("int")).groupBy(key, "segment").agg(F.coalesce(F.sum("_fell"), F.lit(0)).alias("wraps"))


def last_known(df: DataFrame, key: str, order: list[str], state: Column, resets: Column, name: str) -> DataFrame:
    """``df`` with the last non-null state since the last reset."""
    w = Window.partitionBy(key, "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return segments(df, key, order, resets).withColumn(name, F.last(state, True).over(w)).drop("segment")


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    rest = F.struct(*order, F.struct(*df.columns).alias("_row"))
    return df.groupBy(F.col(key).alias("_key")).agg(F.max(rest).alias("_best")).select("_best._row.*")


def sessions(df: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """``df`` with session: a row opens one if it comes more than the gap after the row before."""
    w = Window.partitionBy(key).orderBy(time)
    apart = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    opens = F.when(apart <= gap_seconds * 1_000_000, 0).otherwise(1)
    return df.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_opens")
