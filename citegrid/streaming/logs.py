"""Append-only logs as streams: receipts seen once, transitions, windows, and accesses inside command windows.

Each operator takes and returns a streaming (or batch) DataFrame; ``run_to_table`` drives a stream over what is there
now into Parquet files of the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citegrid.lineage import shared_dir

TRANSITIONS = "key bigint, ident bigint, at timestamp"


def read(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """The table ``file`` of ``folder``, one Parquet file or a folder of part files, as a stream."""
    schema = spark.read.parquet(f"{folder}/{file}").schema
    # A stream takes a single file only by a glob.
    return spark.readStream.schema(schema).parquet(f"{folder}/{file[:-1]}[{file[-1]}]")


def once(df: DataFrame, ident: str, time: str, late: str) -> DataFrame:
    """Each receipt once, if its copies come within ``late``."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([ident])


def tumbling(df: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts of closed windows."""
    rows = df.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("begin"), *keys, "n")


def _clean_again(key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failing = bool(state.get[0]) if state.exists else False
    rows = pd.concat(list(batches)).sort_values(["at", "ident"])
    out = []
    for ident, at, failed in zip(rows["ident"], rows["at"], rows["failed"], strict=True):
        if failing and not failed:
            out.append((key[0], ident, at))
        failing = bool(failed)
    state.update((failing,))
    yield pd.DataFrame(out, columns=["key", "ident", "at"])


def clean_again(df: DataFrame) -> DataFrame:
    """(key, ident, at) of each clean run whose last run failed, of (key, ident, at, failed); the last status is the state."""
    return df.groupBy("key").applyInPandasWithState(_clean_again, TRANSITIONS, "failing boolean", "append", GroupStateTimeout.NoTimeout)


def inside(accesses: DataFrame, windows: DataFrame, late: str, longest: str = "1 day") -> DataFrame:
    """(key, access, window): accesses (key, access, at) inside windows (key, window, begin, end), the end included.

    ``longest`` says how long a window's state is kept; a window that lasts longer fails the stream.
    """
    left = accesses.withWatermark("at", late).select(F.col("key").alias("k"), "access", "at")
    last = F.col("begin") + F.expr(f"INTERVAL {longest}")
    too_long = F.raise_error(F.concat(F.lit(f"a window is longer than {longest}: "), F.col("window").cast("string")))
    right = windows.withColumn("end", F.when(F.col("end") > last, too_long).otherwise(F.col("end"))).withWatermark("begin", late)
    span = F.expr(f"k = key AND at >= begin AND at <= end AND at <= begin + INTERVAL {longest}")
    return left.join(right, span).select("key", "access", "window")


def run_to_table(df: DataFrame, name: str) -> DataFrame:
    """Runs the stream over what is there now, and reads what it wrote."""
    spark = df.sparkSession
    home = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{home}/out")
