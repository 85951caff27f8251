from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from citegrid.plans import streams
from citegrid.streaming import logs


@pytest.mark.parametrize("parts", [1, 5])
def test_tables_of_many_part_files(spark, sf_dir, tmp_path, parts):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(parts).write.parquet(f"{tmp_path}/events.parquet")
    want = {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}
    assert {r.event_type: r.receipts for r in streams.stream_receipts(spark, str(tmp_path)).collect()} == want


def _logs(spark, tmp_path, hours):
    home = f"{tmp_path}/{hours}"
    spark.sql("SELECT 1L AS key, 10L AS access, TIMESTAMP '2024-01-02 12:00:00' AS at").write.parquet(f"{home}/accesses.parquet")
    rows = spark.sql("SELECT 1L AS key, 20L AS window, TIMESTAMP '2024-01-01 00:00:00' AS begin")
    rows.withColumn("end", F.col("begin") + F.expr(f"INTERVAL {hours} HOURS")).write.parquet(f"{home}/windows.parquet")
    return logs.read(spark, home, "accesses.parquet"), logs.read(spark, home, "windows.parquet")


def test_windows_longer_than_a_day(spark, tmp_path):
    found = logs.run_to_table(logs.inside(*_logs(spark, tmp_path, 40), "10 minutes", "2 days"), "inside")
    assert [tuple(r) for r in found.collect()] == [(1, 10, 20)]
    with pytest.raises(Exception, match="a window is longer than 1 day: 20"):
        logs.run_to_table(logs.inside(*_logs(spark, tmp_path, 41), "10 minutes"), "inside")
