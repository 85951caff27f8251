"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.lineage import cut, shared_dir

__all__ = ["cut", "n_blocks", "shared_dir", "written"]

#: Spark's setting that drops a query's shuffle files at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What a block of documents holds at most, on average.
BLOCK_ROWS, BLOCK_BYTES = 1 << 10, 4 << 20
#: Small row groups, as writers hold one for each task.
ROW_GROUP = 16 << 20


def n_blocks(df: DataFrame, text: str) -> int:
    """How many blocks ``df`` is dealt out to, by its rows and by the bytes of its texts."""
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    return max(1, -(-rows // BLOCK_ROWS), -(-(size or 0) // BLOCK_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; its shuffle files go when it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)
