"""Positions and prefix sums within groups of any size.

Rows are dealt out by ranges of (group, order), so a group of a third of all rows fills many partitions. Each partition
counts what it holds of a group; what stands before it in the same group is added from a table of the groups that more
than one partition holds. Each end of a partition splits one group at most, so that table has at most two rows a
partition and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.llm import shared

PART = "_part"


def ranged(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` written in ranges of (group, order), with its partition as ``_part``. Rows alike in all of these are dealt out too."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.withColumn("_spread", F.monotonically_increasing_id())
    parts = spread.repartitionByRange(n, group, *order, "_spread").withColumn(PART, F.spark_partition_id())
    return shared.written(parts.drop("_spread"), name)


def before(parts: DataFrame, group: str, sums: dict[str, Column], heads: dict[str, Column] | None = None) -> DataFrame:
    """(group, _part, a column of each name) for the groups in several partitions: sums over earlier partitions, least values over all."""
    heads = heads or {}
    totals = parts.groupBy(group, PART).agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.min(c).alias(n) for n, c in heads.items()])
    own = Window.partitionBy(group)
    earlier = own.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    split = totals.withColumn("_held", F.count("*").over(own))
    split = split.select(group, PART, "_held", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums], *[F.min(n).over(own).alias(n) for n in heads])
    return split.where("_held > 1").drop("_held")


def joined(rows: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """``rows`` with the columns that ``before`` found, null for groups in one partition."""
    right = found.withColumnsRenamed({group: "_group", PART: "_other"})
    return rows.join(F.broadcast(right), rows[group].eqNullSafe(right["_group"]) & (rows[PART] == right["_other"]), "left").drop("_group", "_other")
