"""Tallies over closed domains, pass rates as exact fractions, cross-tabs, persistence and recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tally(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """(column, n) for each value of a closed domain, zeros included; other values aren't counted."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return F.broadcast(values).join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def pass_rates(df: DataFrame, levels: Sequence[str], passed: Column) -> DataFrame:
    """(levels, n, passed, rate) rolled up; rate is text without decimals, half to even, or n/a."""
    rows = df.rollup(*levels).agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"))
    rate = F.when(F.col("n") == 0, "n/a").otherwise(F.concat(F.bround(F.col("passed").cast("decimal(20,0)") * 100 / F.col("n"), 0).cast("long").cast("string"), F.lit("%")))
    return rows.withColumn("rate", rate)


def crosstab(df: DataFrame, row: str, column: str, domain: Sequence[str]) -> DataFrame:
    """A column of counts for each value of the closed domain."""
    out = df.groupBy(row).pivot(column, list(domain)).count()
    return out.select(row, *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in domain])


def persistence(df: DataFrame, keys: Sequence[str], receipt: str, value: str, order: Sequence[str]) -> DataFrame:
    """How often a finding occurs, in how many receipts, with its sorted values and the value seen first."""
    first = F.min(F.struct(*order, value))[value]
    return df.groupBy(*keys).agg(
        F.count("*").alias("occurrences"), F.countDistinct(receipt).alias("receipts"), F.concat_ws(",", F.array_sort(F.collect_set(value))).alias("values"), first.alias("first_value")
    )


def batch(df: DataFrame, key: str, order: Sequence[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key in order, with their place and how many rows more there are."""
    first = df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= cap)
    more = df.groupBy(key).agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("more"))  # apart, so that tasks rank with a limit
    return first.join(more, first[key].eqNullSafe(more[key])).drop(more[key])


def recall(found: Column, wanted: Column) -> tuple[Column, Column]:
    """Numerator and denominator of the share of distinct wanted items that were found."""
    return F.size(F.array_intersect(wanted, found)), F.size(F.array_distinct(wanted))


def credit(states: Column) -> Column:
    """A row's credit from its facts' states: misstated and pending come first, then all or nothing, then a share."""
    n = F.size(states)
    right = F.size(F.filter(states, lambda s: s == "correct"))
    absent = F.size(F.filter(states, lambda s: s == "absent"))
    return (
        F.when(F.array_contains(states, "contradicted"), F.struct(F.lit("misstated").alias("status"), F.lit(0).alias("num"), F.lit(1).alias("den")))
        .when(F.array_contains(states, "pending"), F.struct(F.lit("pending").alias("status"), F.lit(0).alias("num"), F.lit(1).alias("den")))
        .when(right == n, F.struct(F.lit("covered").alias("status"), F.lit(1).alias("num"), F.lit(1).alias("den")))
        .when(absent == n, F.struct(F.lit("missing").alias("status"), F.lit(0).alias("num"), F.lit(1).alias("den")))
        .when(n == 1, F.struct(F.lit("partial").alias("status"), F.lit(1).alias("num"), F.lit(2).alias("den")))
        .otherwise(F.struct(F.lit("partial").alias("status"), right.alias("num"), n.alias("den")))
    )
