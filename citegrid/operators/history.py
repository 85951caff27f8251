"""The history of a campaign: revisions one after the other, and readings whose slices cover its sections once each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def revisions(rows: DataFrame, first: int = 1) -> DataFrame:
    """(campaign, problem, item) of ``rows`` (campaign, revision): numbers told twice, and runs of numbers that are missing from ``first`` up to the last, as ``a-b``. Null revisions are unnumbered."""
    counted = rows.groupBy("campaign", "revision").agg(F.count("*").alias("n"))
    text = F.col("revision").cast("string")
    twice = counted.where("n > 1 and revision is not null").select("campaign", F.lit("repeated").alias("problem"), text.alias("item"))
    none = counted.where("revision is null").select("campaign", F.lit("unnumbered").alias("problem"), F.col("n").cast("string").alias("item"))
    known = counted.where("revision is not null")
    early = known.where(F.col("revision") < first).select("campaign", F.lit("early").alias("problem"), text.alias("item"))
    # Islands: what stands before each number is the one before it, or it begins after a gap.
    before = F.coalesce(F.lag("revision").over(Window.partitionBy("campaign").orderBy("revision")), F.lit(first - 1))
    gaps = known.where(F.col("revision") >= first).withColumn("before", before).where("revision > before + 1")
    item = F.concat((F.col("before") + 1).cast("string"), F.lit("-"), (F.col("revision") - 1).cast("string"))
    return reduce(DataFrame.unionByName, [twice, none, early, gaps.select("campaign", F.lit("missing").alias("problem"), item.alias("item"))])


def covers(slices: DataFrame, sections: DataFrame) -> DataFrame:
    """(campaign, reading, problem, item): where a reading's slices (campaign, reading, slice, section) don't have each of its campaign's sections (campaign, section) once.

    A section in two slices is repeated, one that the campaign doesn't have is unknown, one in no slice is uncovered.
    """
    own = slices.select("campaign", "reading", "section", "slice", F.lit(True).alias("_own"))
    wanted = slices.select("campaign", "reading").distinct().join(sections.select("campaign", "section").distinct(), "campaign")
    wanted = wanted.select("campaign", "reading", "section", F.lit(None).cast(slices.schema["slice"].dataType).alias("slice"), F.lit(False).alias("_own"))
    # Both sides are aggregated together, not sorted and joined; nulls are equal to nothing, so they stay apart.
    apart = F.when(F.col("reading").isNull() | F.col("section").isNull(), F.col("_own"))
    both = own.union(wanted).groupBy("campaign", "reading", "section", apart.alias("_apart"))
    both = both.agg(F.min("slice").alias("_first"), F.max("slice").alias("_last"), F.max("_own").alias("_held"), F.min("_own").alias("_alone"))
    problem = F.when(~F.col("_held"), "uncovered").when(F.col("_alone"), "unknown").when(F.col("_first") < F.col("_last"), "repeated")
    return both.select("campaign", "reading", problem.alias("problem"), F.col("section").alias("item")).where("problem is not null")
