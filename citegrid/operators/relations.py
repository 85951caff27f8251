"""Constraint joins: exactly-one references, missing and repeated keys, overlaps of intervals, as-of and priority labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(refs: DataFrame, key: str, targets: DataFrame, target: str) -> DataFrame:
    """``refs`` with why: ok if exactly one target has the key, missing if none, ambiguous if several."""
    known = targets.groupBy(F.col(target).alias(key)).agg(F.count("*").alias("_n"))
    why = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("ok")
    return refs.join(known, key, "left").withColumn("why", why).drop("_n")


def repeated(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of keys that occur again, each with its place in ``order``; the first one wins."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("copies", F.count("*").over(w)).where("copies > 1")
    return rows.withColumn("place", F.row_number().over(w.orderBy(*order)))


def overlaps(df: DataFrame, key: str, begin: str, end: str, ident: str, condition: str, width: int) -> DataFrame:
    """(key, a, b) of half-open integer intervals of one key that overlap, unless both have conditions and these differ.

    Intervals are cut at multiples of ``width``; two that overlap meet in the piece where the later one begins, and
    only there are they paired, so the join is on equal (key, piece).
    """
    piece = F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor((F.col(end) - 1) / width)))
    cut = df.where(F.col(begin) < F.col(end)).select(F.col(key).alias("k"), F.col(ident).alias("id"), F.col(begin).alias("b"), F.col(end).alias("e"), F.col(condition).alias("c"), piece.alias("p"))
    left, right = (cut.select("k", "p", *[F.col(x).alias(f"{x}{n}") for x in ("id", "b", "e", "c")]) for n in (1, 2))
    met = left.join(right, ["k", "p"]).where("id1 < id2 AND b1 < e2 AND b2 < e1")
    met = met.where(F.col("p") == F.floor(F.greatest("b1", "b2") / width))
    met = met.where("c1 IS NULL OR c2 IS NULL OR c1 = c2")
    return met.select(F.col("k").alias(key), F.col("id1").alias("a"), F.col("id2").alias("b"))


def as_of(events: DataFrame, marks: DataFrame, key: str, time: str, order: str, value: str) -> DataFrame:
    """``events`` with ``value`` of the latest mark of the same key at or before each: a union and one window.

    marks: (key, time, order, value); of marks with equal times the largest order counts.
    """
    fields = [c for c in events.columns if c not in (key, time, order)]
    both = events.select(key, time, order, F.lit(1).alias("_kind"), F.struct(*fields).alias("_rest"), F.lit(None).cast(marks.schema[value].dataType).alias("_value"))
    both = both.unionByName(marks.select(key, time, order, F.lit(0).alias("_kind"), F.lit(None).cast(both.schema["_rest"].dataType).alias("_rest"), F.col(value).alias("_value")))
    w = Window.partitionBy(key).orderBy(time, "_kind", order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", True).over(w)).where("_kind = 1").select(key, time, order, "_rest.*", value)


def first_label(labels: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(otherwise)
    for condition, name in reversed(labels):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def covers_all(facts: DataFrame, group: str, item: str, wanted: DataFrame) -> DataFrame:
    """(group, n_items): the groups whose facts hold every item of ``wanted``, a relational division."""
    need = wanted.select(item).distinct()
    n = need.count()
    met = facts.select(group, item).distinct().join(F.broadcast(need) if n < 10_000 else need, item)
    return met.groupBy(group).agg(F.count("*").alias("n_items")).where(F.col("n_items") == n)
