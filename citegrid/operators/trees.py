"""Comparing trees: where two documents first differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.lineage import cut

#: Levels of a tree, at most.
DEPTH = 64


def _kind(tree: str) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(tree), "^(OBJECT|ARRAY)<", 1), F.lit(""))


def _entries(level: DataFrame, key: str, tree: str) -> DataFrame:
    """(_of, _place, _at, step, value) for each entry of the containers in ``tree``; a step sorts by name or by place in its list."""
    own = level.select(F.col(key).alias("_of"), F.col("place").alias("_place"), F.col("at").alias("_at"), F.col(tree).alias("_tree"))
    rows = own.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("_tree").outer()))
    pos = F.col("pos").cast("string")
    name = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), pos, F.lit("]")))
    return rows.select("_of", "_place", "_at", name.alias("step"), F.coalesce("key", F.lpad(pos, 10, "0")).alias("sorts"), F.col("value").alias(tree))


def first_difference(df: DataFrame, key: str, expected: str, actual: str, depth: int = DEPTH) -> DataFrame:
    """(key, at): the first place at which a row's two VARIANTs differ, null if they don't. ``key`` is unique.

    Both trees are walked together, the fields of an object by name, with those that only the actual one has after the others, the elements of a list in turn. A place differs where only
    one tree has it, where their kinds differ, or their scalars; a missing field isn't a null one. A round goes one level down in all rows at once, and only into containers that
    aren't equal; of what differs, the place that sorts first is the result.
    """
    # A generator, so that no filter that makes the trees once more is put before it.
    both = F.struct(F.lit("").alias("place"), F.lit("").alias("at"), F.col(expected).alias("a"), F.col(actual).alias("b"))
    level = df.select(key, F.inline_outer(F.array(both)))
    found = []
    for _ in range(depth):
        apart = level.where(~F.to_json("a").eqNullSafe(F.to_json("b"))).withColumn("deeper", (_kind("a") != "") & (_kind("a") == _kind("b")))
        apart = cut(apart)
        found.append(apart.where("not deeper").select(key, "place", "at"))
        inner = apart.where("deeper")
        if inner.isEmpty():
            break
        both = _entries(inner, key, "a").join(_entries(inner, key, "b").withColumnRenamed("sorts", "_sorts"), ["_of", "_place", "_at", "step"], "full")
        only = F.when(F.col("step").startswith(".") & F.col("sorts").isNull(), "1").otherwise("0")
        place = F.concat("_place", only, F.coalesce("sorts", "_sorts"), F.lit("\x01"))  # a character that sorts before those of names
        level = both.select(F.col("_of").alias(key), place.alias("place"), F.concat("_at", "step").alias("at"), "a", "b")
    least = reduce(DataFrame.union, found).groupBy(key).agg(F.min(F.struct("place", "at"))["at"].alias("at"))
    return df.select(key).join(least, key, "left").select(key, "at")
