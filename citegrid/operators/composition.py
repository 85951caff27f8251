"""How specs are composed: names that several own, and relations to other specs by the rules of each relation.

specs: (spec, kind, rank, aliases), one row for each base file of a spec; links: (spec, relation, target).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# For each relation, the kinds that it may lead from and to (none: any), and whether the target's layer may not be later.
RULES = [
    ("parts", ["board", "soc", "chip"], ["board", "soc", "chip"], False),
    ("variant_of", [], ["board", "soc", "chip"], False),
    ("instance", ["board", "soc", "chip"], ["ip", "peripheral"], False),
    ("describes", ["peripheral"], ["board", "soc", "chip"], True),
    ("overlays", [], [], True),
]


def clashes(specs: DataFrame) -> DataFrame:
    """(name, owners): names that several specs have as their id or as an alias, or one spec has in several base files; a spec may repeat its own aliases."""
    ids = specs.select("spec", F.col("spec").alias("name"), F.lit(1).alias("files"))
    more = specs.select("spec", F.explode(F.array_distinct("aliases")).alias("name")).where("name <> spec").distinct().withColumn("files", F.lit(0))
    found = ids.unionByName(more).groupBy("name").agg(F.array_sort(F.collect_set("spec")).alias("owners"), F.sum("files").alias("files"))
    return found.where("size(owners) > 1 or files > 1").select("name", "owners")


def broken(links: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec, relation, target, problem): links to no spec (dangling) or to several base files (ambiguous), to the spec itself, from or to another kind than the relation's, or into a later layer.

    A link has each problem that holds; one of an unknown relation has that alone.
    """
    rules = links.sparkSession.createDataFrame(RULES, "relation string, from_kinds array<string>, to_kinds array<string>, layered boolean")
    held = specs.groupBy("spec").agg(F.count("*").alias("n"), F.min("kind").alias("kind"), F.min("rank").alias("rank"))
    to = held.select(F.col("spec").alias("target"), F.col("n").alias("to_n"), F.col("kind").alias("to_kind"), F.col("rank").alias("to_rank"))
    rows = links.distinct().join(F.broadcast(rules), "relation", "left").join(held.drop("n"), "spec", "left").join(to, "target", "left")
    outside = lambda kinds, kind: (F.size(kinds) > 0) & ~F.array_contains(kinds, F.coalesce(kind, F.lit("")))
    one = F.col("to_n") == 1
    problems = F.array(
        F.when(F.col("to_n").isNull(), "dangling"),
        F.when(F.col("to_n") > 1, "ambiguous"),
        F.when(F.col("spec") == F.col("target"), "self"),
        F.when(outside(F.col("from_kinds"), F.col("kind")), "from-kind"),
        F.when(one & outside(F.col("to_kinds"), F.col("to_kind")), "to-kind"),
        F.when(one & F.col("layered") & (F.col("to_rank") > F.col("rank")), "later-layer"),
    )
    found = F.when(F.col("layered").isNull(), F.array(F.lit("unknown-relation"))).otherwise(F.array_compact(problems))
    return rows.select("spec", "relation", "target", F.explode(found).alias("problem"))
