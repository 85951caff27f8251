"""Findings in order, their tallies, and what a ledger's rows cover.

findings: (root, path, line, col, level, code, message); ledger: (root, grp, name, disposition), groups and states being fixed domains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Levels of findings, groups of a ledger, states of its rows.
LEVELS = ["error", "warning"]
GROUPS, STATES = ["documents", "blocks"], ["spec", "planned", "excluded", "unresolved"]
ORDER = ["path", "line", "col", "message"]
FIRST = 5


def distinct(findings: DataFrame) -> DataFrame:
    """One finding for each place, level and message; of several codes the smallest. Its ``nth`` is the place in its path's order, findings without a line first."""
    rows = findings.groupBy("root", "path", "line", "col", "level", "message").agg(F.min("code").alias("code"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("root", "path").orderBy("line", "col", "message", "level")))


def ordered(findings: DataFrame) -> DataFrame:
    """Distinct findings by path, line, column and message: a range sort of all rows, for output."""
    return distinct(findings).drop("nth").orderBy(*ORDER, "level", "root")


def tallies(findings: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, errors, warnings, passed) of all ``roots`` (root), those without findings too."""
    counted = distinct(findings).groupBy("root").agg(*[F.count_if(F.col("level") == one).alias(f"{one}s") for one in LEVELS])
    rows = roots.select("root").distinct().join(counted, "root", "left")
    counts = [F.coalesce(f"{one}s", F.lit(0)).alias(f"{one}s") for one in LEVELS]
    return rows.select("root", *counts, (F.coalesce("errors", F.lit(0)) == 0).alias("passed"))


def details(findings: DataFrame, first: int = FIRST) -> DataFrame:
    """(root, code, n, details): the first messages of each code, each with its place, and how many more there are.

    A code may have a third of all findings: each task keeps its own first ones, and counts come apart from them.
    """
    rows = distinct(findings)
    place = F.row_number().over(Window.partitionBy("root", "code").orderBy(*ORDER, "level"))
    kept = rows.withColumn("_k", place).where(F.col("_k") <= first)  # a limit before the shuffle, too
    text = F.concat_ws(":", "path", F.coalesce(F.col("line").cast("string"), F.lit("-")), "message")
    top = kept.groupBy("root", "code").agg(F.array_sort(F.collect_list(F.struct("_k", text.alias("text")))).alias("top"))
    counted = rows.groupBy("root", "code").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > first, F.array(F.concat(F.lit("and "), (F.col("n") - first).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return counted.join(top, ["root", "code"]).select("root", "code", "n", F.concat(F.transform("top", lambda t: t["text"]), more).alias("details"))


def coverage(ledger: DataFrame, resolved: DataFrame) -> DataFrame:
    """(root, grp, state, n) for all groups and states of each root, zeros too.

    A row's state is what its disposition says before the colon, but unresolved where that is spec and the spec or the fact it names, ``spec:<spec>`` or ``spec:<spec>#<fact>``, isn't in ``resolved``
    (root, target) of the same root. A name counts by its first row where that is unresolved, so rows are told apart by name and disposition.
    """
    state = F.substring_index("disposition", ":", 1)
    rows = ledger.select("root", "grp", "name", state.alias("state"), F.when(state == "spec", F.substr(F.col("disposition"), F.lit(6))).alias("target"))
    there = resolved.select("root", "target").distinct().withColumn("_there", F.lit(True))
    rows = rows.join(there, ["root", "target"], "left")
    rows = rows.withColumn("state", F.when((F.col("state") == "spec") & F.col("_there").isNull(), "unresolved").otherwise(F.col("state")))
    counted = rows.groupBy("root", "grp", "state").agg(F.count("*").alias("n"))
    domain = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(s).alias("state")) for g in GROUPS for s in STATES])
    every = ledger.select("root").distinct().select("root", F.explode(domain).alias("d")).select("root", "d.grp", "d.state")
    return every.join(counted, ["root", "grp", "state"], "left").select("root", "grp", "state", F.coalesce("n", F.lit(0)).alias("n"))


def summaries(coverage: DataFrame) -> DataFrame:
    """(root, summary): a line for each root; unresolved rows are told only if there are any."""
    place = F.array_position(F.array(*[F.lit(g + s) for g in GROUPS for s in STATES]), F.concat("grp", "state"))
    told = coverage.where((F.col("state") != "unresolved") | (F.col("n") > 0))
    part = F.concat(F.col("n").cast("string"), F.lit(" "), "state")
    group = told.groupBy("root", "grp").agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), part.alias("part")))).alias("parts"))
    line = F.concat("grp", F.lit(" "), F.array_join(F.transform("parts", lambda p: p["part"]), ", "))
    whole = group.groupBy("root").agg(F.array_sort(F.collect_list(F.struct(F.get("parts", F.lit(0))["k"].alias("k"), line.alias("line")))).alias("lines"))
    return whole.select("root", F.array_join(F.transform("lines", lambda x: x["line"]), "; ").alias("summary"))
