"""Which addresses the rules of their host allow: the longest rule that matches decides, and of two of one length the one that allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern(rule: Column) -> Column:
    """A rule as a regular expression: ``*`` stands for any characters, ``$`` at the end for the end."""
    ended = rule.endswith("$")
    body = F.when(ended, F.substr(rule, F.lit(1), F.length(rule) - 1)).otherwise(rule)
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(ended, "$").otherwise(""))


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (host, path, ..) with ``allowed`` and ``rule``, which is null where none matches. rules: (host, rule, allow); empty rules match nothing.

    A rule begins with characters that stand for themselves, up to its first ``*``. Pages meet rules by those: a page is cut to each
    length that the rules of its host begin with, and joined on what is left, so that only rules whose beginning it has are tried.
    """
    kept = rules.where("rule <> ''").groupBy("host", "rule").agg(F.max("allow").alias("allow"))
    begin = F.substring_index(F.regexp_replace("rule", r"\$$", ""), "*", 1)
    kept = kept.withColumn("_begin", begin)
    lengths = kept.groupBy("host").agg(F.collect_set(F.length("_begin")).alias("_lengths"))
    keyed = pages.select("host", "path").distinct()
    cuts = keyed.join(lengths, "host").select("host", "path", F.explode(F.filter("_lengths", lambda n: n <= F.length("path"))).alias("_n"))
    met = cuts.withColumn("_begin", F.substring("path", F.lit(1), F.col("_n"))).join(kept, ["host", "_begin"])
    met = met.where(F.regexp_like("path", pattern(F.col("rule"))))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "allow", "rule")).alias("best"))
    rows = pages.join(best, ["host", "path"], "left")
    return rows.withColumns({"allowed": F.coalesce("best.allow", F.lit(True)), "rule": F.col("best.rule")}).drop("best")
