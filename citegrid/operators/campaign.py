"""Campaign ledgers: which evidence entries a changed source makes stale, and the order of what waits.

entries: (id, kind, spec_revision, sections array<string>, superseded boolean, state);
sources: (id, kind, status, old, new, changed array<string>, known boolean); a source acts if its status is ok.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The entry kinds that a source kind reaches.
REACH = {
    "spec": ["verification", "qualification", "result", "candidate_round"],
    "document": ["verification"],
    "kernel": ["verification"],
    "harness": ["qualification"],
    "guest_init": ["qualification"],
    "emulator": ["qualification", "result", "candidate_round", "observation"],
    "candidate": ["result", "candidate_round"],
    "toolchain": ["qualification", "result", "candidate_round", "observation"],
}
# The order of entry kinds in the queue, and how many are taken at a time.
QUEUE = ["qualification", "verification", "result", "observation"]
BATCH = 3


def touches(sections: Column, changed: Column) -> Column:
    """Whether a section equals a changed one, or one of the two lies under the other by dotted prefix."""

    def under(a: Column, b: Column) -> Column:
        return a.startswith(F.concat(b, F.lit(".")))

    return F.exists(sections, lambda s: F.exists(changed, lambda c: (s == c) | under(s, c) | under(c, s)))


def sweep(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, state, reasons): the entries with the reasons that make them stale; superseded ones and contested ones keep their state."""
    spark = entries.sparkSession
    reach = spark.createDataFrame([(s, k) for s, ks in REACH.items() for k in ks], "source_kind string, kind string")
    acting = sources.where((F.col("status") == "ok") & ~F.col("old").eqNullSafe(F.col("new")))
    acting = acting.select(F.col("id").alias("source"), F.col("kind").alias("source_kind"), "changed", "known").join(F.broadcast(reach), "source_kind")
    met = entries.where(~F.col("superseded")).join(acting, "kind")
    narrow = (F.col("source_kind") == "spec") & F.col("kind").isin("verification", "qualification") & F.col("known")
    fires = ~narrow | touches(F.col("sections"), F.col("changed"))
    reasons = met.where(fires).groupBy("id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "source_kind", "source"))).alias("reasons"))
    out = entries.join(reasons, "id", "left")
    state = F.when(F.col("superseded"), "superseded").when(F.col("state") != "current", F.col("state")).when(F.col("reasons").isNotNull(), "stale").otherwise("current")
    return out.select("id", "kind", state.alias("state"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def queue(swept: DataFrame, cap: int = BATCH) -> DataFrame:
    """The first stale entries by kind and id."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, QUEUE)), F.col("kind")), F.lit(0))
    order = F.when(place == 0, len(QUEUE) + 1).otherwise(place)
    return swept.where("state = 'stale'").orderBy(order, "id").limit(cap)


def contested(entries: DataFrame, readings: DataFrame) -> DataFrame:
    """(id, state): contested where two current readings (id, verdict) of an entry contradict, whatever its state was."""
    apart = readings.groupBy("id").agg(F.countDistinct("verdict").alias("n")).where("n > 1").select("id", F.lit(True).alias("_apart"))
    return entries.join(apart, "id", "left").select("id", F.when(F.col("_apart"), "contested").otherwise(F.col("state")).alias("state"))
