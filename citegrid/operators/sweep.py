"""The sweep of a ledger: which entries a changed source makes stale, by rules that are data, and what follows from that.

Fields: entries (id, kind, claim, basis, superseded, sections, evidence), pins (basis, source, seen), bases (basis, dependencies), sources (source, kind,
now, ok), changes (source, seen, now, sections, checks, since), claims (claim, cites, checks), citations (id, source, sections), contradictions (observation,
conflict, since), premises (claim, observation).

Strata, each over what those before have settled: direct reasons; stale observations make the verifications stale that use them; contradictions make
observations contested; contested observations make the qualifications and verifications stale that rest on them. Reasons add up, so that each state says where it comes
from. Superseded entries are never touched. A reason's ``since`` is that of its change, null without one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of entries that come from runs, and from candidates; evidence that shows a source.
RUNS = ["qualification", "result", "candidate_round", "observation"]
CANDIDATES = ["result", "candidate_round"]
OBSERVED = ["source-observed", "kernel"]
EMULATED = "emulated"
#: (source kind, entry kinds, evidence that an entry must have, what of it a reviewed change must meet, reason, reason without a review).
#: ``sections`` are the entry's, ``cited`` those that it cites of the source, ``cites`` and ``checks`` those of its claim; nothing stands for any change.
RULES = [
    ("spec", ["verification"], [], "sections", "spec changed in reviewed sections", "spec changed; unreviewed"),
    ("spec", ["qualification"], [], "cites", "spec changed in the claim's sections", "spec changed; unreviewed"),
    ("document", ["verification"], [], "cited", "document changed in cited sections", "document changed; whole document"),
    ("kernel", ["verification"], OBSERVED, None, "reference source changed", None),
    ("harness", ["qualification"], [], "checks", "harness changed a named check", "harness changed; unmapped"),
    ("guest_init", ["qualification"], [], "checks", "harness changed a named check", "harness changed; unmapped"),
    ("emulator", RUNS, [], None, "emulator or guest changed", None),
    ("emulator", ["verification"], [EMULATED], None, "emulator or guest changed", None),
    ("candidate", CANDIDATES, [], None, "candidate build changed", None),
    ("toolchain", RUNS, [], None, "recorded toolchain changed", None),
]
REASON = "id string, reason string, source string, since string"


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (a, b) of ``left`` (a, sections) and ``right`` (b, sections) of which a section equals one of the other or lies above it: joins on dotted
    prefixes, as many rows as a section has parts."""
    one, two = left.select("a", F.explode("sections").alias("s")), right.select("b", F.explode("sections").alias("s"))
    parts = F.split("s", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    up = lambda df, c: df.select(c, F.explode(above).alias("s"))
    return up(one, "a").join(two, "s").select("a", "b").union(one.join(up(two, "b"), "s").select("a", "b")).distinct()


def direct(entries: DataFrame, pins: DataFrame, sources: DataFrame, changes: DataFrame, claims: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, reason, source, since): a rule's reason for each entry whose basis saw another state of a source, if the reviewed change meets it or no review says."""
    spark = entries.sparkSession
    rules = spark.createDataFrame(RULES, "source_kind string, kinds array<string>, needs array<string>, scope string, hit string, unmapped string")
    rules = rules.select("source_kind", F.explode("kinds").alias("kind"), "needs", "scope", "hit", "unmapped")
    now = sources.where("ok").select("source", F.col("kind").alias("source_kind"), "now")
    moved = pins.join(now, "source").where(~F.col("seen").eqNullSafe(F.col("now")))
    met = entries.where("not superseded").join(moved, "basis").join(F.broadcast(rules), ["source_kind", "kind"])
    met = met.where((F.size("needs") == 0) | F.arrays_overlap("needs", F.coalesce("evidence", F.array().cast("array<string>"))))
    reviewed = changes.select("source", "seen", "now", F.col("sections").alias("c_sections"), F.col("checks").alias("c_checks"), "since")
    met = met.join(reviewed, ["source", "seen", "now"], "left").join(claims.select("claim", "cites", "checks"), "claim", "left")
    met = met.join(citations.select("id", "source", F.col("sections").alias("cited")), ["id", "source"], "left")
    whose = F.when(F.col("scope") == "sections", F.col("sections")).when(F.col("scope") == "cites", F.col("cites")).when(F.col("scope") == "cited", F.col("cited")).otherwise(F.col("checks"))
    what = F.when(F.col("scope") == "checks", F.col("c_checks")).otherwise(F.col("c_sections"))
    under = lambda a, b: (a == b) | a.startswith(F.concat(b, F.lit("."))) | b.startswith(F.concat(a, F.lit(".")))
    touched = F.when(F.col("scope") == "checks", F.arrays_overlap(whose, what)).otherwise(F.exists(whose, lambda a: F.exists(what, lambda b: under(a, b))))
    reason = F.when(F.col("scope").isNull(), F.col("hit")).when(whose.isNull() | what.isNull(), F.col("unmapped")).when(touched, F.col("hit"))
    return met.select("id", reason.alias("reason"), "source", "since").where("reason is not null")


def _users(entries: DataFrame, bases: DataFrame, observations: DataFrame) -> DataFrame:
    """(id, b): the verifications from emulated evidence that use an observation by their sections or those that their basis depends on. One whose basis doesn't say what it
    depends on uses them all; it gets the observation with the smallest id alone."""
    uses = entries.where((F.col("kind") == "verification") & F.array_contains("evidence", EMULATED) & ~F.col("superseded")).join(bases, "basis", "left")
    told = uses.where("dependencies is not null").select(F.col("id").alias("a"), F.concat(F.coalesce("sections", F.array().cast("array<string>")), "dependencies").alias("sections"))
    pairs = overlapping(told, observations).select(F.col("a").alias("id"), "b")
    least = observations.agg(F.min("b")).first()[0]
    every = uses.where("dependencies is null").select("id", F.lit(least).cast("string").alias("b")).where("b is not null")
    return pairs.unionByName(every)


def sweep(entries: DataFrame, pins: DataFrame, bases: DataFrame, sources: DataFrame, changes: DataFrame, claims: DataFrame, citations: DataFrame, contradictions: DataFrame, premises: DataFrame) -> DataFrame:
    """(id, kind, state, reasons): state superseded, contested, stale or current; reasons (reason, source, since), in order."""
    first = direct(entries, pins, sources, changes, claims, citations)
    seen = entries.where("kind = 'observation' and not superseded").select(F.col("id").alias("b"), "sections")
    stale = seen.join(first.select(F.col("id").alias("b")).distinct(), "b")
    began = first.groupBy(F.col("id").alias("b")).agg(F.min("since").alias("since"))
    second = _users(entries, bases, stale).join(began, "b", "left").select("id", F.lit("cited emulated observation is stale").alias("reason"), F.col("b").alias("source"), "since")

    against = contradictions.join(seen.select(F.col("b").alias("observation")), "observation")
    third = against.select(F.col("observation").alias("id"), F.lit("hardware contradicts emulated observation").alias("reason"), F.col("conflict").alias("source"), "since")
    apart = seen.join(against.select(F.col("observation").alias("b")).distinct(), "b")
    since = first.unionByName(third).where("since <> ''").groupBy(F.col("id").alias("b")).agg(F.min("since").alias("since"))
    quals = entries.where("kind = 'qualification' and not superseded")
    named = quals.join(premises, "claim").join(apart.select(F.col("b").alias("observation")), "observation").select("id", F.col("observation").alias("b"))
    unnamed = quals.join(premises.select("claim").distinct(), "claim", "left_anti").join(claims.where("cites is not null"), "claim")
    cited = overlapping(unnamed.select(F.col("id").alias("a"), F.col("cites").alias("sections")), apart).select(F.col("a").alias("id"), "b")
    uses = named.unionByName(cited).unionByName(_users(entries, bases, apart))
    fourth = uses.join(since, "b", "left").select("id", F.lit("premise observation contested").alias("reason"), F.col("b").alias("source"), F.coalesce("since", F.concat(F.lit("index:"), "b")).alias("since"))

    all_ = reduce(DataFrame.unionByName, [first, second, third, fourth])
    found = all_.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("reason", "source", "since"))).alias("reasons"))
    out = entries.join(found, "id", "left").join(apart.select(F.col("b").alias("id"), F.lit(True).alias("_apart")), "id", "left")
    state = F.when(F.col("superseded"), "superseded").when(F.col("_apart"), "contested").when(F.col("reasons").isNotNull(), "stale").otherwise("current")
    return out.select("id", "kind", state.alias("state"), F.coalesce("reasons", F.array().cast("array<struct<reason:string,source:string,since:string>>")).alias("reasons"))
