"""References between facts: resolving them in three scopes, the rules that they keep to, and what lies behind them.

A reference is ``#fact`` in its own file, ``spec#fact`` in its own root, or ``spec@root#fact`` in any root. Fields: records have (root, path, spec,
name, copies), roots (name, rank, trusted), references (root, path, spec, name, kind, scope, at, ref, relation), and (here, nth) if ``corpus.gathered`` found them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.lineage import written

OK, MISSING, AMBIGUOUS, INVALID, UNTRUSTED = "ok", "missing", "ambiguous", "invalid", "untrusted"


def _named(word: Column, more: str) -> Column:
    """Small letters, digits and the characters of ``more``, not first."""
    return (word != "") & ~word.rlike(f"[^a-z0-9{more}]") & ~F.substring(word, 1, 1).rlike("[^a-z0-9]")


def parsed(refs: DataFrame) -> DataFrame:
    """``refs`` with ``to_spec``, ``to_root``, ``to_fact`` and ``valid``; the first two are null where the reference has none."""
    before, fact = F.substring_index("ref", "#", 1), F.substring_index("ref", "#", -1)
    spec, at = F.substring_index(before, "@", 1), F.substring_index(before, "@", -1)
    qualified = before.contains("@")
    valid = (F.length("ref") - F.length(F.replace("ref", F.lit("#"))) == 1) & _named(fact, "-")
    valid &= (before == "") | (_named(spec, "-") & (~qualified | (_named(at, "._-") & (F.length(before) - F.length(F.replace(before, F.lit("@"))) == 1))))
    none = F.lit(None).cast("string")
    return refs.select("*", F.when(before != "", spec).otherwise(none).alias("to_spec"), F.when(qualified, at).otherwise(none).alias("to_root"), fact.alias("to_fact"), valid.alias("valid"))


def resolve(refs: DataFrame, records: DataFrame, roots: DataFrame) -> DataFrame:
    """``refs`` with (status, to_root, to_path, to_spec, to_fact): ok for exactly one record, else why there is none; the target is null then.

    A name that a file lists twice is ambiguous, as is a root's name that two roots have;
    a root whose files can't all be read is untrusted from outside, and if a marker is unread (a root without a name), every reference that names a root is, as the
    root without a name could be the one meant. References meet names by the place they are looked up in, a file or a spec, in one join; no row is
    sent twice. References to a fact of their file whose ``here`` is given aren't sent at all.
    """
    keys = ["root", "path", "ref"]
    names = roots.groupBy(F.col("name").alias("to_root")).agg(F.count("*").alias("n_roots"), F.min("trusted").alias("trusted"))
    unread = F.lit(not roots.where("name is null").isEmpty())
    by_name = F.broadcast(names.where("to_root is not null").withColumnRenamed("to_root", "in_root"))
    refs = refs.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    known = "here" in refs.columns
    kept = [c for c in refs.columns if c != "here"]
    asked = parsed(refs.where("here is null") if known else refs).withColumnsRenamed({"to_spec": "in_spec", "to_root": "of_root", "to_fact": "of_fact"})
    here = F.col("in_spec").isNull()
    asked = asked.withColumn("in_root", F.coalesce("of_root", "root")).withColumn("place", F.when(here, F.concat(F.lit("f"), "path")).otherwise(F.concat(F.lit("s"), "in_spec"))).join(by_name, "in_root", "left")
    # A file's names say which spec it is, a spec's names which file.
    place = lambda mark, column, other: F.struct(F.concat(F.lit(mark), column).alias("place"), F.col(other).alias("other"))
    at = place("s", "spec", "path") if known else F.explode(F.array(place("f", "path", "spec"), place("s", "spec", "path")))
    held = records.select(F.col("root").alias("in_root"), F.col("name").alias("of_fact"), at.alias("at"))
    held = held.select("in_root", "of_fact", "at.place", "at.other").groupBy("in_root", "place", "of_fact").agg(F.count("*").alias("n"), F.min("other").alias("other"))
    both = asked.join(held, ["in_root", "place", "of_fact"], "left")
    named = F.col("of_root").isNotNull()
    status = (
        F.when(~F.col("valid"), INVALID)
        .when(named & unread, UNTRUSTED)
        .when(named & F.col("n_roots").isNull(), MISSING)
        .when(named & (F.col("n_roots") > 1), AMBIGUOUS)
        .when(named & (F.col("in_root") != F.col("root")) & ~F.col("trusted"), UNTRUSTED)
        .when(F.col("n").isNull(), MISSING)
        .when(F.col("n") > 1, AMBIGUOUS)
        .otherwise(OK)
    )
    target = lambda value, name: F.when(F.col("status") == OK, value).alias(name)
    # Where ``here`` is given, those looked up name a spec, and which path has it is only found out if it is asked for.
    to_path, to_spec = (F.col("other"), F.col("in_spec")) if known else (F.when(here, F.col("path")).otherwise(F.col("other")), F.when(here, F.col("other")).otherwise(F.col("in_spec")))
    found = both.withColumn("status", status).select(*kept, "status", target(F.col("in_root"), "to_root"), target(to_path, "to_path"), target(to_spec, "to_spec"), target(F.col("of_fact"), "to_fact"))
    if not known:
        return found
    own = parsed(refs.where("here is not null")).withColumn("status", F.when(~F.col("valid"), INVALID).when(F.col("here") == 0, MISSING).when(F.col("here") > 1, AMBIGUOUS).otherwise(OK))
    return found.unionByName(own.select(*kept, "status", *[target(F.col(c), name) for c, name in (("root", "to_root"), ("path", "to_path"), ("spec", "to_spec"), ("to_fact", "to_fact"))]))


def rules(resolved: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path, name, kind, at, ref, rule) of references that break a rule: unresolved, repeated in their list, to the fact itself, or into a later layer.

    Only references whose ``nth`` isn't known are gathered by what they resolve to: those of lists that say different things.
    """
    rank = roots.where("name is not null").groupBy("name").agg(F.min("rank").alias("rank"))
    own, to = (rank.select(F.col("name").alias(c), F.col("rank").alias(f"{c}_rank")) for c in ("root", "to_root"))
    rows = resolved.join(F.broadcast(own), "root", "left").join(F.broadcast(to), "to_root", "left")
    same = Window.partitionBy("root", "path", "name", "kind", "scope", "relation", "to_root", "to_path", "to_fact").orderBy("at")
    counted = lambda df: df.withColumn("_nth", F.row_number().over(same))
    known = "nth" in rows.columns
    rows = counted(rows.where("nth is null")).unionByName(rows.where("nth is not null").withColumn("_nth", F.col("nth"))) if known else counted(rows)
    itself = (F.col("to_path") == F.col("path")) & (F.col("to_fact") == F.col("name")) & (F.col("to_root") == F.col("root"))
    ok = F.col("status") == OK
    found = F.array_compact(
        F.array(
            F.when(~ok, F.col("status")),
            F.when(ok & (F.col("kind") != "observation") & (F.col("_nth") > 1), "repeated"),
            F.when(ok & (F.col("kind") != "premise") & itself, "self"),
            F.when(ok & (F.col("to_root_rank") > F.col("root_rank")), "later-layer"),
        )
    )
    return rows.select("root", "path", "name", "kind", "at", "ref", F.explode(found).alias("rule"))


#: Bits of a long that hold elements of a set; larger sets take several longs.
BITS = 63


def _kept(df: DataFrame) -> DataFrame:
    """Written once and read as often as needed, with its size known; a checkpoint makes its rows twice."""
    return written(df, "reach")


def reach(edges: DataFrame, own: DataFrame, elements: list[str], unknown: DataFrame) -> DataFrame:
    """(node, low, elements, open): what a node and all that it reaches over ``edges`` (src, dst) have: the lowest ``low``, the union of their elements,
    and whether one of ``unknown`` (node) is among them.

    ``own`` has (node, low, element), any number of rows a node, with null for none. The values are a lattice, so a node holds one value however
    many paths lead from it, and no pairs of nodes are stored: a round sends what changed over the edges, and joins it to what is known. Rounds are at most
    the length of the longest way without cycles that still changes a value. ``elements`` are all that there can be, a stated list.
    """
    place = {e: k for k, e in enumerate(elements)}
    n = max(1, -(-len(elements) // BITS))
    index = F.element_at(F.map_from_arrays(F.array(*map(F.lit, place)), F.array(*map(F.lit, place.values()))), F.col("element")) if place else F.lit(None).cast("int")
    rows = own.withColumn("_at", F.when(F.col("element").isNotNull(), index))
    bits = [F.when(F.floor(F.col("_at") / BITS) == w, F.expr(f"shiftleft(1L, _at % {BITS})")).otherwise(F.lit(0).cast("long")) for w in range(n)]
    names = [f"_w{w}" for w in range(n)]

    def joined(df: DataFrame) -> DataFrame:
        return df.groupBy("node").agg(F.min("low").alias("low"), *[F.bit_or(w).alias(w) for w in names], F.max("open").alias("open"))

    start = rows.select("node", "low", *[b.alias(w) for b, w in zip(bits, names, strict=True)], F.lit(False).alias("open"))
    lost = unknown.select("node", F.lit(None).cast(dict(own.dtypes)["low"]).alias("low"), *[F.lit(0).cast("long").alias(w) for w in names], F.lit(True).alias("open"))
    value = ["low", *names, "open"]
    edges = _kept(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    first = _kept(joined(start.unionByName(lost)))
    # Only what others refer to is of use to them, so rounds go over these nodes alone; what nothing refers to takes its value from them at the end.
    inner = edges.select(F.col("dst").alias("node")).distinct()
    steps = _kept(edges.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst"))
    new = _kept(first.join(inner, "node", "left_semi"))
    parts = [new]
    while not new.isEmpty():
        sent = joined(new.withColumnRenamed("node", "dst").join(steps, "dst").select(F.col("src").alias("node"), *value))
        old = joined(reduce(DataFrame.unionByName, parts)).select("node", *[F.col(c).alias(f"old_{c}") for c in value], F.lit(True).alias("_had"))
        both = sent.join(old, "node", "left")
        less = F.col("low").isNotNull() & (F.col("old_low").isNull() | (F.col("low") < F.col("old_low")))
        more = reduce(Column.__or__, [F.col(w).bitwiseAND(F.bitwise_not(F.col(f"old_{w}"))) != 0 for w in names])
        changed = both.where(F.col("_had").isNull() | less | more | (F.col("open") & ~F.col("old_open")))
        new = _kept(changed.select("node", F.least("low", "old_low").alias("low"), *[F.col(w).bitwiseOR(F.coalesce(f"old_{w}", F.lit(0))).alias(w) for w in names], (F.col("open") | F.coalesce("old_open", F.lit(False))).alias("open")))
        parts = [*parts, new]
        if len(parts) > 16:  # what is known stands in the rounds' parts, and is written anew only now and then
            parts = [_kept(joined(reduce(DataFrame.unionByName, parts)))]
    known = joined(reduce(DataFrame.unionByName, parts))
    known = joined(first.unionByName(known).unionByName(edges.join(known.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), *value)))
    have = [F.when(F.expr(f"{names[k // BITS]} & shiftleft(1L, {k % BITS})") != 0, e) for e, k in place.items()]
    return known.select("node", "low", F.array_sort(F.array_compact(F.array(*have))).alias("elements") if have else F.array().cast("array<string>").alias("elements"), "open")
