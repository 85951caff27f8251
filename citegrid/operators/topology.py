"""Topology contexts: which specs a focus admits, which connections lie inside, and which end at a boundary.

Fields: specs (spec, kind), parts (spec, part), instances (spec, target), describes (spec, target), connections (record, spec, provider, consumer, port, mode), the ends
being the specs of the nodes that a connection names, null where it names none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.lineage import cut

# The kind that no other focus admits, those that have topology, and those that a connection admits.
BOARD, OWNERS, LINKED = "board", ["board", "soc", "chip"], ["soc", "chip"]


def _rounds(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(focus, spec) of ``start`` and of all that ``step`` makes of what is new, until nothing is."""
    new, found = cut(start), []
    while not new.isEmpty():
        found.append(new)
        seen = reduce(DataFrame.union, found)
        new = cut(step(new).select("focus", "spec").distinct().join(seen, ["focus", "spec"], "left_anti"))
        if len(found) > 8:
            found = [cut(seen)]
    return reduce(DataFrame.union, found) if found else start


def admitted(specs: DataFrame, parts: DataFrame, instances: DataFrame, describes: DataFrame, connections: DataFrame, focus: DataFrame) -> DataFrame:
    """(focus, spec): reachability over pairs of a focus and what it admits so far.

    First the focus and its parts, at any depth, but no board besides itself; then what those have instances of and the peripherals that describe them; then, as long as there are new ones, the
    socs and chips at the ends of connections that an admitted spec owns.
    """
    kinds = specs.groupBy("spec").agg(F.min("kind").alias("kind"))
    own = focus.select("focus", F.col("focus").alias("spec")).join(kinds, "spec", "left_semi").select("focus", "spec")

    def allowed(pairs: DataFrame) -> DataFrame:
        return pairs.join(kinds, "spec").where((F.col("kind") != BOARD) | (F.col("spec") == F.col("focus"))).select("focus", "spec")

    inside = parts.select("spec", "part").distinct()
    composed = _rounds(own, lambda new: allowed(new.join(inside, "spec").select("focus", F.col("part").alias("spec"))))
    placed = composed.join(instances, "spec").select("focus", F.col("target").alias("spec"))
    peripheral = describes.join(kinds.where("kind = 'peripheral'"), "spec").select("spec", F.col("target").alias("of"))
    about = composed.withColumnRenamed("spec", "of").join(peripheral, "of").select("focus", "spec")
    start = composed.union(allowed(placed)).union(allowed(about)).distinct()
    ends = connections.select("spec", F.explode(F.array("provider", "consumer")).alias("to")).where("to is not null and to <> spec").distinct()
    linked = cut(ends.join(kinds.where(F.col("kind").isin(LINKED)).select(F.col("spec").alias("to")), "to", "left_semi"))
    return _rounds(start, lambda new: new.join(linked, "spec").select("focus", F.col("to").alias("spec")))


def boundaries(admitted: DataFrame, connections: DataFrame) -> DataFrame:
    """(focus, record, side, node): ends of admitted specs' connections at specs that the focus doesn't admit."""
    rows = admitted.join(connections, "spec")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("node")) for s in ("provider", "consumer")])
    ends = rows.select("focus", "record", F.explode(sides).alias("x")).select("focus", "record", "x.*").where("node is not null")
    return ends.join(admitted.withColumnRenamed("spec", "node"), ["focus", "node"], "left_anti").select("focus", "record", "side", "node")


def crowded(admitted: DataFrame, connections: DataFrame, outside: DataFrame) -> DataFrame:
    """(focus, consumer, port, n_fixed, n): slots of a focus with several fixed connections, or with a fixed one beside others; connections over a boundary don't count."""
    rows = admitted.join(connections.where("consumer is not null and port is not null"), "spec")
    rows = rows.join(outside.select("focus", "record").distinct(), ["focus", "record"], "left_anti")
    found = rows.groupBy("focus", "consumer", "port").agg(F.count_if(F.col("mode") == "fixed").alias("n_fixed"), F.count("*").alias("n"))
    return found.where("n_fixed > 1 or (n_fixed > 0 and n > 1)")


def chosen_twice(selections: DataFrame, connections: DataFrame) -> DataFrame:
    """(configuration, consumer, port, n): slots in which a configuration selects several connections. selections: (configuration, record)."""
    picked = selections.select("configuration", "record").distinct().join(connections.select("record", "consumer", "port"), "record")
    return picked.groupBy("configuration", "consumer", "port").agg(F.count("*").alias("n")).where("n > 1")
