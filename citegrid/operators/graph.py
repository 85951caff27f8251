"""Reachability, impact, strongly connected components, taint and Merkle bases over edge tables.

An edge (src, dst) says that src rests on dst. All loops are semi-naive: a round joins only what the last one found, and
loops end when nothing is new, however deep the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.lineage import cut, written


def clean(edges: DataFrame) -> DataFrame:
    """Distinct edges with both ends."""
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def _grown(found: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """``found`` with one more table; many become one, so that plans stay small in deep graphs."""
    found = [*found, new]
    return [cut(reduce(DataFrame.union, found))] if len(found) > 16 else found


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(src, dst) for every dst that src reaches over one edge or more; with ``starts`` (src), from those alone."""
    edges = cut(clean(edges))
    step = edges.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
    new = edges if starts is None else cut(edges.join(starts.select("src").distinct(), "src"))
    found = [new]
    while not new.isEmpty():
        new = new.join(step, F.col("dst") == F.col("mid")).select("src", F.col("far").alias("dst")).distinct()
        new = cut(new.join(reduce(DataFrame.union, found), ["src", "dst"], "left_anti"))
        found = _grown(found, new)
    return reduce(DataFrame.union, found)


def impact(edges: DataFrame, critical: DataFrame) -> DataFrame:
    """(node, direct, dependents, critical_dependents): what rests on a node, itself left out."""
    reach = closure(edges).where("src <> dst")
    direct = edges.select("src", "dst").where("src <> dst").distinct().groupBy("dst").agg(F.count("*").alias("direct"))
    marked = critical.select(F.col("node").alias("src"), F.lit(1).alias("mark")).distinct()
    counted = reach.join(marked, "src", "left").groupBy("dst")
    counted = counted.agg(F.count("*").alias("dependents"), F.count("mark").alias("critical_dependents"))
    return counted.join(direct, "dst").select(F.col("dst").alias("node"), "direct", "dependents", "critical_dependents")


def impact_by_levels(levels: list[tuple[DataFrame, str, str]], critical: DataFrame) -> DataFrame:
    """``impact`` for a forest given level by level, from the leaves: (table, child, parent) with distinct children.

    Counts move up with one aggregation for each level, so nothing grows with the number of pairs.
    """
    below, out = None, None
    for table, child, parent in levels:
        edges = table.select(F.col(child).alias("node"), F.col(parent).alias("parent"))
        if below is None:
            marked = critical.select("node", F.lit(1).cast("long").alias("critical")).distinct()
            edges = edges.join(marked, "node", "left").select("node", "parent", F.lit(0).cast("long").alias("n"), F.coalesce("critical", F.lit(0)).alias("c"))
        else:
            had = below.select("node", F.col("dependents").alias("n"), F.col("critical_dependents").alias("c"))
            edges = edges.join(had, "node", "left").select("node", "parent", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", F.lit(0)).alias("c"))
        below = edges.groupBy(F.col("parent").alias("node")).agg(
            F.count("*").alias("direct"), F.sum(F.col("n") + 1).alias("dependents"), F.sum("c").alias("critical_dependents")
        )
        out = below if out is None else out.unionByName(below)
    return out


def _spread(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes that ``seeds`` (node, label) reach over ``edges`` (src, dst), with the smallest label that reaches each."""
    best = cut(seeds)
    new = best
    while not new.isEmpty():
        moved = new.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
        known = best.select("node", F.col("label").alias("old"))
        new = cut(moved.join(known, "node", "left").where("old is null or label < old").select("node", "label"))
        best = cut(best.unionByName(new).groupBy("node").agg(F.min("label").alias("label")))
    return best


def components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components; a component is its smallest node.

    Nodes without an edge in or out are components of one and go first. Of the others, each takes the smallest node
    that reaches it as its label; the nodes of a label that reach that node are its component. What is left goes on
    with the edges inside one label. No table holds pairs of a node with all that it reaches.
    """
    edges = clean(edges)
    nodes = edges.select("src").union(edges.select("dst")).toDF("node").distinct()
    left, found = cut(edges.where("src <> dst")), []
    while not left.isEmpty():
        inside = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        inside = cut(inside.join(inside.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if inside.count() < left.count():  # trim first
            left = inside
            continue
        labels = _spread(left.select("src").union(left.select("dst")).toDF("node").distinct().withColumn("label", F.col("node")), left)
        of_src, of_dst = (labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("src", "dst"))
        left = cut(left.join(of_src, "src").join(of_dst, "dst").where("src_label = dst_label").select("src", "dst", F.col("src_label").alias("label")))
        roots = labels.where("node = label")
        back = left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))  # stays inside one label
        done = _spread(roots, back)
        found.append(done.select("node", F.col("label").alias("component")))
        gone = done.select("node")
        left = left.join(gone, left["src"] == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti")
        left = cut(left.select("src", "dst"))
    if not found:
        return nodes.withColumn("component", F.col("node"))
    of = reduce(DataFrame.union, found)
    return nodes.join(of, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def taint(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, round): the nodes that rest on a seed, by the round that reached them first; seeds have round 0."""
    edges = cut(clean(edges))
    new = cut(seeds.select("node").distinct().withColumn("round", F.lit(0)))
    found, k = [new], 0
    while not new.isEmpty():
        k += 1
        new = edges.join(new, edges["dst"] == new["node"]).select(F.col("src").alias("node")).distinct()
        new = new.join(reduce(DataFrame.union, found).select("node"), "node", "left_anti")
        new = cut(new.withColumn("round", F.lit(k)))
        found = _grown(found, new)
    return reduce(DataFrame.union, found)


def frontier(edges: DataFrame, roots: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): the first nodes of another root that a walk from each start (node) reaches; roots has (node, root).

    A walk goes on only from nodes with edges of their own, so pairs with others are neither kept nor taken into a further round.
    """
    ways = edges.select("src").where("src is not null and dst is not null").distinct().select(F.col("src").alias("node"), F.lit(True).alias("goes"))
    here = roots.select(F.col("node").alias("src"), F.col("root").alias("src_root"))
    there = roots.join(ways, "node", "left").select(F.col("node").alias("dst"), F.col("root").alias("dst_root"), F.coalesce("goes", F.lit(False)).alias("goes"))
    home = F.col("src_root") == F.col("dst_root")
    edges = edges.select("src", "dst").where("src is not null and dst is not null").join(here, "src").join(there, "dst")
    # Edges lie by dst here, so that telling them apart takes no shuffle of its own.
    edges = written(edges.where(~home | F.col("goes")).select("src", "dst", home.alias("home")).distinct(), "frontier-edges")
    new = written(starts.select(F.col("node").alias("start"), "node").distinct(), "frontier-starts")
    seen, crossed = [new], []
    while not new.isEmpty():
        step = new.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), "home").distinct()
        step = written(step, "frontier-step")
        crossed = _grown(crossed, step.where("not home").select("start", "node"))
        new = step.where("home").select("start", "node").join(reduce(DataFrame.union, seen), ["start", "node"], "left_anti")
        new = written(new, "frontier-new")
        seen = _grown(seen, new)
    return reduce(DataFrame.union, crossed).distinct()


def returns_home(edges: DataFrame, roots: DataFrame, front: DataFrame) -> DataFrame:
    """(start, node) of ``front`` from which a walk comes back to a node of the start's root."""
    reach = closure(edges, front.select(F.col("node").alias("src")))
    of_start = roots.select(F.col("node").alias("start"), F.col("root").alias("home"))
    of_end = roots.select(F.col("node").alias("dst"), F.col("root").alias("away"))
    met = front.join(reach, F.col("node") == F.col("src")).join(of_start, "start").join(of_end, "dst")
    return met.where("home = away").select("start", "node").distinct()


def bases(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, basis) of ``nodes`` (key, own) that rest on each other by ``edges``; the basis of a node says what it and all that it rests on are.

    Nodes of a cycle are digested as one: the digest of a component is that of its members' own digests and of the
    bases outside that it rests on, both sorted, and a node's basis that of its own digest and its component's. A node
    without an own digest (null), or that isn't there though others rest on it, makes its basis, and those of all that
    rest on it, null: unknown. One round for each level of the graph; a level's children are digested in 256 buckets.
    """
    edges = clean(edges)
    of = components(edges)
    known = nodes.select(F.col("key").alias("node"), "own")
    member = cut(of.join(known, "node", "full").select("node", "own", F.coalesce("component", "node").alias("component")))
    groups = member.select(F.col("component").alias("parent"), "own")
    broken = groups.groupBy("parent").agg(F.max(F.col("own").isNull()).alias("broken"))
    inner = merkle_parents(groups.where("own is not null"), "parent", "own").withColumnRenamed("digest", "inner")
    todo = cut(broken.join(inner, "parent", "left").select(F.col("parent").alias("component"), "broken", "inner"))
    ends = [member.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")) for c in ("src", "dst")]
    rests = edges.join(ends[0], "src").join(ends[1], "dst").where("src_in <> dst_in").select("src_in", "dst", "dst_in").distinct()
    rests = cut(rests)
    found = member.select("node", F.lit(None).cast("string").alias("basis")).limit(0)
    while not todo.isEmpty():
        waits = rests.join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select(F.col("src_in").alias("component")).distinct()
        ready = cut(todo.join(waits, "component", "left_anti"))
        met = rests.join(ready.select(F.col("component").alias("src_in")), "src_in").join(found.select(F.col("node").alias("dst"), "basis"), "dst")
        lost = met.groupBy(F.col("src_in").alias("component")).agg(F.max(F.col("basis").isNull()).alias("lost"))
        outer = merkle_parents(met.where("basis is not null"), "src_in", "basis").select(F.col("parent").alias("component"), F.col("digest").alias("outer"))
        unknown = F.col("broken") | F.coalesce("lost", F.lit(False))
        whole = F.when(~unknown, node_digest(F.coalesce("inner", F.lit("")), F.coalesce("outer", F.lit(""))))
        group = ready.join(lost, "component", "left").join(outer, "component", "left").select("component", whole.alias("whole"))
        level = member.join(group, "component").select("node", F.when(F.col("whole").isNotNull(), node_digest("own", "whole")).alias("basis"))
        found = cut(found.unionByName(level))
        todo = cut(todo.join(ready, "component", "left_anti"))
    return found.select(F.col("node").alias("key"), "basis").join(nodes.select("key"), "key", "left_semi")


def merkle_parents(children: DataFrame, parent: str, digest: str) -> DataFrame:
    """(parent, digest): a digest of the sorted digests of the children.

    Children are first digested by the first two characters of their digests, so that no task gathers all children
    of a parent; the parent's digest is that of its at most 256 buckets.
    """
    buckets = children.groupBy(F.col(parent).alias("parent"), F.substring(digest, 1, 2).alias("bucket"))
    buckets = buckets.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(digest))), 256).alias("of"))
    rows = F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "of")))
    return buckets.groupBy("parent").agg(F.sha2(F.concat_ws("\n", rows), 256).alias("digest"))


def node_digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def freshness(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """(key, status) of each key, from (key, own, basis) tables of what holds now and of what was recorded.

    own is the digest of the node alone, basis that of the node with what it rests on: current if the bases are
    equal, stale if the node itself changed, upstream-stale if only what it rests on did; unverified without a record, and
    unknown where the basis now is null, as what it rests on can't be told.
    """
    both = now.join(recorded.select("key", F.col("own").alias("old_own"), F.col("basis").alias("old_basis")), "key", "left")
    status = (
        F.when(F.col("basis").isNull(), "unknown")
        .when(F.col("old_basis").isNull(), "unverified")
        .when(F.col("old_basis") == F.col("basis"), "current")
        .when(F.col("old_own") != F.col("own"), "stale")
        .otherwise("upstream-stale")
    )
    return both.select("key", status.alias("status"))
