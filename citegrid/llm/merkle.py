"""A Merkle manifest of a dataset: a leaf for each row, a tree for each group, and a tree of the groups' roots.

Nodes are hexadecimal sha256 digests; a node is the digest of its children's, put together. While a level has several nodes, every
``FAN`` consecutive ones become one, the last run with fewer, even with one alone.

The order of the leaves comes from ranges (see ``ranks``). A tree's leaves are cut into aligned blocks of ``FAN`` ** ``LEVELS``; what a
block holds is bounded, whatever the group. One pass finds the roots of the blocks; the levels above are joins and
aggregations over rows of nodes. Then each block is traversed: for each band of ``HEIGHT`` levels there is the existing subtree
over the leaf at hand and the desired one to its right, which grows by a few leaves with each proof that goes out. Paths
come out one after the other from at most two subtrees a band, and the proofs above the block, which came by a join, are put after them.

Defined results: null groups are a tree of their own, before the others; null ids come first in their tree; rows of one id follow
one another by their leaves, and equal rows have a leaf each; null fields are told from empty ones; very long texts are hashed
where they are read, and no text leaves that task; an empty table gives no rows; other columns aren't part of a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.llm import ranks, shared

FAN = 8
#: Levels below a block's root, and those of a subtree.
LEVELS, HEIGHT = 4, 2
BLOCK = FAN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "doc bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode("ascii")).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Subtree:
    """``levels`` levels of nodes from the nodes of level ``low`` up, over the leaves from ``begin`` on; it grows leaf by leaf.

    Below its levels it keeps a stack of runs that are not full, as many as there are levels.
    """

    def __init__(self, leaves: list[str], low: int, levels: int, number: int) -> None:
        self.leaves, self.low, self.top = leaves, low, low + levels
        span = FAN**self.top
        self.begin, self.end = number * span, min(len(leaves), (number + 1) * span)
        self.next = self.begin
        self.nodes: list[list[str]] = [[] for _ in range(levels + 1)]
        self.stack: list[list[str]] = [[] for _ in range(low)]
        self.closed = False

    def grow(self, n: int) -> None:
        for k in range(self.next, min(self.end, self.next + n)):
            self._put(0, self.leaves[k])
            self.next = k + 1
        if self.next >= self.end and not self.closed:
            self.closed = True
            self._close()

    def _put(self, level: int, node: str) -> None:
        if level >= self.low:
            kept = self.nodes[level - self.low]
            kept.append(node)
            if level < self.top and len(kept) % FAN == 0:
                self._put(level + 1, digest(kept[-FAN:]))
        else:
            run = self.stack[level]
            run.append(node)
            if len(run) == FAN:
                self.stack[level] = []
                self._put(level + 1, digest(run))

    def _close(self) -> None:
        """The runs at the right edge, which have fewer nodes."""
        for level in range(self.top):
            if level < self.low:
                run, self.stack[level] = self.stack[level], []
            else:
                nodes = self.nodes[level - self.low]
                run = nodes[len(nodes) // FAN * FAN :]
            if run:
                self._put(level + 1, digest(run))

    def siblings(self, level: int, leaf: int) -> tuple[list[str], list[str]]:
        """Those of the node of ``level`` over ``leaf``, to its left and to its right."""
        nodes = self.nodes[level - self.low]
        at = leaf // FAN**level - self.begin // FAN**level
        run = at // FAN * FAN
        return nodes[run:at], nodes[at + 1 : run + FAN]


def root_of(leaves: list[str], levels: int) -> str:
    tree = Subtree(leaves, levels, 0, 0)
    tree.grow(len(leaves))
    return tree.nodes[0][0]


def paths(leaves: list[str], levels: int) -> Iterator[list[tuple[list[str], list[str]]]]:
    """For each leaf in turn, its siblings at each level below the block's root."""
    bands = [(low, min(HEIGHT, levels - low)) for low in range(0, levels, HEIGHT)]
    existing = [Subtree(leaves, low, h, 0) for low, h in bands]
    for tree in existing:
        tree.grow(len(leaves))
    desired = [Subtree(leaves, low, h, 1) for low, h in bands]
    for leaf in range(len(leaves)):
        for k, (low, h) in enumerate(bands):
            if leaf and leaf % FAN ** (low + h) == 0:
                existing[k] = desired[k]
                desired[k] = Subtree(leaves, low, h, leaf // FAN ** (low + h) + 1)
            desired[k].grow(1)  # as many leaves as it has are read until its turn comes
        yield [existing[level // HEIGHT].siblings(level, leaf) for level in range(levels)]


def _levels_in(rows: pa.Table) -> int:
    n = rows["n_leaves"][0].as_py()
    return LEVELS if n > BLOCK else height(n)


def _block_root(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    top = root_of(rows["leaf"].to_pylist(), _levels_in(rows))
    return pa.table({"tree": [rows["tree"][0].as_py()], "idx": [rows["block"][0].as_py()], "node": [top]})


def _traversed(rows: pa.Table, above: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    leaves, changed = rows["leaf"].to_pylist(), rows["changed"].to_pylist()
    upper = [(x["before"], x["after"]) for x in above["path"][0].as_py()]
    subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
    tail = "".join(a + b for a, b in upper)
    proofs, folded = [], []
    for k, path in enumerate(paths(leaves, _levels_in(rows))):
        sides = [("".join(a), "".join(b)) for a, b in path]
        proofs.append(digest([a + b for a, b in sides] + [tail]))
        node = leaves[k] if changed[k] is None else changed[k]
        for a, b in [*sides, *upper]:
            node = digest([a, node, b])
        folded.append(node)
    n = len(leaves)
    return pa.table(
        {
            "doc": rows["doc"],
            "leaf": rows["leaf"],
            "subroot": pa.array([subroot] * n, pa.string()),
            "root": pa.array([root] * n, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([x == root for x in folded], pa.bool_()),
        }
    )


def _up(nodes: DataFrame) -> DataFrame:
    """The level above. A run has at most ``FAN`` nodes."""
    runs = nodes.groupBy("tree", F.expr(f"idx div {FAN}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("run"))
    return runs.select("tree", F.col("up").alias("idx"), F.sha2(F.array_join(F.transform("run", lambda x: x["node"]), "").cast("binary"), 256).alias("node"))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels from ``nodes`` up, until each tree has one node; a tree with one goes up no more."""
    out = [nodes]
    while out[-1].agg(F.max("idx")).first()[0]:
        marked = out[-1].withColumn("_last", F.max("idx").over(Window.partitionBy("tree")))
        out.append(shared.cut(_up(marked.where("_last > 0"))))
    return out


def _down(levels: list[DataFrame]) -> DataFrame:
    """(tree, idx, root, path) of the lowest level; path: the texts of the siblings before and after, from there to the root."""
    kind = "array<struct<before:string,after:string>>"
    found = None
    for level in reversed(levels):
        alone = level.withColumn("_n", F.max("idx").over(Window.partitionBy("tree"))).where("_n = 0")
        tops = alone.select("tree", "idx", F.col("node").alias("root"), F.expr(f"cast(array() as {kind})").alias("path"))
        if found is not None:
            side = lambda test: F.array_join(F.transform(F.filter("run", test), lambda x: x["node"]), "")
            runs = level.groupBy("tree", F.expr(f"idx div {FAN}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("run"))
            nodes = runs.join(found.select("tree", F.col("idx").alias("up"), "root", F.col("path").alias("above")), ["tree", "up"])
            nodes = nodes.select("*", F.explode("run").alias("own"))
            step = F.struct(side(lambda x: x["idx"] < F.col("own.idx")).alias("before"), side(lambda x: x["idx"] > F.col("own.idx")).alias("after"))
            nodes = nodes.select("tree", F.col("own.idx").alias("idx"), "root", F.concat(F.array(step), "above").alias("path"))
            tops = tops.unionByName(nodes)
        found = tops if level is levels[0] else shared.cut(tops)
    return found


def manifest(df: DataFrame, doc: str, columns: list[str], group: str, changed: list[Column] | None = None, when: Column | None = None) -> DataFrame:
    """(doc, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``df``.

    ``changed`` are the columns of a leaf after tampering, where ``when`` holds; ``folded_root`` is what the proof gives for it, and for the
    leaf itself elsewhere.
    """
    tampered = F.when(when, leaf_of(changed)) if changed is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    rows = df.select(tree.alias("tree"), F.col(doc).cast("long").alias("doc"), leaf_of([F.col(c) for c in columns]).alias("leaf"), tampered.alias("changed"))
    # Digests alone, written, so that texts are read and hashed once.
    leaves = ranks.ranged(shared.written(rows, "leaves"), "tree", ["doc", "leaf"], "leaves-ranged")
    earlier = ranks.before(leaves, "tree", {"n_before": F.lit(1)})
    local = Window.partitionBy(ranks.PART, "tree").orderBy("doc", "leaf").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranks.joined(leaves.withColumn("n", F.count("*").over(local)), earlier, "tree")
    pos = F.col("n") - 1 + F.coalesce("n_before", F.lit(0))
    placed = placed.select("tree", "doc", "leaf", "changed", pos.alias("pos"), F.expr(f"(n - 1 + coalesce(n_before, 0)) div {BLOCK}").alias("block"))
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n_leaves"))
    placed = shared.written(placed.join(sizes, "tree"), "leaves-placed")

    blocks = placed.select("tree", "block", "pos", "leaf", "n_leaves").groupBy("tree", "block")
    levels = _levels(shared.cut(blocks.applyInArrow(_block_root, "tree string, idx bigint, node string")))
    inner = _down(levels)

    # The groups' roots in their order are the lowest level of one more tree.
    subroots = inner.where("idx = 0").select(F.lit("").alias("one"), F.col("tree").alias("name"), F.col("root").alias("node"))
    roots = ranks.ranged(subroots, "one", ["name"], "subroots")
    before = ranks.before(roots, "one", {"n_before": F.lit(1)})
    local = Window.partitionBy(ranks.PART, "one").orderBy("name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    roots = ranks.joined(roots.withColumn("n", F.count("*").over(local)), before, "one")
    roots = shared.cut(roots.select(F.lit("").alias("tree"), (F.col("n") - 1 + F.coalesce("n_before", F.lit(0))).alias("idx"), "node", "name"))
    outer = _down(_levels(roots.drop("name"))).select("idx", "root", F.col("path").alias("above"))
    outer = roots.join(outer, "idx").select(F.col("name").alias("tree"), "root", "above")

    above = inner.select("tree", F.col("idx").alias("block"), F.col("root").alias("subroot"), "path").join(outer, "tree")
    above = above.select("tree", "block", "subroot", "root", F.concat("path", "above").alias("path"))
    found = placed.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(_traversed, FOUND)
    return found.withColumnRenamed("doc", doc)


def report(df: DataFrame, doc: str = "doc_id", group: str = "lang", text: str = "text", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """The manifest, with the texts of a third of the rows in lower case as the tampering that the proofs have to find."""
    changed = [F.translate(F.col(c), UPPER, LOWER) if c == text else F.col(c) for c in columns]
    when = F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 0
    return manifest(df, doc, list(columns), group, changed, when)
