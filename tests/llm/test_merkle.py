from __future__ import annotations

import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from citegrid.llm import merkle
from tests.llm import cases


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = []
    for x in levels[:-1]:
        run = at // 8 * 8
        out.append((x[run:at], x[at + 1 : run + 8]))
        at //= 8
    return out


def plain(rows):
    """The manifest of (doc_id, source, lang, n_chars, text), all in memory."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    own = {k: sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in names}
    trees = {k: tree([leaf(r) for r in own[k]]) for k in names}
    top = tree([trees[k][-1][0] for k in names])
    out = []
    for g, k in enumerate(names):
        for i, r in enumerate(own[k]):
            path = siblings(trees[k], i) + siblings(top, g)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            node = leaf((*r[:4], cases.lower(r[4]))) if tampered else leaf(r)
            for a, b in path:
                node = H(*a, node, *b)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], H(*(x for a, b in path for x in a + b)), node, node == top[-1][0]))
    return Counter(out)


def of(df):
    return [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in df.collect()]


def test_query_equals_the_plain_version(spark, sf_dir):
    from citegrid.llm import queries

    want = plain(of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    assert Counter(map(tuple, queries.op12_merkle_manifest(spark, sf_dir).collect())) == want


def test_awkward_rows(spark):
    odd = ["", None, "en", "En", "é", "😀", *[f"g{k}" for k in range(90)]]  # two levels of groups
    df = cases.frame(spark, cases.made()).withColumn("lang", F.element_at(F.array(*[F.lit(x) for x in odd]), (F.pmod(F.xxhash64("text"), F.lit(len(odd))) + 1).cast("int")))
    df = df.withColumn("source", F.when(F.col("doc_id") % 5 == 0, None).otherwise("")).withColumns({"n": F.lit(1), "leaf": F.lit("x"), "tree": F.lit("t")}).cache()
    assert Counter(map(tuple, merkle.report(df).collect())) == plain(of(df))


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65, 4095, 4096, 4097, 9000])
def test_trees_of_each_size(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.concat(F.lit("T"), F.col("id")).alias("text"))
    assert Counter(map(tuple, merkle.report(df).collect())) == plain(of(df))


def test_paths_hold_two_subtrees_a_band():
    leaves = [H(str(k)) for k in range(3000)]
    levels = tree(leaves)
    for at, path in enumerate(merkle.paths(leaves, merkle.height(len(leaves)))):
        assert path == siblings(levels, at)
    grown = merkle.Subtree(leaves, 2, 2, 0)
    for k in range(3000):
        grown.grow(1)
        assert all(len(run) < 8 for run in grown.stack)
    assert grown.nodes[0] == levels[2]


def test_equal_rows_fill_several_partitions(spark):
    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("Same").alias("text"))
    assert Counter(map(tuple, merkle.report(df).collect())) == plain(of(df))
