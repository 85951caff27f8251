from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from citegrid.functions import texts
from citegrid.operators import graph, headings, ordered, relations, scoring


def reach(edges):
    out = {}
    for start in {a for a, _ in edges}:
        seen, todo = set(), [start]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[start] = seen
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_impact_and_components(spark, seed):
    luck = random.Random(seed)
    edges = {(luck.randrange(12), luck.randrange(12)) for _ in range(16)}
    df = spark.createDataFrame(sorted(edges), "src bigint, dst bigint")
    far = reach(edges)
    assert {(r.src, r.dst) for r in graph.closure(df).collect()} == {(a, b) for a, bs in far.items() for b in bs}
    nodes = {x for e in edges for x in e}
    want = {n: min([n, *(m for m in far.get(n, ()) if n in far.get(m, ()))]) for n in nodes}
    assert {r.node: r.component for r in graph.components(df).collect()} == want
    critical = spark.createDataFrame([(k,) for k in range(0, 12, 3)], "node bigint")
    for r in graph.impact(df, critical).collect():
        on = {a for a, bs in far.items() if r.node in bs and a != r.node}
        assert (r.dependents, r.critical_dependents) == (len(on), sum(a % 3 == 0 for a in on))
        assert r.direct == len({a for a, b in edges if b == r.node and a != b})


def sha(*parts):
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def bucketed(digests):
    of = {b: sha(*sorted(d for d in digests if d[:2] == b)) for b in {d[:2] for d in digests}}
    return sha(*(f"{b}:{x}" for b, x in sorted(of.items()))) if of else ""


@pytest.mark.parametrize("seed", [1, 2])
def test_bases_equal_a_plain_version(spark, seed):
    """Cycles are digested as one; a node without a digest, and one that isn't there, make all that rests on them unknown."""
    luck = random.Random(seed)
    own = {f"n{k}": None if k == 5 else sha(str(k)) for k in range(14)}
    edges = {(f"n{a}", f"n{b}") for a, b in ((luck.randrange(14), luck.randrange(15)) for _ in range(18))}
    far = reach(edges)
    found = graph.bases(spark.createDataFrame(list(own.items()), "key string, own string"), spark.createDataFrame(sorted(edges), "src string, dst string"))
    known = {}

    def basis(node):
        if node not in known:
            group = {node, *(m for m in far.get(node, ()) if node in far.get(m, ()))}
            outside = [basis(b) for b in sorted({b for a, b in edges if a in group and b not in group})]
            bad = any(own.get(m) is None for m in group) or None in outside
            known[node] = None if bad else sha(own[node], sha(bucketed([own[m] for m in group]), bucketed(outside)))
        return known[node]

    assert {r.key: r.basis for r in found.collect()} == {n: basis(n) for n in own}


def test_frontier_and_returning_home(spark):
    roots = spark.createDataFrame([(n, n[0]) for n in ("a1", "a2", "a3", "b1", "b2", "c1")], "node string, root string")
    edges = spark.createDataFrame([("a1", "a2"), ("a2", "a1"), ("a2", "b1"), ("b1", "c1"), ("c1", "a3"), ("a3", "b2"), ("a1", "zz")], "src string, dst string")
    starts = spark.createDataFrame([("a1",), ("b1",), ("a3",)], "node string")
    front = graph.frontier(edges, roots, starts)
    assert {tuple(r) for r in front.collect()} == {("a1", "b1"), ("b1", "c1"), ("a3", "b2")}
    assert {tuple(r) for r in graph.returns_home(edges, roots, front).collect()} == {("a1", "b1"), ("b1", "c1")}


def test_frontier_goes_on_from_nodes_with_edges_alone(spark, monkeypatch):
    kept, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: kept.append((name, written(df, name))) or kept[-1][1])
    dice = random.Random(5)
    root = {n: n % 3 for n in range(60)}
    pairs = [(dice.randrange(40), dice.randrange(60)) for _ in range(150)]  # nodes from 40 on have no edges of their own
    edges = spark.createDataFrame(pairs * 2 + [(None, 1), (1, None)], "src long, dst long")
    roots = spark.createDataFrame(list(root.items()), "node long, root long")
    got = {tuple(r) for r in graph.frontier(edges, roots, roots.select("node")).collect()}
    want = set()
    for start in root:
        seen, todo = {start}, [start]
        while todo:
            here = todo.pop()
            for a, b in pairs:
                if a == here and root[b] != root[here]:
                    want.add((start, b))
                elif a == here and b not in seen:
                    seen.add(b)
                    todo.append(b)
    assert got == want and len(want) > 100
    new = [df for name, df in kept if name == "frontier-new"]
    assert all(r.node < 40 for df in new for r in df.collect())


def test_deep_chains_settle(spark):
    """No number of rounds is too many."""
    df = spark.createDataFrame([(k, k + 1) for k in range(66)], "src bigint, dst bigint")
    found = graph.taint(df, spark.createDataFrame([(66,)], "node bigint"))
    assert {(r.node, r.round) for r in found.collect()} == {(k, 66 - k) for k in range(67)}


def test_merkle_parents_and_freshness(spark):
    digests = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(50)]
    df = spark.createDataFrame([(k % 2, d) for k, d in enumerate(digests)], "p int, d string")
    found = {r.parent: r.digest for r in graph.merkle_parents(df, "p", "d").collect()}
    for p in (0, 1):
        mine = sorted(d for k, d in enumerate(digests) if k % 2 == p)
        buckets = {b: hashlib.sha256("\n".join(d for d in mine if d[:2] == b).encode()).hexdigest() for b in {d[:2] for d in mine}}
        assert found[p] == hashlib.sha256("\n".join(f"{b}:{x}" for b, x in sorted(buckets.items())).encode()).hexdigest()
    now = spark.createDataFrame([("a", "1", "1"), ("b", "2", "9"), ("c", "8", "7"), ("d", "1", "1")], "key string, own string, basis string")
    old = spark.createDataFrame([("a", "1", "1"), ("b", "2", "3"), ("c", "3", "4")], "key string, own string, basis string")
    assert {r.key: r.status for r in graph.freshness(now, old).collect()} == {"a": "current", "b": "upstream-stale", "c": "stale", "d": "unverified"}
    lost = now.withColumn("basis", F.when(F.col("key") != "a", F.col("basis")))
    assert {r.key: r.status for r in graph.freshness(lost, old).collect()}["a"] == "unknown"


def test_overlaps_equal_brute_force(spark):
    luck = random.Random(3)
    rows = [(luck.randrange(3), k, b := luck.randrange(100), b + luck.randrange(-1, 40), luck.choice([None, "x", "y"])) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, id int, b int, e int, c string")
    got = {(r.k, r.a, r.b) for r in relations.overlaps(df, "k", "b", "e", "id", "c", 16).collect()}
    want = {
        (x[0], x[1], y[1])
        for x in rows
        for y in rows
        if x[0] == y[0] and x[1] < y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3] and (x[4] is None or y[4] is None or x[4] == y[4])
    }
    assert got == want


def test_resolution_reasons(spark):
    refs, targets = spark.createDataFrame([(1,), (2,), (3,), (None,)], "r int"), spark.createDataFrame([(1,), (2,), (2,)], "t int")
    assert {r.r: r.why for r in relations.resolve(refs, "r", targets, "t").collect()} == {1: "ok", 2: "ambiguous", 3: "missing", None: "missing"}


def test_wraps_and_last_known(spark):
    rows = [(1, k, v, t) for k, (v, t) in enumerate([(3, "a"), (1, "a"), (0, "a"), (2, "a"), (1, "reset"), (5, "a"), (4, "a")])]
    df = spark.createDataFrame(rows, "k int, at int, v int, t string")
    found = ordered.wraps(df, "k", ["at"], "v", F.col("t") == "reset").collect()
    assert {r.segment: r.wraps for r in found} == {0: 1, 1: 1}
    known = ordered.last_known(df, "k", ["at"], F.when(F.col("v") > 2, F.col("v")), F.col("t") == "reset", "big").orderBy("at").collect()
    assert [r.big for r in known] == [3, 3, 3, 3, None, 5, 4]


def test_tally_rates_and_credit(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("c", True)], "s string, ok boolean")
    assert {r.s: r.n for r in scoring.tally(df, "s", ["a", "b"]).collect()} == {"a": 2, "b": 0}
    rates = {r.s: r.rate for r in scoring.pass_rates(df, ["s"], F.col("ok")).collect()}
    assert rates == {"a": "50%", "c": "100%", None: "67%"}
    cases = [
        (["correct", "contradicted"], ("misstated", 0, 1)), (["pending", "correct"], ("pending", 0, 1)), (["correct"], ("covered", 1, 1)), (["absent"], ("missing", 0, 1)),
        (["correct", "absent", "absent"], ("partial", 1, 3)), (["other"], ("partial", 1, 2)),
    ]
    df = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(cases)], "k int, s array<string>")
    assert {r.k: tuple(r.c) for r in df.select("k", scoring.credit(F.col("s")).alias("c")).collect()} == {k: c for k, (_, c) in enumerate(cases)}


def test_markdown_sections(spark):
    text = "# One\n## Two\n```\n# no\n```\n### Three ##\n## Four\n#not\n# Five"
    found = headings.sections(headings.of_markdown(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t"), "k").collect()
    assert [(r.level, r.title, r.end_ord, r.parent_ord) for r in found] == [(1, "One", 4, None), (2, "Two", 3, 0), (3, "Three", 3, 1), (2, "Four", 4, 0), (1, "Five", 5, None)]


def test_text_functions(spark):
    df = spark.createDataFrame([("mask 0xDEAD_beef and 0x'10, 0x1", "HTTPS://Ex.org:443/a?b#c", "someCamelHTTPName", "error 'x' in a/b.txt line 12 0xFF")], "t string, u string, n string, m string")
    r = df.select(
        texts.hex_literals(F.col("t")).alias("h"), texts.url_key(F.col("u")).alias("u"), texts.camel_words(F.col("n")).alias("c"), texts.message_slug(F.col("m")).alias("s"),
        texts.hex_value(F.lit("0xFFFFFFFFFFFFFFFF")).alias("big"), texts.hex_value(F.lit("0x1FFFFFFFFFFFFFFFF")).alias("none"), texts.duration_seconds(F.lit("15m")).alias("d"),
        texts.bit_length(F.lit(0)).alias("b0"), texts.bit_length(F.lit(255)).alias("b8"),
    ).first()
    assert r.h == ["0xDEADbeef", "0x1"] and r.u == "https://ex.org/a?b" and r.c == ["some", "Camel", "HTTP", "Name"] and r.s == "msg-error-in-line"
    assert (int(r.big), r.none, r.d, r.b0, r.b8) == (2**64 - 1, None, 900, 0, 8)


def test_licence_expressions():
    from citegrid.functions import spdx

    allowed = ("MIT", "Apache-2.0")
    many = " AND ".join(f"(MIT OR other{k})" for k in range(40))
    for text, want in (("mit", True), ("MIT AND APACHE-2.0", True), (many, True), (many + " AND other", False), ("MIT OR GPL-2.0-only AND GPL-3.0-only", True), ("(MIT OR x) AND y", False), ("x WITH y OR MIT", True), ("(" * 32 + "MIT" + ")" * 32, True), ("(" * 33 + "MIT" + ")" * 33, False), ("MIT WITH", False), ("MIT)", False), ("", False), (None, False), ("MIT OR", False), ("MIT MIT", False), ("a/b OR MIT", False)):
        assert spdx.accepted(text, allowed) is want, text
    assert spdx.accepted("LicenseRef-x OR MIT", allowed) and not spdx.accepted("LicenseRef-x OR MIT", allowed, "public")
    assert not spdx.accepted("DocumentRef-a:LicenseRef-x OR MIT", allowed, "public") and not spdx.accepted("MIT", (*allowed, "LicenseRef-x"), "public")
    assert spdx.accepted("MIT OR gpl-2.0", allowed, None, ("mit", "GPL-2.0")) and not spdx.accepted("MIT OR made-up", allowed, None, ("MIT",))


def test_section_numbers(spark):
    cases = {
        "12 MHz clock": None, "64 bit mode": None, "8 x USB": None, "5 V supply": None, "100 % duty": None, "3 mA load": None, "9 ns setup": None, "7 V.": None, "3": None, "Overview": None,
        "3 Registers": "3", "4.2 Reset": "4.2", "1 A Note": "1", "2 B Channel": "2", "4 V Series": "4", "2 A/D Converter": "2", "5 V-Bus": "5", "A.1 Foo": "A.1", "Chapter 7.2: Timing": "7.2", "part 9. Overview": "Part 9",
    }
    df = spark.createDataFrame(list(cases), "string").toDF("t")
    assert {r.t: r.n for r in df.select("t", texts.section_number(F.col("t")).alias("n")).collect()} == cases


def test_claims_bind_by_document_whatever_its_rows(spark, tmp_path):
    from citegrid.plans import texts as plans

    ids = [f"name{c}{d}" for c in "abcde" for d in "vw"]
    spark.createDataFrame([(1, " ".join(ids)), (None, "none such")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(7, " ".join(ids[:5])), (7, " ".join(ids[5:])), (7, ids[0]), (8, " ".join(ids[:8])), (None, " ".join(ids)), (9, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in plans.claim_binding(spark, str(tmp_path)).collect()} == {(1, 7, 10, 10), (1, None, 10, 10)}
    assert {tuple(r) for r in plans.leak_scan(spark, str(tmp_path)).collect()} == {(None, 1)}
