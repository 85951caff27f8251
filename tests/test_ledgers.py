"""The sweep of a ledger and topology contexts, on small cases written out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from citegrid.operators import findings, history, robots, sweep, topology, trees


@pytest.fixture(scope="module")
def swept(spark):
    make = spark.createDataFrame
    entries = make(
        [
            ("v1", "verification", "c1", "b1", False, ["1.2"], ["emulated"]), ("v2", "verification", "c1", "b2", False, ["9"], ["emulated"]), ("v3", "verification", "c1", "b1", False, ["7"], None),
            ("q1", "qualification", "c1", "b1", False, None, None), ("q2", "qualification", "c2", "b1", False, None, None), ("o1", "observation", "c1", "b3", False, ["1"], None),
            ("o2", "observation", "c1", "b9", False, ["3.1"], None), ("r1", "result", "c1", "b3", True, None, None), ("x", "verification", "c1", "b9", False, ["2"], ["kernel"]),
        ],
        "id string, kind string, claim string, basis string, superseded boolean, sections array<string>, evidence array<string>",
    )
    pins = make([("b3", "emu", "old"), ("b1", "spec", "s1"), ("b9", "kern", None), ("b9", "off", "a")], "basis string, source string, seen string")
    bases = make([("b1", ["5"]), ("b2", None), ("b3", []), ("b9", [])], "basis string, dependencies array<string>")
    sources = make([("emu", "emulator", "new", True), ("spec", "spec", "s2", True), ("kern", "kernel", "k2", True), ("off", "emulator", "b", False)], "source string, kind string, now string, ok boolean")
    changes = make([("spec", "s1", "s2", ["7.1", "4"], None, "spec-r2")], "source string, seen string, now string, sections array<string>, checks array<string>, since string")
    claims = make([("c1", ["3"], ["k"]), ("c2", None, None)], "claim string, cites array<string>, checks array<string>")
    citations = make([], "id string, source string, sections array<string>")
    contradictions = make([("o2", "hw", ""), ("gone", "hw", "d")], "observation string, conflict string, since string")
    premises = make([("c2", "o2")], "claim string, observation string")
    return {r["id"]: (r["state"], [tuple(x) for x in r["reasons"]]) for r in sweep.sweep(entries, pins, bases, sources, changes, claims, citations, contradictions, premises).collect()}


def test_states_and_their_reasons(swept):
    stale = ("cited emulated observation is stale", "o1", None)
    contested = lambda: ("premise observation contested", "o2", "index:o2")
    assert swept == {
        "v1": ("stale", [stale]),  # section 1.2 lies under the observation's 1
        "v2": ("stale", [stale, contested()]),  # a basis without dependencies uses all observations
        "v3": ("stale", [("spec changed in reviewed sections", "spec", "spec-r2")]),
        "q1": ("stale", [contested()]),  # the claim cites 3; the change of the spec doesn't meet it
        "q2": ("stale", [contested(), ("spec changed; unreviewed", "spec", "spec-r2")]),
        "o1": ("stale", [("emulator or guest changed", "emu", None)]),
        "o2": ("contested", [("hardware contradicts emulated observation", "hw", "")]),
        "r1": ("superseded", []),
        "x": ("stale", [("reference source changed", "kern", None)]),
    }


def test_contexts(spark):
    make = spark.createDataFrame
    specs = make([("boardA", "board"), ("boardB", "board"), ("soc1", "soc"), ("chip1", "chip"), ("chip2", "chip"), ("uart", "ip"), ("per", "peripheral"), ("far", "soc")], "spec string, kind string")
    parts = make([("boardA", "soc1"), ("boardA", "boardB"), ("soc1", "chip1"), ("chip1", "soc1"), ("boardB", "chip2")], "spec string, part string")
    instances = make([("chip1", "uart"), ("boardA", "missing")], "spec string, target string")
    describes = make([("per", "soc1"), ("soc1", "chip1")], "spec string, target string")
    connections = make(
        [
            ("a", "soc1", "chip2", "chip1", "p", "fixed"), ("b", "chip2", "chip2", "chip1", "p", "selectable"), ("c", "soc1", "boardB", "chip1", "p", "fixed"), ("d", "chip1", "chip1", "soc1", "q", "fixed"), ("e", "soc1", None, "soc1", "q", "fixed"),
            ("f", "per", "far", "per", "z", "fixed"),
        ],
        "record string, spec string, provider string, consumer string, port string, mode string",
    )
    focus = make([("boardA",), ("boardB",), ("nothing",)], "focus string")
    found = topology.admitted(specs, parts, instances, describes, connections, focus)
    got: dict[str, set] = {}
    for r in found.collect():
        got.setdefault(r["focus"], set()).add(r["spec"])
    assert got == {"boardA": {"boardA", "soc1", "chip1", "uart", "per", "chip2", "far"}, "boardB": {"boardB", "chip2", "chip1", "soc1"}}
    outside = topology.boundaries(found, connections)
    assert {tuple(r) for r in outside.collect()} == {("boardA", "c", "provider", "boardB")}
    slots = {tuple(r) for r in topology.crowded(found, connections, outside).collect()}
    assert slots == {("boardA", "chip1", "p", 1, 2), ("boardA", "soc1", "q", 2, 2), ("boardB", "chip1", "p", 2, 3), ("boardB", "soc1", "q", 2, 2)}
    picks = make([("cfg", "a"), ("cfg", "b"), ("cfg", "b"), ("cfg", "d")], "configuration string, record string")
    assert {tuple(r) for r in topology.chosen_twice(picks, connections).collect()} == {("cfg", "chip1", "p", 2)}


def test_first_differences(spark):
    cases = [
        ('{"a":1,"b":[1,2]}', '{"b":[1,2],"a":1}', None), ('{"a":null}', "{}", ".a"), ('{"a":[]}', '{"a":{}}', ".a"), ("[1,2,3]", "[1,2]", "[2]"), ('{"x":{"b":1,"a":2}}', '{"x":{"b":2,"a":3}}', ".x.a"),
        ('{"a":1}', '{"a":{"b":1}}', ".a"), ("1", '"1"', ""), (str(list(range(12))), str([*range(10), 99, 98]), "[10]"), ("{}", "{}", None), ("null", "0", ""), ("{}", '{"x":1}', ".x"), ("[]", "[null]", "[0]"), ('{"a":{"x":1}}', '{"a":[1]}', ".a"), ('{"b":1}', '{"a":1,"b":2}', ".b"), ('{"a":1,"ab":2}', '{"a":1,"ab":3}', ".ab"),
    ]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, e string, a string").select("k", F.parse_json("e").alias("e"), F.parse_json("a").alias("a"))
    assert {r["k"]: r["at"] for r in trees.first_difference(df, "k", "e", "a").collect()} == {k: c[2] for k, c in enumerate(cases)}


def test_findings_in_order(spark):
    rows = [("r", "a", k, 0, "error", "c1", f"m{k}") for k in range(8)] + [("r", "a", 3, 0, "error", "c0", "m3"), ("r", "a", None, 0, "warning", "c2", "x"), ("r", "A", 9, 1, "error", "c1", "z"), ("r", "a", 1, 0, "error", "c1", "m1")]
    df = spark.createDataFrame(rows, "root string, path string, line int, col int, level string, code string, message string")
    assert [(r["path"], r["line"]) for r in findings.ordered(df).collect()] == [("A", 9), ("a", None), *[("a", k) for k in range(8)]]
    roots = spark.createDataFrame([("r",), ("clean",)], "root string")
    assert {tuple(r) for r in findings.tallies(df, roots).collect()} == {("r", 9, 1, False), ("clean", 0, 0, True)}
    got = {r["code"]: (r["n"], r["details"]) for r in findings.details(df).collect()}
    assert got == {"c0": (1, ["a:3:m3"]), "c1": (8, ["A:9:z", "a:0:m0", "a:1:m1", "a:2:m2", "a:4:m4", "and 3 more"]), "c2": (1, ["a:-:x"])}
    ledger = spark.createDataFrame([("r", "documents", "one", "spec:chip"), ("r", "documents", "two", "spec:chip#no"), ("r", "documents", "three", "excluded: why")], "root string, grp string, name string, disposition string")
    cover = findings.coverage(ledger, spark.createDataFrame([("r", "chip"), ("q", "chip#no")], "root string, target string"))
    assert findings.summaries(cover).first()["summary"] == "documents 1 spec, 0 planned, 1 excluded, 1 unresolved; blocks 0 spec, 0 planned, 0 excluded"


def test_robots(spark):
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a/b", True), ("h", "/*.gif$", False), ("h", "/x", False), ("h", "/x", True), ("h", "", False), ("h", "/q?[", False), ("o", "*", False)], "host string, rule string, allow boolean")
    cases = {"/a": False, "/a/b/c": True, "/a/bc.gif": False, "/z.gif": False, "/z.gif2": True, "/x1": True, "/": True, "/q?[1": False, "/qq": True, "": True}
    pages = spark.createDataFrame([("h", p) for p in cases] + [("o", "/a/b"), ("none", "/a"), ("h", "/a")], "host string, path string")
    got = {(r["host"], r["path"]): r["allowed"] for r in robots.allowed(pages, rules).collect()}
    assert got == {("h", p): v for p, v in cases.items()} | {("o", "/a/b"): False, ("none", "/a"): True}


def test_histories(spark):
    rows = spark.createDataFrame([("a", k) for k in (1, 2, 2, 5, 9, None)] + [("b", 0), ("b", 1), ("c", 3)], "campaign string, revision int")
    got = {tuple(r) for r in history.revisions(rows).collect()}
    assert got == {("a", "repeated", "2"), ("a", "unnumbered", "1"), ("a", "missing", "3-4"), ("a", "missing", "6-8"), ("b", "early", "0"), ("c", "missing", "1-2")}
    slices = spark.createDataFrame([("a", "r1", 1, "x"), ("a", "r1", 2, "y"), ("a", "r2", 1, "x"), ("a", "r2", 2, "x"), ("a", "r2", 3, "z")], "campaign string, reading string, slice int, section string")
    sections = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "w")], "campaign string, section string")
    assert {tuple(r) for r in history.covers(slices, sections).collect()} == {("a", "r2", "repeated", "x"), ("a", "r2", "uncovered", "y"), ("a", "r2", "unknown", "z")}


def test_covers_without_sorting_rows(spark):
    """Slices and wanted sections are aggregated together; nulls are equal to nothing."""
    slices = spark.createDataFrame([("a", "r", 1, "x"), ("a", "r", 1, "x"), ("a", "r", 2, None), ("a", None, 1, "x"), (None, "r", 1, "x"), ("a", "r", None, "y"), ("a", "r", 3, "y")], "campaign string, reading string, slice int, section string")
    sections = spark.createDataFrame([("a", "x"), ("a", None), ("a", "y")], "campaign string, section string")
    found = history.covers(slices, sections)
    want = {("a", "r", "unknown", None), ("a", "r", "uncovered", None), ("a", None, "unknown", "x"), ("a", None, "uncovered", "x"), ("a", None, "uncovered", None), ("a", None, "uncovered", "y"), (None, "r", "unknown", "x")}
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan


def test_trees_are_made_once(spark):
    """The comparison of whole trees isn't put before what makes them."""
    made = spark.sparkContext.accumulator(0)

    def told(x):
        made.add(1)
        return x

    rows = spark.createDataFrame([(k, '{"a":1}', '{"a":%d}' % k) for k in range(4)], "k int, e string, a string")
    df = rows.select("k", F.parse_json(F.udf(told)("e")).alias("e"), F.parse_json("a").alias("a"))
    assert {r["k"]: r["at"] for r in trees.first_difference(df, "k", "e", "a").collect()} == {k: None if k == 1 else ".a" for k in range(4)}
    assert made.value == 4
