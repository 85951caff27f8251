"""Corpora read from files, the references and citations in them, against what the files say."""

from __future__ import annotations

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from citegrid.operators import citations, composition, references
from citegrid.sources import corpus

FACT = {
    "id": "reset",
    "critical": True,
    "support": [{"class": "inference", "premises": [{"fact": "#clock"}, {"fact": "chip@vendor#mode"}, {"note": 1}]}, {"class": "src", "anchors": [{"repo": "linux", "path": "a.c"}]}],
    "conflict": {"sides": [{"settled_by": [{"class": "emulated", "observation": "chip#seen"}]}]},
    "relates": [{"relation": "refines", "fact": "#reset"}],
    "data": {"pair": {"impl": [{"repo": "linux", "path": "b.c"}]}, "register": {"name": "R"}, "fields": [{"id": "en", "support": [{"class": "databook", "doc": "trm"}]}, {"id": "rest"}]},
}
TOPOLOGY = {"id": "wire", "data": {"connection": {"provider": {"node": "#clock"}, "consumer": {"port": "p"}}, "selection": {"selects": "chip@later#x"}}}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    put = lambda at, text: (top / at).parent.mkdir(parents=True, exist_ok=True) or (top / at).write_text(text)
    put("docs/board-specs.yaml", "format: 2\nlayer: public\nname: docs\nlicense: CC-BY-4.0\naccepts: [MIT]\n")
    put("docs/chip.spec.yaml", "id: chip\nfacts:\n- id: clock\n- id: mode\n  support: []\n- id: twice\n- id: twice\nresources:\n  repos:\n  - {name: linux, license: GPL-2.0-only, files: [a.c]}\n")
    put("docs/sub/wide.spec.yaml", json.dumps({"id": "wide", "facts": [FACT, TOPOLOGY, {"id": "clock"}, {"title": "no id"}], "assumptions": [{"id": "warm"}], "resources": {"documents": [{"name": "trm", "class": "databook"}, {"name": "trm", "class": "databook"}]}}))
    put("docs/sub/board-specs.yaml", "name: inner\n")
    put("docs/other.spec.yml", "id: other\n")
    put("vendor/board-specs.yaml", "format: 2\nlayer: product\nname: vendor\n")
    put("vendor/chip.spec.yaml", "id: chip\nfacts: [{id: mode}]\n")
    put("vendor/bad.spec.yaml", "id: bad\nfacts: [{id: x}\n")
    return str(top)


def test_files_roots_and_specs(spark, tree):
    files = corpus.files(spark, [f"{tree}/docs"], [f"{tree}/vendor"])
    got = {(r["root_ord"], r["path"]): (r["kind"], r["code"]) for r in files.collect()}
    assert got[0, "board-specs.yaml"] == ("marker", None) and got[0, "sub/board-specs.yaml"] == (None, "misplaced")
    assert got[0, "other.spec.yml"] == (None, "misplaced") and got[1, "bad.spec.yaml"] == ("spec", "syntax")
    roots = {r["name"]: (r["context"], r["layer"], r["rank"], r["trusted"]) for r in corpus.roots(files).collect()}
    assert roots == {"docs": (False, "public", 0, False), "vendor": (True, "product", 3, False)}
    assert {(r["root"], r["path"], r["spec"]) for r in corpus.specs(files).collect()} == {("docs", "chip.spec.yaml", "chip"), ("docs", "sub/wide.spec.yaml", "wide"), ("vendor", "chip.spec.yaml", "chip")}


@pytest.fixture(scope="module")
def entries(spark, tree):
    return corpus.entries(corpus.specs(corpus.files(spark, [f"{tree}/docs"], [f"{tree}/vendor"]))).cache()


def test_entries_children_and_supports(entries):
    got = {(r["root"], r["spec"], r["family"], r["name"], r["nth"]): r["copies"] for r in entries.collect()}
    assert got["docs", "chip", "fact", "twice", 1] == got["docs", "chip", "fact", "twice", 2] == 2
    assert got["docs", "wide", "document", "trm", 1] == 2 and got["docs", "wide", "assumption", "warm", 1] == 1
    assert sum(1 for k in got if k[2] == "fact") == 8
    supported = {(r["name"], r["s"]) for r in entries.where("spec = 'wide' or name = 'mode'").where("family = 'fact'").select("name", corpus.has_support(F.col("data")).alias("s")).collect()}
    assert ("reset", True) in supported and ("mode", False) in supported and ("wire", False) in supported
    inner = {(r["name"], r["part"], r["ord"], r["own"]) for r in corpus.children(entries).collect()}
    assert inner == {("reset", "fields", 0, True), ("reset", "fields", 1, False)}
    found = {(r["name"], r["at"], r["class"]) for r in corpus.supports(entries).collect()}
    assert found == {
        ("reset", ".support[0]", "inference"), ("reset", ".support[1]", "src"), ("reset", ".conflict.sides[0].settled_by[0]", "emulated"),
        ("reset", ".data.fields[0].support[0]", "databook"), ("reset", ".data.pair.impl", "src"),
    }
    at = {(r["at"], r["repo"], r["file"]) for r in corpus.anchors(corpus.supports(entries)).collect()}
    assert at == {(".support[1].anchors[0]", "linux", "a.c"), (".data.pair.impl[0]", "linux", "b.c")}


def test_references_in_three_scopes(spark, entries):
    roots = spark.createDataFrame([("docs", 0, True), ("vendor", 3, True), ("later", 4, False)], "name string, rank int, trusted boolean")
    refs = corpus.references(entries, corpus.supports(entries))
    found = references.resolve(refs, entries.where("family = 'fact'"), roots)
    got = {(r["kind"], r["ref"]): (r["status"], r["to_root"], r["to_path"], r["to_fact"]) for r in found.collect()}
    assert got == {
        ("premise", "#clock"): ("ok", "docs", "sub/wide.spec.yaml", "clock"),
        ("premise", "chip@vendor#mode"): ("ok", "vendor", "chip.spec.yaml", "mode"),
        ("observation", "chip#seen"): ("missing", None, None, None),
        ("relates", "#reset"): ("ok", "docs", "sub/wide.spec.yaml", "reset"),
        ("topology-provider", "#clock"): ("ok", "docs", "sub/wide.spec.yaml", "clock"),
        ("topology-selects", "chip@later#x"): ("untrusted", None, None, None),
    }
    broken = {(r["kind"], r["ref"], r["rule"]) for r in references.rules(found, roots).collect()}
    assert broken == {("premise", "chip@vendor#mode", "later-layer"), ("observation", "chip#seen", "missing"), ("relates", "#reset", "self"), ("topology-selects", "chip@later#x", "untrusted")}


@pytest.mark.parametrize(
    ("ref", "status"),
    [("#twice", "ambiguous"), ("chip#twice", "ambiguous"), ("chip@docs#mode", "ok"), ("chip@vendor#mode", "untrusted"), ("chip@gone#mode", "missing"), ("chip@two#mode", "ambiguous"), ("Chip#mode", "invalid"), ("mode", "invalid"), ("a#b#c", "invalid"), ("#", "invalid")],
)
def test_reasons(spark, entries, ref, status):
    roots = spark.createDataFrame([("docs", 0, False), ("vendor", 0, False), ("two", 0, True), ("two", 1, True)], "name string, rank int, trusted boolean")
    refs = spark.createDataFrame([("docs", "chip.spec.yaml", "chip", "mode", "relates", None, ".x", ref, None)], "root string, path string, spec string, name string, kind string, scope string, at string, ref string, relation string")
    facts = entries.where("family = 'fact'")
    assert references.resolve(refs, facts, roots).first()["status"] == status
    unread = roots.unionByName(spark.createDataFrame([(None, 0, False)], roots.schema))
    assert references.resolve(refs, facts, unread).first()["status"] == ("untrusted" if "@" in ref else status)


def test_reach_is_the_closure_s(spark):
    luck = random.Random(4)
    nodes = [f"n{k}" for k in range(60)]
    edges = [(luck.choice(nodes), luck.choice(nodes)) for _ in range(90)] + [("n0", "n0")]
    names = [f"L{k}" for k in range(70)]  # more than a long has bits
    own = [(x, luck.randrange(5), luck.choice([None, *names])) for x in nodes for _ in range(2)]
    lost = luck.sample(nodes, 4)
    got = references.reach(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(own, "node string, low int, element string"), names, spark.createDataFrame([(x,) for x in lost], "node string"))
    step = defaultdict(set)
    for a, b in edges:
        step[a].add(b)
    for r in got.collect():
        seen, todo = {r["node"]}, [r["node"]]
        while todo:
            for y in step[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        have = [x for x in own if x[0] in seen]
        assert (r["low"], r["elements"], r["open"]) == (min(x[1] for x in have), sorted({x[2] for x in have if x[2]}), bool(seen & set(lost)))


def test_citations_of_sections(spark):
    rows = [(0, 1, "1", "One", 1, 9), (1, 2, "1.2", "Timing", 2, 4), (2, 3, None, "Deep", 4, 4), (3, 2, "1.3", "Next", 4, 6), (4, 1, "A", "Appendix", 9, 12)]
    sections = spark.createDataFrame([("trm", *r) for r in rows], "document string, ord int, level int, number string, title string, begin int, end int")
    assert {r["ord"]: r["above"] for r in citations.placed(sections).collect()} == {0: [], 1: [0], 2: [0, 1], 3: [0], 4: []}
    cites = [
        ("number", None, "1.2.7", None, [11]), ("dots", None, "11", None, None), ("title", "tIMING", None, None, None), ("heading", None, None, "Appendix", None), ("folded", None, None, "appendix", [12]),
        ("begins", None, None, None, [4]), ("inside", None, None, None, [3, 5, 5]), ("edge", None, None, None, [9]), ("none", None, None, None, [99]),
    ]
    df = spark.createDataFrame([(c[0], "trm", *c[1:]) for c in cites], "fact string, document string, section string, number string, heading string, pages array<int>")
    got = defaultdict(set)
    for r in citations.linked(df, sections).collect():
        got[r["fact"]].add(r["ord"])
    assert got == {"number": {0, 1}, "title": {0, 1}, "heading": {4}, "folded": {4}, "begins": {0, 1, 2}, "inside": {0, 1, 3}, "edge": {4}}
    indexes = spark.createDataFrame([("trm", "b.index.yaml"), ("trm", "trm.index.yaml"), ("x", "b.index.yaml"), ("x", "a.index.yaml")], "document string, file string")
    assert {tuple(r) for r in citations.canonical(indexes).collect()} == {("trm", "trm.index.yaml"), ("x", "a.index.yaml")}
    text = citations.linked(df, sections)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_composition(spark):
    specs = spark.createDataFrame([("a", "board", 0, ["x", "x", "a"]), ("b", "chip", 2, ["x"]), ("c", "ip", 4, None), ("d", "peripheral", 1, ["a"]), ("e", "soc", 0, []), ("e", "soc", 0, [])], "spec string, kind string, rank int, aliases array<string>")
    assert {(r["name"], tuple(r["owners"])) for r in composition.clashes(specs).collect()} == {("x", ("a", "b")), ("a", ("a", "d")), ("e", ("e",))}
    links = [("a", "parts", "b"), ("a", "parts", "a"), ("a", "parts", "c"), ("c", "parts", "b"), ("a", "parts", "gone"), ("a", "parts", "e"), ("a", "instance", "c"), ("a", "instance", "b"), ("d", "describes", "b"), ("d", "describes", "a"), ("a", "overlays", "c"), ("a", "odd", "zz"), ("a", "odd", "zz")]
    got = {tuple(r) for r in composition.broken(spark.createDataFrame(links, "spec string, relation string, target string"), specs).collect()}
    assert got == {
        ("a", "parts", "a", "self"), ("a", "parts", "c", "to-kind"), ("c", "parts", "b", "from-kind"), ("a", "parts", "gone", "dangling"), ("a", "parts", "e", "ambiguous"), ("a", "instance", "b", "to-kind"),
        ("d", "describes", "b", "later-layer"), ("a", "overlays", "c", "later-layer"), ("a", "odd", "zz", "unknown-relation"),
    }


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_files_list_is_found_without_a_shuffle(spark):
    """Entries, supports and references are made file by file; shuffled with their trees, they were several times the input."""
    specs = spark.createDataFrame([("docs", "wide.spec.yaml", "wide", json.dumps({"id": "wide", "facts": [FACT, TOPOLOGY]}))], "root string, path string, spec string, record string")
    entries = corpus.entries(specs)
    for df in (entries, corpus.supports(entries), corpus.anchors(corpus.supports(entries)), corpus.references(entries)):
        assert "Exchange" not in _plan(df) and "Sort" not in _plan(df)
    key = ["name", "kind", "scope", "at", "ref", "relation"]
    apart = corpus.references(entries, corpus.supports(entries)).select(*key).collect()
    assert sorted(map(str, corpus.references(entries).select(*key).collect())) == sorted(map(str, apart)) and len(apart) == 6
    roots = spark.createDataFrame([("docs", 0, True)], "name string, rank int, trusted boolean")
    found = _plan(references.resolve(corpus.references(entries), entries.where("family = 'fact'"), roots))
    assert found.count("Exchange hashpartitioning") == 3  # references, names of facts, and names of roots


def test_copies_and_supports_at_odd_places(spark):
    one = {"class": "src"}
    facts = [
        {"id": "a", "support": [one, [one], None]}, {"id": "b", "support": {"support": [one]}}, {"id": "a"}, {"id": "c", "conflict": {"settled_by": [one]}, "note": 'x"support":['},
        {"id": "d", "support": [{"class": "x", "support": [{"deep": [{"settled_by": [one, one]}]}]}]}, {"id": "a"}, {"id": "e", "support\"": 1, "support": [one]}, {"id": "f", "data": {"pair": [one]}},
    ]
    record = {"id": "s", "facts": facts, "instances": [{"id": "a"}, {"id": "b"}], "assumptions": [{"id": "a"}, {"name": "none"}, 3], "resources": {"repos": {"x": {"name": "a"}}}}
    specs = spark.createDataFrame([("r", "p", "s", json.dumps(record)), ("r", "q", "t", json.dumps({"facts": [{"id": "a"}]})), ("r", "z", "u", "{}"), ("r", "y", "v", "[1]")], "root string, path string, spec string, record string")
    entries = corpus.entries(specs)
    got = sorted((r["spec"], r["family"], r["ord"], r["name"], r["copies"], r["nth"]) for r in entries.collect())
    assert got == sorted([
        ("s", "fact", 0, "a", 4, 1), ("s", "fact", 2, "a", 4, 2), ("s", "fact", 5, "a", 4, 3), ("s", "instance", 0, "a", 4, 4), ("s", "fact", 1, "b", 2, 1), ("s", "instance", 1, "b", 2, 2),
        ("s", "fact", 3, "c", 1, 1), ("s", "fact", 4, "d", 1, 1), ("s", "fact", 6, "e", 1, 1), ("s", "fact", 7, "f", 1, 1), ("s", "assumption", 0, "a", 1, 1), ("s", "repo", 0, "a", 1, 1), ("t", "fact", 0, "a", 1, 1),
    ])
    at = sorted((r["name"], r["at"], r["class"]) for r in corpus.supports(entries).where("spec = 's'").collect())
    deep = ".support[0].support[0].deep[0].settled_by"
    assert at == [
        ("a", ".support[0]", "src"), ("a", ".support[1]", None), ("a", ".support[2]", None), ("b", ".support.support[0]", "src"), ("c", ".conflict.settled_by[0]", "src"), ("d", ".support[0]", "x"),
        ("d", ".support[0].support[0]", None), ("d", f"{deep}[0]", "src"), ("d", f"{deep}[1]", "src"), ("e", ".support[0]", "src"),
    ]


def test_links_are_counted_without_a_row_for_each(spark):
    """Facts that say the same are looked up once, and sections aren't broadcast; all links of all facts were made before."""
    luck = random.Random(7)
    rows = [(d, k, luck.randint(1, 4), luck.choice(["1", "2", "1.2", None]), luck.choice(["Timing", "Pins", "x"]), b := luck.randint(1, 40), b + luck.randint(-1, 9)) for d in ("a", "b") for k in range(30)]
    sections = spark.createDataFrame(rows, "document string, ord int, level int, number string, title string, begin int, end int")
    pick = lambda *of: luck.choice([None, *of])
    cites = [(luck.randrange(60), luck.choice("ab"), pick("TIMING", "none"), pick("1.2.3", "2", "9"), pick("Pins"), pick([luck.randint(1, 45)], [3, 3, 9], [])) for _ in range(200)]
    df = spark.createDataFrame(cites, "fact long, document string, section string, number string, heading string, pages array<int>")
    want = citations.linked(df, sections).groupBy("document", "ord").agg(F.count("*").alias("facts"), F.min("fact").alias("first_fact"))
    got = citations.counted(df, sections)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    same = spark.range(3000).selectExpr("id fact", "'a' document", "cast(null as string) section", "'1.2.3' number", "cast(null as string) heading", "array(1) pages")
    found = citations.counted(same, sections)
    assert {r["facts"] for r in found.collect()} == {3000}
    assert "Broadcast" not in _plan(found)


def _odd_files() -> list[str]:
    """Records as they mostly are, and such whose lists stand elsewhere, are objects or are hidden by escapes."""
    premises = [{"fact": "#a"}, {"fact": "#a"}, {"note": 1}, 3, {"fact": "s0#b"}]
    one, src = {"class": "inference", "premises": premises}, {"class": "src", "anchors": [{"repo": "x"}, {"repo": 4}, 1]}
    plain = [
        {"id": "a", "support": [one, src, None], "relates": [{"fact": "#b", "relation": "r"}, {"fact": "#b", "relation": "q"}, {"fact": "#b", "relation": "r"}, {}]}, {"id": "a", "support": [one]}, {"support": [one]},
        {"id": "b", "conflict": {"settled_by": [{"class": "emulated", "observation": "#gone"}]}, "data": {"pair": {"impl": [{"repo": "y"}], "none": 2}, "selection": {"selects": "#a"}}}, {"id": 7}, 5,
    ]
    odd = [
        {"id": "a", "support": {"support": [one]}}, {"id": "b", "note": {"settled_by": [one]}}, {"id": "c", "relates": {"k": {"fact": "#a"}}}, {"id": "d", "support": [{"class": "inference", "premises": {"k": {"fact": "#a"}}}]},
        {"id": "e", "support": [{"class": "x", "support": [one]}]}, {"id": "f", "data": 3, "conflict": [one]}, {"id": "g", "note": 'x"support":[', "support": [src]}, {"id": "support", "support": [one]},
    ]
    files = [{"facts": plain, "instances": plain[:1] + [{"id": "i", "support": [one]}]}, *[{"facts": [*plain, x]} for x in odd], {"facts": {"k": plain[0]}}, {"facts": [], "variants": [{"id": "a"}]}, {}]
    files += [{"facts": [{"id": f"n{k % 70}", "relates": [{"fact": f"#n{j}"} for j in range(k)]} for k in range(90)]}, [1], None]
    return [json.dumps(x) for x in files] + ['{"facts":[{"id":"a","\\u0073upport":[{"class":"src"}]}]}', '{ "facts" : [ {"id": "z", "relates" : [ {"fact" :"#z"} ]} ] }']


def test_files_gathered_are_what_entries_say(spark):
    """What is read with its type and what goes the general way agree, and a file is parsed once, without a shuffle."""
    rows = [("r", f"p{k}", f"s{k}", x) for k, x in enumerate(_odd_files())] + [("r", "none", "none", None)]
    files = spark.createDataFrame(rows, "root string, path string, spec string, record string")
    entries, found = corpus.entries(files.coalesce(1)).cache(), corpus.gathered(files.coalesce(1), sources=True)
    assert _plan(found).count("parseJson(record") == 1 and "Exchange" not in _plan(found)
    found = found.cache()
    of = lambda df, *columns: sorted(map(str, df.select(*columns).collect()))
    own = ["root", "path", "spec", "name"]
    assert of(corpus.named(found), *own) == of(entries.where("family = 'fact'"), *own)
    key = [*own, "kind", "scope", "at", "ref", "relation"]
    assert of(corpus.mentioned(found), *key) == of(corpus.references(entries), *key)
    facts, lists = defaultdict(int), defaultdict(list)
    for r in corpus.named(found).collect():
        facts[r["path"], r["name"]] += 1
    mentions = corpus.mentioned(found).collect()
    for r in mentions:
        lists[r["path"], r["name"], r["kind"], r["scope"], r["relation"]].append(r)
    for same in lists.values():
        known = {r["nth"] for r in same}
        assert known == {None} or (len({r["ref"] for r in same}) == 1 and [r["nth"] for r in sorted(same, key=lambda r: r["at"])] == list(range(1, len(same) + 1)))
    assert {r["here"] for r in mentions if not r["ref"].startswith("#")} == {None} and len({r["nth"] for r in mentions}) > 2
    assert all(r["here"] == min(2, facts[r["path"], r["ref"][1:]]) for r in mentions if r["ref"].startswith("#"))
    supports = corpus.supports(entries)
    want, got = defaultdict(set), defaultdict(set)
    for r in supports.select("path", "name", corpus.anchor_list(supports).alias("anchors")).collect():
        want[r["path"], r["name"]] |= {a["repo"] for a in r["anchors"] or []}
    for r in found.select("path", F.inline("sources")).collect():
        got[r["path"], r["name"]] |= set(r["repos"])
    assert got == want


@pytest.mark.parametrize("how", ["general", "gathered"])
def test_references_resolve_alike_gathered_or_not(spark, how):
    """With ``here`` given, references to the file itself aren't looked up elsewhere, and get the same status."""
    facts = [{"id": "a", "relates": [{"fact": r, "relation": "r"} for r in ("#a", "#b", "#c", "#", "#a#b", "", "s#a", "s@r#b", "s#c", "t@r#a", "gone#a", "A#a")]}, {"id": "b"}, {"id": "b"}]
    files = spark.createDataFrame([("r", "p", "s", json.dumps({"facts": facts})), ("r", "q", "t", json.dumps({"facts": [{"id": "a"}]})), ("r", "u", "t", json.dumps({"facts": [{"id": "a"}]}))], "root string, path string, spec string, record string")
    roots = spark.createDataFrame([("r", 0, True)], "name string, rank int, trusted boolean")
    entries, found = corpus.entries(files), corpus.gathered(files)
    refs, records = (corpus.references(entries), entries.where("family = 'fact'")) if how == "general" else (corpus.mentioned(found), corpus.named(found))
    got = {r["ref"]: (r["status"], r["to_path"], r["to_spec"], r["to_fact"]) for r in references.resolve(refs, records, roots).collect()}
    none = (None, None, None)
    assert got == {
        "#a": ("ok", "p", "s", "a"), "#b": ("ambiguous", *none), "#c": ("missing", *none), "#": ("invalid", *none), "#a#b": ("invalid", *none), "": ("invalid", *none), "s#a": ("ok", "p", "s", "a"),
        "s@r#b": ("ambiguous", *none), "s#c": ("missing", *none), "t@r#a": ("ambiguous", *none), "gone#a": ("missing", *none), "A#a": ("invalid", *none),
    }


def test_layer_reach_makes_its_files_once(spark, sf_dir, monkeypatch):
    """Facts, references and licences are read of what one pass through the files has written; there were three passes."""
    from citegrid.plans import corpora

    seen, reach = [], references.reach
    monkeypatch.setattr(references, "reach", lambda edges, own, *rest: seen.extend(map(_plan, (edges, own))) or reach(edges, own, *rest))
    corpora.layer_reach(spark, sf_dir)
    assert len(seen) == 2 and not any("l_orderkey" in x or "parseJson" in x for x in seen)


def test_rules_gather_only_lists_that_say_different_things(spark):
    """Repeats are told by what a list says where it says one thing; all references were shuffled and sorted for that."""
    refers = lambda *refs: {"support": [{"class": "inference", "premises": [{"fact": r} for r in refs]}], "relates": [{"fact": r, "relation": "r"} for r in refs]}
    facts = [{"id": "a", **refers("#b", "#b")}, {"id": "b", **refers("#a", "s#a", "#b", "s@r#a")}, {"id": "c", **refers("#c")}, {"id": "d", **refers(*["#a"] * 12)}, {"id": "e", **refers(*["#a"] * 70)}, {"id": "f", **refers("#x", "#x")}]
    files = spark.createDataFrame([("r", "p", "s", json.dumps({"facts": facts}))], "root string, path string, spec string, record string")
    roots = spark.createDataFrame([("r", 0, True)], "name string, rank int, trusted boolean")
    entries, found = corpus.entries(files), corpus.gathered(files)
    want = references.rules(references.resolve(corpus.references(entries), entries.where("family = 'fact'"), roots), roots)
    resolved = references.resolve(corpus.mentioned(found), corpus.named(found), roots).cache()
    got = references.rules(resolved, roots)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and {r[-1] for r in rows} == {"repeated", "self", "missing"}
    assert {r["name"] for r in resolved.where("nth is null").collect()} == {"b", "e"}
    shuffled = _plan(got).split("Window")[1]
    assert "isnull(nth" in shuffled.replace(" ", "")


def test_reference_scopes_reads_what_one_pass_has_written(spark, sf_dir):
    """Names and references come of the same pass through the files; each made and parsed all files."""
    from citegrid.plans import corpora

    text = _plan(corpora.reference_scopes(spark, sf_dir))
    assert not [x for x in ("l_orderkey", "parseJson", "min(other", "SortAggregate") if x in text]
