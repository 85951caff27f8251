from __future__ import annotations

import json

import pytest

from citegrid.operators import campaign
from citegrid.sources import strict


def test_strict_files(spark, tmp_path):
    good = {"id": "a", "facts": [{"id": "f1", "n": 7}, {"id": "f2", "s": "é"}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    for name, text in {"twice.json": '{"a": 1, "a": 2}', "float.json": '{"a": 1.5}', "bad.json": "{", "bom.json": "﻿{}"}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "latin.json").write_bytes(b'"\xe9"')
    (tmp_path / "deep.json").write_text("[" * 70 + "]" * 70)
    (tmp_path / "notes.txt").write_text("no document")
    found = {r.path.rpartition("/")[2]: r for r in strict.read(spark, str(tmp_path)).collect()}
    codes = {k: r.code for k, r in found.items()}
    assert codes == {"a.json": None, "twice.json": "duplicate-key", "float.json": "float", "bad.json": "syntax", "bom.json": "encoding", "latin.json": "encoding", "deep.json": "limit"}
    assert json.loads(found["a.json"].record) == good
    rows = strict.records(strict.read(spark, str(tmp_path)), "facts").orderBy("ord").collect()
    assert [(r.ord, r.id) for r in rows] == [(0, "f1"), (1, "f2")]


def test_yaml_scalars_and_refusals():
    pytest.importorskip("yaml")
    text = "a: 0x1F\nb: yes\nc: 2024-01-02\nd: '7'\ne: ~\nf: [true, -3]\ng: 010\n"
    assert strict.parse_yaml(text) == {"a": 31, "b": "yes", "c": "2024-01-02", "d": "7", "e": None, "f": [True, -3], "g": 10}
    for text, code in (("a: 1\na: 2", "duplicate-key"), ("a: &x 1\nb: *x", "anchor"), ("a: 1.5", "float"), ("a: !t 1", "tag"), ("a: [", "syntax"), ("1: 2", "key")):
        with pytest.raises(strict.Refused) as e:
            strict.parse_yaml(text)
        assert e.value.code == code


def test_canonical_and_basis():
    assert strict.canonical({"b": "é", "a": [1, None, True]}) == '{"a":[1,null,true],"b":"é"}'
    fact = {"id": "f", "claim": "c", "section": "1.2"}
    one = strict.basis(fact, {"documents": {}, "repos": {}}, {}, {"x#b": "2", "x#a": "1"})
    assert one == strict.basis({**fact, "section": "9"}, {"repos": {}, "documents": {}}, {}, {"x#a": "1", "x#b": "2"})
    assert one != strict.basis(fact, {"documents": {}, "repos": {}}, {}, {"x#a": "1", "x#b": "3"})
    assert one != strict.basis(fact, {"documents": {}, "repos": {}}, {}, {"x#a": "1", "x#b": "2"}, {"r": 1})


def test_trace_lines(spark, tmp_path):
    (tmp_path / "t.log").write_text("12.5 mmio read 0x10 = 0xff\nnoise\n13.000001 mmio write 0x14 = 0x0\n14.0 irq read 0x8\n")
    found = strict.accesses(strict.lines(spark, str(tmp_path / "t.log"))).orderBy("line").collect()
    assert [(r.line, r.t_us, r.kind, r.rw, int(r.reg), None if r.value is None else int(r.value)) for r in found] == [
        (1, 12_500_000, "mmio", "read", 16, 255), (3, 13_000_001, "mmio", "write", 20, 0), (4, 14_000_000, "irq", "read", 8, None),
    ]


def test_receipts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "event_id": "1", "errors": 2\n}')
    (tmp_path / "b.json").write_text('{"event_id": ')
    assert [tuple(r) for r in strict.receipts(spark, str(tmp_path), "event_id string, errors int").collect()] == [("1", 2)]


def test_sweep_and_queue(spark):
    entries = spark.createDataFrame(
        [
            ("e1", "verification", ["1.2"], False, "current"), ("e2", "verification", ["3"], False, "current"), ("e3", "result", ["3"], False, "current"),
            ("e4", "qualification", ["1"], True, "current"), ("e5", "verification", ["1.2.3"], False, "contested"), ("e6", "observation", [], False, "current"),
        ],
        "id string, kind string, sections array<string>, superseded boolean, state string",
    )
    sources = spark.createDataFrame(
        [("s", "spec", "ok", "1", "2", ["1.2"], True), ("t", "toolchain", "ok", "9", "9", [], True), ("d", "document", "gone", "1", "2", [], True)],
        "id string, kind string, status string, old string, new string, changed array<string>, known boolean",
    )
    swept = campaign.sweep(entries, sources)
    assert {r.id: (r.state, r.reasons) for r in swept.collect()} == {
        "e1": ("stale", ["spec:s"]), "e2": ("current", []), "e3": ("stale", ["spec:s"]), "e4": ("superseded", []), "e5": ("contested", ["spec:s"]), "e6": ("current", []),
    }
    assert [r.id for r in campaign.queue(swept).collect()] == ["e1", "e3"]
    readings = spark.createDataFrame([("e1", "PASS"), ("e1", "FAIL"), ("e2", "PASS")], "id string, verdict string")
    assert {r.id: r.state for r in campaign.contested(swept, readings).collect()}["e1"] == "contested"


def test_files_that_break_parsers_are_findings(spark, tmp_path):
    bad = {"deep.json": "[" * 200_000, "deep.yaml": "[" * 5_000, "long.yaml": "a: " + "9" * 5_000, "half.json": '{"a": "\\ud800"}', "large.json": f'"{"x" * 2_000_000}"'}
    for name, text in {**bad, "good.json": '{"a": [1]}'}.items():
        (tmp_path / name).write_text(text)
    found = {r.path.rsplit("/", 1)[1]: (r.record, r.code) for r in strict.read(spark, str(tmp_path), strict.Limits(size=1 << 20)).collect()}
    assert found.pop("good.json") == ('{"a":[1]}', None)
    assert set(found) == set(bad) and all(record is None and code for record, code in found.values())
    assert found["large.json"][1] == found["deep.json"][1] == "limit" and found["half.json"][1] == "encoding"
