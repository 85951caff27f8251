"""Blocks by braces against a plain reader of characters, and symbols near spans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from citegrid.operators import spans


def plain_nodes(text: str):
    """Blocks of a whole text, read a character at a time."""
    found, open_, comment, level = [], [], False, 0
    for number, line in enumerate(text.split("\n"), 1):
        head, i, quoted = "", 0, False
        while i < len(line):
            c, two = line[i], line[i : i + 2]
            if comment:
                comment, i = two != "*/", i + (2 if two == "*/" else 1)
                continue
            if quoted:
                quoted, i = c != '"', i + (2 if c == "\\" else 1)
                continue
            if two == "//":
                break
            if two == "/*":
                comment, i, head = True, i + 2, head + " "
                continue
            if c == "'" and len(line) > i + 2 and line[i + 2] == "'" and line[i + 1] not in "'\\":
                i, head = i + 3, head + " "
                continue
            if c == '"':
                quoted, head = True, head + " "
            elif c == "{":
                level += 1
                while ":" in head and head.split(":")[0].strip().isidentifier():
                    head = head.split(":", 1)[1]
                found.append(["".join(head.split()), level, number, None])
                open_.append((level, len(found) - 1))
                head = ""
            elif c == "}":
                if open_ and open_[-1][0] == level:
                    found[open_.pop()[1]][3] = number
                level -= 1
                head = ""
            elif c == ";":
                head = ""
            else:
                head += c
            i += 1
    return sorted(map(repr, map(tuple, found)))


def rows(spark, text, file="f"):
    return spark.createDataFrame([(file, k, x) for k, x in enumerate(text.split("\n"), 1)], "file string, line long, text string")


@pytest.mark.parametrize("seed", range(4))
def test_blocks_equal_a_plain_reader(spark, monkeypatch, seed):
    monkeypatch.setattr(spans, "BLOCK", 7)  # many ranges, so that states and levels go over their ends
    dice = random.Random(seed)
    bits = ["a {", "b: c@1 {", "}", "};", "/*", "*/", "/*/", "/* { */", '"{"', '"\\"}"', "//", "'{'", "x", " ", "\n", "\n", "\n", ";"]
    text = "".join(dice.choice(bits) for _ in range(600))
    got = sorted(repr(("".join(r.name.split()), r.level, r.begin, r.end)) for r in spans.nodes(rows(spark, text)).collect())
    assert got == plain_nodes(text) and len(got) > 5


def test_one_file_isnt_one_task(spark):
    """All windows but those over ranges' totals are within a range of lines."""
    lines = rows(spark, "a {\n}")
    for found in (spans.code(lines), spans.nodes(lines)):
        text = found._jdf.queryExecution().executedPlan().toString()
        over_lines = [x for x in text.split("\n") if "Window" in x and "line#" in x.split("], [")[-1]]
        assert over_lines and all("_block" in x for x in over_lines)


def test_lines_are_read_once_and_paired_within_ranges(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 7)
    reads = spark.sparkContext.accumulator(0)

    def read(text):
        reads.add(1)
        return text

    text = "a {\n/* {\n} */ b {\n}\n" * 20
    lines = rows(spark, text).repartition(4)
    lines = lines.withColumn("text", F.udf(read, "string").asNondeterministic()("text"))
    got = sorted(repr(("".join(r.name.split()), r.level, r.begin, r.end)) for r in spans.nodes(lines).collect())
    assert got == plain_nodes(text) and reads.value == 81
    plan = spans._paired(rows(spark, text))._jdf.queryExecution().executedPlan().toString()
    over_lines = [x.split("], [") for x in plan.split("\n") if "Window [" in x]
    assert over_lines and all("_block#" in x[-2] for x in over_lines)


def test_look_up(spark):
    found = spans.nodes(rows(spark, "a {\n b { };\n b {\n };\n c { };\n l: m: d {\n};\n e {\n e { };"))
    wanted = spark.createDataFrame([("f", n) for n in "abcdez"] + [("f", "a"), ("g", "a")], "file string, node string")
    got = {(r.file, r.node): (r.status, r.begin, r.end) for r in spans.look_up(wanted, found).collect()}
    none = (None, None)
    assert got == {
        ("f", "a"): ("unclosed", *none), ("f", "b"): ("several", *none), ("f", "c"): ("ok", 5, 5), ("f", "d"): ("ok", 6, 7),
        ("f", "e"): ("unclosed", *none), ("f", "z"): ("missing", *none), ("g", "a"): ("missing", *none),
    }


def test_symbols_near_spans(spark):
    lines = spark.createDataFrame([("f", 100, "int foo_bar(x->y);"), ("f", 301, "foo"), ("f", 9000, None), (None, 1, "foo")], "file string, line long, text string")
    cases = [
        (("f", "foo_bar", 300, 300), True), (("f", "foo_bar", 301, 301), False), (("f", "foo_bar", 1, 99), False), (("f", "foo", 300, 300), False), (("f", "foo", 290, 9500), True),
        (("f", "x->y", 100, 100), True), (("f", "->", 100, 100), False), (("f", None, 100, 100), False), (("f", "foo", 302, 301), False), (("f", "foo", 0, 400), False), (("g", "foo", 1, 400), False),
    ]
    cited = spark.createDataFrame([(*c, k) for k, (c, _) in enumerate(cases)] * 2, "file string, symbol string, begin long, end long, k int")
    got = [(r.k, r.found) for r in spans.with_symbol(cited, lines).orderBy("k").collect()]
    assert got == [(k, want) for k, (_, want) in enumerate(cases) for _ in range(2)]


def test_words_that_nobody_asks_for_arent_sent(spark, monkeypatch):
    lines = spark.range(3000).selectExpr("'f' file", "id line", "concat('w', id, ' v', id, ' u', id) text")
    cited = spark.range(200).selectExpr("'f' file", "concat('w', id * 9) symbol", "id * 9 + if(id % 2 = 0, 0, 300) begin", "id * 9 + 400 end").where("begin > 0")
    kept, asked_for = [], spans._asked_for

    def watched(words, asked):
        kept.append(asked_for(words, asked))
        return kept[-1]

    monkeypatch.setattr(spans, "_asked_for", watched)
    got = {r.symbol: r.found for r in spans.with_symbol(cited, lines).collect()}
    assert got == {f"w{k * 9}": k % 2 == 0 for k in range(1, 200)} | {"w9": False}
    assert 199 <= kept[0].count() < 300


def test_no_rows(spark):
    none = spark.createDataFrame([], "file string, line long, text string")
    assert spans.nodes(none).count() == 0
