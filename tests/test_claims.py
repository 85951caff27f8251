"""Claims against cited text, on small cases written out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from citegrid.operators import claims


SENTENCES = [
    ("", []), ("No end", ["No end"]), ("One. Two! Three? ", ["One.", " Two!", " Three?", " "]), ("At 1.5 V.x is on.", ["At 1.5 V.x is on."]), ("So (e.g. this) or approx. that. Then.", ["So (e.g. this) or approx. that.", " Then."]),
    ("See Fig. 3, cf. it vs.", ["See Fig. 3, cf. it vs."]), ("What?! Yes.", ["What?!", " Yes."]), ("...\nA", ["...", "\nA"]),
]


def test_sentences(spark):
    rows = spark.createDataFrame([(c,) for c, _ in SENTENCES], "claim string")
    got = {r.claim: r.s for r in rows.select("claim", claims.sentences(F.col("claim")).alias("s")).collect()}
    assert {c: [x.text for x in s] for c, s in got.items()} == dict(SENTENCES)
    assert all([c[x.begin : x.end] for x in s] == [x.text for x in s] for c, s in got.items())


END, AFTER, CELL = "range-end", "range-successor", "cell-absent"
# (claim, its spans as text or (text, context, symbol), its findings in order)
CASES = [
    ("The widget reset value is 0x10.", ["#define WIDGET_RESET 0x40\n#define GADGET_MODE 0x10"], [("hex-unbound", "16", None)]),
    ("The gadget mode is 0x10.", ["#define WIDGET_RESET 0x40\n#define GADGET_MODE 0x10"], []),
    ("The gadget mode is set. It is 10h.", ["#define GADGET_MODE 0x10"], [("hex-unbound", "16", None)]),
    ("It is 0x99.", ["#define GADGET_MODE 0x10"], []),  # nowhere in cited text
    ("The widget ceiling is 0x7f.", [("\t.limit = 0x7f,", "struct widget_cfg cfg = {", None)], []),
    ("Probe returns 0x3 for a widget.", [("\treturn 0x3;", None, "widget_probe")], []),
    (None, [None], []),
    ("It is 0x1 of A0..A1.", [], []),  # a prefix of one character is too short for an index
    ("Pins GPIO0..GPIO7 exist.", ["gpio_7 here"], []),
    ("Pins `GPIO0`..`GPIO7` exist.", ["GPIO 70, GPIO7cfg"], []),
    ("Pins GPIO0 .. GPIO7.", ["GPIO70"], [(END, "GPIO0..GPIO7", "GPIO7")]),
    ("Pins GPIO0..GPIO7.", ["GPIO7 GPIO8"], [(AFTER, "GPIO0..GPIO7", "GPIO8")]),
    ("Pins GPIO0..GPIO7 and gpio_8..gpio_9.", ["GPIO7, GPIO8, GPIO9"], []),
    ("PIN00..PIN09", ["pin09, pin10"], [(AFTER, "PIN00..PIN09", "PIN10")]),
    ("GP1_CFG2..GP3_CFG2", ["gp3 cfg2, gp4_cfg2"], [(AFTER, "GP1_CFG2..GP3_CFG2", "GP4_CFG2")]),
    ("x.GPIO0..GPIO7, GPIO7..GPIO3, GPIO0...GPIO4", ["a"], []),
    ("ngpios = <32>, NGPIOS=< 0X10 >, ngpios = <a>", ["ngpios=<32>; xngpios = <0x10>"], [(CELL, "0x10", "ngpios")]),
]


def test_findings(spark):
    facts = spark.createDataFrame([(k, claim) for k, (claim, _, _) in enumerate(CASES)] * 2, "fact long, claim string")  # repeated rows change nothing
    spans = [(k, nth, *(s if isinstance(s, tuple) else (s, None, None))) for k, (_, cited, _) in enumerate(CASES) for nth, s in enumerate(cited)]
    cited = spark.createDataFrame(spans, "fact long, nth int, text string, context string, symbol string")
    got = {k: [] for k in range(len(CASES))}
    for r in claims.findings(facts, cited).orderBy("rank", "subject", "code").collect():
        got[r.fact].append((r.code, r.subject, r["name"]))
    assert got == {k: want for k, (_, _, want) in enumerate(CASES)}


def test_names_by_leads(spark):
    """Words come with the leads of the names that they make, so that those which aren't asked for go before a shuffle."""
    cited = spark.createDataFrame([(1, "reset GPIO_7 8at\n, __ in x"), (2, None)], "fact long, text string")
    got = {tuple(r) for r in claims.names(cited).collect()}
    assert got == {(1, "reset gpio7 8at", "resetgpio7"), (1, "reset gpio7 8at", "resetgpio78"), (1, "gpio7 8at", "gpio7"), (1, "gpio7 8at", "gpio78"), (1, "8at", "8")}


@pytest.mark.parametrize("leads", [0, 1 << 16])
def test_findings_with_few_or_many_leads(spark, monkeypatch, leads):
    monkeypatch.setattr(claims, "LEADS", leads)
    test_findings(spark)


def test_no_rows(spark):
    none = spark.createDataFrame([], "fact long, nth int, text string, context string, symbol string")
    assert claims.findings(none.selectExpr("fact", "text claim"), none).count() == 0
