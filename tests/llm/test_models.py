from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrid.llm import decontamination, quality_model, toxicity
from citegrid.tables import table
from tests.llm import cases

LABELS = "doc_id bigint, toxic int, quality int, extra string"


def bags(n: int = 300):
    luck = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        sentences = [" ".join(luck.choice("aa bb cc dd ee ff gg hh".split()) for _ in range(9)) for _ in range(6)]
        bad = luck.random() < 0.3
        if bad:
            sentences[luck.randrange(6)] += " " + luck.choice(["vile", "nasty"])
        rows.append((k, ". ".join(sentences)))
        labels.append((k, int(bad), int(not bad), "x"))
    return rows, labels


def test_toxicity_learns_words_and_finds_sentences(spark):
    rows, labels = bags()
    odd = [(None, "vile"), (900, None), (901, ""), (902, "vile " * 4000), rows[0]]
    known = spark.createDataFrame([*labels, (None, 1, 1, "x"), (5, None, None, "x"), (99_999, 1, 0, "x")], LABELS)
    found = toxicity.report(cases.frame(spark, rows + odd), "doc_id", "text", known, "toxic").collect()
    assert len(found) == len(rows) + len(odd)
    truth = {k: y for k, y, _, _ in labels}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    assert all(r.predicted == truth[r.doc_id] for r in held)
    text = dict(rows)
    for r in found:
        assert 0 <= r.score <= 1
        for s in r.offending if r.doc_id in text else []:
            assert "vile" in text[r.doc_id][s.begin : s.end] or "nasty" in text[r.doc_id][s.begin : s.end]
    assert {r.doc_id: r.score for r in found}[900] == 0 == {r.doc_id: r.score for r in found}[901]


def test_noisy_or_equals_a_plain_version(spark):
    rows, _ = bags(20)
    model = toxicity.Model(np.random.default_rng(1).normal(0, 1, 1 << toxicity.BITS).astype(np.float32), -2.0)
    found = cases.frame(spark, rows).select("text", toxicity.scored("text", model)["score"].alias("score")).collect()
    import pyarrow as pa

    from citegrid.llm import vectors

    for r in found:
        product = 1.0
        for sentence in r.text.split(". "):
            b = toxicity.bags(next(vectors.pieces(pa.array([sentence]))))
            product *= 1 - 1 / (1 + np.exp(2.0 - float(model.weights[b.word].astype(float).sum() + model.weights[b.prefix].astype(float).sum())))
        assert r.score == pytest.approx(1 - product, abs=1e-9)


@pytest.mark.parametrize("labels", [[], [(1, 1, 1, "x")], [(1, None, None, "x")]])
def test_models_without_both_labels(spark, labels):
    df, known = cases.frame(spark, [(1, "a b c"), (2, "")]), spark.createDataFrame(labels, LABELS)
    assert max(r.score for r in toxicity.report(df, "doc_id", "text", known, "toxic").collect()) < 1e-12
    assert len(quality_model.report(df, "doc_id", "text", known, "quality").collect()) == 2


def test_held_out_scores_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    truth = {r.doc_id: r for r in labels.collect()}
    for module, label, least in ((toxicity, "toxic", 0.85), (quality_model, "quality", 0.97)):
        held = [r for r in module.report(docs, "doc_id", "text", labels, label).collect() if r.held_out and r.doc_id in truth]
        assert cases.auc([truth[r.doc_id][label] for r in held], [r.score for r in held]) >= least


def test_compiled_rules_equal_plain_ones(spark):
    rows = cases.made()
    df = quality_model.statistics(cases.frame(spark, rows), "text", ["doc_id"])
    x = df.select(*quality_model.STATISTICS).toPandas().to_numpy()
    assert np.isfinite(x).all()
    model = quality_model.Ensemble(0.3, [(((0, True, 2.0), (5, False, 0.9)), 1.5), (((2, False, 0.0),), -2.0)])
    got = sorted(r[0] for r in df.select(quality_model.compiled(model)).collect())
    z = 0.3 + sum(w * quality_model.holds(rule, x) for rule, w in model.rules)
    assert got == pytest.approx(sorted(1 / (1 + np.exp(-z))))


def test_lasso_drops_rules_that_say_nothing():
    luck = np.random.default_rng(0)
    r = luck.integers(0, 2, (400, 12)).astype(float)
    y = ((r[:, 3] > 0) ^ (luck.random(400) < 0.05)).astype(float)
    _, w = quality_model.lasso(r, y, 0.02)
    assert abs(w[3]) > 1 and (np.abs(np.delete(w, 3)) < 0.3).all() and (w == 0).sum() >= 6


def plain_matches(rows, items):
    """Every alignment of every item with every text."""
    import re

    def tokens(t):
        return re.findall(r"[a-z0-9\x80-\U0010ffff]+", cases.lower(t or ""))

    out = set()
    for d, t in rows:
        w = tokens(t)
        for i, body in items:
            x = tokens(body)
            for o in range(-len(x), len(w)):
                n = sum(0 <= o + k < len(w) and w[o + k] == v for k, v in enumerate(x))
                if x and n * 100 >= 80 * len(x):
                    out.add((d, i))
    return out


def test_decontamination_against_brute_force(spark):
    luck = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(luck.choice(vocabulary) for _ in range(luck.randrange(15, 40)))) for k in range(12)]
    rows = []
    for k in range(80):
        text = [luck.choice(vocabulary) for _ in range(60)]
        if k % 3 == 0:
            inside = items[k % 12][1].split()
            for _ in range(k % 4):
                inside[luck.randrange(len(inside))] = "changed"
            text[20:20] = [x.upper() + "," for x in inside] if k % 2 else inside
        rows.append((k, " ".join(text)))
    rows += [(900, None), (901, ""), (None, items[3][1]), rows[0], (902, items[0][1] + " x " + items[0][1])]
    items += [(52, "two words"), (None, items[1][1]), items[2], (3, items[4][1])]  # an item without an id, a repeated one, one of two texts
    rows += [(905, "some two words"), (5, items[7][1])]
    bench = spark.createDataFrame([*items, (50, None), (51, "")], "item_id bigint, text string")
    want = plain_matches([r for r in rows], items)
    for most in (decontamination.FILTER_SEEDS, 0):
        found = decontamination.matches(cases.frame(spark, rows), "doc_id", "text", bench, "item_id", "text", filter_seeds=most).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    both = next(r for r in found if (r.doc_id, r.item_id) == (902, 0))
    assert both.begin == 0 and both.n_equal == both.n_words


@pytest.mark.parametrize("percent", [50, 80, 95, 100])
def test_tiles_of_an_item_outnumber_the_words_that_may_differ(percent):
    for n in range(1, 500):
        at, taken, tiles = np.arange(n), [], 0
        for number, mask in enumerate(decontamination.MASKS):
            found = at[decontamination._tiles(np.full(n, n), at, number, percent)]
            tiles += len(found)
            taken += [int(k) + m for k in found for m in mask]
        assert tiles > n * (100 - percent) // 100 and len(set(taken)) == len(taken) and max(taken) < n


def test_decontamination_finds_every_alignment(spark):
    """Items of 1 to 45 words, verbatim, with as many words replaced as may be (every fifth; at random), one more, and cut off by
    either end of the document."""
    luck = random.Random(6)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 46)]
    rows, want = [], set()

    def add(n: int, words: list[str], held: bool) -> None:
        rows.append((len(rows), " ".join(words)))
        if held:
            want.add((len(rows) - 1, n))

    for n, body in items:
        most = n // 5
        fifth = [x if k % 5 != 4 else "other" for k, x in enumerate(body.split())]
        add(n, ["pre", *fifth, "post"], True)
        for k in range(6):
            inside = body.split()
            for p in luck.sample(range(n), most + (k == 5)):
                inside[p] = "other"
            add(n, ["pre", *inside, "post"], k < 5)
        add(n, body.split()[most:], True)
        add(n, ["pre", *body.split()[: n - most]], True)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for most in (decontamination.FILTER_SEEDS, 0):
        found = decontamination.matches(cases.frame(spark, rows), "doc_id", "text", bench, "item_id", "text", filter_seeds=most).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    docs = cases.frame(spark, [(1, "a b c d e f g h i j k l m n o p")])
    assert decontamination.matches(docs, "doc_id", "text", bench, "item_id", "text").collect() == []
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p")], "item_id bigint, text string")
    assert decontamination.matches(cases.frame(spark, []), "doc_id", "text", bench, "item_id", "text").collect() == []


def test_a_huge_text_leaves_the_other_labels(spark):
    from citegrid.llm import toxicity

    rows = [(k, "plain words here" if k % 2 else "vile words here", k % 2) for k in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    long = spark.range(1).select(F.lit(99).cast("long").alias("doc_id"), F.repeat(F.lit("long "), toxicity.TEXT_BYTES // 4).alias("text"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(99, 1)], "doc_id long, toxic int")
    texts, y = toxicity.labelled_sample(docs.unionByName(long), "doc_id", "text", labels, "toxic")
    assert len(texts) == len(y) == 40
