from __future__ import annotations

import re
import textwrap
from collections import Counter

import pytest

from citegrid.llm import licenses, quality_rules, sharding
from tests.llm import cases


def counts(text):
    w = cases.words(text)
    lines = [x for x in (text or "").split("\n") if cases.words(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark):
    rows = [*cases.made(), (700, "## a | b\n## a | b\n\n\n<x> 100%"), (701, "one two three four five " * 3)]
    found = quality_rules.judge(cases.frame(spark, rows), "doc_id", "text").collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    want = Counter()
    for d, t in rows:
        n, chars, symbols, dup, repeat = counts(t)
        want[d, n, chars, symbols, dup, repeat, n < 10 or 100 * repeat > 20 * n] += 1
    assert got == want
    assert not any(r.kept for r in found if r.base_failed)


def test_verdict_does_not_depend_on_the_order(spark):
    prose = " ".join(f"Word{k} and some other ones." for k in range(20))
    texts = [prose, prose.upper(), prose.replace(" ", "!! "), prose.replace(" ", "### "), "\n".join(["- item of a list here"] * 30)]
    df = quality_rules.measured(cases.frame(spark, list(enumerate(texts))), "doc_id", "text")
    chain = quality_rules.rules()
    first = {r[0]: r[1] is None for r in df.select("doc_id", quality_rules.cascade(chain)).collect()}
    last = {r[0]: r[1] is None for r in df.select("doc_id", quality_rules.cascade(chain[::-1])).collect()}
    assert first == last == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_rules_are_ordered_by_rejection_per_cost():
    chain = [quality_rules.Rule(n, None, None) for n in "abcd"]
    a, b, c, d = chain
    # b rejects most for its cost; of what it lets pass, a rejects nothing and c one in five.
    kinds = [((True, True, False, False), 30, (60, 30, 90, 30)), ((False, False, True, False), 20, (40, 20, 60, 20)), ((False,) * 4, 80, (160, 80, 240, 80))]
    assert quality_rules.ordered(kinds, chain) == [b, c, d, a]
    assert quality_rules.ordered([], chain) == chain


def test_the_order_repeats(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = quality_rules.rules()
    orders = []
    for parts in (1, 3):
        rows = quality_rules.sampled(docs.repartition(parts).select("doc_id", "text"), "doc_id", "text", 100)
        assert 40 < rows.count() < 180
        sample = quality_rules.measured(rows, "doc_id", "text").persist()
        orders.append([r.name for r in quality_rules.ordered(quality_rules.estimate(sample, chain), chain)])
    assert orders[0] == orders[1]


def test_empty_table(spark):
    empty = cases.frame(spark, [])
    assert quality_rules.judge(empty, "doc_id", "text").collect() == []
    assert licenses.scan(empty, "doc_id", "text").collect() == []
    assert sharding.place(empty, "doc_id").collect() == []


def plain_scan(text):
    text = text or ""
    units = [*text.split("\n"), *re.split(r"[.:;!?]+[\x20\x09-\x0D]+", text), *re.split(r"\n[^A-Za-z0-9\n]*\n", text), text]
    units = {tuple(licenses.normal_words(u)) for u in units}
    best = []
    for words in units:
        grams = set(licenses.bigrams(words))
        scores = []
        for name, body in licenses.TEMPLATES:
            template = set(licenses.bigrams(licenses.normal_words(body)))
            n = len(grams & template)
            if grams and 2 * n / (len(grams) + len(template)) >= licenses.THRESHOLD:
                scores.append((-n, -2.0 * n / (len(grams) + len(template)), name))
        if scores:
            best.append(min(scores))
    return (min(best)[2], -min(best)[1], len(best)) if best else (None, None, 0)


def test_licences_equal_brute_force(spark):
    notices = [
        "Released under the MIT License.",
        "some words\nLICENSED under the Apache-License, version 2.0!\nReleased under the MIT License",
        "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software\nand associated documentation files",
        "Licensed under the Apache License",
        "Licensed under CC BY 4.0.\n\nLicensed under CC BY-NC 4.0",
        "the MIT License " * 200,
    ]
    rows = [*cases.made(), *enumerate(notices, 800)]
    found = licenses.scan(cases.frame(spark, rows), "doc_id", "text").collect()
    assert Counter((r.doc_id, r.license, r.dice, r.n_notices) for r in found) == Counter((d, *plain_scan(t)) for d, t in rows)
    assert sum(r.license is not None for r in found) >= 4


def wrapped(text, mark="", width=72):
    return "\n".join(mark + line for line in textwrap.wrap(" ".join(text.split()), width))


def test_licences_as_wrapped_in_the_wild(spark):
    mit = "\n\n".join(["MIT License", "Copyright (c) 2020 Some One", *map(wrapped, (licenses.MIT_GRANT, licenses.MIT_NOTICE, licenses.MIT_WARRANTY))])
    parts = [licenses.BSD_GRANT, licenses.BSD_SOURCE, licenses.BSD_BINARY, licenses.BSD_NAME, licenses.BSD_WARRANTY]
    bsd3 = "\n\n".join(["Copyright 2020, Some One. All rights reserved.", *[f"{k}. {wrapped(x)}" for k, x in enumerate(parts)]])
    bsd2 = "\n\n".join(["Copyright 2020, Some One. All rights reserved.", *[f"{k}. {wrapped(x)}" for k, x in enumerate(parts) if k != 3]])
    gpl = licenses.GPL_HEADER.format("General Public License", 3)
    prose = " ".join(f"line {k} of a long story" for k in range(200))
    texts = {
        1: ("mit", mit),
        2: ("bsd-3-clause", bsd3),
        3: ("bsd-2-clause", bsd2),
        4: ("gpl-3.0", f"{wrapped(gpl, '# ')}\n\nimport os\n{prose}"),
        5: ("apache-2.0", f"/*\n{wrapped(licenses.APACHE_HEADER, ' * ')}\n *\n{wrapped(licenses.APACHE_WARRANTY, ' * ')}\n */\n{prose}"),
        6: ("mit", f"{prose}\n\n{mit}\n\n{prose}"),
        7: ("mit", f"{prose}. Released under the\nMIT License. {prose}"),
        8: (None, f"{prose} and the MIT licence is one of many that people know"),
        9: ("isc", wrapped(f"{licenses.ISC_GRANT} {licenses.ISC_WARRANTY}", "// ")),
    }
    found = {r.doc_id: r.license for r in licenses.scan(cases.frame(spark, [(k, t) for k, (_, t) in texts.items()]), "doc_id", "text").collect()}
    assert found == {k: name for k, (name, _) in texts.items()}


def test_everyday_words_tell_no_notice():
    """Else nearly all English texts are cut into units, by an "of" or a "by"."""
    sets = [(name, tuple(licenses.bigrams(licenses.normal_words(body)))) for name, body in licenses.TEMPLATES]
    assert not licenses.EVERYDAY & set(licenses.telling_words(sets, licenses.THRESHOLD))


def test_every_notice_has_a_telling_word():
    """Whatever a third of a template's bigrams is replaced by: those with telling words are too many to be all missing."""
    sets = [(name, tuple(licenses.bigrams(licenses.normal_words(body)))) for name, body in licenses.TEMPLATES]
    telling = set(licenses.telling_words(sets, licenses.THRESHOLD))
    for _, grams in sets:
        plain = [g for g in grams if not telling & set(g.split())]
        least = min(n for n in range(1, len(grams) + 1) if 2 * n / (n + len(grams)) >= licenses.THRESHOLD)
        assert len(plain) < least


def test_size_bounds_lose_nothing():
    for a in range(1, 60):
        lo, hi = licenses.size_bounds(a, 0.8)
        assert all(lo <= b <= hi for b in range(1, 100) if 2 * min(a, b) / (a + b) >= 0.8)


@pytest.mark.parametrize(("n", "size"), [(1, 2), (3, 7), (5, 101), (64, 6421)])
def test_table_is_fair(n, size):
    slots = sharding.fill([f"s{k}" for k in range(n)], size)
    counts = Counter(slots)
    assert set(slots) == set(range(n)) and max(counts.values()) - min(counts.values()) <= 1


def test_few_slots_move():
    names = [f"s{k}" for k in range(10)]
    before, after = sharding.fill(names, 1009), sharding.fill(names[:9], 1009)
    assert sum(a != b for a, b in zip(before, after, strict=True) if a != 9) < 0.2 * 1009


def test_bad_tables():
    for names, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill(names, size)


def test_placement(spark, tmp_path):
    rows = cases.made()
    df = cases.frame(spark, rows)
    found = sharding.place(df, "doc_id", ["x", "y", "z"]).collect()
    slots = sharding.fill(["x", "y", "z"], 307)
    assert len(found) == len(rows) and all(slots[r.slot] == r.shard for r in found)
    assert all(len({r.shard for r in found if r.doc_id == d}) == 1 for d, _ in rows)
    sharding.write_shards(df, "doc_id", str(tmp_path / "out"), ["x", "y", "z"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and re.fullmatch("[0-2]+", "".join(str(r[0]) for r in back.select("_shard").distinct().collect()))
