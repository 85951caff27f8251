"""The corpus pipeline against a plain version; the trained scores are taken as they are, all later stages are done again."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from citegrid.llm import toxicity
from tests.llm import cases

COLUMNS = list(corpus_pipeline.COLUMNS)


def near(rows):
    of = cases.linked([(r[0], r[1]) for r in rows if r[0] is not None], corpus_pipeline.PERCENT, corpus_pipeline.SHINGLE)
    known = {r[1]: of[r[0]][1] for r in rows if r[0] is not None}
    return [r for r in rows if (of[r[0]][1] == r[0] if r[0] is not None else r[1] not in known or not cases.words(r[1]))]


def test_rows_are_judged_by_id_and_text(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    df = cases.frame(spark, [(1, a), (8, a + " end"), (8, b), (None, a), (None, c), (None, c), (9, c)])
    kept = corpus_pipeline.keep_one_of_each(spark, df, "").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, a), (8, b), (9, c)])
    spark.createDataFrame([(1, a), (None, c)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.keep_unleaked(spark, df, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(8, b)])


def repeats(rows):
    out = []
    for r, (_, w, mark) in zip(rows, cases.removed([(r[0], r[1]) for r in rows]), strict=True):
        text = " ".join(x for x, m in zip(w, mark, strict=True) if not m) if any(mark) else r[1]
        out.append((r[0], text, r[2], r[3], len(text) if any(mark) else r[4]))
    return out


def bare(text):
    return [cases.lower(w) for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")]


def leaks(rows, bench):
    kept = []
    for r in rows:
        places = defaultdict(list)
        for j, w in enumerate(bare(r[1])):
            places[w].append(j)
        held = False
        for item in map(bare, bench):
            votes = Counter(j - i for i, w in enumerate(item) for j in places[w])
            held = held or bool(votes) and 100 * max(votes.values()) >= 80 * len(item)
        if not held:
            kept.append(r)
    return kept


def tokens(rows):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [coder.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    return Counter((r[0], r[2], r[3], len(x), tuple(x)) for r, x in zip(rows, ids, strict=True))


def plain(rows, bench):
    return tokens(leaks(repeats(near(rows)), bench))


def got(found):
    return Counter((r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.ids)) for r in found.collect())


def test_shared_tables(spark, sf_dir):
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    model = toxicity.fit(read["documents"], "doc_id", "text", read["labels"], "toxic")
    scored = read["documents"].select(*COLUMNS, toxicity.scored("text", model)["score"].alias("score"))
    clean = [tuple(r[c] for c in COLUMNS) for r in scored.collect() if r.score < toxicity.THRESHOLD]
    assert got(corpus_pipeline.run(spark, sf_dir)) == plain(clean, [r.text for r in read["benchmark"].collect()])


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_documents(spark, tmp_path, empty):
    item = " ".join(f"q{k}" for k in range(30))
    rows = [] if empty else [*cases.made(6), (900, f"one {item.upper()}, two"), (901, " ".join(f"q{k}" if k % 9 else "other" for k in range(30))), (902, "q1 q2 q3 q4 q5 q6 q7 q8")]
    cases.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(3, 1, 0), (6, 1, 0), (None, 0, 1), (9, None, None)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = got(corpus_pipeline.run(spark, str(tmp_path)))
    assert found == plain([(d, t, "en", "src0", len(t or "")) for d, t in rows], [item])
    assert empty or {900, 901}.isdisjoint(k[0] for k in found) and any(k[0] == 902 for k in found)


def test_near_duplicates_of_five_words_and_80_percent(spark, sf_dir):
    """One word changed inside 50 leaves 41 of 51 runs of five words, and 45 of 51 of three; two far apart leave too few."""
    base = [f"b{k}" for k in range(50)]
    once, twice = list(base), list(base)
    once[25] = "other"
    twice[10] = twice[40] = "another"
    rows = [(k, " ".join(x)) for k, x in enumerate((base, once, twice, [f"c{k}" for k in range(50)]), 1)]
    kept = corpus_pipeline.keep_one_of_each(spark, cases.frame(spark, rows), sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4]
