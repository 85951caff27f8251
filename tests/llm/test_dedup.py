from __future__ import annotations

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from citegrid.llm import components, ngram_join, substring_dedup, vectors
from tests.llm import cases


@pytest.mark.parametrize("seed", [3, 4])
def test_substring_dedup_equals_brute_force(spark, seed):
    rows = cases.made(seed)
    found = substring_dedup.report(cases.frame(spark, rows), "doc_id", "text").collect()
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found)
    want = Counter()
    for d, w, mark in cases.removed(rows):
        kept = " ".join(x for x, m in zip(w, mark, strict=True) if not m)
        want[None if d == cases.LAST else d, len(w), sum(mark), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert got == want


def test_substring_dedup_of_many_blocks(spark):
    rows = [(d, t) for d, t in cases.made(5, 80) if d is not None]
    found = substring_dedup.locate(cases.frame(spark, rows), "doc_id", "text", n_blocks=9).collect()
    want = {d: sum(mark) for d, _, mark in cases.removed(rows)}
    assert {r.row.doc_id: sum(s.end - s.begin for s in r.spans) for r in found} == want


@pytest.mark.parametrize("part", [40, 700])
def test_substring_dedup_of_texts_in_parts(monkeypatch, part):
    """Whatever the parts, words and marks are those of the whole text."""
    monkeypatch.setattr(vectors, "PART", part)
    luck = random.Random(part)
    text = " ".join(luck.choice("abc") for _ in range(900))
    words = text.encode().split()
    passages = [(1, b" ".join(words[a : a + n])) for a, n in ((0, 13), (100, 40), (890, 13), (400, 300))]
    tree = substring_dedup.Automaton(passages, 13)
    n, spans, kept = substring_dedup._shortened(tree, text, 5)
    mark = tree.covered(words, 5)
    assert n == 900 and spans == substring_dedup.spans_of(mark) and kept.encode().split() == [x for x, m in zip(words, mark, strict=True) if not m]


def test_automaton_is_linear_on_repetitive_texts():
    """A passage of one word met by runs of twelve of it, and a tile that stands in thousands of places."""
    began = time.perf_counter()
    tree = substring_dedup.Automaton([(1, b"z " * 200_000)], 13)
    assert not any(tree.covered((b"z " * 12 + b"y ").split() * 15_000, 2))
    assert all(tree.covered([b"z"] * 200_000, 2))
    tile = [b"t%d" % k for k in range(7)]
    passage = [x for k in range(20_000) for x in (*tile, *[b"p%d" % k] * 7)]
    tree = substring_dedup.Automaton([(1, b" ".join(passage))], 13)
    assert not any(tree.covered([x for k in range(20_000) for x in (*tile, *[b"q%d" % k] * 7)], 2))
    assert all(tree.covered(passage, 2))
    assert time.perf_counter() - began < 60


def test_substring_dedup_tells_colliding_windows_apart(spark, monkeypatch):
    """The check beside the hash, where all hashes are equal, and the smallest id holds other words."""
    piece = next(vectors.pieces(pa.array([" ".join(f"{x}{k}" for k in range(13)) for x in "abab"])))
    (_, _, _, text, hashes, check), = substring_dedup.windows_of(piece, 13)
    assert check[0] == check[2] != check[1] == check[3]
    hashes[:] = 5
    h, c, d, b = hashes, check, np.array([1, 2, 3, 4]), np.zeros(4, np.int32)
    packed = [vectors.packed(h, rising=True), vectors.packed(c), *substring_dedup._packed_docs(d, b)]
    group = pa.table([[0], *[[x] for x in packed]], names=["range", "hashes", "checks", "ids", "blocks", "places"])
    found = substring_dedup._confirm(group).to_pylist()
    owners = vectors.unpacked_ids(found[0]["ids"], found[0]["places"], 2)
    assert sorted(owners.tolist()) == [1, 2]


def test_spans_and_other_columns(spark):
    text = " ".join(f"w{k}" for k in range(20))
    df = cases.frame(spark, [(1, text), (2, f"a {text} b"), (3, "c")])
    found = {r.row.doc_id: r for r in substring_dedup.locate(df, "doc_id", "text", verbatim=True).collect()}
    assert [(s.begin, s.end) for s in found[2].spans] == [(1, 21)] and found[2].kept == "a b"
    assert found[1].kept == text and found[1].row.spans == "p" and found[1].row.key == "k"


@pytest.mark.parametrize("operator", [substring_dedup.report, ngram_join.join])
def test_empty_table(spark, operator):
    assert operator(cases.frame(spark, []), "doc_id", "text").collect() == []


@pytest.mark.parametrize("seed", [3, 4])
def test_ngram_join_equals_brute_force(spark, seed):
    rows = cases.made(seed)
    found = ngram_join.join(cases.frame(spark, rows), "doc_id", "text").collect()
    want = cases.linked([(d, t) for d, t in rows if not (d is None and not t)])
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_ngram_join_on_chains_of_copies(spark):
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):  # each differs a little from the last, so that links form a chain
        base = list(base)
        base[(k * 3) % 120] = f"n{k}"
        rows.append((100 + k, " ".join(base)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(cases.frame(spark, rows), "doc_id", "text").collect()}
    assert found == cases.linked(rows)


def test_ngram_join_by_a_best_class_that_one_of_two_was_not_compared_with(spark):
    """Three sizes of one template, differing in the last fragment only: b is the best class of every other fragment,
    too large to link with a, and not linked with c; a and c link with each other."""
    words = [f"w{k}" for k in range(2_000)]
    _, hashes = ngram_join.shingles(next(vectors.pieces(pa.array([" ".join(words)]))), 1)
    of = {w: int(ngram_join.shingles(next(vectors.pieces(pa.array([w]))), 1)[1][0]) for w in words}
    assert set(of.values()) == set(hashes.tolist())
    last = [w for w in words if of[w] >= (1 << 64) // 20 * 19]
    rest = [w for w in words if of[w] < (1 << 64) // 20 * 19][:82]
    a, c, b = rest + last[:7], rest + last[:10], rest + last[7:10] + last[10:24]
    assert [len(set(x)) for x in (a, c, b)] == [89, 92, 99]
    rows = [(10 * k + copy, " ".join(x)) for k, x in enumerate((a, c, b), 1) for copy in range(2)]
    found = {r.doc_id: r.component_id for r in ngram_join.join(cases.frame(spark, rows), "doc_id", "text", size=1).collect()}
    assert found == {10: 10, 11: 10, 20: 10, 21: 10, 30: 30, 31: 30}


def test_ngram_join_of_repeated_ids_with_several_texts(spark):
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, " ".join([*a, "word"])), (9, " ".join([*b, "word"])), (7, " ".join(a)), (4, "c d e f")]
    rows += [(None, " ".join([*b, "end"])), (None, "z y x"), (None, "c d e f"), (None, "n m"), (None, "n m")]
    want = {(7, 58, 7): 3, (8, 59, 7): 1, (9, 59, 7): 1, (4, 2, 4): 1, (None, 59, 7): 1, (None, 1, None): 3, (None, 2, 4): 1}
    for order in (rows, rows[::-1]):
        found = ngram_join.join(cases.frame(spark, order).coalesce(1), "doc_id", "text").collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == want


def test_words_that_collide_in_polynomial_hashes(spark):
    one, two = cases.thue_morse("a", "b")
    rows = [(1, f"x {one} y"), (2, f"x {two} y"), (3, f"x {two} y")]
    found = {r.doc_id: r.component_id for r in ngram_join.join(cases.frame(spark, rows), "doc_id", "text").collect()}
    assert found == {1: 1, 2: 2, 3: 2}
    rest = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{two} {rest}")]
    found = {r.doc_id: r.n_removed for r in substring_dedup.report(cases.frame(spark, rows), "doc_id", "text").collect()}
    assert found == {1: 0, 2: 0, 3: 13}


def test_long_texts_are_read_in_parts(monkeypatch):
    luck = random.Random(1)
    text = " ".join(luck.choice(["a", "bb", "c" * 50, "d" * 500, "é"]) + luck.choice(["", "", "\n "]) for _ in range(200))
    for size in (1, 3, 5, 13):
        monkeypatch.setattr(vectors, "PART", 1 << 30)
        whole = ngram_join.shingles(next(vectors.pieces(pa.array([text]))), size)
        for part in (60, 300, 2_000):
            monkeypatch.setattr(vectors, "PART", part)
            found = ngram_join.shingles(next(vectors.pieces(pa.array([text]))), size)
            assert np.array_equal(found[1], whole[1])


def test_word_hashes_and_comparison():
    words = ["", "a", "b", "aa", *("x" * k for k in (7, 8, 9, 15, 16, 17, 127, 128, 129, 4_000)), "x" * 128 + "y", *cases.thue_morse("a", "b")]
    buf = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(x) for x in words])
    w = vectors.Words(end - [len(x) for x in words], end, np.array([0, len(words)]))
    assert len(set(vectors.word_hashes(buf, w).tolist())) == len(words)
    for k, x in enumerate(words):
        equal = vectors.same(buf, w.start, w.end, buf, np.full(len(words), w.start[k]), np.full(len(words), w.end[k]))
        assert equal.tolist() == [x == y for y in words]


def test_bounds_of_sizes():
    for a in range(1, 80):
        for b in range(a, 80):
            n = max((i for i in range(a + 1) if 100 * i >= 90 * (a + b - i)), default=None, key=lambda i: -i)
            if n is not None:
                assert a + b - 2 * n <= ngram_join.most_apart(a + b)
                first = ngram_join.size_classes(100)
                place = [max(k for k, f in enumerate(first) if f <= x) for x in (a, b)]
                assert place[1] - place[0] <= 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101)], "x bigint, y bigint")
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {k: 0 for k in range(31)} | {100: 100, 101: 100}


def _sent(sets, percent):
    """The signatures of each set."""
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(sets))), pa.array([len(s) for s in sets]), pa.array([0] * len(sets)), pa.array([np.sort(s).view(np.int64) for s in sets])], names=["node", "n", "rank", "grams"]
    )
    out = pa.Table.from_batches(ngram_join._fragments(percent, "rank")(iter([batch])))
    found = [set() for _ in sets]
    for sig, node in zip(out.column("sig").to_pylist(), out.column("node").to_pylist(), strict=True):
        found[node].add(sig)
    return found


def test_sets_without_common_ngrams_do_not_meet_in_empty_fragments():
    luck = np.random.default_rng(5)
    found = _sent([luck.integers(0, 1 << 64, n, np.uint64) for n in luck.integers(100, 700, 300)], 80)
    assert sum(len(s) for s in found) == len(set().union(*found))


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_sets_that_link_meet_in_some_fragment(percent):
    """Pairs that differ by as much as a link allows, of all small sizes, most of them with empty fragments."""
    luck = np.random.default_rng(percent)
    for n in [*range(1, 80), 150, 400, 1500]:
        for extra in range(n // 4 + 2):
            both = n * percent // 100 + extra
            if both > n:
                break
            # The most that the other set can hold besides: 100 * both >= percent * (n + more).
            more = 100 * both // percent - n
            if more < 0:
                continue
            x = luck.integers(0, 1 << 64, n + more, np.uint64)
            one, two = _sent([x[:n], np.concatenate([x[:both], x[n:]])], percent)
            assert one & two, (n, both, more)
