from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from citegrid.llm import bpe, packing, pretokens, vectors
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def encoded(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoding_of_odd_strings(library):
    luck = random.Random(2)
    parts = ["'s", "'t", "'re", "'ve", "'ll", "'", " ", "  ", "\n", "a", "B", "é", "中", "1", "½", "#", "\xa0", "　", "\x1c", "<|endoftext|>", "<|endof", "r", "e", "hello", " the", "😀", "́"]
    texts = ["".join(luck.choice(parts) for _ in range(luck.randrange(25))) for _ in range(3000)] + ["a" * 3000, " " * 3000]
    want = encoded(library, texts)
    for known in (bpe.memory(PATH), packing.memory(PATH)):
        got = []
        for piece in vectors.pieces(pa.array(texts), 5000):
            ids, off = known(piece, b"<|endoftext|>")
            got += [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]
        assert got == want


def test_every_token_is_its_own_encoding():
    known = bpe.vocabulary(PATH)
    assert all(known.encode(t) == [i] for i, t in zip(known.ids, known.text, strict=True))


def test_classes_are_the_library_s(library):
    kinds = pretokens.classes()
    luck = random.Random(1)
    for c in [*range(0x3100), *(luck.randrange(0x3100, 0x20000) for _ in range(3000))]:
        if not 0xD800 <= c < 0xE000:
            alone = [len(library.pre_tokenizer.pre_tokenize_str(x + chr(c))) == 1 for x in "a1#"]
            assert alone == [kinds[c] == pretokens.LETTER, kinds[c] == pretokens.NUMBER, kinds[c] == 0], hex(c)


def test_memory_forgets_and_goes_on(library):
    texts = [t for _, t in cases.made(8)]
    small = pretokens.Memory(lambda found: [bpe.vocabulary(PATH).encode(x) for x in found], limit=50)
    got = []
    for piece in vectors.pieces(pa.array(texts, pa.string()), 300):
        ids, off = small(piece, b"<|endoftext|>")
        got += [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]
    assert got == encoded(library, texts)


def test_pieces_whose_hashes_collide(library, monkeypatch):
    """Found by a hash of few values, pieces are told apart by their bytes."""
    texts = [t for _, t in cases.made(9)] + [" ".join(cases.thue_morse("a", "b", 6))]
    hashes = vectors.word_hashes
    monkeypatch.setattr(vectors, "word_hashes", lambda buf, w: hashes(buf, w) % np.uint64(7))
    known = pretokens.Memory(lambda found: [bpe.vocabulary(PATH).encode(x) for x in found])
    got = []
    for piece in vectors.pieces(pa.array(texts, pa.string()), 500):
        ids, off = known(piece, b"<|endoftext|>")
        got += [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]
    assert got == encoded(library, texts)


def test_words_that_collide_in_polynomial_hashes(library):
    texts = list(cases.thue_morse("a", "b"))
    for known in (bpe.memory(PATH), packing.memory(PATH)):
        ids, off = known(next(vectors.pieces(pa.array(texts))), b"<|endoftext|>")
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == encoded(library, texts)


def test_long_texts_are_cut_where_no_token_crosses(library, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 200)
    for _, text in cases.made(10):
        piece = next(vectors.pieces(pa.array([text], pa.string())))
        assert bpe.memory(PATH)(piece, b"<|endoftext|>")[0].tolist() == encoded(library, [text])[0]


def test_columns_that_clash_are_refused(spark):
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(cases.frame(spark, [(1, "a")]), "text", PATH)


def test_bpe_report(spark, library):
    rows = cases.made()
    want = Counter()
    for (d, t), ids in zip(rows, encoded(library, [t for _, t in rows]), strict=True):
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    found = bpe.report(cases.frame(spark, rows), "doc_id", "text", PATH).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip_and_ranges(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 10_001, dtype=np.uint64).astype(np.uint32)
    data = packing.pack(ids, width)
    assert len(data) == -(-len(ids) * width // 8)
    assert (packing.unpack(data, width, len(ids)) == ids).all()
    offsets = np.arange(0, len(ids), packing.BLOCK) * width // 8
    for a, b in ((0, 1), (4095, 4097), (5000, 10_001), (7, 7)):
        assert (packing.ids_between(data, offsets, width, len(ids), a, b) == ids[a:b]).all()


def test_bits():
    assert [packing.bits_for(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


def test_packed_files(spark, library):
    rows = cases.made(6)
    found = packing.report(cases.frame(spark, rows), "doc_id", "text", PATH).collect()
    texts = spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string").selectExpr("t", "xxhash64(t) AS h").collect()
    place = {r.t: r.h for r in texts}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, place[r[1]]))
    want, start = [], 0
    for (d, _), ids in zip(ordered, encoded(library, [t for _, t in ordered]), strict=True):
        ids = [*ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found]
    assert sorted(got, key=lambda r: r[1]) == want


@pytest.mark.parametrize("operator", [bpe.report, packing.report])
def test_empty_table(spark, operator):
    assert operator(cases.frame(spark, []), "doc_id", "text", PATH).collect() == []
