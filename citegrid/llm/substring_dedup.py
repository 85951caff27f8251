"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document. The document with the smallest id in which a window's
word sequence starts owns it. A word of a document goes if a window that covers it belongs to a document with a
smaller id.

1. Confirm: rows are dealt out to blocks. Every window's hash is dealt out by hash range, as compressed columns of a task's
   windows. Per range, hashes in two or more documents are confirmed, and the owner's block learns which other blocks
   hold each of them. Tasks read whole blocks and send at most two rows for a hash and block, so a passage in a third of
   all documents costs rows by the number of blocks, not of documents.
2. Passages: each block turns the confirmed windows of its documents into passages, maximal runs as text, and
   sends each block the passages that occur there.
3. Automata: each block is a shard. It compiles an Aho-Corasick automaton over the passages sent to it, cut into
   tiles so short that every window of a passage holds a whole tile, and streams its documents through it. Around each
   hit, the words are compared with those around the tile in the passages, as far as a window reaches; runs of a
   window's length or more are occurrences. A tile with the same words around it in several places is kept once, and one
   with many different ones keeps its windows in a dictionary, so that the work is linear in the text whatever repeats.
   Only words are compared here, so equal hashes of different words can't remove anything.

Windows are told apart by 80 bits, 64 of a hash and 16 of another, so that no real owner hides behind a chance
collision in a corpus of any real size.

Every document meets one automaton, so the work grows with the input. Blocks are chosen by a hash of id, text and input
partition, so that rows without an id, or with one id, are spread like others; there are so many that a block holds
about a thousand documents or four megabytes.

Defined results: a null text has no words; texts shorter than a window keep all words; rows with the same id are
one another's equals, so neither removes from the other; a null id counts as 2 ** 63 - 1, larger than every other; very long
texts are read in parts; an empty table gives no rows; extra columns travel in the struct ``row`` and can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrid.llm import shared, vectors

WINDOW = 13
#: Bytes of text whose windows a task holds before it sends them.
FLUSH = 16 << 20
#: Blocks whose windows' hash ranges make one group of step 1.
BLOCKS_PER_RANGE = 4
#: Different words around a tile that are compared one after another.
FEW = 8
LAST = np.iinfo(np.int64).max
STEP = np.uint32(0x9E3779B1)

SPANS = "array<struct<begin: bigint, end: bigint>>"


def windows_of(piece: vectors.Piece, window: int) -> Iterator[tuple[vectors.Piece, vectors.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, words, position of the first word, text, hash, check) of the windows of each part of the piece; the check is independent of the hash."""
    for part in vectors.parts(piece, window - 1):
        w = vectors.words(part)
        h = vectors.word_hashes(part.buf, w)
        at, text, g = vectors.windows(h, w.first, window)
        check = np.zeros(0, np.uint16)
        if len(at):
            high = (h >> np.uint64(32)).astype(np.uint32)
            n = len(h) - window + 1
            c = high[:n].copy()
            for k in range(1, window):
                c *= STEP
                c ^= c >> np.uint32(15)
                c += high[k : n + k]
            check = (c[at] >> np.uint32(16)).astype(np.uint16)
        yield part, w, at, text, g, check


def _ends(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values in order, whether each is the first and the last of its kind."""
    new = np.ones(len(h) + 1, bool)
    new[1:-1] = h[1:] != h[:-1]
    return new[:-1], new[1:]


def _new(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _send(n_ranges: int, window: int):
    def flush(hs: list[np.ndarray], cs: list[np.ndarray], ds: list[np.ndarray], bs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, c, d, b = (np.concatenate(x) for x in (hs, cs, ds, bs))
        order = np.argsort(h)
        h, c, d, b = h[order], c[order], d[order], b[order]
        first, last = _ends(h)
        alone = first & last
        # Of a window in several places, the smallest and the largest id of each block.
        many = np.flatnonzero(~alone)
        many = many[np.lexsort((d[many], b[many], c[many], h[many]))]
        hm, cm, dm, bm = h[many], c[many], d[many], b[many]
        begins = np.append(_new(hm, cm, bm), True)
        least = dm[np.flatnonzero(begins[:-1])[np.cumsum(begins[:-1]) - 1]]
        take = begins[:-1] | (begins[1:] & (dm != least))
        h, c, d, b = (np.concatenate([x[alone], m[take]]) for x, m in ((h, hm), (c, cm), (d, dm), (b, bm)))
        order = np.argsort(h, kind="stable")
        h, c, d, b = h[order], c[order], d[order], b[order]
        bounds = np.searchsorted(range_of(h, n_ranges), np.arange(n_ranges + 1))
        # A row's document is its place among the different (id, block).
        rows = []
        for r in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[r], bounds[r + 1])
            rows.append((int(r), vectors.packed(h[part], rising=True), vectors.packed(c[part]), *_packed_docs(d[part], b[part])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in rows], pa.int32()), *[pa.array([x[k] for x in rows], pa.binary()) for k in range(1, 6)]],
            names=["range", "hashes", "checks", "ids", "blocks", "places"],
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, cs, ds, bs, size = [], [], [], [], 0
        for batch in batches:
            ids, blocks = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "block"))
            for piece in vectors.pieces(batch.column("text")):
                for part, _, _, text, g, check in windows_of(piece, window):
                    if len(g):
                        hs.append(g)
                        cs.append(check)
                        ds.append(ids[piece.rows][text])
                        bs.append(blocks[piece.rows][text])
                        size += len(part.buf)
                    if size >= FLUSH:
                        yield from flush(hs, cs, ds, bs)
                        hs, cs, ds, bs, size = [], [], [], [], 0
        if hs:
            yield from flush(hs, cs, ds, bs)

    return send


def _packed_docs(ids: np.ndarray, blocks: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The different (id, block), and the place of each row among them."""
    order = np.lexsort((blocks, ids))
    new = _new(ids[order], blocks[order])
    place = np.empty(len(ids), np.int64)
    place[order] = np.cumsum(new) - 1
    known = order[new]
    small = np.uint16 if len(known) < 1 << 16 else np.uint32
    return vectors.packed(ids[known], rising=True), vectors.packed(blocks[known].astype(np.int32)), vectors.packed(place.astype(small))


def _unpacked_docs(ids: bytes, blocks: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    known = vectors.unpacked(ids, np.int64, rising=True)
    place = vectors.unpacked(places, np.uint16 if len(known) < 1 << 16 else np.uint32)
    return known[place], vectors.unpacked(blocks, np.int32)[place]


def range_of(h: np.ndarray, n_ranges: int) -> np.ndarray:
    """Rises with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)


def _confirm(group: pa.Table) -> pa.Table:
    hs, cs, ds, bs = [], [], [], []
    for hashes, checks, ids, blocks, places in zip(*(group.column(x).to_pylist() for x in ("hashes", "checks", "ids", "blocks", "places")), strict=True):
        hs.append(vectors.unpacked(hashes, np.uint64, rising=True))
        cs.append(vectors.unpacked(checks, np.uint16))
        d, b = _unpacked_docs(ids, blocks, places)
        ds.append(d)
        bs.append(b)
    h, c, d, b = (np.concatenate(x) for x in (hs, cs, ds, bs))
    del hs, cs, ds, bs
    order = np.argsort(h)
    h = h[order]
    first, last = _ends(h)
    again = np.flatnonzero(~(first & last))
    h, order = h[again], order[again]
    c, d, b = c[order], d[order], b[order]
    order = np.lexsort((b, d, c, h))
    h, c, d, b = h[order], c[order], d[order], b[order]
    place = np.cumsum(_new(h, c)) - 1
    begins = np.flatnonzero(_new(h, c))
    owner, home = d[begins][place], b[begins][place]
    later = d > owner
    h, c, owner, home, at = h[later], c[later], owner[later], home[later], b[later]
    order = np.lexsort((c, h, at, owner, home))
    h, c, owner, home, at = h[order], c[order], owner[order], home[order], at[order]
    new = _new(h, c, owner, at, home)
    h, c, owner, home, at = h[new], c[new], owner[new], home[new], at[new]
    edges = np.append(np.flatnonzero(_new(home)), len(home))
    rows = [
        (int(home[a]), vectors.packed(h[a:b]), vectors.packed(c[a:b]), *vectors.packed_ids(owner[a:b]), vectors.packed(at[a:b]))
        for a, b in zip(edges[:-1], edges[1:], strict=True)
    ]
    return pa.table(
        [pa.array([x[0] for x in rows], pa.int32()), *[pa.array([x[k] for x in rows], pa.binary()) for k in range(1, 6)]],
        names=["block", "hashes", "checks", "ids", "places", "targets"],
    )


def _passages(window: int):
    def salted(h: np.ndarray, c: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return vectors.mix(h + ids.astype(np.uint64) * vectors.STEP) + c.astype(np.uint64) * vectors.M1

    def passages(docs: pa.Table, sent: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if len(docs) and len(sent):
            hs, cs, owners, targets = [], [], [], []
            names = ("hashes", "checks", "ids", "places", "targets")
            for hashes, checks, ids, places, target in zip(*(sent.column(x).to_pylist() for x in names), strict=True):
                hs.append(vectors.unpacked(hashes, np.uint64))
                cs.append(vectors.unpacked(checks, np.uint16))
                owners.append(vectors.unpacked_ids(ids, places, len(hs[-1])))
                targets.append(vectors.unpacked(target, np.int32))
            owner, target = np.concatenate(owners), np.concatenate(targets)
            wanted = salted(np.concatenate(hs), np.concatenate(cs), owner)
            docs = docs.filter(pc.is_in(docs.column("key"), pa.array(np.unique(owner))))
            ids = docs.column("key").to_numpy()
            for piece in vectors.pieces(docs.column("text")):
                for part, w, at, text, g, check in windows_of(piece, window):
                    known, where = np.unique(salted(g, check, ids[piece.rows][text]), return_index=True)
                    if not len(known):
                        continue
                    place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                    here = np.flatnonzero(known[place] == wanted)
                    to, begin = target[here], at[where[place[here]]]
                    order = np.lexsort((begin, to))
                    to, begin = to[order], begin[order]
                    new = np.ones(len(to) + 1, bool)
                    new[1:-1] = (to[1:] != to[:-1]) | (begin[1:] != begin[:-1] + 1)
                    edges = np.flatnonzero(new)
                    text_of = w.text_of()
                    raw = part.buf.tobytes()
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        i, j = begin[a], begin[b - 1] + window - 1
                        out.append((int(to[a]), int(ids[piece.rows][text_of[i]]), raw[w.start[i] : w.end[j]]))
        return pa.table(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())],
            names=["block", "owner", "passage"],
        )

    return passages


@dataclass
class Around:
    """What stands around a tile in the passages: (words, the tile's place among them) with the smallest owner; if many, the windows instead."""

    contexts: list[tuple[tuple[int, ...], int, int]]
    windows: dict[tuple[int, ...], int] | None


class Automaton:
    """An Aho-Corasick automaton over the tiles of passages."""

    def __init__(self, passages: list[tuple[int, bytes]], window: int) -> None:
        self.window, self.tile = window, (window + 1) // 2
        self.reach = window - self.tile
        self.numbers: dict[bytes, int] = {}
        number = self.numbers
        found: dict[tuple[int, ...], dict[tuple[tuple[int, ...], int], int]] = {}
        for owner, text in passages:
            p = tuple([number.setdefault(x, len(number) + 1) for x in text.split()])
            for o in range(0, len(p) - self.tile + 1, self.tile):
                low = max(0, o - self.reach)
                here = found.setdefault(p[o : o + self.tile], {})
                context = (p[low : o + self.window], o - low)
                here[context] = min(owner, here.get(context, owner))
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for tile, contexts in found.items():
            self.tree.add_word(tile, self._around(contexts))
        self.full = bool(found)
        if self.full:
            self.tree.make_automaton()

    def _around(self, contexts: dict[tuple[tuple[int, ...], int], int]) -> Around:
        if len(contexts) <= FEW:
            return Around([(words, at, owner) for (words, at), owner in contexts.items()], None)
        windows: dict[tuple[int, ...], int] = {}
        for (words, _), owner in contexts.items():
            for k in range(len(words) - self.window + 1):
                key = words[k : k + self.window]
                windows[key] = min(owner, windows.get(key, owner))
        return Around([], windows)

    def covered(self, words: list[bytes], doc: int) -> bytearray:
        """1 for each word that an occurrence of an earlier document's passage covers."""
        mark = bytearray(len(words))
        if not self.full or len(words) < self.window:
            return mark
        get, tile, window, reach = self.numbers.get, self.tile, self.window, self.reach
        seq = tuple([get(x, 0) for x in words])
        n = len(seq)
        for last, around in self.tree.iter(seq):
            j = last - tile + 1
            if mark.find(0, max(0, j - reach), min(n, j + window)) < 0:
                continue
            if around.windows is not None:
                for k in range(max(0, j - reach), min(j, n - window) + 1):
                    if around.windows.get(seq[k : k + window], doc) < doc:
                        mark[k : k + window] = b"\1" * window
                continue
            for p, o, owner in around.contexts:
                if owner >= doc:
                    continue
                lo, hi = 0, tile
                most = min(j, o)
                while lo < most and seq[j - lo - 1] == p[o - lo - 1]:
                    lo += 1
                most = min(n - j, len(p) - o)
                while hi < most and seq[j + hi] == p[o + hi]:
                    hi += 1
                if lo + hi >= window:
                    mark[j - lo : j + hi] = b"\1" * (lo + hi)
        return mark


def spans_of(mark: bytearray) -> list[dict[str, int]]:
    spans, at = [], mark.find(1)
    while at >= 0:
        end = mark.find(0, at)
        end = len(mark) if end < 0 else end
        spans.append({"begin": at, "end": end})
        at = mark.find(1, end)
    return spans


def _shortened(tree: Automaton, text: str | None, key: int) -> tuple[int, list[dict[str, int]], str]:
    """(words, spans of removed words, the other words) of one text, of which a part is cut into words at a time."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    overlap = tree.window - 1
    mark, kept, held = bytearray(), [], []
    for part in vectors.parts(vectors.Piece(raw, np.array([0, len(raw)]), slice(0, 1)), overlap):
        words = part.buf.tobytes().split()
        found = tree.covered(words, key)
        if held:  # this part begins with the last words of the one before
            found[: len(held)] = bytes(a | b for a, b in zip(found, mark[-len(held) :], strict=False))
            del mark[-len(held) :]
        sure = len(words) - min(overlap, len(words))
        kept.extend(x for x, m in zip(words[:sure], found, strict=False) if not m)
        held = words[sure:]
        mark += found
    kept.extend(x for x, m in zip(held, mark[len(mark) - len(held) :], strict=True) if not m)
    return len(mark), spans_of(mark), b" ".join(kept).decode()


def _locate(window: int, verbatim: bool):
    def locate(docs: pa.Table, passages: pa.Table) -> pa.Table:
        tree = Automaton(list(zip(passages.column("owner").to_pylist(), passages.column("passage").to_pylist(), strict=True)), window)
        counts, spans, kept = [], [], []
        for key, text in zip(docs.column("key").to_pylist(), docs.column("text"), strict=True):
            whole = text.as_py()
            n, cut, rest = _shortened(tree, whole, key)
            counts.append(n)
            spans.append(cut)
            kept.append(whole if verbatim and not cut else rest)
        return pa.table(
            [
                docs.column("row"),
                pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.string()),
            ],
            names=["row", "n_words", "spans", "kept"],
        )

    return locate


def locate(df: DataFrame, doc: str, text: str, window: int = WINDOW, verbatim: bool = False, n_blocks: int | None = None) -> DataFrame:
    """(row, n_words, spans, kept) for each row of ``df``.

    row: the columns other than ``text``, as a struct; spans: the ranges of removed words, by position;
    kept: the other words joined by one space; with ``verbatim``, texts that lose no word as they are.
    """
    n_blocks = n_blocks or shared.n_blocks(df, text)
    n_ranges = max(1, -(-n_blocks // BLOCKS_PER_RANGE))
    key = F.coalesce(F.col(doc).cast("long"), F.lit(int(LAST))).alias("key")
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("row")
    docs = df.select(key, F.col(text).alias("text"), rest)
    docs = docs.withColumn("block", F.pmod(F.xxhash64("key", "text", F.spark_partition_id()), F.lit(n_blocks)).cast("int"))
    docs = docs.repartition("block")  # one exchange for all three readers
    sent = docs.mapInArrow(_send(n_ranges, window), "range int, hashes binary, checks binary, ids binary, blocks binary, places binary")
    confirmed = sent.groupBy("range").applyInArrow(_confirm, "block int, hashes binary, checks binary, ids binary, places binary, targets binary")
    passages = docs.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(
        _passages(window), "block int, owner bigint, passage binary"
    )
    schema = T.StructType(
        [
            T.StructField("row", docs.schema["row"].dataType),
            *T._parse_datatype_string(f"n_words bigint, spans {SPANS}, kept string").fields,
        ]
    )
    return docs.groupBy("block").cogroup(passages.groupBy("block")).applyInArrow(_locate(window, verbatim), schema)


def report(df: DataFrame, doc: str, text: str, window: int = WINDOW) -> DataFrame:
    """(doc, n_words, n_removed, kept_sha256, spans) for each document."""
    found = locate(df.select(doc, text), doc, text, window)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(F.col("row")[doc].alias(doc), "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), "spans")
