"""Benchmark decontamination by spaced-seed hashing.

Words are runs of ASCII letters, digits and non-ASCII bytes, with A-Z lower-cased, as 64-bit hashes. A seed is the
hash of the words at a mask's kept positions; the other positions are ignored, so a substituted word there leaves
the seed as it is. Seeds of the benchmark and of the documents are joined; every hit gives an alignment of an item
with a document, and an alignment counts if at least PERCENT % of the item's words are equal, place by place.

Every such alignment is found. At most e of an item's n words may differ, e being 100 - PERCENT % of n, rounded down. The
item is tiled by more than e masks of at most ``WEIGHT`` words each, which have no word in common: pairs of masks of every
other word, that interlock, and an unbroken run at the end. A word that differs breaks one mask, so of p masks p - e
are left; alignments with fewer seeds are dropped before their words are compared. Documents are read with the masks
that some item uses.

The benchmark's seeds, if all items together have no more than ``FILTER_SEEDS``, also go to the tasks that read the
documents, which drop seeds that can't hit before any shuffle. Beyond that every seed goes to the join; the result is
the same.

Defined results: null and empty texts hit nothing; an item in several places of a document is given at its best, then
first, alignment; rows are compared one by one, and the best of those with the same ids is given; a null id of a
document or item counts as 2 ** 63 - 1 and is returned as null; very long texts are compared whole; an empty table on
either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.llm import shared, vectors

#: The most words of a mask; at 80 % a long item can't have more masks than e with more words each.
WEIGHT = 4
#: The kept positions of each mask: of each weight an unbroken run, then every other word.
MASKS = tuple(tuple(range(0, w * step, step)) for w in range(1, WEIGHT + 1) for step in (1, 2))
PERCENT = 80
FILTER_SEEDS = 1 << 20
FILTER_BITS = 22
LAST = np.iinfo(np.int64).max

INSIDE = np.zeros(256, bool)
INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _words(piece: vectors.Piece) -> tuple[np.ndarray, np.ndarray]:
    w = vectors.words(piece, INSIDE[piece.buf])
    return vectors.word_hashes(vectors.LOWER[piece.buf], w), w.first


def _seeds(h: np.ndarray, text: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of each place where a mask fits into one text."""
    mask = MASKS[number]
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.full(n, number + 1, np.uint64)
    for k in mask:
        g *= vectors.STEP
        g += h[k : n + k]
    at = np.flatnonzero(text[:n] == text[mask[-1] :])
    return at, vectors.mix(g[at])


def _tiles(n: np.ndarray, at: np.ndarray, number: int, percent: int) -> np.ndarray:
    """Whether the mask at word ``at`` of an item of ``n`` words is one of the item's tiles."""
    weight = number // 2 + 1
    of_item = np.clip(n // (n * (100 - percent) // 100 + 1), 1, WEIGHT)
    paired = n - n % (2 * weight)
    if number % 2:
        tile = (at < paired) & (at % (2 * weight) < 2)
    else:
        tile = (at == paired) & (n - paired >= weight)
    return tile & (of_item == weight)


def _lists(values: np.ndarray, off: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))


def _scan(numbers: list[int], wanted: np.ndarray | None = None, tiled: int | None = None):
    """Texts with a seed of the masks ``numbers``, as (key, row, words, seeds, places, masks); with ``wanted``, only the seeds
    among them; with ``tiled``, only those of the tiles of an item for that percentage."""
    table = None
    if wanted is not None:
        table = np.zeros(1 << FILTER_BITS, bool)
        table[wanted >> np.uint64(64 - FILTER_BITS)] = True

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in vectors.pieces(batch.column("text")):
                h, first = _words(piece)
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                ats, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                masks = [np.zeros(0, np.int32)]
                for number in numbers:
                    at, g = _seeds(h, text, number)
                    if tiled is not None:
                        tile = _tiles(np.diff(first)[text[at]], at - first[text[at]], number, tiled)
                        at, g = at[tile], g[tile]
                    if table is not None:
                        near = np.flatnonzero(table[g >> np.uint64(64 - FILTER_BITS)])
                        near = near[np.isin(g[near], wanted)]
                        at, g = at[near], g[near]
                    ats.append(at)
                    seeds.append(g)
                    masks.append(np.full(len(at), number, np.int32))
                at, g, mask = np.concatenate(ats), np.concatenate(seeds), np.concatenate(masks)
                order = np.argsort(at, kind="stable")
                at, g, mask = at[order], g[order], mask[order]
                found, counts = np.unique(text[at], return_counts=True)
                if not len(found):
                    continue
                off = np.concatenate([[0], np.cumsum(counts)])
                sizes = np.diff(first)[found]
                ends = np.concatenate([[0], np.cumsum(sizes)])
                which = np.repeat(first[found] - ends[:-1], sizes) + np.arange(ends[-1])
                places = (at - first[text[at]]).astype(np.int32)
                keys = [batch.column(c).slice(piece.rows.start, len(first) - 1).take(pa.array(found)) for c in ("key", "row")]
                yield pa.RecordBatch.from_arrays(
                    [*keys, _lists(h[which].view(np.int64), ends), _lists(g.view(np.int64), off), _lists(places, off), _lists(mask, off)],
                    names=["key", "row", "words", "seeds", "places", "masks"],
                )

    return scan


SCANNED = "key bigint, row bigint, words array<bigint>, seeds array<bigint>, places array<int>, masks array<int>"


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, text); rows are told apart by key and text."""
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(int(LAST))).alias("key"), F.col(text).alias("text"))
    return rows.select("key", F.xxhash64("key", "text").alias("row"), "text")


def matches(docs: DataFrame, doc: str, text: str, bench: DataFrame, item: str, item_text: str, percent: int = PERCENT, filter_seeds: int = FILTER_SEEDS) -> DataFrame:
    """(doc, item, n_equal, n_words, begin): each document with each item it holds; begin counts its words from 0."""
    items = _keyed(bench, item, item_text).distinct()
    items = shared.written(items.mapInArrow(_scan(list(range(len(MASKS))), tiled=percent), SCANNED), "decontamination-items")
    seeds = items.select(F.explode(F.arrays_zip("seeds", "places")).alias("s"), F.col("key").alias("item"), F.col("row").alias("item_row"))
    seeds = seeds.select(F.col("s.seeds").alias("seed"), F.col("s.places").alias("item_at"), "item", "item_row")
    numbers = sorted(r[0] for r in items.select(F.explode("masks")).distinct().collect())
    wanted = None
    if seeds.count() <= filter_seeds:
        rows = seeds.select("seed").distinct().toPandas()["seed"].to_numpy(np.int64)
        wanted = np.sort(rows.view(np.uint64))
    scanned = shared.written(_keyed(docs, doc, text).mapInArrow(_scan(numbers, wanted), SCANNED), "decontamination-hits")
    hits = scanned.select(F.col("key").alias("doc_"), "row", F.explode(F.arrays_zip("seeds", "places")).alias("s"))
    hits = hits.select("doc_", "row", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at"))
    met = hits.join(F.broadcast(seeds) if wanted is not None else seeds, "seed")
    lined = met.groupBy("doc_", "row", "item", "item_row", (F.col("at") - F.col("item_at")).alias("begin")).agg(F.count("*").alias("hits"))
    least = F.size("seeds") - F.floor(F.size("words") * (100 - percent) / 100)
    of_item = items.select(F.col("key").alias("item"), F.col("row").alias("item_row"), F.col("words").alias("item_words"), least.alias("least"))
    lined = lined.join(of_item, ["item", "item_row"]).where("hits >= least").drop("hits", "least")
    both = lined.join(scanned.select(F.col("key").alias("doc_"), "row", "words"), ["doc_", "row"])
    skip = F.greatest(-F.col("begin"), F.lit(0))
    n = F.size("item_words")
    pairs = F.zip_with(
        F.slice("item_words", skip + 1, n), F.slice("words", F.col("begin") + skip + 1, F.greatest(n - skip, F.lit(0))), lambda a, b: F.when(a == b, F.lit(1))
    )
    counted = both.select("doc_", "item", "begin", n.alias("n_words"), F.size(F.filter(pairs, lambda x: x.isNotNull())).alias("n_equal"))
    counted = counted.where(F.col("n_equal") * 100 >= F.col("n_words") * percent)
    best = counted.groupBy("doc_", "item").agg(F.max(F.struct("n_equal", -F.col("begin"), "n_words")).alias("b"))
    return best.select(
        *[F.when(F.col(c) != int(LAST), F.col(c)).alias(name) for c, name in (("doc_", doc), ("item", item))],
        F.col("b.n_equal").cast("long").alias("n_equal"),
        F.col("b.n_words").cast("long").alias("n_words"),
        (-F.col("b.col2")).cast("long").alias("begin"),
    )
