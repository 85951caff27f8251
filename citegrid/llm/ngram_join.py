"""N-gram Jaccard join by vertical partitioning.

A document's set holds its distinct runs of ``SHINGLE`` lower-cased words, as 64-bit hashes; the hashes' order is
the global order of the n-grams. Two documents link when 100 * overlap >= PERCENT * union.

1. The order is cut into ranges. Each range counts, for every document, how many of its n-grams in that range
   another document has too; the sum over the ranges bounds any overlap of the document. Since a link needs an
   overlap of PERCENT % of either set, most documents are out here. A task sends an n-gram that several of its
   documents share once, so a frequent one costs rows by the number of tasks.
2. Copies with equal sets become one class. The order is cut anew into F fragments, F by the size of the sets,
   more than the n-grams by which two linked sets of that size can differ: linked sets are equal in some fragment. A set
   sends its empty fragments only where no full one need be among the equal ones; else texts with nothing in common would meet there.
   Equal fragments give candidate pairs, first of each class with the fragment's best class (the one with the
   most n-grams that others have too), then, for fragments whose classes are not yet one component, of every two
   classes in different components that their sizes, the bounds of step 1 and their overlaps with the best class allow. Links inside a component change nothing and
   are not looked for.
3. Candidates are counted: each of ``PARTS`` parts of the order gives a partial overlap, and the parts' sum
   per pair decides. Components follow from the links.

N-grams are compared by 64-bit hashes. Only two different n-grams of one pair of documents with equal hashes could
change a link, so the chance doesn't grow with the corpus.

Defined results: texts without words have n_shingles 0 and are linked with nothing; every row is judged by its own
text, so rows with one id and several texts are linked by each of them, and component_id is the smallest id among the
rows reached; a null id counts as 2 ** 63 - 1, the largest, and is returned as null, also as a component; very long
texts are read in parts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.llm import shared, vectors
from citegrid.llm.components import components

SHINGLE = 3
PERCENT = 90
PARTS = 4
FLUSH = 4 << 20
#: N-grams whose fragments are hashed at once.
SLICE = 1 << 18
#: N-grams of the sets of a block of classes.
BLOCK_GRAMS = 1 << 21
#: N-grams of the pairs of a cell, counted once for each pair.
CELL_GRAMS = 1 << 22
#: Nodes have fewer bits; above them stands the class's rank.
NODE_BITS = 53
#: Classes with more than one of so many rows are attached to their rows by a broadcast; there are fewer than this.
HOT = 1024
#: Blocks of documents for each range of step 1.
BLOCKS_PER_RANGE = 4
LAST = np.iinfo(np.int64).max


def most_apart(total: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of two linked sets whose sizes sum to ``total``."""
    return (100 - percent) * total // (100 + percent)


def size_classes(most: int, percent: int = PERCENT) -> np.ndarray:
    """The first size of each class; sizes that can link are in the same or neighbouring classes."""
    first = [1]
    while first[-1] <= most:
        first.append(first[-1] * 100 // percent + 1)
    return np.array(first, np.int64)


def n_fragments(top: np.ndarray, percent: int) -> np.ndarray:
    """Into how many fragments sets of up to ``top`` n-grams are cut: two more than those in which linked ones can differ, and spare ones, so that hardly a set has as many empty ones.

    The spare ones only save candidates. Whole numbers, quotients and roots alone, which every machine rounds alike.
    """
    apart = (100 - percent) * 2 * top // (100 + percent)
    empty = apart / 3.0 ** ((100 + percent) // max(1, 2 * (100 - percent)))
    return apart + 2 + np.minimum((3 * empty + 4 * np.sqrt(empty)).astype(np.int64), top // 16)


def shingles(piece: vectors.Piece, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash), by text and hash, each pair once."""
    texts, grams = [], []
    for part in vectors.parts(piece, size - 1):
        w = vectors.words(part)
        h = vectors.word_hashes(vectors.LOWER[part.buf], w)
        _, text, g = vectors.windows(h, w.first, size)
        texts.append(text)
        grams.append(g)
    if len(texts) == 1:
        counts = np.diff(w.first)
        for short in range(1, size):
            few = np.flatnonzero(counts == short)
            if len(few):
                whole = np.zeros(len(few), np.uint64)
                for k in range(short):
                    whole = whole * vectors.STEP + h[w.first[few] + k]
                texts.append(few)
                grams.append(vectors.mix(whole + np.uint64(short)))
    text, g = np.concatenate(texts), np.concatenate(grams)
    order = np.lexsort((g, text))
    text, g = text[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    return text[new], g[new]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    off = np.concatenate([[0], np.cumsum(sizes)])
    return total[off[1:]] - total[off[:-1]]


def _digest(g: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set."""
    return _sums(vectors.mix(g + vectors.M1), sizes), _sums(vectors.mix(g ^ vectors.M2), sizes)


def _ranges(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _send(n_ranges: int, size: int):
    names = ["range", "hashes", "ids", "places", "shared", "info"]

    def flush(texts: list[np.ndarray], hs: list[np.ndarray], docs: np.ndarray, ids: np.ndarray, of_text: np.ndarray) -> Iterator[pa.RecordBatch]:
        t, h = np.concatenate(texts), np.concatenate(hs)
        sizes = np.bincount(t, minlength=len(docs))
        one, two = _digest(h, sizes)
        order = np.argsort(h)
        h, t = h[order], t[order]
        new = np.ones(len(h) + 1, bool)
        new[1:-1] = h[1:] != h[:-1]
        alone = new[:-1] & new[1:]
        common = np.bincount(t[~alone], minlength=len(docs))
        info = np.stack([docs.view(np.uint64), sizes.astype(np.uint64), one, two, common.astype(np.uint64), ids.view(np.uint64), of_text.view(np.uint64)])
        both = h[new[:-1] & ~alone]
        h, d = h[alone], docs[t[alone]]
        cut, cut2 = (np.searchsorted(_ranges(x, n_ranges), np.arange(n_ranges + 1)) for x in (h, both))
        rows = [(int(docs[0] % n_ranges), None, None, None, None, vectors.packed(info.ravel()))]
        for r in np.flatnonzero(np.diff(cut) + np.diff(cut2)):
            part, part2 = slice(cut[r], cut[r + 1]), slice(cut2[r], cut2[r + 1])
            rows.append((int(r), vectors.packed(h[part], rising=True), *vectors.packed_ids(d[part]), vectors.packed(both[part2], rising=True), None))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in rows], pa.int32()), *[pa.array([x[k] for x in rows], pa.binary()) for k in range(1, 6)]], names=names
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, hs, info, n, held = [], [], [], 0, 0
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "key", "text_hash")]
            for piece in vectors.pieces(batch.column("text")):
                text, g = shingles(piece, size)
                texts.append(text + n)
                hs.append(g)
                info.append([c[piece.rows] for c in columns])
                n += len(piece.off) - 1
                held += len(piece.buf)
                if held >= FLUSH:
                    yield from flush(texts, hs, *map(np.concatenate, zip(*info, strict=True)))
                    texts, hs, info, n, held = [], [], [], 0, 0
        if info:
            yield from flush(texts, hs, *map(np.concatenate, zip(*info, strict=True)))

    return send


def _count(n_blocks: int):
    def count(group: pa.Table) -> pa.Table:
        hs, ds, known, infos = [], [], [np.zeros(0, np.uint64)], []
        for row in zip(*(group.column(c).to_pylist() for c in ("hashes", "ids", "places", "shared", "info")), strict=True):
            if row[4] is not None:
                infos.append(vectors.unpacked(row[4], np.uint64).reshape(7, -1))
                continue
            hs.append(vectors.unpacked(row[0], np.uint64, rising=True))
            ds.append(vectors.unpacked_ids(row[1], row[2], len(hs[-1])))
            known.append(vectors.unpacked(row[3], np.uint64, rising=True))
        out: list[tuple] = []
        if hs:
            h, d, known = np.concatenate(hs), np.concatenate(ds), np.unique(np.concatenate(known))
            order = np.argsort(h)
            h, d = h[order], d[order]
            new = np.ones(len(h) + 1, bool)
            new[1:-1] = h[1:] != h[:-1]
            found = ~(new[:-1] & new[1:])
            if len(known) and len(h):
                found |= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            docs, counts = np.unique(d[found], return_counts=True)
            block = docs % n_blocks
            order = np.argsort(block, kind="stable")
            docs, counts, block = docs[order], counts[order].astype(np.uint32), block[order]
            for a, b in _runs(block):
                out.append((int(block[a]), vectors.packed(docs[a:b], rising=True), vectors.packed(counts[a:b]), None))
        for info in infos:
            block = info[0].view(np.int64) % n_blocks
            order = np.argsort(block, kind="stable")
            info, block = info[:, order], block[order]
            for a, b in _runs(block):
                out.append((int(block[a]), None, None, vectors.packed(np.ascontiguousarray(info[:, a:b]).ravel())))
        return pa.table(
            [pa.array([x[0] for x in out], pa.int32()), *[pa.array([x[k] for x in out], pa.binary()) for k in (1, 2, 3)]],
            names=["block", "ids", "counts", "info"],
        )

    return count


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _sum(group: pa.Table) -> pa.Table:
    infos, ids, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for a, b, info in zip(*(group.column(c).to_pylist() for c in ("ids", "counts", "info")), strict=True):
        if info is not None:
            infos.append(vectors.unpacked(info, np.uint64).reshape(7, -1))
        else:
            ids.append(vectors.unpacked(a, np.int64, rising=True))
            counts.append(vectors.unpacked(b, np.uint32))
    info = np.concatenate(infos, axis=1)
    docs, at = np.unique(np.concatenate(ids), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(docs)).astype(np.int64)
    doc = info[0].view(np.int64)
    more = np.zeros(len(doc), np.int64)
    if len(docs):
        place = np.minimum(np.searchsorted(docs, doc), len(docs) - 1)
        more = np.where(docs[place] == doc, total[place], 0)
    return pa.table(
        [pa.array(info[5].view(np.int64)), pa.array(info[6].view(np.int64)), pa.array(info[1].view(np.int64)), pa.array(info[2].view(np.int64)), pa.array(info[3].view(np.int64)), pa.array(info[4].view(np.int64) + more)],
        names=["doc", "text_hash", "n", "one", "two", "common"],
    )


def bounds(docs: DataFrame, n_blocks: int, size: int) -> DataFrame:
    """(doc, text_hash, n, one, two, common): the set's size, its digest, and how many of its n-grams another row has, at most.

    Rows are told apart by ``row``; those that share it count their n-grams together, which can only raise ``common``.
    """
    n_ranges = max(1, -(-n_blocks // BLOCKS_PER_RANGE))
    sent = docs.mapInArrow(_send(n_ranges, size), "range int, hashes binary, ids binary, places binary, shared binary, info binary")
    counted = sent.groupBy("range").applyInArrow(_count(n_blocks), "block int, ids binary, counts binary, info binary")
    return counted.groupBy("block").applyInArrow(_sum, "doc bigint, text_hash bigint, n bigint, one bigint, two bigint, common bigint")


def _sets(size: int):
    """Rows whose set isn't the class's have another text with the same id, and go."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in vectors.pieces(batch.column("text")):
                text, g = shingles(piece, size)
                part = batch.slice(piece.rows.start, piece.rows.stop - piece.rows.start)
                sizes = np.bincount(text, minlength=part.num_rows)
                one, two = _digest(g, sizes)
                right = sizes == part.column("n").to_numpy()
                for of, name in ((one, "one"), (two, "two")):
                    right &= of.view(np.int64) == part.column(name).to_numpy()
                off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(off), pa.array(g.view(np.int64)))
                made = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "n", "rank")), grams], names=["node", "n", "rank", "grams"])
                yield made.filter(pa.array(right))

    return sets


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``SLICE`` n-grams, or one row."""
    ends, begin = batch.column("grams").offsets.to_numpy(), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + SLICE, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def _fragments(percent: int, beside: str):
    """(sig, node, beside): a hash of each fragment of each set."""

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            n = batch.column("n").to_numpy()
            lists = batch.column("grams")
            off = lists.offsets.to_numpy().astype(np.int64)
            g = lists.values.to_numpy()[off[0] : off[-1]].view(np.uint64)
            row = np.repeat(np.arange(len(n)), np.diff(off))
            firsts = size_classes(int(n.max()) * 2 + 2, percent)
            own_class = np.searchsorted(firsts, n, "right") - 1
            for scheme in (own_class, own_class + 1):
                top = firsts[scheme + 1] - 1
                count = n_fragments(top, percent)
                # From any set that it can link with here, a set differs in no more fragments than this.
                apart = (100 - percent) * (n + np.minimum(n * 100 // percent, top)) // (100 + percent)
                f = ((g >> np.uint64(32)) * count[row].astype(np.uint64)) >> np.uint64(32)
                new = np.ones(len(g), bool)
                new[1:] = (row[1:] != row[:-1]) | (f[1:] != f[:-1])
                at = np.flatnonzero(new)
                tag = vectors.mix(scheme[row[at]].astype(np.uint64) * vectors.M1 + f[at])
                sig = vectors.mix(np.add.reduceat(vectors.mix(g), at) + tag)
                who = held = row[at]
                bare = np.flatnonzero(np.bincount(who, minlength=len(n)) <= apart)
                for k in bare.tolist():  # all fragments that it shares with another may be empty: they count like the others
                    empty = np.setdiff1d(np.arange(count[k]), f[at][held == k].astype(np.int64)).astype(np.uint64)
                    tags = vectors.mix(np.full(len(empty), scheme[k], np.uint64) * vectors.M1 + empty)
                    sig, who = np.append(sig, vectors.mix(tags)), np.append(who, np.full(len(empty), k))
                whole = batch.select(["node", beside]).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), *whole.columns], names=["sig", "node", beside])

    return fragments


def _pairs(of: DataFrame, sizes: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Distinct (x, y, total) of the nodes a and b; unless every, of those that may link, by the sizes and by what other documents have of either set: the sum's share that the overlap must reach."""
    pairs = of.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    one = sizes.select(F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("own").alias("own_x"))
    two = sizes.select(F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("own").alias("own_y"))
    bound = F.least(F.col("n_x") - F.col("own_x"), F.col("n_y") - F.col("own_y"))
    total = F.col("n_x") + F.col("n_y")
    near = (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent) & (bound * (100 + percent) >= total * percent)
    return pairs.join(one, "x").join(two, "y").where(F.lit(every) | near).select("x", "y", total.alias("total"))


def _parts(sets: DataFrame) -> DataFrame:
    """(node, part, grams): each set cut by the two highest bits of the hashes."""
    shift = 64 - (PARTS - 1).bit_length()

    def of(part: int) -> Column:
        return F.filter("grams", lambda g: F.shiftrightunsigned(g, shift) == part)

    cut = F.array(*map(of, range(PARTS)))
    return sets.select("node", F.posexplode(cut).alias("part", "grams"))


def _homes(sizes: DataFrame, to_best: DataFrame) -> DataFrame:
    """(node, block): a block's sets have about ``BLOCK_GRAMS`` n-grams together. Classes with the same smallest best class
    are in the same block, which others share, or, if they are too many, in blocks of their own."""
    family = to_best.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("family"))
    placed = sizes.join(family, "node", "left").select("node", "n", F.coalesce("family", "node").alias("family"))
    all_blocks = max(1, -(-(placed.agg(F.sum("n")).first()[0] or 0) // BLOCK_GRAMS))
    blocks = F.ceil(F.sum("n") / BLOCK_GRAMS).alias("blocks")
    found = _looked_up(placed, placed.groupBy("family").agg(F.count("*").alias("m"), blocks), ["family"])
    own = F.xxhash64("family", F.pmod(F.xxhash64("node"), F.col("blocks")))
    return found.select("node", F.when(F.col("blocks") > 1, own).otherwise(F.pmod(F.xxhash64("family"), F.lit(all_blocks))).alias("block"))


def _partial(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The overlaps in one part of the order: for each x those with its ys, in their order."""
    if not len(pairs) or not len(sets):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64()))], names=["cell", "x", "found"])
    nodes = sets.column("node").to_numpy()
    lists = sets.column("grams").combine_chunks()
    off = lists.offsets.to_numpy().astype(np.int64)
    known, gram = np.unique(lists.values.to_numpy()[off[0] : off[-1]], return_inverse=True)
    off = off - off[0]
    order = np.argsort(nodes)
    x, others = pairs.column("x").to_numpy(), pairs.column("ys").combine_chunks()
    ends_y = others.offsets.to_numpy().astype(np.int64)
    y = others.values.to_numpy()[ends_y[0] : ends_y[-1]]
    ends_y = ends_y - ends_y[0]
    at = order[np.searchsorted(nodes, y, sorter=order)]
    here = order[np.searchsorted(nodes, x, sorter=order)]
    sizes = off[at + 1] - off[at]
    overlap = np.zeros(len(y), np.int64)
    mark = np.zeros(len(known), bool)
    for k, (a, b) in enumerate(zip(ends_y[:-1].tolist(), ends_y[1:].tolist(), strict=True)):
        mine = gram[off[here[k]] : off[here[k] + 1]]
        mark[mine] = True
        for c in range(a, b, 1024):
            part = slice(c, min(b, c + 1024))
            ends = np.cumsum(sizes[part])
            which = np.repeat(off[at[part]] - (ends - sizes[part]), sizes[part]) + np.arange(ends[-1])
            found = np.concatenate([[0], np.cumsum(mark[gram[which]])])
            overlap[part] = found[ends] - found[ends - sizes[part]]
        mark[mine] = False
    found = pa.ListArray.from_arrays(pa.array(ends_y.astype(np.int32)), pa.array(overlap))
    return pa.table([pairs.column("cell").combine_chunks(), pa.array(x), found], names=["cell", "x", "found"])


def overlaps(pairs: DataFrame, sets: DataFrame, homes: DataFrame) -> DataFrame:
    """(x, y, total, overlap) of the pairs: partial overlaps of the parts, summed per pair.

    Pairs of the same two blocks are counted together, in one cell, one part of the order at a time, so that a set is
    sent once for each cell and not for each pair. A cell's pairs go as lists of the ys of each x, which no more than a block has, and their overlaps come back
    in the same order, without the ys.
    """
    placed = pairs.join(homes.select(F.col("node").alias("x"), F.col("block").alias("block_x")), "x")
    placed = placed.join(homes.select(F.col("node").alias("y"), F.col("block").alias("block_y")), "y")
    placed = placed.select("x", "y", "total", F.xxhash64("block_x", "block_y").alias("cell"))
    lists = placed.groupBy("cell", "x").agg(F.array_sort(F.collect_list(F.struct("y", "total"))).alias("of"))
    lists = shared.written(lists.select("cell", "x", F.col("of.y").alias("ys"), F.col("of.total").alias("totals")), "ngram-pairs")
    grams = lists.agg(F.sum(F.aggregate("totals", F.lit(0).cast("long"), lambda s, n: s + n))).first()[0]
    to = F.pmod("cell", F.lit(max(1, -(-(grams or 0) // CELL_GRAMS))))  # small cells share one
    asked = lists.select("cell", "x", "ys", to.alias("at"), F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"))
    wanted = lists.select(to.alias("to"), F.explode(F.array_append("ys", F.col("x"))).alias("node")).distinct()
    shipped = wanted.join(_parts(sets), "node")
    partial = asked.groupBy("at", "part").cogroup(shipped.groupBy("to", "part")).applyInArrow(_partial, "cell bigint, x bigint, found array<bigint>")
    none = F.transform("ys", lambda _: F.lit(0).cast("long"))
    both = lists.join(partial.groupBy("cell", "x").agg(F.collect_list("found").alias("parts")), ["cell", "x"])
    summed = F.aggregate("parts", none, lambda s, one: F.zip_with(s, one, lambda m, n: m + n))
    return both.select("x", F.explode(F.arrays_zip(F.col("ys").alias("y"), F.col("totals").alias("total"), summed.alias("overlap"))).alias("p")).select("x", "p.*")


def _links(counted: DataFrame, percent: int) -> DataFrame:
    return counted.where(F.col("overlap") * (100 + percent) >= F.col("total") * percent).select("x", "y")


def _texts(docs: DataFrame, alive: DataFrame) -> DataFrame:
    """The text of each class, by its smallest id; a row that is there several times is taken once."""
    found = docs.join(alive, F.col("key") == F.col("doc")).drop("key", "doc")
    return found.where("copies = 1").union(found.where("copies > 1").distinct()).drop("copies")


def _looked_up(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of ``known``, whose ``m`` says how many rows have each key. Keys of very many rows are few, and go to the rows instead of the rows to them."""
    total = rows.count()
    hot = F.broadcast(known.where(F.col("m") * HOT > total).drop("m"))
    cold = known.where(F.col("m") * HOT <= total).drop("m")
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))


def _best(sigs: DataFrame) -> DataFrame:
    """(sig, best): for each fragment of several classes that of the highest rank, which stands in the bits above the node, then the smallest."""
    packed = F.shiftleft(F.lit(127).cast("long") - F.col("rank"), NODE_BITS).bitwiseOR(F.col("node"))
    found = sigs.groupBy("sig").agg(F.min(packed).alias("top"), F.count("*").alias("m")).where("m > 1")
    return found.select("sig", F.col("top").bitwiseAND(F.lit((1 << NODE_BITS) - 1)).alias("best"))


def _apart(sets: DataFrame, found: DataFrame, best: DataFrame, first: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes that share a fragment, are in different components and may still link.

    What a class has in common with the fragment's best class splits its n-grams in two, and either part bounds the
    overlap with a third class: of the first by the smaller part, of the rest by what is neither's own. Where one of
    the two was not compared with the best class, only what is neither's own bounds it.
    """
    named = sets.join(found, "node", "left").select("node", "n", "grams", F.coalesce("component", "node").alias("of"))
    named = named.mapInArrow(_fragments(percent, "of"), "sig bigint, node bigint, of bigint")
    split = named.groupBy("sig").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi").select("sig")
    met = named.join(split, "sig").join(best, "sig").join(sizes, "node")
    met = met.withColumns({"x": F.least("node", "best"), "y": F.greatest("node", "best")}).join(first.drop("total"), ["x", "y"], "left")
    inner = F.when(F.col("node") == F.col("best"), F.col("n")).otherwise(F.col("overlap"))
    open_ = met.select("sig", "of", "n", F.col("node").alias("a"), "own", inner.alias("inner"), (F.col("n") - inner - F.col("own")).alias("outer"))
    open_ = shared.written(open_, "ngram-open")
    other = open_.select("sig", *[F.col(c).alias(f"{c}_b") for c in ("of", "n", "own", "inner", "outer")], F.col("a").alias("b"))
    split_bound = F.least("inner", "inner_b") + F.greatest(F.least("outer", "outer_b"), F.lit(0))
    whole_bound = F.least(F.col("n") - F.col("own"), F.col("n_b") - F.col("own_b"))
    bound = F.when(F.col("inner").isNull() | F.col("inner_b").isNull(), whole_bound).otherwise(split_bound)
    near = bound * (100 + percent) >= (F.col("n") + F.col("n_b")) * percent
    return open_.join(other, "sig").where((F.col("of") < F.col("of_b")) & near).select("a", "b")


def join(df: DataFrame, doc: str, text: str, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc, n_shingles, component_id, text_hash) for each row of ``df``; text_hash is Spark's xxhash64 of the text."""
    key = F.coalesce(F.col(doc).cast("long"), F.lit(int(LAST)))
    docs = df.select(key.alias("key"), F.col(text).alias("text"))
    rows = docs.withColumns({"row": F.xxhash64("key", "text", F.spark_partition_id()), "text_hash": F.xxhash64("text")})
    known = shared.written(bounds(rows, shared.n_blocks(df, text), size), "ngram-bounds")
    digest = ["n", "one", "two"]
    held = known.where("n > 0").groupBy(*digest, "doc").agg(F.count("*").alias("copies"), F.max("common").alias("common"))
    classes = held.groupBy(*digest).agg(F.min(F.struct("doc", "copies")).alias("first"), F.max("common").alias("common"), F.sum("copies").alias("m"))
    classes = classes.select(*digest, "first.*", "common", "m").repartitionByRange("doc", *digest).sortWithinPartitions("doc", *digest)
    # In the order of the smallest ids, so that the smallest node of a component has its smallest id; written, so that nodes stay.
    classes = shared.written(classes.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    common = F.least("common", "n")
    rank = F.floor(F.log2(common + 1) * 4).cast("int").alias("rank")
    alive = classes.where(F.col("common") * 100 >= F.col("n") * percent).select("node", "doc", *digest, (F.col("n") - common).alias("own"), rank, "copies")
    sets = _texts(docs, alive)
    sets = shared.written(sets.mapInArrow(_sets(size), "node bigint, n bigint, rank int, grams array<bigint>"), "ngram-sets")
    sizes = alive.select("node", "n", "own")
    sigs = shared.written(sets.mapInArrow(_fragments(percent, "rank"), "sig bigint, node bigint, rank int"), "ngram-fragments")
    best = _best(sigs)
    to_best = sigs.select("sig", F.col("node").alias("a")).join(best, "sig").where("a <> best").select("a", F.col("best").alias("b"))
    to_best = shared.written(to_best.distinct(), "ngram-best")
    homes = shared.written(_homes(sizes, to_best), "ngram-homes")
    first = shared.written(overlaps(_pairs(to_best, sizes, percent, every=True), sets, homes), "ngram-overlaps")
    found = components(_links(first, percent))
    second = _pairs(_apart(sets, found, best, first, sizes, percent), sizes, percent).join(first.select("x", "y"), ["x", "y"], "left_anti")
    more = shared.written(_links(overlaps(second, sets, homes), percent), "ngram-links")
    stars = found.where("node <> component").select(F.col("component").alias("x"), F.col("node").alias("y"))
    found = components(stars.union(more))
    named = classes.join(found, "node", "left").select(*digest, "m", F.coalesce("component", "node").alias("component"))
    of_component = named.groupBy("component").agg(F.count("*").alias("m")).join(classes.select(F.col("node").alias("component"), F.col("doc").alias("least")), "component")
    named = shared.written(_looked_up(named.withColumnRenamed("m", "members"), of_component, ["component"]), "ngram-components")
    full = known.where("n > 0").select("doc", "text_hash", *digest)
    out = _looked_up(full, named.select(*digest, F.col("members").alias("m"), "least"), digest).select("doc", "n", "least", "text_hash")
    out = out.union(known.where("n = 0").select("doc", "n", F.col("doc").alias("least"), "text_hash"))
    back = [F.when(F.col(c) != int(LAST), F.col(c)) for c in ("doc", "least")]
    return out.select(back[0].alias(doc), F.col("n").alias("n_shingles"), back[1].alias("component_id"), "text_hash")
