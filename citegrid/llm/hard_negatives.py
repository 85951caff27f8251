"""Hard-negative mining by one-dimensional distance keys.

Vectors are scaled to whole numbers x. With M the longest length, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have the distance
sqrt(|q|^2 + M^2 - 2 x.q), so the highest inner products are the nearest x'. Each row's key is (pivot, distance of x' to that pivot), the
pivot being the nearest of ``PIVOTS`` means fitted on a sample. Rows are stored in the order of their keys, in blocks of at most
``BLOCK`` rows with the interval of their distances; no block depends on how many rows share a key.

Anchors are packed in the same order. In each round a pack asks, for each pivot, for the blocks that meet the interval of its own
distances widened by a radius, but for those it met before: the next annulus. Blocks and packs meet by equal cells of the
distance. The k-th best score of a request bounds the distance within which a better row can be; a request whose bound is
within the radius is certified and asks no more; the others go on with about twice the radius or their largest bound, if that is less. So rounds
grow with the logarithm of the radius, and no row is left out.

The first search finds the positives. Each of them is then a request for the rows of other labels whose scores lie in its window.

Scores are exact: products are sums of whole numbers below 2^53 (doubles; below 2^24 floats), beyond that integers.

Defined results: rows without id, label or vector, or with a null or non-finite component, take no part, nor do vectors whose squared
length reaches 2^62, as their scores would be no longs; shorter vectors are filled up with zeros; an empty one is all zeros; repeated rows are rows
of their own, each an anchor where it is one; a tie goes to the smaller id; a positive with a score below zero has no window and no
rows; an empty table gives no rows; other columns are ignored, whatever their names.

Sample: the ``SAMPLE`` rows with the smallest hash of their id fit the means alone; all rows are stored and searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.llm import shared

PIVOTS, SAMPLE, ROUNDS = 32, 2048, 6
BLOCK, PACK = 1024, 128
SCALE = 256
#: Cells of the distance in M, the least first radius in M, and how a radius grows at most.
CELLS, START, GROWTH = 16, 0.5, 2.1
#: A radius has this much of M more than its bound, for what rounding does to distances.
SLACK = 1e-5

KEYED = "pivot int, dist double, id bigint, label bigint, asks boolean, vec binary"
BLOCKS = "block bigint, pivot int, lo double, hi double, n int, ids binary, labels binary, dists binary, asks binary, vecs binary"
FOUND = "pack bigint, req int, score bigint, id bigint, key bigint"


class Space:
    """What the keys rest on; small, and sent with the tasks."""

    def __init__(self, dim: int, top: float, widest: float) -> None:
        self.dim, self.top = max(dim, 1), top
        self.store = np.int16 if widest < 2**15 else np.int32
        self.kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
        self.radius = float(np.sqrt(top))
        self.pivots = np.zeros((1, self.dim + 1))

    def whole(self, lists: pa.ListArray) -> np.ndarray:
        off = lists.offsets.to_numpy()
        values = np.floor(lists.values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64)
        n = np.diff(off)
        out = np.zeros((len(lists), self.dim), np.int64)
        row = np.repeat(np.arange(len(lists)), n)
        out[row, np.arange(off[0], off[-1]) - np.repeat(off[:-1], n)] = values[off[0] : off[-1]]
        return out

    def raised(self, x: np.ndarray, lift: bool = True) -> np.ndarray:
        x = x.astype(np.float64)
        rest = np.sqrt(np.maximum(self.top - (x * x).sum(1), 0)) if lift else np.zeros(len(x))
        return np.column_stack([x, rest])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """To all pivots."""
        two = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None, :] - 2 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(two, 0))

    def fit(self, x: np.ndarray) -> None:
        x = np.unique(self.raised(x), axis=0)
        self.pivots = x[np.linspace(0, len(x) - 1, min(PIVOTS, len(x))).astype(int)]
        for _ in range(ROUNDS):
            own = self.distances(x).argmin(1)
            self.pivots = np.array([x[own == k].mean(0) if (own == k).any() else p for k, p in enumerate(self.pivots)])

    def read(self, data, n: int) -> np.ndarray:
        return np.frombuffer(data, self.store, n * self.dim).reshape(n, self.dim)


def _keyed(space: Space):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = space.whole(batch.column("vec"))
            d = space.distances(space.raised(x))
            pivot = d.argmin(1)
            vecs = [r.tobytes() for r in x.astype(space.store)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pivot, pa.int32()), pa.array(d[np.arange(len(d)), pivot]), batch.column("id"), batch.column("label"), batch.column("asks"), pa.array(vecs, pa.binary())],
                names=["pivot", "dist", "id", "label", "asks", "vec"],
            )

    return keyed


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows that follow one another with one pivot, at most ``most`` at a time."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        pivot = batch.column("pivot").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            while a < b:
                if held and (held[0].column("pivot")[0].as_py() != pivot[a] or sum(x.num_rows for x in held) >= most):
                    yield joined()
                    held = []
                k = min(b - a, most - sum(x.num_rows for x in held))
                held.append(batch.slice(a, k))
                a += k
    if held:
        yield joined()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    for k, rows in enumerate(_runs(batches, BLOCK)):
        d = rows.column("dist").to_numpy()
        as_bytes = lambda name, kind: rows.column(name).to_numpy(zero_copy_only=False).astype(kind).tobytes()  # noqa: E731, B023
        vecs = b"".join(rows.column("vec").to_pylist())
        one = {"block": first + k, "pivot": rows.column("pivot")[0].as_py(), "lo": d.min(), "hi": d.max(), "n": len(d), "ids": as_bytes("id", np.int64), "labels": as_bytes("label", np.int64)}
        one |= {"dists": d.tobytes(), "asks": as_bytes("asks", np.uint8), "vecs": vecs}
        types = {"block": pa.int64(), "pivot": pa.int32(), "n": pa.int32()}
        yield pa.RecordBatch.from_pydict({c: pa.array([v], types.get(c)) for c, v in one.items()})


def _keys(block: int, n: int) -> np.ndarray:
    return block * BLOCK + np.arange(n)


def _anchors(space: Space):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(r["asks"], np.uint8))
                if len(at):
                    x = space.read(r["vecs"], r["n"])[at]
                    ids, labels, d = (np.frombuffer(r[c], k)[at] for c, k in (("ids", np.int64), ("labels", np.int64), ("dists", np.float64)))
                    arrays = [pa.array(np.full(len(at), r["pivot"]), pa.int32()), pa.array(d), pa.array(ids), pa.array(labels), pa.array(_keys(r["block"], r["n"])[at]), pa.array([v.tobytes() for v in x], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["pivot", "dist", "id", "label", "key", "vec"])

    return anchors


def _packs(space: Space):
    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, rows in enumerate(_runs(batches, PACK)):
            x = space.read(b"".join(rows.column("vec").to_pylist()), rows.num_rows)
            d = space.distances(space.raised(x, lift=False))
            norms = (x.astype(np.int64) ** 2).sum(1)
            take = lambda c: rows.column(c).to_numpy()  # noqa: E731, B023
            one = {"pack": first + k, "near": d.min(0).tolist(), "far": d.max(0).tolist(), "ids": take("id").tolist(), "norms": norms.tolist()}
            one |= {"n": len(x), "keys": take("key").tobytes(), "labels": take("label").tobytes(), "vecs": x.tobytes()}
            yield pa.RecordBatch.from_pydict({c: pa.array([v], pa.int32() if c == "n" else None) for c, v in one.items()})

    return packs


PACKS = "pack bigint, near array<double>, far array<double>, ids array<bigint>, norms array<bigint>, n int, keys binary, labels binary, vecs binary"


def _scored(space: Space, same: bool, k: int):
    """The first ``k`` rows of a block for each request of a pack, but for those under its k-th best so far."""
    least = np.iinfo(np.int64).min

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                ids = np.frombuffer(r["b_ids"], np.int64)
                order = np.argsort(ids, kind="stable")
                ids, labels, keys = ids[order], np.frombuffer(r["b_labels"], np.int64)[order], _keys(r["block"], len(ids))[order]
                x = space.read(r["b_vecs"], len(ids))[order].astype(space.kind)
                slot, req = np.array([q["slot"] for q in r["reqs"]]), np.array([q["req"] for q in r["reqs"]], np.int32)
                hi, lo = (np.array([q[c] for q in r["reqs"]], np.int64)[:, None] for c in ("hi", "lo"))
                own, of = np.unique(slot, return_inverse=True)
                q = space.read(r["vecs"], r["n"])[own].astype(space.kind)
                scores = (q @ x.T).astype(np.int64)
                mine = np.frombuffer(r["labels"], np.int64)[own]
                fits = (mine[:, None] == labels[None, :]) == same
                fits &= np.frombuffer(r["keys"], np.int64)[own][:, None] != keys[None, :]
                wanted = scores[of]
                wanted = np.where(fits[of] & (wanted <= hi) & (wanted >= lo), wanted, least)
                some = np.flatnonzero((wanted > least).any(1))
                if not len(some):
                    continue
                wanted = wanted[some]
                n = min(k, wanted.shape[1])
                if space.top < 2**50 and n < wanted.shape[1]:  # one number for score and place, so that ties are in order
                    at = np.where(wanted > least, wanted * BLOCK + (BLOCK - 1 - np.arange(wanted.shape[1])), least)
                    best = np.argpartition(at, wanted.shape[1] - n, axis=1)[:, -n:]
                else:
                    best = np.lexsort((np.broadcast_to(-np.arange(wanted.shape[1]), wanted.shape), wanted), axis=1)[:, -n:]
                score = np.take_along_axis(wanted, best, 1)
                there = score > least
                out = np.repeat(req[some], there.sum(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(out), r["pack"])), pa.array(out), pa.array(score[there]), pa.array(ids[best[there]]), pa.array(keys[best[there]])],
                    names=["pack", "req", "score", "id", "key"],
                )

    return scored


class Index:
    """The stored rows and the anchors in packs."""

    def __init__(self, space: Space, blocks: DataFrame, packs: DataFrame) -> None:
        self.space, self.blocks, self.packs = space, blocks, packs
        self.width = max(space.radius / CELLS, 1e-9)
        cell = lambda c: F.floor(F.col(c) / self.width)
        spans = blocks.select("block", "pivot", "lo", "hi", cell("lo").alias("b_cell"), F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
        self.spans = spans

    def met(self, asks: DataFrame) -> DataFrame:
        """(pack, block) of the blocks within a pack's radius and not within its last one."""
        sides = asks.select("pack", "radius", "last", F.posexplode(F.arrays_zip("near", "far")).alias("pivot", "d"))
        most = 2 * self.space.radius * (1 + SLACK)
        sides = sides.select(
            "pack", "pivot", F.greatest(F.lit(0.0), F.col("d.near") - F.col("radius")).alias("a"), F.least(F.lit(most), F.col("d.far") + F.col("radius")).alias("b"), (F.col("d.near") - F.col("last")).alias("a0"), (F.col("d.far") + F.col("last")).alias("b0")
        ).where("a <= b")
        first = F.floor(F.col("a") / self.width)
        sides = sides.withColumn("a_cell", first).withColumn("cell", F.explode(F.sequence(first, F.floor(F.col("b") / self.width))))
        pairs = sides.join(self.spans, ["pivot", "cell"])
        pairs = pairs.where("lo <= b and hi >= a and cell = greatest(a_cell, b_cell)")
        return pairs.where("a0 is null or not (lo <= b0 and hi >= a0)").select("pack", "block")

    def search(self, requests: DataFrame, same: bool, k: int, start: Column) -> DataFrame:
        """(pack, slot, req, .., found) for ``requests`` (pack, slot, req, hi, lo and others): the first ``k`` rows of each, in order.

        ``start`` is a pack's first radius over its requests, in units of distance.
        """
        space = self.space
        norms = self.packs.select("pack", F.posexplode("norms").alias("slot", "norm"))
        none = F.expr("cast(array() as array<struct<rev:bigint,id:bigint,key:bigint>>)")
        state = shared.cut(requests.join(norms, ["pack", "slot"]).withColumn("found", none))
        reach = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + space.top - 2.0 * score)) + SLACK * space.radius
        kth = F.when(F.size("found") == k, -F.get("found", F.lit(k - 1))["rev"])
        # Without k rows, what the window's end bounds; at most two radii lie between any two points.
        need = F.least(reach(F.coalesce(kth, F.col("lo"))), F.lit(2 * space.radius * (1 + 2 * SLACK)))
        radii = shared.cut(state.groupBy("pack").agg(start.cast("double").alias("radius")).withColumn("last", F.lit(None).cast("double")))
        open_ = state
        vectors = self.packs.select("pack", "near", "far", "n", "keys", "labels", "vecs")
        stored = self.blocks.select("block", *[F.col(c).alias(f"b_{c}") for c in ("ids", "labels", "vecs")])
        while True:
            reqs = open_.groupBy("pack").agg(F.collect_list(F.struct("req", "slot", "hi", F.greatest("lo", F.coalesce(kth, F.col("lo"))).alias("lo"))).alias("reqs"))
            asks = vectors.join(radii, "pack").join(reqs, "pack")
            pairs = self.met(vectors.join(radii, "pack").select("pack", "near", "far", "radius", "last"))
            units = pairs.join(asks.drop("near", "far", "radius", "last"), "pack").join(stored, "block")
            hits = units.mapInArrow(_scored(space, same, k), FOUND)
            hits = hits.select("pack", "req", (-F.col("score")).alias("rev"), "id", "key")
            before = state.select("pack", "req", F.explode("found").alias("f")).select("pack", "req", "f.*")
            rank = F.row_number().over(Window.partitionBy("pack", "req").orderBy("rev", "id", "key"))
            best = hits.unionByName(before).withColumn("_rank", rank).where(F.col("_rank") <= k)
            best = best.groupBy("pack", "req").agg(F.array_sort(F.collect_list(F.struct("rev", "id", "key"))).alias("_now"))
            state = state.join(best, ["pack", "req"], "left").withColumn("found", F.coalesce("_now", "found")).drop("_now")
            state = shared.cut(state)
            open_ = state.join(radii, "pack").withColumn("need", need).where(F.col("need") > F.col("radius"))
            step = open_.groupBy("pack").agg(F.first("radius").alias("last"), F.least(GROWTH * F.first("radius"), F.max("need")).alias("radius"))
            radii = shared.cut(step.select("pack", "radius", "last"))
            if radii.isEmpty():
                return state
            open_ = open_.drop("need", "radius", "last")


def build(df: DataFrame, vec_id: str, vector: str, label: str, anchor: Column) -> Index | None:
    """Stores the rows by their keys in the shared folder; ``anchor`` says which of them ask."""
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("asks"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above all numbers
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * SCALE).cast("double"), 2.0))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(finite)
    widest = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    rows = rows.where(F.coalesce(widest, F.lit(0.0)) < 2.0**31 / SCALE).where(norm < 2.0**62)
    dim, top, wide = rows.agg(F.max(F.size("vec")), F.max(norm), F.max(widest)).first()
    if dim is None:
        return None
    space = Space(dim, float(top), (wide or 0.0) * SCALE + 1)
    sample = rows.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()
    space.fit(space.whole(sample.column("vec").combine_chunks()))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sorted_by(keyed: DataFrame, last: str) -> DataFrame:
        spread = keyed.withColumn("_spread", F.monotonically_increasing_id())
        return spread.repartitionByRange(n, "pivot", "dist", last, "_spread").sortWithinPartitions("pivot", "dist", last, "_spread").drop("_spread")

    blocks = shared.written(sorted_by(rows.mapInArrow(_keyed(space), KEYED), "id").mapInArrow(_blocks, BLOCKS), "distance-keys")
    asking = blocks.mapInArrow(_anchors(space), "pivot int, dist double, id bigint, label bigint, key bigint, vec binary")
    packs = shared.written(sorted_by(asking, "key").mapInArrow(_packs(space), PACKS), "anchors")
    return Index(space, blocks, packs)


COLUMNS = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(df: DataFrame, vec_id: str, vector: str, label: str, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of its label, the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score."""
    index = build(df, vec_id, vector, label, anchor)
    if index is None:
        return df.sparkSession.createDataFrame([], COLUMNS)
    space = index.space
    most = int(space.top)
    slots = index.packs.select("pack", F.posexplode("ids").alias("slot", "anchor_id"))
    every = slots.withColumns({"req": F.col("slot"), "hi": F.lit(most).cast("long"), "lo": F.lit(-most).cast("long")})
    near = index.search(every, True, positives, F.max(F.lit(START * space.radius)))
    own = near.select("pack", "slot", "anchor_id", F.posexplode("found").alias("at", "p")).withColumn("positive_score", -F.col("p.rev")).where("positive_score >= 0")
    # Hundredths of a score, rounded down or up, without passing a long.
    part = lambda percent, more: F.expr(f"positive_score div 100 * {percent} + (positive_score % 100 * {percent} + {more}) div 100")
    windows = own.select(
        "pack", "slot", "anchor_id", F.col("p.id").alias("positive_id"), "positive_score", (F.col("slot") * positives + F.col("at")).alias("req"), part(high, 0).alias("hi"), part(low, 99).alias("lo")
    )
    inner = F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + space.top - 2.0 * F.col("hi"))) + SLACK * space.radius
    far = index.search(windows, False, negatives, F.greatest(F.max(inner), F.lit(START * space.radius)))
    found = far.select("anchor_id", "positive_id", "positive_score", F.posexplode("found").alias("at", "x"))
    return found.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.rev")).alias("negative_score"))


def report(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Mines with every hundredth row as anchor, after every seventh row's label has been moved on by one."""
    moved = F.when(F.col(vec_id) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))
    return mine(df.withColumn(label, moved), vec_id, vector, label, F.col(vec_id) % 100 == 0)
