from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citegrid.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, block string, pivot string, score string, rank string, asks string"


def plain(rows, every: int = 1, k: int = 5):
    kept = []
    for i, v, y in rows:
        if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i % 7 == 0 else y))
    out = []
    for at, (i, v, y) in enumerate(kept):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, n, z) for n, (j, w, z) in enumerate(kept) if n != at)
            for s, j, _, _ in [x for x in scores if x[3] == y][:k]:
                fits = [x for x in scores if x[3] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
                out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", "p", "s", "r", "a") for r in rows], SCHEMA).repartition(3)


def mined(df, every: int = 1):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return Counter(map(tuple, hard_negatives.mine(df.withColumn("label", moved), "vec_id", "embedding", "label", F.col("vec_id") % every == 0).collect()))


def floats(spark, rows):
    """The values as the column's floats."""
    return [(r["vec_id"], r["embedding"], r["label"]) for r in frame(spark, rows).collect()]


@pytest.mark.parametrize("scale", [1.0, 60.0, 900_000.0])  # scores of floats, doubles and whole numbers
def test_clusters_copies_and_awkward_rows(spark, scale):
    luck = random.Random(scale)
    middles = [[luck.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(260):
        m = middles[i % 5]
        rows.append((i, [scale * (x + luck.gauss(0, 0.4)) for x in m], luck.choice([i % 5, luck.randrange(3)])))
    rows += [(300 + i, [scale] * 6, i % 4) for i in range(40)]  # copies: ties by id
    rows += [(400, None, 1), (401, [1.0] * 6, None), (402, [1.0, float("nan")], 1), (403, [1.0, None], 1), (404, [float("inf")], 1), (None, [1.0] * 6, 1)]
    rows += [(405, [], 1), (406, [scale], 2), (407, [0.0] * 6, 9), (408, [-scale] * 6, 8)]
    assert mined(frame(spark, rows)) == plain(floats(spark, rows))


def test_query_equals_the_plain_version(spark, sf_dir):
    from citegrid.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert Counter(map(tuple, queries.op13_hard_negatives(spark, sf_dir).collect())) == plain(rows, 100)


def test_far_blocks_are_left_out(spark):
    """An annulus that doesn't meet a block's interval isn't read."""
    luck = random.Random(1)
    rows = [(i, [10.0 * (i % 8 == k) + luck.gauss(0, 0.01) for k in range(8)], (i // 8) % 2) for i in range(4000)]
    index = hard_negatives.build(frame(spark, rows), "vec_id", "embedding", "label", F.col("vec_id") % 100 == 0)
    asks = index.packs.select("pack", "near", "far", F.lit(0.1 * index.space.radius).alias("radius"), F.lit(None).cast("double").alias("last"))
    assert 0 < index.met(asks).count() < index.packs.count() * index.blocks.count() / 2


def test_empty_and_repeated(spark):
    assert mined(frame(spark, [])) == Counter()
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.9], 2), (2, [1.0, 1.9], 2), (0, [1.0, 2.0], 0)]
    assert mined(frame(spark, rows)) == plain(rows)
