"""Blocks of many points: the same nearest ones, ties included, by few tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqengine.operators import matching


@pytest.mark.parametrize("kind", ["spread", "ties", "far from zero", "nan", "nearly equal"])
@pytest.mark.parametrize("sizes", [(1, 1), (40, 1), (1, 40), (70, 90)])
def test_like_a_full_table(kind, sizes):
    rng = np.random.default_rng(1)
    a, b = (rng.normal(size=(n, 5)) if kind != "ties" else rng.integers(0, 2, (n, 5)).astype(float) for n in sizes)
    if kind == "far from zero":
        a, b = a + 1e6, b + 1e6
    if kind == "nan":
        a[0, 2] = np.nan
    if kind == "nearly equal":
        a, b = (1 + 1e-10 * x for x in (a, b))
    far = np.round(np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)), 9)
    for tile in (16, 256):
        for way, table in enumerate((far, far.T)):
            best = np.argsort(table, axis=1, kind="stable")[:, : 2 - way]
            own, other, distance = matching.two_nearest(a, b, 9, tile)[way]
            np.testing.assert_array_equal(own, np.repeat(np.arange(len(table)), best.shape[1]))
            np.testing.assert_array_equal(other, best.reshape(-1))
            np.testing.assert_array_equal(distance, np.take_along_axis(table, best, 1).reshape(-1))


def test_blocks_grow_with_a_frame(spark):
    """Small blocks are for small frames: a frame makes eight of them until they are large."""
    rows = spark.range(6000).select(F.lit("a").alias("pair"), F.col("id").alias("point"), F.array(F.col("id") * 1.0).alias("vec"))
    dealt = matching._dealt(rows, rows.limit(100), "pair", "point", "vec", 20, "_i")
    assert dealt.select("_i").distinct().count() == 8 and dealt.select("_j").distinct().count() == 5 and dealt.count() == 30_000


def test_mutual_over_many_blocks(spark):
    """Blocks of one point are for small frames only; who is nearest to whom is the same."""
    rng = np.random.default_rng(2)
    here, there = rng.integers(0, 5, (60, 3)).astype(float), rng.integers(0, 5, (45, 3)).astype(float)
    frame = lambda rows, base: spark.createDataFrame([("a", base + i, v.tolist()) for i, v in enumerate(rows)], "pair string, point long, vec array<double>")
    assert matching._dealt(frame(here, 0), frame(there, 100), "pair", "point", "vec", 1, "_i").select("_i", "_j").distinct().count() <= 64
    far = np.round(np.sqrt(((here[:, None] - there[None]) ** 2).sum(axis=2)), 9)
    expected = {(i, 100 + j) for i, j in enumerate(far.argmin(axis=1)) if far[:, j].argmin() == i}
    assert {(r.point, r.other) for r in matching.mutual(frame(here, 0), frame(there, 100), "pair", "point", "vec", 1).collect()} == expected
