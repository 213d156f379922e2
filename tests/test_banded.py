"""The partitioned banded solver against dense solves, however a clip is cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqengine.operators import banded, smooth


def dense(path, weight, closeness):
    n = len(path)
    a = np.eye(n) * closeness / n
    for order, stencil in enumerate(([-1, 1], [1, -2, 1], [-1, 3, -3, 1]), 1):
        d = sum(np.eye(n - order, n, k) * x for k, x in enumerate(stencil))
        a += d.T @ np.diag(weight[: n - order] / (n - order)) @ d
    return np.linalg.solve(a, closeness / n * path)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 8, 37])
def test_cyclic_reduction(k):
    rng = np.random.default_rng(k)
    m = rng.normal(size=(3 * k, 3 * k))
    mask = np.abs(np.subtract.outer(np.arange(3 * k) // 3, np.arange(3 * k) // 3)) <= 1
    m = (m + m.T) * mask + np.eye(3 * k) * 30
    right = rng.normal(size=(3 * k, 2))
    blocks = m.reshape(k, 3, k, 3).swapaxes(1, 2)
    upper = np.stack([blocks[i, min(i + 1, k - 1)] for i in range(k)])
    found = banded.solve_blocks(np.stack([blocks[i, i] for i in range(k)]), upper, right.reshape(k, 3, 2))
    assert found.reshape(-1, 2) == pytest.approx(np.linalg.solve(m, right), abs=1e-10)


@pytest.mark.parametrize("n", [8, 9, 10, 11, 90])
def test_in_memory(n):
    rng = np.random.default_rng(n)
    path, weight = rng.normal(size=n).cumsum(), rng.random(n) * (rng.random(n) > 0.2)
    assert banded.smoothest(path, weight, 1e-3) == pytest.approx(dense(path, weight, 1e-3), abs=1e-8)


@pytest.mark.parametrize("run", [250, 72, 5])  # the longest clip in 2, 7 and 100 runs
def test_clips_in_runs_equal_the_dense_solve(spark, run):
    rng, rows, clips = np.random.default_rng(2), [], {}
    for clip, n in ((1, 5), (2, 8), (3, 61), (None, 200), (4, 1501)):
        p, q, w = rng.normal(size=n).cumsum(), rng.random(n), rng.random(n) * (rng.random(n) > 0.2)
        clips[clip] = (p, q, w)
        rows += [(clip, i + 1, float(p[i]), float(q[i]), float(w[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "c int, pos int, p double, q double, weight double").repartition(5)
    out = smooth.smooth_paths(df, "c", "pos", ["p", "q"], run=run)
    assert out.dtypes == [("c", "int"), ("pos", "int"), ("smooth_p", "double"), ("smooth_q", "double")]
    found = out.collect()
    assert len(found) == len(rows)
    for clip, (p, q, w) in clips.items():
        own = sorted((r for r in found if r.c == clip), key=lambda r: r.pos)
        for k, path in ((2, p), (3, q)):
            expected = path if len(path) < 8 else dense(path, w, 1e-3)
            assert [r[k] for r in own] == pytest.approx(expected, abs=1e-8)


def test_no_task_holds_a_clip(spark):
    """A run has at most twice its rows, whatever the length of the clip."""
    for n in (60, 119, 120, 3000, 3059):
        runs = spark.range(n).groupBy(banded._number(F.col("id"), F.lit(max(n // 60, 1)), 60).alias("run")).count().collect()
        assert sorted(r.run for r in runs) == list(range(n // 60)) and max(r["count"] for r in runs) < 120


def test_empty_and_short(spark):
    empty = spark.createDataFrame([], "c int, pos int, p double, weight double")
    assert smooth.smooth_paths(empty, "c", "pos", ["p"]).isEmpty()
    with pytest.raises(ValueError):
        smooth.smooth_paths(empty, "c", "pos", ["p"], run=1)
