"""Nearest points in blocks against all pairs."""

import numpy as np
import pytest

from seqengine.operators import matching, quality


def frames(spark, rng):
    rows = [[], []]
    for pair, sizes in (("a", (37, 50)), ("b", (1, 1)), ("c", (12, 1)), ("only_here", (3, 0)), ("only_there", (0, 4))):
        for side, n in enumerate(sizes):
            rows[side] += [(pair, 1000 * side + i, rng.integers(0, 4, 3).astype(float).tolist()) for i in range(n)]
    rows[0].append(("a", 999, None))
    return [spark.createDataFrame(r, "pair string, point long, vec array<double>") for r in rows]


@pytest.mark.parametrize("block", [1, 5, 512])
def test_like_all_pairs(spark, block):
    """Many equal distances, too: the first by name counts."""
    now, then = frames(spark, np.random.default_rng(block))
    far = [r for r in quality.point_distances(now.filter("vec is not null"), then, "pair", "point", "vec").collect()]
    forth, back = matching.nearest(now, then, "pair", "point", "vec", block)
    expected = {}
    for r in far:
        expected.setdefault((r.pair, r.point), []).append((round(r.distance, 9), r.other))
    found = {(r.pair, r.point): (r.other, r.distance, r.second) for r in forth.collect()}
    assert found.keys() == expected.keys() and len(found) == 50
    for key, near in expected.items():
        near.sort()
        assert found[key] == (near[0][1], near[0][0], near[1][0] if len(near) > 1 else None)
    nearest = {}
    for r in far:
        nearest[r.pair, r.other] = min(nearest.get((r.pair, r.other), (9e9, 0)), (round(r.distance, 9), r.point))
    assert {(r.pair, r.other): r.point for r in back.collect()} == {k: v[1] for k, v in nearest.items()}
    both = {(r.pair, r.point, r.other) for r in matching.mutual(now, then, "pair", "point", "vec", block).collect()}
    assert both == {(p, x, near[0][1]) for (p, x), near in expected.items() if nearest[p, near[0][1]][1] == x}
    sharp = {(p, x) for (p, x), near in expected.items() if len(near) > 1 and near[0][0] < 0.8 * near[1][0]}
    enough = {p for p, _ in sharp if sum(q == p for q, _ in sharp) >= 3}
    assert {(r.pair, r.point) for r in matching.distinct(now, then, "pair", "point", "vec", 0.8, 3, block).collect()} == {k for k in sharp if k[0] in enough}


def test_empty(spark):
    now, then = frames(spark, np.random.default_rng(0))
    assert matching.mutual(now.limit(0), then, "pair", "point", "vec").isEmpty()
