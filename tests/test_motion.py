"""Block matching, and pictures that are kept steady over time."""

import numpy as np
import pytest

from seqengine.operators import motion

H, W = 48, 80


def steady(spark, pictures, masks=None, **more):
    rows = [(1, k, None if p is None else p.reshape(-1).tolist(), None if masks is None else masks[k].reshape(-1).tolist()) for k, p in enumerate(pictures)]
    df = spark.createDataFrame(rows, "c int, k int, vec array<double>, mask array<boolean>")
    h, w = next(p.shape for p in pictures if p is not None)
    out = motion.steady_pictures(df, "c", ["k"], "vec", h, w, mask="mask" if masks is not None else None, **more)
    assert out.columns == ["c", "k", "vec", "mask", "steady"]
    return [np.array(r.steady).reshape(h, w) if r.steady is not None else None for r in sorted(out.collect(), key=lambda r: r.k)]


def by_quantiles(picture, valid=None):
    low, high = np.quantile(picture if valid is None else picture[valid], (0.02, 0.98))
    return np.clip((picture - low) / max(high - low, 1e-6), 0, 1)


def smooth_noise(rng):
    x = rng.random((H, W))
    for axis in (0, 1):
        for _ in range(4):
            x = (np.roll(x, 1, axis) + x + np.roll(x, -1, axis)) / 3
    return x


def test_planted_motion():
    rng = np.random.default_rng(0)
    before = rng.random((20, 30))
    now = np.roll(before, (2, -1), (0, 1))
    match = motion.matched_places(now, before, reach=3, block=2).reshape(20, 30)
    y, x = np.mgrid[:20, :30]
    assert (match == (y - 2) * 30 + x + 1)[4:-4, 4:-4].all()
    assert (motion.matched_places(before, before, 2, 1) == np.arange(600)).all()


def test_like_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(5):
        a, b = rng.integers(0, 4, (6, 7)).astype(float), rng.integers(0, 4, (6, 7)).astype(float)
        for reach, block in ((1, 1), (2, 1), (1, 0)):
            at = lambda p, y, x: p[min(max(y, 0), 5), min(max(x, 0), 6)]

            def move(own, far, y, x, reach=reach, block=block, at=at):
                best = None
                for dy in range(-reach, reach + 1):
                    for dx in range(-reach, reach + 1):
                        if 0 <= y + dy < 6 and 0 <= x + dx < 7:
                            cost = sum(abs(at(own, y + i, x + j) - at(far, y + dy + i, x + dx + j)) for i in range(-block, block + 1) for j in range(-block, block + 1))
                            best = min(best or (9e9,), (cost, dy * dy + dx * dx, dy, dx))
                return best[2:]

            expected = []
            for y in range(6):
                for x in range(7):
                    dy, dx = move(a, b, y, x)
                    expected.append((y + dy) * 7 + x + dx if move(b, a, y + dy, x + dx) == (-dy, -dx) else -1)
            assert motion.matched_places(a, b, reach, block).tolist() == expected


def test_scale_and_shift_are_removed(spark):
    y, x = np.mgrid[:H, :W]
    scene = 0.2 + 0.5 * x / x.max() + 0.2 * np.sin(y / 9)
    first, second = steady(spark, [scene, scene * 1.7 - 0.35])
    assert first == pytest.approx(second, abs=2e-5)


def test_a_small_drift_is_followed_in_part(spark):
    """A picture whose quantiles move is brought back towards the one before, through a move of the whole scene."""
    rng = np.random.default_rng(3)
    scene = smooth_noise(rng)
    moved = np.roll(scene, (0, 2), (0, 1)).copy()
    moved[:6] += 0.15 * np.ptp(scene)  # a brighter stripe changes the range
    first, second = steady(spark, [scene, moved])
    alone, inside = by_quantiles(moved), (slice(12, -8), slice(8, -8))
    then = np.roll(first, (0, 2), (0, 1))
    assert np.abs(second - then)[inside].mean() < 0.7 * np.abs(alone - then)[inside].mean()


def test_a_moving_object_leaves_nothing_behind(spark):
    first = np.tile(np.linspace(0.1, 0.9, W), (H, 1))
    second = first.copy()
    first[15:30, 15:27] = 0.9
    second[15:30, 42:54] = 0.9
    _, out = steady(spark, [first, second])
    current = by_quantiles(second)
    inner = (current > 0.01) & (current < 0.99)
    design = np.column_stack((current[inner], np.ones(inner.sum())))
    line = np.linalg.lstsq(design, out[inner], rcond=None)[0]
    assert out == pytest.approx(np.clip(line[0] * current + line[1], 0, 1), abs=2e-5)


def test_masked_places_do_not_count(spark):
    frame = np.tile(np.linspace(2, 8, W), (H, 1))
    valid = np.ones((H, W), dtype=bool)
    valid[:, :20] = False
    broken = frame.copy()
    broken[:, :20] = -10_000
    out, again = steady(spark, [broken, broken], [valid, valid])
    assert out[valid] == pytest.approx(by_quantiles(frame, valid)[valid], abs=2e-5)
    assert again == pytest.approx(out, abs=2e-5)


def test_a_cut_is_left_as_it_is(spark):
    rng = np.random.default_rng(7)
    second = np.flipud(rng.random((H, W)))
    out = steady(spark, [smooth_noise(rng), second], coverage=0.2)
    assert out[1] == pytest.approx(by_quantiles(second), abs=2e-5)


def test_pictures_without_numbers(spark):
    scene = np.random.default_rng(1).random((H, W))
    none = np.full((H, W), np.nan)
    out = steady(spark, [scene, none, None, scene], [np.ones((H, W), bool), np.zeros((H, W), bool), np.ones((H, W), bool), np.ones((H, W), bool)])
    assert not out[1].any() and out[0] == pytest.approx(out[3], abs=1e-9)


def test_reduced_pictures(spark):
    scene = np.tile(np.linspace(0, 1, 100), (50, 1)) + np.sin(np.arange(50) / 5)[:, None] * 0.2
    first, second = steady(spark, [scene, scene * 2 + 1], small=40)
    assert first == pytest.approx(second, abs=1e-6)
    assert motion.small_size(50, 100, 40) == (20, 40) and motion.small_size(50, 100, 320) == (50, 100)
    assert motion.area_weights(5, 2) == pytest.approx(np.array([[0.4, 0.4, 0.2, 0, 0], [0, 0, 0.2, 0.4, 0.4]]))
