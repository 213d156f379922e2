"""Helpers that run without Spark."""

import numpy as np
import pytest

from seqengine.functions import rates
from seqengine.functions.names import suggest
from seqengine.functions.weights import blend_weights, moving_window, shutter_samples, shutter_window
from seqengine.operators import kernels, windows
from seqengine.operators.normalise import next_range, robust_line
from seqengine.operators.banded import smoothest
from seqengine.operators.smooth import jacobi
from seqengine.plans import spec


@pytest.mark.parametrize("scheme", ["equal", "gaussian_sym", "pyramid", "ascending", "descending", "what"])
@pytest.mark.parametrize("n", [1, 4, 5, 8])
def test_weights_sum_to_one(scheme, n):
    assert sum(blend_weights(n, scheme)) == pytest.approx(1)


def test_weights_shapes():
    assert blend_weights(0, "equal") == [] and blend_weights(-5, "equal") == []
    assert blend_weights(4, "ascending") == pytest.approx([0.1, 0.2, 0.3, 0.4])
    assert blend_weights(5, "unknown") == pytest.approx([0.2] * 5)
    g = blend_weights(7, "gaussian_sym")
    assert g == pytest.approx(g[::-1]) and max(g) == g[3]


def test_shutter():
    assert shutter_window(8, 180.0) == (2, 2)
    assert shutter_samples(8, 180.0) == ([0.75, 0.875], pytest.approx([0.125, 0.25]))
    assert shutter_window(8, 0.0) == (0, 0)
    with pytest.raises(ValueError):
        shutter_window(1, 180.0)


def test_factor():
    assert rates.rationalise(2.5) == (5, 2) and rates.rationalise(2) == (2, 1)
    with pytest.raises(ValueError):
        rates.rationalise(0.5)
    with pytest.raises(ValueError):
        rates.check_trim(3, 2)
    assert moving_window(24) == 49 and moving_window(1) == 3


def test_smallest_multiple():
    assert rates.smallest_multiple(lambda h, w: h % 4 == 0 and w % 4 == 0) == 4
    with pytest.raises(ValueError):
        rates.smallest_multiple(lambda h, w: False)


def test_thresholds():
    assert spec.dedup_threshold("ssim", 35) == pytest.approx(0.965)
    assert spec.dedup_threshold("vmaf", 50) == 95 and spec.dedup_threshold("mse", 25) == 25 and spec.dedup_threshold("flownets", 50) == 0.5
    assert spec.cut_threshold("ssim", 50) == 0.5 and spec.cut_threshold("mse", 50) == 2500 and spec.cut_threshold("maxxvit", 60) == pytest.approx(0.4)
    assert spec.autoclip_threshold("adaptive", 50) == 3 and spec.autoclip_threshold("adaptive", 100) == 0.5


def test_options():
    assert spec.with_implied({"dedup_sens": 1})["dedup"] is True
    assert spec.with_implied({"dedup_sens": 1, "dedup": False})["dedup"] is False
    assert spec.capability({"depth": True, "autoclip": True}) == "autoclip" and spec.capability({}) == "frames"
    assert spec.fall_back("Depth", {"depth-ncnn", "depth-directml"}) == "depth-directml" and spec.fall_back("x", {"y"}) == "x"
    assert spec.fall_back("rife", {"rife-ncnn", "rife-directml"}, "interpolate") == "rife-ncnn"
    one = spec.load_spec('{"clip": "c", "order": ["t"], "payload": "v", "dedup": "mse"}', factor=3.0)
    assert one.factor == 3.0 and spec.load_spec(spec.dump_spec(one)) == one
    with pytest.raises(ValueError, match="payload"):
        spec.load_spec('{"clip": "c", "order": ["t"], "paylod": "v"}')
    with pytest.raises(ValueError, match="no operation"):
        spec.Pipeline("c", ("t",), "v").normalised()
    assert spec.Pipeline("c", ("t",), "v", smooth_dedup=True).normalised().interpolate
    assert suggest("ssm", ["ssim", "mse"])[0] == "ssim"


def test_window_demand():
    assert windows.chained_demand((1, 1), (1, 2)) == (2, 3) and windows.parallel_demand((1, 0), (0, 2)) == (1, 2)
    with pytest.raises(ValueError):
        windows.check_bounds(-1, 0)


def test_smoothest_is_the_minimum():
    rng = np.random.default_rng(3)
    n, path, w = 30, np.cumsum(rng.normal(size=30)), rng.uniform(0.1, 1, 30)
    a = np.eye(n) * 1e-3 / n
    for order in (1, 2, 3):
        d = np.diff(np.eye(n), order, axis=0)
        a += d.T @ np.diag(w[: n - order] / (n - order)) @ d
    assert smoothest(path, w, 1e-3) == pytest.approx(np.linalg.solve(a, path * 1e-3 / n), abs=1e-6)
    assert (smoothest(path[:5], w[:5], 1e-3) == path[:5]).all()


def test_jacobi_keeps_constants():
    assert jacobi(np.full(20, 3.0)) == pytest.approx(np.full(20, 3.0))
    assert (jacobi(np.arange(5.0)) == np.arange(5.0)).all()


def test_range_follows_and_resets():
    assert next_range(None, 0, 1) == (0, 1)
    assert next_range((0.0, 1.0), 0.5, 1.5) == pytest.approx((0.001, 1.001))
    assert next_range((0.0, 1.0), 0.0, 4.0) == (0.0, 4.0)
    assert next_range((0.0, 1.0), 3.0, 4.0) == (3.0, 4.0)


def test_robust_line():
    x = np.linspace(0, 1, 50)
    y = 1.2 * x + 0.1
    y[3] = 9
    assert robust_line(x, y) == pytest.approx((1.2, 0.1), abs=0.02)


def test_line_thinning_pixel_by_pixel():
    """The plain definition, one pixel at a time, on an image whose lines are to move visibly."""
    x = np.random.default_rng(4).uniform(size=(8, 10))
    h, w = x.shape

    def at(a, y, c):
        y, c = min(max(y, 0), len(a) - 1), min(max(c, 0), len(a[0]) - 1)
        y0, c0 = int(y), int(c)
        y1, c1, fy, fc = min(y0 + 1, len(a) - 1), min(c0 + 1, len(a[0]) - 1), y - y0, c - c0
        return (a[y0][c0] * (1 - fc) + a[y0][c1] * fc) * (1 - fy) + (a[y1][c0] * (1 - fc) + a[y1][c1] * fc) * fy

    def slopes(a, reach):
        dx, dy = reach * (w - 1) / w, reach * (h - 1) / h
        across = [[at(a, i, j + dx) - at(a, i, j - dx) for j in range(w)] for i in range(h)]
        along = [[at(a, i, j - dx) + 2 * a[i][j] + at(a, i, j + dx) for j in range(w)] for i in range(h)]
        gx = [[(at(across, i - dy, j) + 2 * across[i][j] + at(across, i + dy, j)) / 8 for j in range(w)] for i in range(h)]
        gy = [[(at(along, i + dy, j) - at(along, i - dy, j)) / 8 for j in range(w)] for i in range(h)]
        return gx, gy

    gx, gy = slopes(x, 1.0)
    edge = [[(gx[i][j] ** 2 + gy[i][j] ** 2) ** 0.35 for j in range(w)] for i in range(h)]
    gx, gy = slopes(edge, 1.0)
    strength, want = 40.0, np.zeros_like(x)
    for i in range(h):
        for j in range(w):
            y, c = float(i), float(j)
            for _ in range(6):
                dx, dy = at(gx, y, c), at(gy, y, c)
                length = (dx * dx + dy * dy) ** 0.5 + 0.01
                c, y = c - dx / length * strength * h / 1080 * (w - 1) / w, y - dy / length * strength * h / 1080 * (h - 1) / h
            want[i, j] = at(x, y, c)
    made = kernels.thin_lines(x[None], "heavy", strength=strength)[0]
    assert made == pytest.approx(want) and np.abs(made - x).max() > 0.05


@pytest.mark.parametrize("name", ["sharpen", "line_darken", "line_thin_lite", "line_thin_medium", "line_thin_heavy", "soften"])
def test_kernels_keep_flat_rows(name):
    flat = np.full((2, 8, 8), 0.5)
    made = kernels.KERNELS[name](flat)
    if name == "line_darken":  # beyond the border an image is dark
        assert made[:, 3:5, 3:5] == pytest.approx(flat[:, 3:5, 3:5])
    else:
        assert made == pytest.approx(flat)
    noisy = np.random.default_rng(0).uniform(size=(3, 8, 8))
    made = kernels.KERNELS[name](noisy)
    assert made.shape == noisy.shape and made.min() >= 0 and made.max() <= 1
    assert made[1:2] == pytest.approx(kernels.KERNELS[name](noisy[1:2]))


def test_upscale():
    assert kernels.upscale_2x(np.arange(4.0).reshape(1, 2, 2)).tolist() == [[[0, 0, 1, 1], [0, 0, 1, 1], [2, 2, 3, 3], [2, 2, 3, 3]]]
