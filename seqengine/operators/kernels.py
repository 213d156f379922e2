"""Row models: a registry of functions on batches of vectors, and deterministic filters (PRJ01-PRJ18, UDF01-UDF07).

A kernel takes an array of shape (rows, height, width) and returns one of the same number
of rows. Registered kernels run in pandas batches; simple projections are expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import clamp
from ..session import ship

Kernel = Callable[[np.ndarray], np.ndarray]
KERNELS: dict[str, Kernel] = {}


def register(name: str) -> Callable[[Kernel], Kernel]:
    """Makes a kernel known by name (UDF05, UDF06)."""

    def put(kernel: Kernel) -> Kernel:
        KERNELS[name] = kernel
        return kernel

    return put


def _around(x: np.ndarray) -> np.ndarray:
    """The nine neighbours of each pixel, edges repeated: shape (9, rows, height, width)."""
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="edge")
    h, w = x.shape[1:]
    return np.stack([p[:, i : i + h, j : j + w] for i in range(3) for j in range(3)])


def _gauss(x: np.ndarray) -> np.ndarray:
    return np.tensordot(np.array([1, 2, 1, 2, 4, 2, 1, 2, 1]) / 16, _around(x), axes=1)


def _edged(x: np.ndarray, reach: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (reach, reach), (reach, reach)), mode="edge")


def _correlate(padded: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each pixel's weighted sum of its surroundings; padded has the margin that the weights need."""
    views = np.lib.stride_tricks.sliding_window_view(padded, weights.shape, axis=(1, 2))
    return np.einsum("nijkl,kl->nij", views, weights)


#: Fixed values of the sharpening: the band of log blur scores, the most, the local window, two floors.
BLUR_BAND, MOST, WINDOW, CONTRAST_FLOOR, FLOOR = (-2.31, -1.19), 0.9, 7, 1e-3, 1e-6
_SMOOTH = np.outer([1, 2, 1], [1, 2, 1]) / 16


def _laplacian() -> np.ndarray:
    """A Laplacian of smoothed brightness."""
    out = np.zeros((5, 5))
    for i, j, weight in ((0, 1, 1), (1, 0, 1), (1, 1, -4), (1, 2, 1), (2, 1, 1)):
        out[i : i + 3, j : j + 3] += weight * _SMOOTH
    return out


def sharpening(x: np.ndarray) -> np.ndarray:
    """How much each image is to be sharpened, from its own blur: detail relative to local contrast, where there is contrast."""
    if min(x.shape[1:]) < 3:
        return np.full(len(x), min(0.5, MOST))
    box = np.full((WINDOW, WINDOW), 1 / WINDOW**2)
    mean, square = _correlate(_edged(x, WINDOW // 2), box), _correlate(_edged(x * x, WINDOW // 2), box)
    contrast = np.sqrt(np.maximum(square - mean * mean, 0) + FLOOR)
    detail = (_correlate(_edged(x, 2), _laplacian()) / (contrast + CONTRAST_FLOOR)) ** 2
    score = (detail * contrast).sum(axis=(1, 2)) / (contrast.sum(axis=(1, 2)) + FLOOR)
    low, high = BLUR_BAND
    return np.minimum(1 - np.clip((np.log(score + 1e-4) - low) / (high - low), 0, 1), MOST)


@register("sharpen")
def sharpen(x: np.ndarray) -> np.ndarray:
    """Contrast-adaptive sharpening of an amount that the image's blur sets (PRJ14)."""
    n = _around(x)
    cross, four = n[[1, 3, 4, 5, 7]], n[1] + n[3] + n[5] + n[7]
    low, high = cross.min(axis=0) + n.min(axis=0), cross.max(axis=0) + n.max(axis=0)
    room = np.sqrt(np.clip(np.minimum(low, 2 - high) / np.maximum(high, 1e-4), 0, 1))
    w = -room / (8 - 3 * sharpening(x))[:, None, None]
    return np.clip((x + w * four) / (1 + 4 * w), 0, 1)


@register("line_darken")
def line_darken(x: np.ndarray, strength: float = 0.7) -> np.ndarray:
    """Edges, scaled to their own range, thinned and softened, are taken off the brightness (PRJ15). Beyond its border an image is 0; a flat one has no edge."""
    dark = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    across = np.outer([1, 2, 1], [-1, 0, 1])
    edge = np.hypot(_correlate(dark, across), _correlate(dark, across.T))
    low, high = edge.min(axis=(1, 2), keepdims=True), edge.max(axis=(1, 2), keepdims=True)
    edge = np.where(high > low, (edge - low) / np.where(high > low, high - low, 1), 0)
    thin = _around(edge).min(axis=0)
    bell = np.exp(-0.5 * np.array([1, 0, 1]))
    soft = _correlate(np.pad(thin, ((0, 0), (1, 1), (1, 1))), np.outer(bell, bell) / bell.sum() ** 2)
    return np.clip(x - strength * soft, 0, 1)


def _sampled(x: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Bilinear samples of (images, channels, height, width) at (images or 1, height, width) places; edges go on."""
    h, w = x.shape[2:]
    ys, xs = np.broadcast_arrays(np.clip(ys, 0, h - 1), np.clip(xs, 0, w - 1))
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), ys - y0, xs - x0
    images = np.arange(len(x))[:, None, None]
    at = lambda y, x_: np.stack([x[images, c, y, x_] for c in range(x.shape[1])], axis=1)
    fy, fx = fy[:, None], fx[:, None]
    return (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy


def _resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = x.shape[2:]
    return _sampled(x, np.linspace(0, h - 1, height)[None, :, None], np.linspace(0, w - 1, width)[None, None, :])


def _slopes(x: np.ndarray, reach: float) -> np.ndarray:
    """(images, 2, height, width): slopes across and down of (images, 1, height, width), from samples `reach` away in units of the side."""
    h, w = x.shape[2:]
    rows, columns = np.arange(h)[None, :, None], np.arange(w)[None, None, :]
    left, right = (_sampled(x, rows, columns + k * reach * (w - 1) / w) for k in (-1, 1))
    pair = np.concatenate([right - left, left + 2 * x + right], axis=1)
    top, bottom = (_sampled(pair, rows + k * reach * (h - 1) / h, columns) for k in (-1, 1))
    return np.stack([top[:, 0] + 2 * pair[:, 0] + bottom[:, 0], bottom[:, 1] - top[:, 1]], axis=1) / 8


#: Fixed values of the line thinners: scale of the brightness, of the edges, spread of their blur, reach of either gradient.
THINNERS = {"lite": (0.5, 0.25, 0.5, 0.5, 0.25), "medium": (1.0, 0.5, 1.0, 1.0, 0.5), "heavy": (1.0, 1.0, 2.0, 1.0, 1.0)}


def thin_lines(x: np.ndarray, variant: str, strength: float = 0.1, rounds: int = 6) -> np.ndarray:
    """Pixels are drawn, step by step, down the slope of edge strength, so that lines get thinner (PRJ16). Steps grow with the height (1 at 1,080)."""
    bright, small, spread, reach, second = THINNERS[variant]
    h, w = x.shape[1:]
    image = x[:, None].astype(float)
    luma = image
    for scale in (bright, small):
        if scale < 1:
            luma = _resized(luma, max(int(h * scale), 1), max(int(w * scale), 1))
    edge = (np.hypot(*_slopes(luma, reach).transpose(1, 0, 2, 3)) ** 0.7)[:, None]
    sigma = spread * h / 1080
    if sigma >= 0.1:
        reached = max(int(np.ceil(2 * sigma)), 1)
        bell = np.exp(-0.5 * (np.arange(-reached, reached + 1) / sigma) ** 2)
        bell /= bell.sum()
        edge = _correlate(_edged(edge[:, 0], reached), np.outer(bell, bell))[:, None]
    field = _resized(_slopes(edge, second), h, w)
    ys, xs = np.broadcast_to(np.arange(h, dtype=float)[None, :, None], x.shape), np.broadcast_to(np.arange(w, dtype=float)[None, None, :], x.shape)
    step = strength * h / 1080
    for _ in range(rounds):
        slope = _sampled(field, ys, xs)
        slope = slope / (np.hypot(slope[:, 0], slope[:, 1]) + 0.01)[:, None]
        xs, ys = xs - slope[:, 0] * step * (w - 1) / w, ys - slope[:, 1] * step * (h - 1) / h
    return _sampled(image, ys, xs)[:, 0]


for _variant in THINNERS:
    register(f"line_thin_{_variant}")(partial(thin_lines, variant=_variant))
KERNELS["line_thin"] = KERNELS["line_thin_medium"]


@register("soften")
def soften(x: np.ndarray) -> np.ndarray:
    return _gauss(x)


@register("upscale_2x")
def upscale_2x(x: np.ndarray) -> np.ndarray:
    """Each pixel twice in both directions (PRJ05); the output has four times the values."""
    return x.repeat(2, axis=1).repeat(2, axis=2)


def apply_kernel(df: DataFrame, payload: str, name: str, height: int, width: int, out: str | None = None) -> DataFrame:
    """df with a kernel's output for the payload, an array of height * width values (PRJ12, UDF01)."""
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {name}; there are {', '.join(sorted(KERNELS))}")
    ship(df.sparkSession)
    kernel, out = KERNELS[name], out or payload
    schema = ", ".join(f"`{n}` {k}" for n, k in df.dtypes if n != out)

    def run(batches: Iterator) -> Iterator:
        for rows in batches:
            if len(rows):
                made = kernel(np.stack(rows[payload].to_numpy()).astype(float).reshape(-1, height, width))
                rows = rows.drop(columns=[out], errors="ignore").assign(**{out: list(made.reshape(len(rows), -1))})
                yield rows

    return df.mapInPandas(run, f"{schema}, `{out}` array<double>")


def apply_pair_kernel(df: DataFrame, before: str, payload: str, score: Callable[[np.ndarray, np.ndarray], np.ndarray], out: str) -> DataFrame:
    """df with a number for each row from its array and that of the row before it, 0 where there is none (CUT01c).

    score takes two arrays of shape (rows, length), such as the inputs of a classifier.
    """
    ship(df.sparkSession)
    schema = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)

    def run(batches: Iterator) -> Iterator:
        for rows in batches:
            made, both = np.zeros(len(rows)), (rows[before].notna() & rows[payload].notna()).to_numpy()
            if both.any():
                made[both] = score(*(np.stack(rows.loc[both, c].to_numpy()).astype(float) for c in (before, payload)))
            yield rows.assign(**{out: made})

    return df.mapInPandas(run, f"{schema}, `{out}` double")


def chain(df: DataFrame, payload: str, steps: list[Callable[[Column], Column]], out: str) -> DataFrame:
    """Projections one after another, left to right (PRJ13)."""
    return df.withColumn(out, reduce(lambda c, f: f(c), steps, F.col(payload)))


def to_unit(values: Column, depth: int = 8) -> Column:
    """Integers to [0, 1] (PRJ01)."""
    return F.transform(values, lambda x: clamp(x / float(2**depth - 1)))


def from_unit(values: Column, depth: int = 8) -> Column:
    """[0, 1] to integers, cut off (PRJ02)."""
    return F.transform(values, lambda x: F.floor(clamp(x) * float(2**depth - 1)).cast("int"))


def box_mean(values: Column, height: int, width: int) -> Column:
    """Half-size means of 2 x 2 pixels (PRJ03)."""
    at = [[r * width + c for r in (i, i + 1) for c in (j, j + 1)] for i in range(0, height, 2) for j in range(0, width, 2)]
    return F.array(*(reduce(lambda a, b: a + b, (F.get(values, F.lit(k)) for k in four)) / 4 for four in at))


def with_alpha(values: Column, threshold: float) -> Column:
    """Values followed by an opacity for each: 1 above the threshold (PRJ18)."""
    return F.concat(values, F.transform(values, lambda x: F.when(x > threshold, F.lit(1.0)).otherwise(F.lit(0.0))))


def luma_only(y: Column, cb: Column, cr: Column, kernel: Callable[[Column], Column]) -> Column:
    """A kernel on brightness alone, colours kept (PRJ07)."""
    return F.struct(kernel(y).alias("y"), cb.alias("cb"), cr.alias("cr"))
