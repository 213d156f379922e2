"""Blend weights and shutter windows, computed on the driver: a handful of numbers."""

from __future__ import annotations

import math


def blend_weights(n: int, scheme: str) -> list[float]:
    """n weights of sum 1: equal, gaussian_sym, pyramid, ascending or descending; an unknown scheme is equal (BLR01)."""
    if n <= 0:
        return []
    middle, sigma = (n - 1) / 2, max(n / 4, 0.5)
    shape = {
        "gaussian_sym": lambda i: math.exp(-((i - middle) ** 2) / (2 * sigma * sigma)),
        "pyramid": lambda i: float(min(i, n - 1 - i) + 1),
        "ascending": lambda i: float(i + 1),
        "descending": lambda i: float(n - i),
    }.get(scheme, lambda i: 1.0)
    raw = [shape(i) for i in range(n)]
    return [w / sum(raw) for w in raw]


def shutter_window(factor: int, angle: float) -> tuple[int, int]:
    """(samples before, samples after) a row that fall in its open shutter (BLR02)."""
    if factor < 2 or not 0 <= angle <= 360:
        raise ValueError("the factor must be at least 2 and the angle from 0 to 360")
    half = angle / 720
    first = max(1, math.ceil(factor * (1 - half)))
    return factor - 1 - min(factor - 1, first - 1), min(factor - 1, math.floor(factor * half))


def shutter_samples(factor: int, angle: float) -> tuple[list[float], list[float]]:
    """Times in (0, 1) of the samples in the interval before a row, and in that after it (BLR03, BLR06)."""
    left, right = shutter_window(factor, angle)
    return [k / factor for k in range(factor - left, factor)], [k / factor for k in range(1, right + 1)]


def shared_samples(factor: int, angle: float) -> list[float]:
    """The times of an interval that the rows on either side of it need, each once (SET05)."""
    left, right = shutter_samples(factor, angle)
    return sorted({*left, *right})


def moving_window(fps: float) -> int:
    """An odd window of about two seconds, at least 3 (STB04)."""
    n = max(3, round(fps * 2))
    return n if n % 2 else n + 1
