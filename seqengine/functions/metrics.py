"""Distances between two rows' payloads: numbers, or arrays of equal length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For values on a scale of `peak`: the customary stabilising constants of structural similarity.
SSIM_K1, SSIM_K2 = 0.01, 0.03


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def mean(values: Column) -> Column:
    return _sum(values) / F.size(values)


def squared_difference(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays (FIL03c)."""
    return _sum(F.zip_with(a, b, squared_difference)) / F.size(a)


def mad(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays (FIL03e, AGG05)."""
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a)


def psnr(mean_squared: Column, peak: float = 255.0) -> Column:
    """Peak signal to noise in dB, 99 where there is no difference (AGG04)."""
    return F.when(mean_squared == 0, F.lit(99.0)).otherwise(10 * F.log10(F.lit(peak * peak) / mean_squared))


def ssim(a: Column, b: Column, peak: float = 1.0) -> Column:
    """Structural similarity from the global mean, variance and covariance of two arrays (FIL03a, CUT01a).

    One window over the whole array; the windowed form is left to registered kernels.
    """
    c1, c2 = (SSIM_K1 * peak) ** 2, (SSIM_K2 * peak) ** 2
    ma, mb = mean(a), mean(b)
    va = _sum(F.transform(a, lambda x: (x - ma) * (x - ma))) / F.size(a)
    vb = _sum(F.transform(b, lambda x: (x - mb) * (x - mb))) / F.size(b)
    cov = _sum(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb))) / F.size(a)
    return ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 for a zero one (AGG14)."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Brightness of a colour (PRJ24)."""
    return 0.299 * red + 0.587 * green + 0.114 * blue


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def weighted_mean(value: Column, weight: Column) -> Column:
    """An aggregate: the mean of value by weight, null without weight (AGG08)."""
    total = F.sum(F.when(value.isNotNull(), weight))
    return F.when(total != 0, F.sum(value * weight) / total)


def min_max(values: Column) -> Column:
    """An array scaled from its own least and greatest value to [0, 1]; a flat one is all 0 (AGG09)."""
    low, span = F.array_min(values), F.array_max(values) - F.array_min(values)
    return F.transform(values, lambda x: F.when(span > 0, (x - low) / span).otherwise(F.lit(0.0)))


def histogram(values: Column, bins: int, low: float = 0.0, high: float = 1.0) -> Column:
    """How many values fall in each of equal bins; those outside count in the first and last (AGG14)."""
    at = F.transform(values, lambda x: F.least(F.greatest(F.floor((x - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(at, lambda x: x == b)).cast("double"))
