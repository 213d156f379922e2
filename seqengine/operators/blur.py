"""Shutter blur and masked blends (BLR01-BLR06, MSK01-MSK02)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import clamp, luma
from ..functions.weights import blend_weights, shutter_samples
from .clips import ordered


def blur(df: DataFrame, clip: str, pos: str, payload: str, factor: int = 8, angle: float = 180.0, scheme: str = "gaussian_sym", gamma: float | None = None, out: str = "blurred") -> DataFrame:
    """Adds the blend of a row with the samples of its open shutter on either side (BLR03).

    The first and last rows of a clip stay as they are. With a gamma, values are clamped to
    [0, 1] and blended in linear light (BLR04). The interpolation between rows is linear, so
    that all samples are expressions of three neighbouring rows.
    """
    w = ordered(clip, pos)
    before, after = shutter_samples(factor, angle)
    weights = blend_weights(len(before) + 1 + len(after), scheme)
    df = df.withColumn("_prev", F.lag(payload).over(w)).withColumn("_next", F.lead(payload).over(w))
    here = F.col(payload)
    samples = [(1 - t) * F.col("_prev") + t * here for t in before] + [here] + [(1 - t) * here + t * F.col("_next") for t in after]
    if gamma:
        samples = [F.pow(clamp(s), F.lit(gamma)) for s in samples]
    total = reduce(lambda a, b: a + b, (F.lit(x) * s for x, s in zip(weights, samples, strict=True)))
    if gamma:
        total = clamp(F.pow(total, F.lit(1 / gamma)))
    inside = F.lag(pos).over(w).isNotNull() & F.lead(pos).over(w).isNotNull()
    return df.withColumn("_inside", inside).withColumn(out, F.when(F.col("_inside"), total).otherwise(here)).drop("_prev", "_next", "_inside")


def mask_weight(red: Column, green: Column, blue: Column, alpha: Column | None = None) -> Column:
    """How much of the processed value shows at a mask pixel: dark opaque pixels protect the pristine one (MSK01)."""
    protected = 1 - luma(red, green, blue)
    return 1 - (protected * alpha if alpha is not None else protected)


def masked(pristine: Column, processed: Column, weight: Column) -> Column:
    """pristine + weight * (processed - pristine), exact at 0 and 1 (MSK02)."""
    return F.when(weight == 0, pristine).when(weight == 1, processed).otherwise(pristine + weight * (processed - pristine))


def masked_vectors(pristine: Column, processed: Column, weights: Column) -> Column:
    """The same for arrays, with a weight for each place."""
    return F.zip_with(F.zip_with(pristine, processed, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), weights, lambda p, w: masked(p["a"], p["b"], w))


def with_mask(df: DataFrame, mask: DataFrame, column: str = "weight") -> DataFrame:
    """Adds the only row of a mask table to each row (JON04); a missing mask leaves the weight null."""
    one = mask.select(column).limit(1)
    return df.join(F.broadcast(one), F.lit(True), "left")
