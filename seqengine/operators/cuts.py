"""Changes between neighbouring rows, shots, and cut lists (CUT01-CUT08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from .clips import ordered

#: A cut: a distance above the threshold, or a similarity below it (CUT01a-c, CUT02).
METHODS = {
    "mse": lambda a, b, t: metrics.mse(a, b) > t,
    "ssim": lambda a, b, t: metrics.ssim(a, b) < t,
    "squared": lambda a, b, t: metrics.squared_difference(a, b) > t,
}


def mark_cuts(df: DataFrame, clip: str, order: list[str], payload: str, method: str, threshold: float) -> DataFrame:
    """df with is_cut: the row differs from the one just before it. The first row of a clip is no cut."""
    before = F.lag(payload).over(ordered(clip, *order))
    return df.withColumn("_before", before).withColumn("is_cut", F.coalesce(METHODS[method](F.col("_before"), F.col(payload), threshold), F.lit(False))).drop("_before")


def with_shots(df: DataFrame, clip: str, order: list[str]) -> DataFrame:
    """Adds shot_id, the number of cuts up to a row (CUT07)."""
    return df.withColumn("shot_id", F.sum(F.col("is_cut").cast("bigint")).over(ordered(clip, *order).rowsBetween(Window.unboundedPreceding, 0)))


def shot_bounds(df: DataFrame, clip: str, pos: str = "pos") -> DataFrame:
    """First and last position and the number of rows of each shot."""
    return df.groupBy(clip, "shot_id").agg(F.min(pos).alias("start_pos"), F.max(pos).alias("end_pos"), F.count(F.lit(1)).alias("n_rows"))


def cut_seconds(df: DataFrame, clip: str, fps: Column, start: float = 0.0, pos: str = "pos") -> DataFrame:
    """Where the cuts are, in seconds (CUT05)."""
    return df.filter("is_cut").select(clip, (F.lit(start) + (F.col(pos) - 1) / fps).alias("cut_sec"))


def adaptive_scores(df: DataFrame, clip: str, order: list[str], payload: str, around: int = 2) -> DataFrame:
    """Each row's change, and its ratio to the mean change of `around` rows on either side (CUT04).

    The mean leaves the row itself out; the window is a choice of this library.
    """
    w = ordered(clip, *order)
    change = F.abs(F.col(payload) - F.lag(payload).over(w))
    df = df.withColumn("change", change)
    near = w.rowsBetween(-around, around)
    others = (F.sum("change").over(near) - F.col("change")) / (F.count("change").over(near) - 1)
    return df.withColumn("ratio", F.when(F.col("change").isNotNull() & (others > 0), F.col("change") / others))


def adaptive_cuts(df: DataFrame, clip: str, order: list[str], payload: str, threshold: float, least: float, around: int = 2) -> DataFrame:
    """df with is_cut: the ratio reaches the threshold and the change is at least `least`."""
    scored = adaptive_scores(df, clip, order, payload, around)
    return scored.withColumn("is_cut", F.coalesce((F.col("ratio") >= threshold) & (F.col("change") >= least), F.lit(False)))


def rising_edges(df: DataFrame, clip: str, order: list[str], high: Column) -> DataFrame:
    """df with is_cut: high holds and did not in the row before; never in the first row (CUT06)."""
    before = F.lag(high).over(ordered(clip, *order))
    return df.withColumn("is_cut", F.coalesce(high & ~before, F.lit(False)))


def overlapping_windows(df: DataFrame, clip: str, size: int = 100, stride: int = 50, pad: int = 25, pos: str = "pos") -> DataFrame:
    """One row for each window that a row is in, with its place; `core` marks the window that answers for it (WIN11).

    Window k has the places k * stride - pad to k * stride - pad + size - 1, counted from 0.
    """
    at = F.col(pos) - 1 + pad
    last = F.floor(at / stride)
    first = F.greatest(F.floor((at - size) / stride) + 1, F.lit(0))
    spread = df.withColumn("window_id", F.explode(F.sequence(first, last))).withColumn("place", at - F.col("window_id") * stride)
    return spread.withColumn("core", (F.col("place") >= pad) & (F.col("place") < pad + stride))


def range_resets(low: Column, high: Column, last_low: Column, last_high: Column, ratio: float = 3.0) -> Column:
    """CUT08: has the range of values changed so much that history no longer holds?"""
    span, last = F.greatest(high - low, F.lit(1e-6)), F.greatest(last_high - last_low, F.lit(1e-6))
    return (span / last > ratio) | (span / last < 1 / ratio) | (F.abs(low - last_low) / last > 2)
