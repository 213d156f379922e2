"""Robust ranges of array rows (NRM01-NRM02, FIL08, AGG06-AGG11)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import clamp
from .clips import fold


def finite(values: Column) -> Column:
    """The elements that are numbers (FIL08)."""
    return F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantile(values: Column, q: float) -> Column:
    """The q-quantile of an array between neighbours, null of an empty one (AGG06)."""
    s = F.array_sort(values)
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at)
    a, b = F.get(s, low.cast("int")), F.get(s, F.ceil(at).cast("int"))
    return a + (b - a) * (at - low)


def median(values: Column) -> Column:
    return quantile(values, 0.5)


def robust_spread(values: Column) -> Column:
    """1.4826 times the median distance from the median (AGG07)."""
    m = median(values)
    return 1.4826 * median(F.transform(values, lambda x: F.abs(x - m)))


def normalise_rows(df: DataFrame, payload: str, low_q: float = 0.02, high_q: float = 0.98, out: str = "normalised", mask: str | None = None) -> DataFrame:
    """Adds each array scaled from its low and high quantile to [0, 1]; NaN counts as the low one, and a row without numbers is all 0 (NRM01).

    mask: an array of booleans; the quantiles are of the places where it holds.
    """
    seen = F.zip_with(payload, mask, lambda x, m: F.when(m, x)) if mask else F.col(payload)
    df = df.withColumn("_ok", finite(seen))
    df = df.withColumn("_low", quantile(F.col("_ok"), low_q)).withColumn("_high", quantile(F.col("_ok"), high_q))
    span = F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-6))
    scaled = F.transform(payload, lambda x: F.when(F.col("_low").isNull(), F.lit(0.0)).when(F.isnan(x) | x.isNull(), F.lit(0.0)).otherwise(clamp((x - F.col("_low")) / span)))
    return df.withColumn(out, scaled).drop("_ok", "_low", "_high")


def next_range(state: tuple[float, float] | None, low: float, high: float, adapt: float = 0.02, most: float = 0.05, reset: float = 3.0) -> tuple[float, float]:
    """The stable range after a row whose own range is (low, high) (NRM02, CUT08)."""
    if state is None:
        return low, high
    span = max(state[1] - state[0], 1e-6)
    share = max(high - low, 1e-6) / span
    if share > reset or share < 1 / reset or abs(low - state[0]) / span > 2:
        return low, high
    step = most * span
    return state[0] + adapt * min(max(low - state[0], -step), step), state[1] + adapt * min(max(high - state[1], -step), step)


def slow_range(df: DataFrame, clip: str, order: list[str], low: str, high: str) -> DataFrame:
    """df with stable_low and stable_high: a range that follows each row's slowly, and starts anew after a jump (NRM02)."""

    def step(rows, state):
        lows, highs = [], []
        for a, b in zip(rows[low].tolist(), rows[high].tolist(), strict=True):
            if a is not None and b is not None and a == a and b == b:
                state = next_range(state, a, b)
            lows.append(state[0] if state else None)
            highs.append(state[1] if state else None)
        return rows.assign(stable_low=lows, stable_high=highs), state

    schema = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    return fold(df, clip, order, step, f"{schema}, stable_low double, stable_high double")


def robust_line(x: np.ndarray, y: np.ndarray, rounds: int = 3) -> tuple[float, float]:
    """(scale, shift) of y ~ scale * x + shift; far points weigh less in each round (AGG11, NRM01)."""
    design = np.column_stack([x, np.ones(len(x))])
    line = np.linalg.lstsq(design, y, rcond=None)[0]
    for _ in range(rounds):
        off = np.abs(y - design @ line)
        w = np.minimum(1.0, 1.5 * max(float(np.median(off)) * 1.4826, 0.01) / (off + 1e-6))
        line = np.linalg.lstsq(design * w[:, None], y * w, rcond=None)[0]
    return float(line[0]), float(line[1])


def robust_lines(df: DataFrame, group: str, x: str, y: str, rounds: int = 3) -> DataFrame:
    """(group, n, scale, shift) of y ~ scale * x + shift in each group, far rows weighing less in each round (AGG11).

    All rounds are windows over one partitioning. A null in x or y leaves a row out; a group of one x has no line.
    """
    whole = Window.partitionBy(group)
    rows = df.select(group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x is not null and _y is not null")
    rows = rows.withColumn("_w", F.lit(1.0))
    a, b, u, v, w = (F.col(f"_{c}") for c in "abxyw")
    for k in range(rounds + 1):
        total = {"s": w * w, "sx": w * w * u, "sy": w * w * v}
        rows = rows.withColumns({f"_{n}": F.sum(c).over(whole) for n, c in total.items()})
        rows = rows.withColumns({"_u": u - F.col("_sx") / F.col("_s"), "_v": v - F.col("_sy") / F.col("_s")})
        rows = rows.withColumns({"_uu": F.sum(w * w * F.col("_u") * F.col("_u")).over(whole), "_uv": F.sum(w * w * F.col("_u") * F.col("_v")).over(whole)})
        rows = rows.withColumn("_a", F.when(F.col("_uu") > 0, F.col("_uv") / F.col("_uu"))).withColumn("_b", (F.col("_sy") - a * F.col("_sx")) / F.col("_s"))
        if k < rounds:
            rows = rows.withColumn("_off", F.abs(v - (a * u + b)))
            sigma = F.greatest(F.median("_off").over(whole) * 1.4826, F.lit(0.01))
            rows = rows.withColumn("_w", F.least(F.lit(1.0), 1.5 * sigma / (F.col("_off") + 1e-6)))
        rows = rows.select(group, "_x", "_y", "_w", "_a", "_b")
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.first("_a").alias("scale"), F.first("_b").alias("shift"))
