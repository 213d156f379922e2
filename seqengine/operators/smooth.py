"""Trajectories and their smoothing (STB01-STB08, WIN12)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import clamp
from .banded import smoothest_paths
from .bands import over_halo
from .clips import ordered


def scene_weight(df: DataFrame, clip: str, pos: str, score: Column, out: str = "weight") -> DataFrame:
    """Adds the trust in a row's motion: (score - 0.5) / 0.25 in [0, 1], squared below 0.65, 0 at both ends (STB02)."""
    w = ordered(clip, pos)
    base = clamp((score - 0.5) / 0.25)
    edge = F.lag(pos).over(w).isNull() | F.lead(pos).over(w).isNull()
    df = df.withColumn("_base", base).withColumn("_edge", edge)
    return df.withColumn(out, F.when(F.col("_edge"), F.lit(0.0)).when(F.col("_base") < 0.65, F.col("_base") * F.col("_base")).otherwise(F.col("_base"))).drop("_base", "_edge")


def limited_angle(angle: Column, most: float = 45.0) -> Column:
    """An angle in radians, at most so many degrees either way (STB03)."""
    return F.radians(F.least(F.greatest(F.degrees(angle), F.lit(-most)), F.lit(most)))


def trajectory(df: DataFrame, clip: str, pos: str, moves: list[str], weight: str = "weight") -> DataFrame:
    """Adds path_<move>: the running sum of weight * move (STB03, AGG10)."""
    w = ordered(clip, pos).rowsBetween(Window.unboundedPreceding, 0)
    for m in moves:
        df = df.withColumn(f"path_{m}", F.sum(F.col(m) * F.col(weight)).over(w))
    return df


def moving_average(df: DataFrame, clip: str, pos: str, column: str, radius: int, out: str) -> DataFrame:
    """Adds the centred mean over 2 * radius + 1 rows, with the end rows repeated beyond the ends;
    clips shorter than that stay as they are (STB04)."""
    whole, w = Window.partitionBy(clip), ordered(clip, pos)
    inside = F.sum(column).over(w.rowsBetween(-radius, radius))
    n, rank = F.count(F.lit(1)).over(whole), F.row_number().over(w)
    first, last = F.first(column).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last(column).over(w.rowsBetween(0, Window.unboundedFollowing))
    left, right = F.greatest(F.lit(0), radius - (rank - 1)), F.greatest(F.lit(0), radius - (n - rank))
    mean = (inside + left * first + right * last) / (2 * radius + 1)
    return df.withColumn(out, F.when(n < 2 * radius + 1, F.col(column)).otherwise(mean))


def smooth_paths(df: DataFrame, clip: str, pos: str, paths: list[str], weight: str = "weight", seconds: float = 2.0, run: int = 8192) -> DataFrame:
    """(clip, pos, smooth_<path>): the curves with the least weighted energy of their first three differences that stay close to the paths (STB05).

    The energies are means, so that the minimum solves a banded linear system, which is solved in parts: no task holds more than
    some `run` times three rows of a clip. `pos` counts a clip's rows from 1.
    """
    return smoothest_paths(df, clip, pos, paths, weight, 2e-3 / max(seconds, 0.25), run)


def correct(df: DataFrame, fixes: DataFrame, clip: str, pos: str, moves: list[str]) -> DataFrame:
    """df with fix_<move> from the analysis pass by position; a row without one is left as it is (STB06, JON03)."""
    joined = df.join(fixes.select(clip, pos, *(f"fix_{m}" for m in moves)), [clip, pos], "left")
    return joined.withColumns({f"fix_{m}": F.coalesce(F.col(f"fix_{m}"), F.lit(0.0)) for m in moves})


def affine(dx: Column, dy: Column, da: Column, cx: Column, cy: Column) -> Column:
    """The six numbers of a turn by da about (cx, cy) and a shift (STB06)."""
    c, s = F.cos(da), F.sin(da)
    return F.array(c, -s, (1 - c) * cx + s * cy + dx, s, c, (1 - c) * cy - s * cx + dy)


def jacobi(values: np.ndarray, rounds: int = 50, strength: float = 100.0, radius: int = 3, least: int = 12) -> np.ndarray:
    """Repeated weighted means of the rows around each, against its own value (STB08); short series stay."""
    if len(values) < least:
        return values
    taps = [k for k in range(-radius, radius + 1) if k]
    kernel = {k: float(np.exp(-9 * k * k / radius**2)) for k in taps}
    now, n = values.astype(float), len(values)
    for _ in range(rounds):
        total, norm = values.astype(float).copy(), np.ones(n)
        for k, w in kernel.items():
            low, high = max(0, -k), min(n, n - k)
            if low >= high:
                continue
            total[low:high] += strength * w * now[low + k : high + k]
            norm[low:high] += strength * w
        now = total / norm
    return now


def jacobi_paths(df: DataFrame, clip: str, pos: str, column: str, rounds: int = 50, strength: float = 100.0, radius: int = 3, core: int = 4096, out: str = "smoothed") -> DataFrame:
    """df with the repeated means of a column (STB08, WIN12), `core` rows of a clip in one task at a time.

    Each round looks `radius` rows further, so with a halo of all rounds the result is that of the whole clip.
    """
    kernel = lambda values, whole: jacobi(values, rounds, strength, radius, 12 if whole else 0)
    return over_halo(df, clip, pos, column, kernel, core, rounds * radius, out)
