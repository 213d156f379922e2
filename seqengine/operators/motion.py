"""Motion between pictures of a clip by block matching, and what rests on it (NRM01 over time).

A picture is an array of height x width numbers, row by row. Pictures meet by position in a join, so
that pairs of one long clip are matched in many tasks; only the small fits run in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from ..functions.metrics import clamp
from ..session import ship
from .clips import fold
from .normalise import normalise_rows, robust_line


def displacements(reach: int) -> list[tuple[int, int]]:
    """Moves (down, right) of at most `reach` either way, the shortest first."""
    steps = range(-reach, reach + 1)
    return sorted(((dy, dx) for dy in steps for dx in steps), key=lambda d: (d[0] ** 2 + d[1] ** 2, d))


def moves(picture: np.ndarray, other: np.ndarray, reach: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the move (down, right) to the place of the other picture whose surroundings are most like its own.

    Surroundings are `block` places either way, edges repeated, compared by the sum of absolute differences; of equal
    sums (to nine digits) the shortest move. No move leads out of the picture.
    """
    h, w = picture.shape
    own, far = np.pad(picture, block, mode="edge"), np.pad(other, block + reach, mode="edge")
    best, down, right = np.full((h, w), np.inf), np.zeros((h, w), dtype=int), np.zeros((h, w), dtype=int)
    y, x = np.mgrid[:h, :w]
    for dy, dx in displacements(reach):
        off = np.abs(own - far[reach + dy :, reach + dx :][: h + 2 * block, : w + 2 * block])
        rows = sum(off[k : k + h] for k in range(2 * block + 1))
        cost = np.round(sum(rows[:, k : k + w] for k in range(2 * block + 1)), 9)
        better = (cost < best) & (y + dy >= 0) & (y + dy < h) & (x + dx >= 0) & (x + dx < w)
        best[better], down[better], right[better] = cost[better], dy, dx
    return down, right


def matched_places(now: np.ndarray, before: np.ndarray, reach: int, block: int) -> np.ndarray:
    """For each place of a picture its place in the one before, -1 where the move back from there doesn't lead here again."""
    h, w = now.shape
    down, right = moves(now, before, reach, block)
    back_down, back_right = moves(before, now, reach, block)
    y, x = np.mgrid[:h, :w]
    y, x = y + down, x + right
    returns = (down + back_down[y, x] == 0) & (right + back_right[y, x] == 0)
    return np.where(returns, y * w + x, -1).reshape(-1)


def area_weights(n: int, m: int) -> np.ndarray:
    """The matrix (m, n) of means over m equal stretches of n places, places at a border in part."""
    edges = np.linspace(0, n, m + 1)
    low, high = edges[:-1, None], edges[1:, None]
    return np.clip(np.minimum(high, np.arange(1, n + 1)) - np.maximum(low, np.arange(n)), 0, None) / (high - low)


def small_size(height: int, width: int, most: int) -> tuple[int, int]:
    scale = min(1.0, most / max(height, width))
    return (height, width) if scale == 1 else (max(8, round(height * scale)), max(8, round(width * scale)))


def with_matches(df: DataFrame, clip: str, pos: str, payload: str, height: int, width: int, reach: int = 4, block: int = 2, before: str = "before", out: str = "match") -> DataFrame:
    """df with the picture of the position before (null for none) and each place's place in it (-1: none, null for no picture of this size)."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def match(now: pd.Series, last: pd.Series) -> pd.Series:
        def one(a, b):
            if a is None or b is None or len(a) != height * width or len(b) != height * width:
                return None
            return matched_places(np.asarray(a, dtype=float).reshape(height, width), np.asarray(b, dtype=float).reshape(height, width), reach, block)

        return pd.Series([one(a, b) for a, b in zip(now, last, strict=True)], dtype=object)

    ship(df.sparkSession)
    last = df.select(F.col(clip).alias("_clip"), (F.col(pos) + 1).alias("_pos"), F.col(payload).alias(before))
    met = df.join(last, F.col(clip).eqNullSafe(F.col("_clip")) & (F.col(pos) == F.col("_pos")), "left").drop("_clip", "_pos")
    return met.withColumn(out, match(payload, before))


def steady_pictures(
    df: DataFrame, clip: str, order: list[str], payload: str, height: int, width: int, mask: str | None = None, reach: int = 4, block: int = 2, small: int = 320,
    strength: float = 0.75, most_scale: float = 0.1, most_shift: float = 0.04, coverage: float = 0.08, close: float = 0.12, out: str = "steady",
) -> DataFrame:
    """Adds pictures normalised by their quantiles and brought near the picture before by one small scale and shift (NRM01).

    The fit rests on places that move to the picture before and back again, that changed by less than `close` on
    the way, and that aren't near 0 or 1; with fewer than `coverage` of all there is none. Nothing of an older picture enters but
    these two numbers. mask: an array of booleans, the places to look at. small: pictures with a longer side are reduced
    to it for the fit. A picture without numbers is all 0, and doesn't count as one before.
    """
    sh, sw = small_size(height, width, small)
    rows = normalise_rows(df, payload, out="_now", mask=mask).withColumn("_valid", F.transform(payload, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if mask:
        rows = rows.withColumn("_valid", F.zip_with("_valid", mask, lambda a, b: a & F.coalesce(b, F.lit(False))))
    rows = rows.withColumn("_empty", ~F.coalesce(F.exists("_valid", lambda v: v), F.lit(False)))
    if (sh, sw) == (height, width):
        rows = rows.withColumn("_small", F.col("_now")).withColumn("_small_valid", F.col("_valid"))
    else:
        down, across = area_weights(height, sh), area_weights(width, sw).T

        @F.pandas_udf(ArrayType(DoubleType()))
        def reduced(pictures: pd.Series) -> pd.Series:
            return pd.Series([None if p is None or len(p) != height * width else (down @ np.asarray(p, dtype=float).reshape(height, width) @ across).reshape(-1) for p in pictures], dtype=object)

        ones = F.transform("_valid", lambda v: v.cast("double"))
        rows = rows.withColumn("_small", reduced("_now")).withColumn("_small_valid", F.transform(reduced(ones), lambda v: v > 0.999))
    full = rows.filter("not _empty").withColumn("_k", F.row_number().over(Window.partitionBy(clip).orderBy(*order)))
    full = with_matches(full, clip, "_k", "_small", sh, sw, reach, block, "_before", "_match")

    def step(part, state):
        scales, shifts = [], []
        for now, valid, before, match in zip(part["_small"], part["_small_valid"], part["_before"], part["_match"], strict=True):
            now, scale, shift = np.asarray(now, dtype=float), 1.0, 0.0
            if state is not None and match is not None:
                match = np.asarray(match)
                seen, kept = np.asarray(before, dtype=float)[match], state[match]
                use = (match >= 0) & np.asarray(valid, dtype=bool) & (np.abs(seen - now) < close) & (now > 0.02) & (now < 0.98) & (kept > 0.02) & (kept < 0.98)
                if len(now) and use.any() and use.mean() >= coverage:
                    a, b = robust_line(now[use], kept[use])
                    scale = 1 + strength * (min(max(a, 1 - most_scale), 1 + most_scale) - 1)
                    shift = strength * min(max(b, -most_shift), most_shift)
            state = np.clip(scale * now + shift, 0, 1)
            scales.append(scale)
            shifts.append(shift)
        return part[kept_columns].assign(_scale=scales, _shift=shifts), state

    kept_columns = [*df.columns, "_now"]
    schema = ", ".join(f"`{n}` {k}" for n, k in df.dtypes) + ", _now array<double>, _scale double, _shift double"
    fitted = fold(full.select(*kept_columns, "_k", "_small", "_small_valid", "_before", "_match"), clip, ["_k"], step, schema)
    steady = F.transform("_now", lambda x: clamp(x * F.col("_scale") + F.col("_shift")))
    none = rows.filter("_empty").select(*df.columns, F.col("_now").alias(out))
    return fitted.select(*df.columns, steady.alias(out)).unionByName(none)
