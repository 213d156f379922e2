"""Nearest points of two frames in blocks (JON07, FIL10): no table of all pairs, and no task with all points of a pair of frames.

The points of a frame are dealt into blocks by hash, as many as their number asks for: up to eight, and blocks of 4,096 points beyond. Each block
meets each block of the other frame in one task, which keeps for every point its two nearest (one in the other direction); of these the best are
taken. A pair of n and m points makes 2 n + m rows for each block of the other side instead of n x m.

All distances are computed, by a product of matrices; those that may be among the nearest for all its rounding are computed again from differences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship

#: Blocks of a frame, as long as they hold no more than so many points.
BLOCKS, LARGEST = 8, 4096


def _dealt(points: DataFrame, others: DataFrame, pair: str, point: str, vector: str, block: int, side: str) -> DataFrame:
    """points with the blocks (_i, _j) of both sides in which each takes part."""
    own_sizes = points.groupBy(F.col(pair).alias("_p")).agg(F.count(F.lit(1)).alias("_own"))
    far_sizes = others.groupBy(F.col(pair).alias("_q")).agg(F.count(F.lit(1)).alias("_far"))
    sizes = own_sizes.join(far_sizes, F.col("_p") == F.col("_q"))
    blocks = lambda c: F.ceil(F.col(c) / F.greatest(F.lit(float(block)), F.least(F.col(c) / BLOCKS, F.lit(float(LARGEST)))))
    # columns of their own on each side, for frames that are parts of one table
    rows = points.select(F.col(pair).alias(f"_pair{side}"), F.col(point).alias("_name"), F.col(vector).alias("_vector")).join(sizes, F.col(f"_pair{side}") == F.col("_p"))
    own, far = F.pmod(F.xxhash64("_name"), blocks("_own")).alias(side), F.explode(F.sequence(F.lit(0).cast("long"), blocks("_far") - 1)).alias("_j" if side == "_i" else "_i")
    return rows.select(F.col(f"_pair{side}").alias("_pair"), "_name", "_vector", own, far)


def _firsts(own: np.ndarray, far: np.ndarray, other: np.ndarray, most: int) -> np.ndarray:
    """Which entries are among the first `most` of their own, by far and then other."""
    order = np.lexsort((other, far, own))
    own = own[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    return order[rank < most]


def two_nearest(a: np.ndarray, b: np.ndarray, digits: int, tile: int = 256) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """[(row of a, row of b, distance) of the two nearest in b for each of a, (row of b, row of a, distance) of the nearest in a for each of b].

    Distances are rounded; of equal ones the first row counts.
    """
    unit, squares_a, squares_b = 10.0**-digits, (a * a).sum(axis=1), (b * b).sum(axis=1)
    found: tuple[list, list] = ([], [])
    for low in range(0, len(a), tile):
        some = a[low : low + tile]
        squares = squares_a[low : low + tile, None] + squares_b[None] - 2 * (some @ b.T)
        off = 8 * (a.shape[1] + 4) * np.finfo(float).eps * (squares_a[low : low + tile].max() + squares_b.max())
        if np.isfinite(squares).all():
            limit = lambda x: x + 2 * off + 2 * unit * np.sqrt(np.maximum(x, 0) + off) + unit * unit  # noqa: E731  for what rounds to the same
            second = np.partition(squares, min(1, len(b) - 1), axis=1)[:, min(1, len(b) - 1)]
            rows, columns = np.nonzero((squares <= limit(second)[:, None]) | (squares <= limit(squares.min(axis=0))[None]))
        else:
            rows, columns = np.indices(squares.shape).reshape(2, -1)
        far = np.empty(len(rows))
        for k in range(0, len(rows), 16384):  # differences, not products, so that equal points are at 0
            far[k : k + 16384] = np.sqrt(((some[rows[k : k + 16384]] - b[columns[k : k + 16384]]) ** 2).sum(axis=1))
        far, rows = np.round(far, digits), rows + low
        for way, own, other in ((0, rows, columns), (1, columns, rows)):
            first = _firsts(own, far, other, 2 - way)
            found[way].append((own[first], other[first], far[first]))
    out = []
    for way, parts in enumerate(found):
        own, other, far = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = _firsts(own, far, other, 2 - way)
        out.append((own[first], other[first], far[first]))
    return out


def nearest(points: DataFrame, others: DataFrame, pair: str, point: str, vector: str, block: int = 512, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """((pair, point, other, distance, second), (pair, other, point)): the nearest point of the other frame with its distance and that of the
    second nearest (null for none), and the nearest the other way round.

    block: the least number of points in a block. Distances are rounded to so many digits; of equal ones the first by name counts. Rows of a null vector are left out; the vectors of a pair
    have one length.
    """
    ship(points.sparkSession)
    points, others = points.filter(F.col(vector).isNotNull() & F.col(pair).isNotNull()), others.filter(F.col(vector).isNotNull() & F.col(pair).isNotNull())
    key, kinds = dict(points.dtypes)[pair], dict(points.dtypes)[point]
    schema = f"{pair} {key}, way int, name {kinds}, other {kinds}, distance double"

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.empty(0, dtype=object) for c in (pair, "way", "name", "other", "distance")})
        left, right = left.sort_values("_name"), right.sort_values("_name")
        a, b = (np.stack(x["_vector"].to_numpy()).astype(float) for x in (left, right))
        out = []
        for (way, own, names), (rows, best, far) in zip(((0, left, right), (1, right, left)), two_nearest(a, b, digits), strict=True):
            out.append(pd.DataFrame({"way": way, "name": own["_name"].to_numpy()[rows], "other": names["_name"].to_numpy()[best], "distance": far}))
        return pd.concat(out).assign(**{pair: left["_pair"].iloc[0]})[[pair, "way", "name", "other", "distance"]]

    left, right = _dealt(points, others, pair, point, vector, block, "_i"), _dealt(others, points, pair, point, vector, block, "_j")
    found = materialize(left.groupBy("_pair", "_i", "_j").cogroup(right.groupBy("_pair", "_i", "_j")).applyInPandas(met, schema), "nearest")
    best = found.groupBy(pair, "way", "name").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "other"))), 1, 2).alias("near"))
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    forth = best.filter("way = 0").select(pair, F.col("name").alias(point), first["other"].alias("other"), first["distance"].alias("distance"), second["distance"].alias("second"))
    return forth, best.filter("way = 1").select(pair, F.col("name").alias("other"), first["other"].alias(point))


def mutual(points: DataFrame, others: DataFrame, pair: str, point: str, vector: str, block: int = 512) -> DataFrame:
    """(pair, point, other, distance) of points that are each other's nearest."""
    forth, back = nearest(points, others, pair, point, vector, block)
    return forth.drop("second").join(back, [pair, point, "other"])


def distinct(points: DataFrame, others: DataFrame, pair: str, point: str, vector: str, ratio: float = 0.8, least: int = 10, block: int = 512) -> DataFrame:
    """(pair, point, other, distance, second) of points whose nearest is well below the second, in pairs with enough of them."""
    kept = nearest(points, others, pair, point, vector, block)[0].filter(F.col("distance") < ratio * F.col("second"))
    return kept.join(kept.groupBy(pair).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(pair), pair)
