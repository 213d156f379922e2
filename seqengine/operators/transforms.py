"""Transforms of pairs of frames from matched points (STB01): a turn, a size and a shift, robust against wrong matches.

Every round of the fit is a set of weighted sums over a pair's matches. The sums are windows over the same
partitioning, so that all rounds need one exchange and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import clamp

#: Matches below which nothing is said of a pair, and the distance in pixels up to which a match is right.
LEAST_MATCHES, RIGHT_WITHIN = 10, 2.5


def _fitted(points: DataFrame, pair: str, weight: Column, with_size: bool) -> DataFrame:
    """points (x, y in the first frame, u, v in the second) with the transform (_a, _b, _dx, _dy) of the least weighted squares of their pair.

    u = a x - b y + dx, v = b x + a y + dy. Without size, a and b are the cosine and sine of the best turn.
    """
    whole = Window.partitionBy(pair)
    mean = lambda c: F.sum(F.col("_w") * F.col(c)).over(whole) / F.col("_sum")
    points = points.withColumn("_w", weight).withColumn("_sum", F.sum("_w").over(whole))
    points = points.withColumns({f"_m{c}": mean(c) for c in "xyuv"})
    x, y, u, v = (F.col(c) - F.col(f"_m{c}") for c in "xyuv")
    along, across = F.sum(F.col("_w") * (x * u + y * v)).over(whole), F.sum(F.col("_w") * (x * v - y * u)).over(whole)
    if with_size:
        spread = F.sum(F.col("_w") * (x * x + y * y)).over(whole)
    else:
        points = points.withColumns({"_along": along, "_across": across})
        along, across = F.col("_along"), F.col("_across")
        spread = F.sqrt(along * along + across * across)
    points = points.withColumn("_spread", spread)
    points = points.withColumn("_a", F.when(F.col("_spread") > 0, along / F.col("_spread")).otherwise(1.0)).withColumn("_b", F.when(F.col("_spread") > 0, across / F.col("_spread")).otherwise(0.0))
    a, b = F.col("_a"), F.col("_b")
    points = points.withColumn("_dx", F.col("_mu") - (a * F.col("_mx") - b * F.col("_my"))).withColumn("_dy", F.col("_mv") - (b * F.col("_mx") + a * F.col("_my")))
    off = F.hypot(a * F.col("x") - b * F.col("y") + F.col("_dx") - F.col("u"), b * F.col("x") + a * F.col("y") + F.col("_dy") - F.col("v"))
    return points.withColumn("_off", off).drop("_w", "_sum", *(f"_m{c}" for c in "xyuv"), "_spread", "_along", "_across")


def pair_transforms(
    matches: DataFrame, pair: str, x: str, y: str, u: str, v: str, likeness: str | None = None, with_size: bool = True, rounds: int = 10,
    least: int = LEAST_MATCHES, within: float = RIGHT_WITHIN, share: float = 0.7,
) -> DataFrame:
    """(pair, n, inliers, dx, dy, angle, size, score) of each pair of frames from matches of (x, y) with (u, v), a row each.

    A match that is off by r weighs 1 / (1 + (r / s)^2)^2, where s begins at twice the mean distance of the plain fit and is halved in
    every round, down to `within`; the last fit is of the matches within that. score: `share` times the share of these,
    and the rest times the mean of the column likeness (0 to 1), of which 1 is taken where there is none. A pair of fewer than
    `least` matches, or with fewer than two that agree, stands still, with a score of 0. rounds=0 is the plain fit of all matches.
    Rows with a null or NaN are no matches.
    """
    points = matches.select(pair, *(F.col(c).cast("double").alias(n) for c, n in zip((x, y, u, v), "xyuv", strict=True)), (F.col(likeness).cast("double") if likeness else F.lit(1.0)).alias("like"))
    for c in "xyuv":
        points = points.filter(F.col(c).isNotNull() & ~F.isnan(c))
    whole = Window.partitionBy(pair)
    points = _fitted(points, pair, F.lit(1.0), with_size)
    if rounds:
        points = points.withColumn("_s", F.greatest(2 * F.avg("_off").over(whole), F.lit(within)))
        for _ in range(rounds):
            share_off = F.col("_off") / F.col("_s")
            points = _fitted(points.withColumn("_next", 1 / ((1 + share_off * share_off) * (1 + share_off * share_off))), pair, F.col("_next"), with_size)
            points = points.withColumn("_s", F.greatest(F.col("_s") / 2, F.lit(within)))
        points = points.withColumn("_in", F.col("_off") <= within)
        points = _fitted(points, pair, F.col("_in").cast("double"), with_size)
    else:
        points = points.withColumn("_in", F.lit(True))
    one = points.groupBy(pair).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_in").alias("inliers"), F.avg(F.when(F.col("_in"), F.col("like"))).alias("_like"),
        *(F.first(c).alias(c) for c in ("_a", "_b", "_dx", "_dy")),
    )
    stands = (F.col("n") < least) | (F.col("inliers") < 2)
    score = clamp(share * F.col("inliers") / F.col("n") + (1 - share) * F.coalesce("_like", F.lit(1.0)))
    still = lambda c, value: F.when(stands, F.lit(value)).otherwise(c)
    return one.select(
        pair, "n", "inliers", still(F.col("_dx"), 0.0).alias("dx"), still(F.col("_dy"), 0.0).alias("dy"), still(F.atan2("_b", "_a"), 0.0).alias("angle"),
        still(F.hypot("_a", "_b"), 1.0).alias("size"), still(score, 0.0).alias("score"),
    )


def matched_points(matches: DataFrame, points: DataFrame, others: DataFrame, pair: str, point: str, other: str, x: str, y: str) -> DataFrame:
    """matches (pair, point, other) with the places (x, y) of point and (u, v) of other."""
    own = points.select(pair, point, F.col(x).alias("x"), F.col(y).alias("y"))
    far = others.select(pair, F.col(point).alias(other), F.col(x).alias("u"), F.col(y).alias("v"))
    return matches.join(own, [pair, point]).join(far, [pair, other])
