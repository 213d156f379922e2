"""Bounded windows over ordered rows (WIN01-WIN12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clips import ordered


def check_bounds(past: int, future: int) -> None:
    if past < 0 or future < 0:
        raise ValueError("a window has no negative bounds")


def at_offset(clip: str, pos: str, payload: str, offset: int) -> Column:
    """The payload that many rows away, null beyond an edge (WIN02)."""
    w = ordered(clip, pos)
    return F.lead(payload, offset).over(w) if offset > 0 else F.lag(payload, -offset).over(w)


def row_frame(df: DataFrame, clip: str, pos: str, payload: str, past: int, future: int, out: str = "frame") -> DataFrame:
    """Adds the payloads from `past` rows before to `future` rows after (WIN01, WIN10)."""
    check_bounds(past, future)
    return df.withColumn(out, F.collect_list(payload).over(ordered(clip, pos).rowsBetween(-past, future)))


def with_successor(df: DataFrame, clip: str, pos: str, payload: str, cut: str = "is_cut", out: str = "successor") -> DataFrame:
    """Adds the next row's payload, null where that row opens a new shot (WIN03)."""
    w = ordered(clip, pos)
    return df.withColumn(out, F.when(~F.lead(cut).over(w), F.lead(payload).over(w)))


def anchored_frame(df: DataFrame, clip: str, pos: str, payload: str, size: int, anchors: int = 2, out: str = "frame") -> DataFrame:
    """Adds the last `size` payloads, of which the first `anchors` are always those of the clip's first rows (WIN09)."""
    w = ordered(clip, pos)
    recent = F.collect_list(payload).over(w.rowsBetween(1 - size, 0))
    first = F.array(*(F.nth_value(payload, i + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) for i in range(anchors)))
    full = F.row_number().over(w) > size
    return df.withColumn("_recent", recent).withColumn("_first", first).withColumn("_full", full).withColumn(out, F.when(F.col("_full"), F.concat("_first", F.slice("_recent", anchors + 1, size - anchors))).otherwise(F.col("_recent"))).drop("_recent", "_first", "_full")


def chained_demand(*windows: tuple[int, int]) -> tuple[int, int]:
    """Stages one after another need the sum of their windows (WIN05)."""
    return sum(w[0] for w in windows), sum(w[1] for w in windows)


def parallel_demand(*windows: tuple[int, int]) -> tuple[int, int]:
    """Stages beside each other need the larger of their windows (WIN05)."""
    return max((w[0] for w in windows), default=0), max((w[1] for w in windows), default=0)
