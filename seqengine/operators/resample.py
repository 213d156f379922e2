"""Exact rational resampling of sequences (INT01-INT16).

A factor N/D maps position p to the output slot floor(p * N / D). Between a row at p and the
next one at c, the slots strictly between theirs are filled at t = (slot * D - p * N) /
(N * (c - p)). All slot arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clips import ordered


def _slot(pos: Column, n: int, d: int) -> Column:
    """floor(pos * n / d), exact for products below 2 ** 53."""
    scaled = pos * n
    return ((scaled - F.pmod(scaled, F.lit(d))) / d).cast("bigint")


def time_in_gap(slot: Column, prev: Column, cur: Column, n: int, d: int) -> Column:
    return (slot * d - prev * n) / (F.lit(float(n)) * (cur - prev))


def ladder(k: int | Column) -> Column:
    """k even times in (0, 1) (INT03)."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: i / (k + 1).cast("double"))).otherwise(F.array().cast("array<double>"))


def hold_before_cut(prev: Column, cur: Column, n: int, d: int) -> Column:
    """How many slots of a gap that ends in a cut still show the row before it (INT02)."""
    return F.greatest(F.lit(0), _slot(cur - 1, n, d) - _slot(prev, n, d))


def gaps(df: DataFrame, clip: str, pos: str, payload: str) -> DataFrame:
    """df with prev_pos and prev_value, null in a clip's first row (INT05, INT10)."""
    w = ordered(clip, pos)
    return df.withColumn("prev_pos", F.lag(pos).over(w)).withColumn("prev_value", F.lag(payload).over(w))


def gap_plan(df: DataFrame, clip: str, pos: str, n: int, d: int) -> DataFrame:
    """(clip, prev_pos, cur_pos, slot, t) of every slot to fill between neighbouring rows (INT01)."""
    pairs = df.select(clip, F.lag(pos).over(ordered(clip, pos)).alias("prev_pos"), F.col(pos).alias("cur_pos"))
    return _fill(pairs, n, d).withColumn("t", time_in_gap(F.col("slot"), F.col("prev_pos"), F.col("cur_pos"), n, d))


def _fill(pairs: DataFrame, n: int, d: int) -> DataFrame:
    """A row for each slot strictly between those of prev_pos and cur_pos; none where there is no gap."""
    low, high = _slot(F.col("prev_pos"), n, d) + 1, _slot(F.col("cur_pos"), n, d) - 1
    return pairs.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high").withColumn("slot", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")


Blend = Callable[[Column, Column, Column], Column]
#: What stands between two numbers a and b at a time t in (0, 1), by name (INT23).
BLENDS: dict[str, Blend] = {}


def register_blend(name: str) -> Callable[[Blend], Blend]:
    def put(blend: Blend) -> Blend:
        BLENDS[name] = blend
        return blend

    return put


@register_blend("linear")
def linear(a: Column, b: Column, t: Column) -> Column:
    """The default (INT19)."""
    return (1 - t) * a + t * b


@register_blend("hold")
def hold(a: Column, b: Column, t: Column) -> Column:
    """The row before."""
    return a


@register_blend("nearest")
def nearest(a: Column, b: Column, t: Column) -> Column:
    """The nearer row, the later one in the middle."""
    return F.when(t < 0.5, a).otherwise(b)


@register_blend("smooth")
def smooth(a: Column, b: Column, t: Column) -> Column:
    """Leaves each row slowly."""
    return linear(a, b, t * t * (3 - 2 * t))


def blended(method: str, a: Column, b: Column, t: Column, vector: bool = False) -> Column:
    """Two numbers, or two arrays place by place, at a time between them."""
    if method not in BLENDS:
        raise ValueError(f"unknown interpolation {method}; there are {', '.join(sorted(BLENDS))}")
    blend = BLENDS[method]
    return F.zip_with(a, b, lambda x, y: blend(x, y, t)) if vector else blend(a, b, t)


def interpolate(
    df: DataFrame,
    clip: str,
    pos: str,
    payload: str,
    n: int,
    d: int,
    cut: str | None = None,
    max_span: int = 0,
    tail: DataFrame | None = None,
    weight: Column | None = None,
    method: str = "linear",
) -> DataFrame:
    """(clip, slot, kind, value): the rows of df at their slots, and synthetic rows between them.

    cut: a boolean column; a gap that ends in a cut is filled with copies of the row before
    it, then of the row itself (INT08). max_span: a gap of more positions is filled with
    copies of the row before (INT07); 0 is no limit. tail: (clip, last_pos, trailing) of
    rows dropped at the end, which become copies of the last row (INT09). weight: of the
    synthetic value against the row before it (INT13). method: one of BLENDS.
    """
    vector = dict(df.dtypes)[payload].startswith("array")
    wanted = [clip, F.col(pos).alias("cur_pos"), F.col(payload).alias("value")] + ([F.col(cut).alias("cut")] if cut else [])
    paired = gaps(df, clip, pos, payload).select(*wanted, "prev_pos", "prev_value")
    real = paired.select(clip, _slot(F.col("cur_pos"), n, d).alias("slot"), F.lit("real").alias("kind"), "value")
    filled = _fill(paired, n, d)
    t = time_in_gap(F.col("slot"), F.col("prev_pos"), F.col("cur_pos"), n, d)
    blend = blended(method, F.col("prev_value"), F.col("value"), t, vector)
    if weight is not None:
        anchor = F.col("prev_value")
        blend = F.zip_with(anchor, blend, lambda a, b: a + weight * (b - a)) if vector else anchor + weight * (blend - anchor)
    kind, value = F.lit("interp"), blend
    if max_span:
        far = F.col("cur_pos") - F.col("prev_pos") > max_span
        kind, value = F.when(far, F.lit("hold_prev")).otherwise(kind), F.when(far, F.col("prev_value")).otherwise(value)
    if cut:
        index = F.col("slot") - _slot(F.col("prev_pos"), n, d)
        old = index <= hold_before_cut(F.col("prev_pos"), F.col("cur_pos"), n, d)
        held = F.when(old, F.lit("hold_prev")).otherwise(F.lit("hold_cur"))
        kind = F.when(F.col("cut"), held).otherwise(kind)
        value = F.when(F.col("cut") & old, F.col("prev_value")).when(F.col("cut"), F.col("value")).otherwise(value)
    out = real.unionByName(filled.select(clip, "slot", kind.alias("kind"), value.alias("value")))
    if tail is not None:
        low = _slot(F.col("last_pos"), n, d) + 1
        high = _slot(F.col("last_pos") + F.col("trailing"), n, d)
        ends = tail.filter("trailing > 0").withColumn("_low", low).withColumn("_high", high).filter("_low <= _high")
        ends = ends.select(clip, "last_pos", F.explode(F.sequence("_low", "_high")).alias("slot"))
        last = df.select(F.col(clip), F.col(pos).alias("last_pos"), F.col(payload).alias("value"))
        out = out.unionByName(ends.join(last, [clip, "last_pos"]).select(clip, "slot", F.lit("tail").alias("kind"), "value"))
    return out


def interpolate_around(df: DataFrame, clip: str, pos: str, payload: str, n: int, d: int, project: Callable[[Column], Column], first: bool, **more) -> DataFrame:
    """(clip, slot, kind, value) of rows that are interpolated and projected, such as enlarged (INT12).

    first: interpolation comes first and synthetic rows are projected too; else projected rows are interpolated. Projections that are
    linear in every place give the same either way.
    """
    if first:
        out = interpolate(df, clip, pos, payload, n, d, **more)
        return out.withColumn("value", project(F.col("value")))
    return interpolate(df.withColumn(payload, project(F.col(payload))), clip, pos, payload, n, d, **more)


def look_ahead(df: DataFrame, clip: str, pos: str, payload: str, n: int, d: int) -> DataFrame:
    """A kernel of three rows (before, at, after): t is pushed to the second half of the pair, and a
    missing row after is the row itself (INT22)."""
    w = ordered(clip, pos)
    rows = df.select(clip, F.col(pos).alias("cur_pos"), F.col(payload).alias("value"), F.lag(pos).over(w).alias("prev_pos"), F.lag(payload).over(w).alias("prev_value"), F.lead(payload).over(w).alias("next_value"))
    filled = _fill(rows, n, d)
    t = 0.5 + 0.5 * time_in_gap(F.col("slot"), F.col("prev_pos"), F.col("cur_pos"), n, d) - 0.0001
    after = F.coalesce("next_value", "value")
    value = (1 - t) * (1 - t) * F.col("prev_value") + 2 * t * (1 - t) * F.col("value") + t * t * after
    return filled.select(clip, "slot", t.alias("t"), value.alias("value"))


def timeline(df: DataFrame, slot: Column, fps: float, factor: float, slow_motion: bool) -> DataFrame:
    """Adds out_sec, the time of a slot at the output rate (INT14)."""
    return df.withColumn("out_sec", slot / F.lit(fps if slow_motion else fps * factor))


def splat(df: DataFrame, clip: str, x: Column, y: Column, value: Column) -> DataFrame:
    """Forward warping: each value is shared among the four cells around (x, y) by nearness and summed (INT21)."""
    x0, y0 = F.floor(x), F.floor(y)
    fx, fy = x - x0, y - y0
    cells = F.array(*(F.struct((x0 + i).alias("cx"), (y0 + j).alias("cy"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)))
    spread = df.select(clip, value.alias("_value"), F.explode(cells).alias("cell")).select(clip, "cell.cx", "cell.cy", "cell.w", (F.col("cell.w") * F.col("_value")).alias("wv"))
    return spread.groupBy(clip, "cx", "cy").agg(F.sum("wv").alias("total"), F.sum("w").alias("weight"))
