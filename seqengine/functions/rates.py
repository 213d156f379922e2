"""Frame rates, trims and sizes as column expressions over a table with one row a clip."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


def rational(num: Column, den: Column) -> Column:
    """num / den, null where either is missing or the denominator is 0."""
    return F.when((num > 0) & (den > 0), num / den)


def resolve_fps(r_num: Column, r_den: Column, avg_num: Column, avg_den: Column, is_vfr: Column, fps: Column) -> Column:
    """The average rate of a clip with a variable rate, or if both rates are more than 1 % of
    the larger apart; else the nominal one; else `fps`; else 1 (SRC07)."""
    nominal, average = rational(r_num, r_den), rational(avg_num, avg_den)
    apart = F.abs(nominal - average) > 0.01 * F.greatest(nominal, average)
    use_average = average.isNotNull() & (F.coalesce(is_vfr, F.lit(False)) | F.coalesce(apart, F.lit(False)))
    return F.coalesce(F.when(use_average, average), nominal, F.when(fps > 0, fps), F.lit(1.0))


def total_frames(nb_frames: Column, duration: Column, fps: Column) -> Column:
    """The stated number of rows, or the whole part of duration * fps (SRC06)."""
    return F.coalesce(F.nullif(nb_frames, F.lit(0)), (duration * fps).cast("bigint"))


def trim_start(fps: Column, in_sec: float) -> Column:
    """First 0-based position of a trim; halves round to even (FIL01)."""
    return F.rint(F.lit(float(in_sec)) * fps).cast("bigint")


def trim_end(fps: Column, in_sec: float, out_sec: float) -> Column:
    """Position after the last of a trim, at least one row; null for no end (FIL01)."""
    if out_sec <= 0:
        return F.lit(None).cast("bigint")
    return F.greatest(trim_start(fps, in_sec) + 1, F.rint(F.lit(float(out_sec)) * fps).cast("bigint"))


def check_trim(in_sec: float, out_sec: float) -> None:
    """FIL02."""
    if out_sec != 0 and out_sec <= in_sec:
        raise ValueError(f"the out point {out_sec} must be after the in point {in_sec}")


def rationalise(factor: float, most: int = 100) -> tuple[int, int]:
    """A factor as a fraction with a small denominator (INT04); below 1 is an error (INT18)."""
    if factor < 1:
        raise ValueError(f"the factor must be at least 1, not {factor}")
    found = Fraction(factor).limit_denominator(most)
    return found.numerator, found.denominator


def output_fps(fps: Column, factor: float, slow_motion: bool) -> Column:
    """INT14."""
    return fps if slow_motion else fps * factor


def aspect_ratio(width: Column, height: Column) -> Column:
    """PRJ25."""
    return F.round(width / height, 2)


def even_size(length: Column, factor: float) -> Column:
    """A side scaled by a factor, to an even number (PRJ03)."""
    return (F.rint(length * factor / 2) * 2).cast("bigint")


def pad_to(length: Column, multiple: Column) -> Column:
    """What is missing to the next multiple (PRJ11)."""
    return F.pmod(-length, multiple)


def padding_multiple(scale: Column, base: int = 16) -> Column:
    """INT17."""
    return F.greatest(F.lit(64.0), 4 * base / scale).cast("bigint")


def patch_size(length: Column, quality: str, patch: int = 14) -> Column:
    """A side for the quality low (518), medium (700), or high: its own, up to a multiple of the patch (NRM03)."""
    if quality == "high":
        return F.ceil(length / patch).cast("bigint") * patch
    return F.lit(700 if quality == "medium" else 518).cast("bigint")


def dynamic_scale(similarity: Column) -> Column:
    """0.5, 1 or 2, the nearest in log2 to 0.5 + 1.5 * similarity squared (INT16)."""
    s = F.log2(F.least(F.greatest(0.5 + 1.5 * similarity * similarity, F.lit(0.5)), F.lit(2.0)))
    return F.when(s < -0.5, F.lit(0.5)).when(s < 0.5, F.lit(1.0)).otherwise(F.lit(2.0))


def smallest_multiple(works, among: tuple[int, ...] = (1, 2, 4, 8, 16)) -> int:
    """The smallest multiple for which works(height, width) holds, by trial (PRJ11)."""
    for m in among:
        if works(m, m):
            return m
    raise ValueError(f"none of {among} works")
