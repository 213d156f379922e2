"""Sinks (SNK01-SNK17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_clips(df: DataFrame, path: str, clip: str, order: list[str], mode: str = "error") -> int:
    """Writes clips in order, a folder for each (SNK01, SNK07), and returns the number of rows written (SNK16, SNK17)."""
    seen = Observation("written")
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.repartition(clip).sortWithinPartitions(clip, *order).write.mode(mode).partitionBy(clip).parquet(path)
    return seen.get["rows"]


def write_checked(df: DataFrame, path: str, expected: int, mode: str = "error") -> None:
    """Writes df and fails if fewer rows than expected came (SNK17)."""
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    if (rows := seen.get["rows"]) < expected:
        raise RuntimeError(f"{rows} of {expected} rows were written")


def write_cut_list(cuts: DataFrame, path: str, seconds: str = "cut_sec", mode: str = "error") -> None:
    """One number a line, in order; an empty list makes an empty file (SNK10). A cut list is small: it goes to one file."""
    cuts.select(seconds).repartition(1).sortWithinPartitions(seconds).select(F.col(seconds).cast("string")).write.mode(mode).text(path)


def consume(df: DataFrame) -> None:
    """Computes every row and writes none (SNK09)."""
    df.write.format("noop").mode("overwrite").save()
