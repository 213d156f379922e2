"""Rows of a clip and their neighbours in chunks of positions: halos (WIN12) and band joins (AGG14).

A clip is cut at fixed positions, so one that is long is dealt to many tasks, whatever its share of the table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import dot
from .clips import by_stretches


def with_halo(df: DataFrame, pos: str, core: int, halo: int, n: str, chunk: str = "chunk", own: str = "own") -> DataFrame:
    """A row for each chunk of `core` positions (counted from 1) whose rows, or the `halo` rows on either side of them, hold it; own marks the chunk that it belongs to.

    n: a column with the number of rows of the clip.
    """
    at = F.col(pos) - 1
    first, last = F.greatest(F.floor((at - halo) / core), F.lit(0)), F.least(F.floor((at + halo) / core), F.floor((F.col(n) - 1) / core))
    return df.withColumn(chunk, F.explode(F.sequence(first, last))).withColumn(own, F.col(chunk) == F.floor(at / core))


def over_halo(df: DataFrame, clip: str, pos: str, column: str, kernel: Callable[[np.ndarray, bool], np.ndarray], core: int = 4096, halo: int = 256, out: str = "smoothed") -> DataFrame:
    """df with what a kernel of a stretch of numbers gives, a chunk and its halo at a time; what it gives for the halo is discarded.

    kernel(values, whole) gets the numbers of a stretch in order, scaled by the least and greatest of the whole clip to 0 and 1, and whether
    that stretch is all of the clip; what it returns is scaled back. The result is that of the clip in one piece if the kernel looks no further than halo rows.
    pos counts the rows from 1; a null in column is handed on as NaN. A clip of equal numbers is scaled to 0.
    """
    ends = df.groupBy(clip).agg(F.min(column).alias("_low"), F.max(column).alias("_high"), F.count(F.lit(1)).alias("_n")).withColumnRenamed(clip, "_clip")
    spread = with_halo(df.join(ends, F.col(clip).eqNullSafe(F.col("_clip"))).drop("_clip"), pos, core, halo, "_n", "_chunk", "_own")
    names = df.columns

    def run(rows, starts):
        numbers = lambda name: pc.cast(rows.column(name), pa.float64()).to_numpy()
        low, high, sizes = numbers("_low"), numbers("_high"), numbers("_n")
        span = np.where(high == low, 1.0, high - low)
        scaled, made = (numbers(column) - low) / span, np.empty(len(rows))
        for start, end in zip(starts, starts[1:], strict=False):
            made[start:end] = kernel(scaled[start:end], end - start == sizes[start])
        return rows.select(names).append_column(out, pa.array(made * span + low, from_pandas=True)).filter(rows.column("_own"))

    schema = ", ".join(f"`{n}` {k}" for n, k in df.dtypes) + f", `{out}` double"
    return by_stretches(spread, [clip, "_chunk"], [pos], run, schema)


def unit(vector: Column) -> Column:
    """The vector with length 1; a zero vector stays."""
    size = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(size > 0, x / size).otherwise(x))


def band_pairs(df: DataFrame, clip: str, pos: str, columns: list[str], width: int) -> DataFrame:
    """(clip, pos, columns, other_pos, other_<column>…): each row with each of the next `width` rows of its clip, by position.

    Rows meet in buckets of width positions, each in its own and the next one: n rows make at most n x width pairs, and no bucket compares more than two
    of its size.
    """
    bucket = F.floor(F.col(pos) / width)
    near = df.select(clip, pos, *columns, F.explode(F.array(bucket, bucket + 1)).alias("_bucket"))
    far = df.select(F.col(clip).alias("_clip"), F.col(pos).alias("other_pos"), *(F.col(c).alias(f"other_{c}") for c in columns), bucket.alias("_other"))
    met = near.join(far, F.col(clip).eqNullSafe(F.col("_clip")) & (F.col("_bucket") == F.col("_other")) & (F.col("other_pos") > F.col(pos)) & (F.col("other_pos") <= F.col(pos) + width))
    return met.drop("_bucket", "_clip", "_other")


def self_similarity(df: DataFrame, clip: str, pos: str, vector: str, width: int) -> DataFrame:
    """(clip, pos, other_pos, similarity): the cosine of each row with each of the next `width` rows (AGG14)."""
    pairs = band_pairs(df.select(clip, pos, unit(F.col(vector)).alias("_unit")), clip, pos, ["_unit"], width)
    return pairs.select(clip, pos, "other_pos", dot(F.col("_unit"), F.col("other__unit")).alias("similarity"))


def lookup_rows(similar: DataFrame, rows: DataFrame, clip: str, pos: str, width: int, out: str = "band") -> DataFrame:
    """(clip, pos, band): the similarities of a row with the `width` rows before it, itself and the `width` after it; 0 beyond a clip's ends."""
    both = similar.select(clip, pos, (F.col("other_pos") - F.col(pos)).alias("_at"), "similarity").unionByName(
        similar.select(clip, F.col("other_pos").alias(pos), (F.col(pos) - F.col("other_pos")).alias("_at"), "similarity")
    )
    both = both.unionByName(rows.select(clip, pos, F.lit(0).cast(dict(both.dtypes)["_at"]).alias("_at"), F.lit(1.0).alias("similarity")))
    known = both.groupBy(clip, pos).agg(F.map_from_entries(F.collect_list(F.struct("_at", "similarity"))).alias("_known"))
    steps = F.sequence(F.lit(-width), F.lit(width)).cast(f"array<{dict(both.dtypes)['_at']}>")
    return known.select(clip, pos, F.transform(steps, lambda k: F.coalesce(F.try_element_at("_known", k), F.lit(0.0))).alias(out))
