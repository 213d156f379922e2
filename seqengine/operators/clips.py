"""Ordered sequences in a table: positions, and folds that carry a state from row to row.

A sequence ("clip") is named by one column and ordered by others that leave no ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship


def ordered(clip: str, *order: str) -> Window:
    return Window.partitionBy(clip).orderBy(*order)


def with_position(df: DataFrame, clip: str, order: list[str], pos: str = "pos", bucket: Column | None = None) -> DataFrame:
    """Adds the 1-based position of each row in its clip.

    bucket: for clips too long for one task, a coarse form of the first order column (such as
    its day) that never falls along the order. Rows are then numbered within buckets, and
    those before them are counted; only the counts of a clip's buckets meet in one task.
    """
    if bucket is None:
        return df.withColumn(pos, F.row_number().over(ordered(clip, *order)).cast("bigint"))
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(clip, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(ordered(clip, "_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(clip, "_bucket", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(clip, "_bucket").orderBy(*order))
    return df.withColumn("_inside", inside).join(counts, [clip, "_bucket"]).withColumn(pos, (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_bucket", "_before", "_inside")


def fold(df: DataFrame, clip: str, order: list[str], step: Callable[[pd.DataFrame, Any], tuple[pd.DataFrame, Any]], schema: str) -> DataFrame:
    """Runs step over each clip's rows in order.

    step takes rows of one clip that follow each other, and the state that it returned for
    the rows before (None at a clip's start); it returns output rows and the next state.
    Rows of a null clip are one clip. Clips share partitions, which are sorted by Spark and read in batches, so that a clip of
    any length takes bounded memory in Python.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started, current, state = False, None, None
        for rows in batches:
            if not len(rows):
                continue
            keys = rows[clip]
            changed = keys.ne(keys.shift()) & ~(keys.isna() & keys.shift().isna())
            changed.iloc[0] = True
            starts = changed.to_numpy().nonzero()[0].tolist() + [len(rows)]
            parts = []
            for low, high in zip(starts, starts[1:], strict=False):
                key = keys.iloc[low]
                if not started or not (key == current or (pd.isna(key) and pd.isna(current))):
                    started, current, state = True, key, None
                out, state = step(rows.iloc[low:high], state)
                parts.append(out)
            yield pd.concat(parts)

    return df.repartition(clip).sortWithinPartitions(clip, *order).mapInPandas(run, schema)


def _differ(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal, and so are NaNs."""
    now, then = values[1:], values[:-1]
    differ = pc.fill_null(pc.not_equal(now, then), False)
    if pa.types.is_floating(values.type):
        differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(now), pc.is_nan(then)), False))
    return pc.or_(differ, pc.not_equal(pc.is_null(now), pc.is_null(then))).to_numpy(zero_copy_only=False)


def by_stretches(df: DataFrame, keys: list[str], order: list[str], run: Callable[[pa.Table, list[int]], pa.Table], schema: str) -> DataFrame:
    """What run makes of short stretches of rows that have equal keys, many at a time: applyInArrow without a call for each.

    run gets whole stretches, each in order, and where each begins, with the number of rows at the end. Partitions are sorted by Spark and
    read in batches; a stretch must fit into memory, all of a partition need not.
    """
    ship(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # of the last stretch, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [kept[-1].slice(kept[-1].num_rows - 1)] if kept else []
            near = pa.Table.from_batches([*last, batch]).select(keys)
            starts = (np.any([_differ(near.column(k)) for k in keys], axis=0).nonzero()[0] + 1 - len(last)).tolist()  # in the batch, of stretches that begin behind another
            if not starts:
                kept.append(batch)
                continue
            before, cut = sum(b.num_rows for b in kept), starts[-1]
            done = pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks()
            yield from run(done, sorted({0, *(s + before for s in starts)})).to_batches()
            kept = [batch.slice(cut)]
        if kept:
            done = pa.Table.from_batches(kept).combine_chunks()
            yield from run(done, [0, done.num_rows]).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(whole, schema)


def recurrent(df: DataFrame, clip: str, order: list[str], payload: str, kernel: Callable[[Any, Any], tuple[Any, float]], out: str, reset: str | None = None) -> DataFrame:
    """df with what a recurrent kernel makes of each row (WIN08, UDF04).

    kernel(state, value) returns the next state and the output; the state is None at a clip's
    start and in a row for which the boolean column `reset` holds. A null value is passed over with a null output.
    """

    def step(rows, state):
        made = []
        resets = rows[reset].tolist() if reset else [False] * len(rows)
        for value, anew in zip(rows[payload].tolist(), resets, strict=True):
            if anew:
                state = None
            if value is None or value != value:
                made.append(None)
                continue
            state, one = kernel(state, value)
            made.append(one)
        return rows.assign(**{out: made}), state

    schema = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    return fold(df, clip, order, step, f"{schema}, `{out}` double")
