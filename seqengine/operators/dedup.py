"""Greedy removal of repeated rows: each row is held against the last one that was kept (FIL03-FIL05).

This isn't dropDuplicates, nor a comparison with the row before: a slow drift is kept once
it has gone far enough from the row kept last. It is a fold, so rows of a clip are read in
order; clips run beside each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import SSIM_K1, SSIM_K2
from ..session import materialize
from .clips import by_stretches, fold, ordered


def _ssim(a: np.ndarray, b: np.ndarray, peak: float) -> float:
    c1, c2 = (SSIM_K1 * peak) ** 2, (SSIM_K2 * peak) ** 2
    ma, mb = a.mean(), b.mean()
    return float((2 * ma * mb + c1) * (2 * ((a - ma) * (b - mb)).mean() + c2) / ((ma**2 + mb**2 + c1) * (a.var() + b.var() + c2)))


#: Is b a repetition of a? Similarities count at the threshold, distances only below it (FIL03a-f, FIL04).
METHODS = {
    "mse": lambda a, b, t: float(np.mean((a - b) ** 2)) < t,
    "mad": lambda a, b, t: float(np.mean(np.abs(a - b))) < t,
    "ssim": lambda a, b, t: _ssim(a, b, 1.0) >= t,
    "similarity100": lambda a, b, t: 100.0 * max(0.0, _ssim(a, b, 1.0)) >= t,
}
#: Further names of the same measures.
METHODS |= {"ssim-cuda": METHODS["ssim"], "mse-cuda": METHODS["mse"], "flownets": METHODS["mad"], "vmaf": METHODS["similarity100"], "vmaf-cuda": METHODS["similarity100"]}


def mark_repeats(df: DataFrame, clip: str, order: list[str], payload: str, method: str, threshold: float) -> DataFrame:
    """df with `kept`: false for a row that repeats the last kept row of its clip. The payload is a number or an array.

    A row whose payload is null is dropped; a row compared to none is kept.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; there are {', '.join(METHODS)}")
    repeats, kinds = METHODS[method], dict(df.dtypes)
    number = not kinds[payload].startswith("array")

    def step(rows, last):
        values, kept = rows[payload].tolist(), []
        if number and method in ("mse", "mad"):  # plain numbers need no arrays
            square = method == "mse"
            for x in values:
                if x is None or x != x:
                    kept.append(False)
                    continue
                gap = None if last is None else (x - last) * (x - last) if square else abs(x - last)
                kept.append(gap is None or not gap < threshold)
                if kept[-1]:
                    last = x
        else:
            for x in values:
                if x is None or (number and x != x):
                    kept.append(False)
                    continue
                x = np.atleast_1d(np.asarray(x, dtype=np.float64))
                kept.append(last is None or not repeats(last, x, threshold))
                if kept[-1]:
                    last = x
        return rows.assign(kept=kept), last

    schema = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    return fold(df, clip, order, step, f"{schema}, kept boolean")


def keep_first_of_repeats(marked: DataFrame, clip: str, pos: str = "pos") -> DataFrame:
    """The kept rows, with the number of dropped rows between each and the kept one before (FIL05)."""
    before = F.lag(pos).over(ordered(clip, pos))
    return marked.filter("kept").drop("kept").withColumn("dups_before", F.coalesce(F.col(pos) - before - 1, F.lit(0)).cast("bigint"))


def drop_counts(marked: DataFrame, clip: str) -> DataFrame:
    """Rows read, dropped and kept of each clip (AGG01)."""
    counts = marked.groupBy(clip).agg(F.count(F.lit(1)).alias("consumed"), F.count_if(~F.col("kept")).alias("dropped"))
    return counts.withColumn("emitted", F.col("consumed") - F.col("dropped"))


def trailing_repeats(marked: DataFrame, clip: str, pos: str = "pos") -> DataFrame:
    """For each clip its last kept position and the number of rows dropped after it (INT09)."""
    ends = marked.groupBy(clip).agg(F.max(F.when(F.col("kept"), F.col(pos))).alias("last_pos"), F.max(pos).alias("end_pos"))
    return ends.select(clip, "last_pos", (F.col("end_pos") - F.col("last_pos")).alias("trailing"))


def mark_repeats_spread(df: DataFrame, clip: str, pos: str, payload: str, method: str, threshold: float, rows_per_chunk: int = 100_000) -> DataFrame:
    """mark_repeats for clips too long for one task, over rows with positions from 1.

    Clips are cut into chunks of consecutive positions, and each is folded by itself as if
    its first row were kept. Then chunks are folded again, each from the row that the chunk
    before it kept last, as long as an end differs from that of the last pass. Folds from different
    references soon keep the same rows, so the second pass is usually the last; in each pass
    at least the next chunk becomes right.
    """
    repeats = METHODS[method]
    chunk = ((F.col(pos) - 1) / rows_per_chunk).cast("bigint")
    rows = df.withColumn("_chunk", chunk)
    number = not dict(df.dtypes)[payload].startswith("array")
    kind, clip_kind = dict(df.dtypes)[payload], dict(df.dtypes)[clip]

    plain = number and method in ("mse", "mad")
    square = method == "mse"

    def walk(values, last):
        kept, at = [], None
        for i, x in enumerate(values):
            if x is None or (number and x != x):
                kept.append(False)
                continue
            if plain:  # plain numbers need no arrays
                x = float(x)
                kept.append(last is None or not ((x - last) * (x - last) if square else abs(x - last)) < threshold)
            else:
                x = np.atleast_1d(np.asarray(x, dtype=np.float64))
                kept.append(last is None or not repeats(last, x, threshold))
            if kept[-1]:
                last, at = x, i
        return kept, at

    def first(key):
        if key is None or (number and key != key):
            return None
        return float(key) if plain else np.atleast_1d(np.asarray(key, dtype=np.float64))

    def walks(table, starts):
        """(start, what is kept, the place that is kept last) of each chunk."""
        values, given = table.column(payload).to_pylist(), table.column("_from").take(starts[:-1]).to_pylist()
        return [(start, *walk(values[start:end], first(begun))) for start, end, begun in zip(starts, starts[1:], given, strict=False)]

    def ends(table, starts):
        """The payload that a chunk keeps last, or what it began with."""
        heads, n = table.take(starts[:-1]), len(table)
        at = [n + k if place is None else start + place for k, (start, _, place) in enumerate(walks(table, starts))]
        last = pa.chunked_array([*table.column(payload).chunks, *heads.column("_from").chunks]).take(at)
        return heads.select([clip, "_chunk"]).append_column("_end", last)

    def marks(table, starts):
        kept = pa.array([x for _, marked, _ in walks(table, starts) for x in marked], pa.bool_())
        return table.drop_columns(["_chunk", "_from"]).append_column("kept", kept)

    light = rows.select(clip, "_chunk", pos, payload)
    given = None
    while True:
        source = light.withColumn("_from", F.lit(None).cast(kind)) if given is None else light.join(given, [clip, "_chunk"], "left")
        found = materialize(by_stretches(source, [clip, "_chunk"], [pos], ends, f"`{clip}` {clip_kind}, _chunk bigint, _end {kind}"), "ends")
        before = found.select(clip, (F.col("_chunk") + 1).alias("_chunk"), F.col("_end").alias("_from"))
        if given is not None:
            now, then = before.alias("n"), given.alias("t")
            changed = now.join(then, [clip, "_chunk"], "left").filter(~F.col("n._from").eqNullSafe(F.col("t._from")))
            if changed.isEmpty():
                break
        given = before
    schema = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    return by_stretches(rows.join(given, [clip, "_chunk"], "left"), [clip, "_chunk"], [pos], marks, f"{schema}, kept boolean")
