"""Stateful operators on streams (STR01-STR08).

Rows of a clip are ordered within a micro-batch; between micro-batches they must come in
order. A row that is not after the last one seen of its clip is late and is dropped, which
`with_watermark` makes explicit for event times. A clip's rows of one micro-batch are sorted
in memory; a limit of files at the source bounds them. `idle` ends a clip from which no row
has come for so long (such as "10 minutes", of processing time): what is held back is emitted
and its state goes; without it a state stays until the query ends.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_folder, ship


def with_watermark(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; one without is read in the session's (STR08)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _in_order(parts: Iterator[pd.DataFrame], order: list[str], last: tuple | None) -> pd.DataFrame:
    rows = pd.concat(list(parts)).sort_values(order)
    if last is None:
        return rows
    late = [tuple(r) <= last for r in rows[order].itertuples(index=False)]
    return rows[[not x for x in late]]


def _stateful(df: DataFrame, clip: str, schema: str, state: str, step: Callable, end: Callable | None, idle: str | None) -> DataFrame:
    """Runs step(key, parts, old state or None) -> (rows, new state) on each clip; end(key, state) -> rows when a clip is idle."""
    ship(df.sparkSession)
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def run(key, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            old = held.get
            held.remove()
            if end:
                yield end(key, old)
            return
        rows, new = step(key, parts, held.get if held.exists else None)
        if new is not None:
            held.update(new)
        if wait and held.exists:
            held.setTimeoutDuration(wait)
        yield rows

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return df.groupBy(clip).applyInPandasWithState(run, schema, state, "append", timeout)


def mark_repeats(df: DataFrame, clip: str, order: str, value: str, threshold: float, idle: str | None = None) -> DataFrame:
    """(clip, order, value, kept): greedy dedup of a stream by squared difference (STR03, FIL03c). order is one long column.

    A null value is never kept and compared with nothing, as in the batch form.
    """

    def step(key, parts, old):
        at, last = old or (None, None)
        rows = _in_order(parts, [order], (at,) if at is not None else None)
        kept = []
        for x in rows[value].tolist():
            kept.append(x is not None and x == x and (last is None or not (x - last) * (x - last) < threshold))
            if kept[-1]:
                last = x
        return rows.assign(kept=kept), (int(rows[order].iloc[-1]), last) if len(rows) else None

    kind = dict(df.dtypes)[clip]
    return _stateful(df.select(clip, order, value), clip, f"{clip} {kind}, {order} long, {value} double, kept boolean", "at long, last double", step, None, idle)


def mark_cuts(df: DataFrame, clip: str, order: str, value: str, threshold: float, idle: str | None = None) -> DataFrame:
    """(clip, order, value, is_cut): each row against the one before it in the stream (STR03, CUT01b). Beside a null is no cut."""

    def step(key, parts, old):
        at, last = old or (None, None)
        rows = _in_order(parts, [order], (at,) if at is not None else None)
        values = rows[value].astype("float64").tolist()
        before = [np.nan if last is None else last, *values[:-1]]
        new = (int(rows[order].iloc[-1]), values[-1]) if len(rows) else None
        return rows.assign(is_cut=[(x - b) * (x - b) > threshold for b, x in zip(before, values, strict=False)]), new

    kind = dict(df.dtypes)[clip]
    return _stateful(df.select(clip, order, value), clip, f"{clip} {kind}, {order} long, {value} double, is_cut boolean", "at long, last double", step, None, idle)


def with_successor(df: DataFrame, clip: str, order: str, value: str, idle: str | None = None) -> DataFrame:
    """(clip, order, value, successor): each row with the value of the row after it, and so a row later (STR04).

    The last row of a clip waits for one after it; with `idle` it is emitted with a null successor then.
    """

    def step(key, parts, old):
        rows = _in_order(parts, [order], (old[0],) if old else None)
        if not len(rows):
            return pd.DataFrame({clip: [], order: [], value: [], "successor": []}), None
        at = ([old[0]] if old else []) + rows[order].tolist()
        values = ([np.nan if old[1] is None else old[1]] if old else []) + rows[value].astype("float64").tolist()
        out = pd.DataFrame({clip: key[0], order: at[:-1], value: values[:-1], "successor": values[1:]}, index=range(len(at) - 1))
        return out, (int(at[-1]), values[-1])

    def end(key, old):
        return pd.DataFrame({clip: [key[0]], order: [old[0]], value: [old[1]], "successor": [None]})

    kind = dict(df.dtypes)[clip]
    return _stateful(df.select(clip, order, value), clip, f"{clip} {kind}, {order} long, {value} double, successor double", "at long, last double", step, end, idle)


def interpolate(df: DataFrame, clip: str, order: str, value: str, n: int, d: int, threshold: float = 0.0, close: str | None = None, idle: str | None = None) -> DataFrame:
    """(clip, slot, kind, value): smooth dedup and resampling of a stream (STR03-STR05, INT01, INT05, INT09).

    A row is emitted with the slots before it; a null value is dropped like a repeated one.
    Rows dropped at the end are only known at the end: a row for which the boolean column
    `close` holds, or `idle`, ends a clip, which emits the tail.
    """
    rows = df.select(clip, order, value, (F.col(close) if close else F.lit(False)).alias("_close"))

    def tail(pos: int, kept_pos: int, last: float | None) -> list[tuple]:
        return [(slot, "tail", last) for slot in range(kept_pos * n // d + 1, pos * n // d + 1)] if last is not None else []

    def table(key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["slot", "kind", value]).assign(**{clip: key[0]})[[clip, "slot", "kind", value]]

    def step(key, parts, old):
        at, pos, kept_pos, last = old or (None, 0, 0, None)
        rows = _in_order(parts, [order], (at,) if at is not None else None)
        out: list[tuple] = []
        for x, closes in zip(rows[value].tolist(), rows["_close"].tolist(), strict=True):
            if closes:
                out += tail(pos, kept_pos, last)
                continue
            pos += 1
            if x is None or x != x or (last is not None and (x - last) * (x - last) < threshold):
                continue
            if last is not None:
                for slot in range(kept_pos * n // d + 1, pos * n // d):
                    t = (slot * d - kept_pos * n) / (n * (pos - kept_pos))
                    out.append((slot, "interp", (1 - t) * last + t * x))
            out.append((pos * n // d, "real", x))
            kept_pos, last = pos, x
        return table(key, out), (int(rows[order].iloc[-1]), pos, kept_pos, last) if len(rows) else None

    kind = dict(df.dtypes)[clip]
    schema = f"{clip} {kind}, slot long, kind string, {value} double"
    return _stateful(rows, clip, schema, "at long, pos long, kept_pos long, last double", step, lambda key, old: table(key, tail(*old[1:])), idle)


def windowed_counts(df: DataFrame, ts: str, delay: str, length: str, slide: str | None, keys: list[str]) -> DataFrame:
    """Counts in tumbling or sliding windows of event time, with late rows dropped after `delay` (STR08)."""
    marked = with_watermark(df, ts, delay)
    return marked.groupBy(F.window(ts, length, slide) if slide else F.window(ts, length), *keys).agg(F.count(F.lit(1)).alias("n"))


def source(spark: SparkSession, folder: str, pattern: str, files_per_trigger: int = 1) -> DataFrame:
    """The files of a folder as a stream; a limit of files makes the backpressure (STR01)."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_available(df: DataFrame) -> DataFrame:
    """Runs a stream over all that is there, to its end (STR02), and reads what it wrote."""
    spark = df.sparkSession
    folder = scratch_folder(spark, "stream")
    query = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def sample_by_clock(df: DataFrame, show: Callable[[DataFrame], None], every: str, checkpoint: str):
    """A query that hands what has come to show(rows) once in each span of wall-clock time, such as "2 seconds" (STR06)."""
    return df.writeStream.foreachBatch(lambda rows, _: show(rows)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def stop_within(query, seconds: float = 5.0) -> bool:
    """Cancels a query; the micro-batch in work has so many seconds to end. False if it was cut off (STR07)."""
    end = time.monotonic() + seconds
    while (working := query.isActive and query.status["isTriggerActive"]) and time.monotonic() < end:
        query.awaitTermination(0.1)
    query.stop()
    return not working
