"""Stateful operators on streams in event time (STR03-STR05, STR08): rows may come late and mixed, over any number of micro-batches.

Clips are dealt into buckets by hash, and a bucket's rows wait in its state, in spans of event time (`grain`), until the watermark has passed a span.
Rows of small spans that come together wait in one pack, with a timer for its first span. The timer takes what is past, sorts each clip's rows and runs the
fold over them: all together if they are few, else in order of spans, for which packs are dealt out one by one, so that memory is bounded by a bucket's rows of
one span, however many rows a micro-batch brings. State is read and written once for all clips and small spans of a bucket: a call between Spark and Python
for each would cost more than all else. Each row is seen once and in order. A clip is over when no row came for longer than `idle`
between two spans, or can come any more: what the fold still owes is emitted, its state goes, and later rows begin anew. A row whose span is already
past comes out with `late` set, and touches no state. Rows go to Python and into state packed, those of a bucket as one binary,
as each row by itself would be turned from one form into another several times. Nothing depends on how rows were dealt to micro-batches
but which ones are late, and a query that is started again from its checkpoint goes on where it was.

State is kept by RocksDB; `run` starts a query so. A null or NaN value is handed to the fold as NaN.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..session import make_folder, move, scratch_folder
from .processors import with_watermark

NAN = float("nan")
#: Bytes of rows that a task packs at a time, rows above which a bucket's spans do not wait and are not folded together, and output rows that make a table.
PACKED, FOLDED, MADE = 1 << 24, 50_000, 20_000
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class Fold(NamedTuple):
    """What runs over a clip's ordered rows.

    columns: of an output row, behind the clip. state: its columns. step(state or None, places, values) gives
    output rows and the next state; end(state) the rows still owed; late(place, value) the row of a late one.
    """

    columns: str
    state: str
    step: Callable[[tuple | None, list[int], list[float]], tuple[list[tuple], tuple]]
    end: Callable[[tuple], list[tuple]]
    late: Callable[[int, float], tuple]


def _to_bytes(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_table(rows.combine_chunks())
    return out.getvalue().to_pybytes()


def _from_bytes(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True) if len(keys) else iter(())


def _packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_bucket, _rows) of rows (_bucket, clip, ms, at, value): those of each bucket as one binary, in the order they have."""

    def pack(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(kept)
        order = np.argsort(table["_bucket"].to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        buckets, rows = table["_bucket"].to_numpy(), table.drop_columns(["_bucket"])
        runs = list(_runs(buckets))
        return pa.RecordBatch.from_arrays([pa.array([buckets[a] for a, _ in runs], pa.int32()), pa.array([_to_bytes(rows.slice(a, b - a)) for a, b in runs], pa.binary())], names=["_bucket", "_rows"])

    kept, size = [], 0
    for part in parts:
        kept.append(part)
        size += part.nbytes
        if size >= PACKED:
            yield pack(kept)
            kept, size = [], 0
    if size:
        yield pack(kept)


class _InOrder(StatefulProcessor):
    def __init__(self, fold: Fold, names: list[str], grain: int, idle: int):
        self.fold, self.names, self.grain, self.idle = fold, names, grain, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, {}
        self.waiting = handle.getMapState("waiting", "first long, last long, n long, size long", "rows binary")
        columns = ", ".join("{} array<{}>".format(*x.rsplit(" ", 1)) for x in self.fold.state.split(", "))
        self.held = handle.getListState("held", f"_clip array<string>, _done array<long>, {columns}")

    def _table(self, rows: list[tuple], late: bool) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names[:-1]).assign(**{self.names[-1]: late})

    def _came(self, part: pd.DataFrame) -> pa.Table:
        """(clip, ms, at, value) of a table of packed rows, or of one of rows."""
        if part.shape[1] == 2:
            return pa.concat_tables([_from_bytes(x) for x in part.iloc[:, 1]]).combine_chunks()
        clip, ms, at, value = (part.iloc[:, k].tolist() for k in range(1, 5))
        columns = zip((clip, ms, at, value), (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)
        return pa.table([pa.array(x, kind, from_pandas=True) for x, kind in columns], names=["clip", "ms", "at", "value"])

    def _columns(self, rows: pa.Table) -> tuple[list[int | None], list[float]]:
        at, values = rows["at"], rows["value"].fill_null(NAN)
        return at.to_pylist() if at.null_count else at.to_numpy().tolist(), values.to_numpy().tolist()

    def _by_clip(self, rows: pa.Table) -> Iterator[tuple[str | None, int, int, list[int | None], list[float]]]:
        """Clip, first and last span, places and values of each stretch of a clip without longer idleness, in order; rows of one place stay as they came."""
        spans = rows["span"].to_numpy()
        clips = rows["clip"].combine_chunks().dictionary_encode(null_encoding="encode")
        codes, names = clips.indices.to_numpy(), clips.dictionary.to_pylist()
        order = np.lexsort((rows["at"].fill_null(np.iinfo("int64").min).to_numpy(), spans, codes))
        at, values = self._columns(rows.take(pa.array(order)))
        codes, spans = codes[order], spans[order]
        apart = (codes[1:] != codes[:-1]) | ((spans[1:] - spans[:-1] - 1) * self.grain > self.idle)
        for a, b in _runs(np.concatenate(([0], np.cumsum(apart)))):
            yield names[codes[a]], int(spans[a]), int(spans[b - 1]), at[a:b], values[a:b]

    def _wait(self, rows: pa.Table, n: int, packs: set[tuple], past: int, most: int) -> None:
        """Puts rows, in order of their spans, into packs of at most so many rows, or of one span; a timer is set for a pack's first span unless it is past."""
        firsts, spans = {first for first, *_ in packs}, rows["span"].to_numpy()
        ends = [b for _, b in _runs(spans)]
        start = 0
        for k, end in enumerate(ends):
            if k + 1 < len(ends) and ends[k + 1] - start <= most:
                continue
            pack = (int(spans[start]), int(spans[end - 1]), n, end - start)
            if pack[0] >= past and pack[0] not in firsts:
                self.handle.registerTimer((pack[0] + 1) * self.grain)
            self.waiting.updateValue(pack, (_to_bytes(rows.slice(start, end - start)),))
            packs.add(pack)
            start = end

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() // self.grain  # the first span that the watermark has not passed
        packs = set(self.waiting.keys())
        for n, part in enumerate(rows, 1 + max((n for _, _, n, _ in packs), default=0)):
            table = self._came(part)
            table = table.append_column("span", pa.array(table["ms"].to_numpy() // self.grain)).drop_columns(["ms"])
            table = table.take(pa.array(np.argsort(table["span"].to_numpy(), kind="stable"))).combine_chunks()
            late = int(np.searchsorted(table["span"].to_numpy(), past))
            if late:
                some = table.slice(0, late)
                yield self._table([(clip, *self.fold.late(*row)) for clip, *row in zip(some["clip"].to_pylist(), *self._columns(some), strict=True)], True)
            self._wait(table.slice(late), n, packs, past, FOLDED)

    def _take(self, pack: tuple, packs: set[tuple]) -> pa.Table:
        rows = _from_bytes(self.waiting.getValue(pack)[0])
        self.waiting.removeKey(pack)
        packs.remove(pack)
        return rows

    def _due(self, past: int) -> Iterator[pa.Table]:
        """Takes the rows before a span out of state, in tables of whole spans, in order: all together or, if there are many, some spans at a time."""
        packs = set(self.waiting.keys())
        due = [pack for pack in packs if pack[0] < past]
        if sum(size for *_, size in due) > FOLDED:
            for pack in due:
                if pack[0] != pack[1]:
                    self._wait(self._take(pack, packs), pack[2], packs, past, 0)
            due = [pack for pack in packs if pack[0] < past]
        waited, size = [], 0
        for k, pack in enumerate(due := sorted(due)):
            rows = self._take(pack, packs)
            split = int(np.searchsorted(rows["span"].to_numpy(), past))
            if split < len(rows):
                self._wait(rows.slice(split), pack[2], packs, past, FOLDED)
            waited.append((pack[2], k, rows.slice(0, split)))
            size += split
            whole = k + 1 == len(due) or pack[1] < due[k + 1][0]
            if k + 1 == len(due) or size >= FOLDED and whole:
                yield pa.concat_tables([rows for *_, rows in sorted(waited, key=lambda x: x[:2])])
                waited, size = [], 0

    def _end_of(self, span: int) -> int:
        """When no row can come any more that goes on with a clip whose last row is in a span; never at the end of a span."""
        return (span + 2) * self.grain + self.idle + 1

    def _next_end(self, held: dict) -> int | None:
        return self._end_of(min(done for done, _ in held.values())) if held else None

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """At a bucket's first timer in a micro-batch, all that the watermark has passed; at its others, nothing is left."""
        watermark, out = timerValues.getCurrentWatermarkInMs(), []
        if self.seen.get(key) == watermark:
            return
        self.seen[key] = watermark
        held = {clip: (done, tuple(state)) for row in self.held.get() for clip, done, *state in zip(*row, strict=True)} if self.held.exists() else {}
        timer = self._next_end(held)
        for rows in self._due(watermark // self.grain):
            for clip, first, last, at, values in self._by_clip(rows):
                done, state = held.get(clip, (first, None))
                if state is not None and (first - done - 1) * self.grain > self.idle:
                    out += [(clip, *row) for row in self.fold.end(state)]
                    state = None
                made, state = self.fold.step(state, at, values)
                out += [(clip, *row) for row in made]
                held[clip] = last, state
                if len(out) >= MADE:
                    yield self._table(out, False)
                    out = []
        over = [clip for clip, (done, _) in held.items() if self._end_of(done) <= watermark]
        out += [(clip, *row) for clip in over for row in self.fold.end(held.pop(clip)[1])]
        if out:
            yield self._table(out, False)
        if held:
            self.held.put([tuple(map(list, zip(*((clip, done, *state) for clip, (done, state) in held.items()), strict=True)))])
            if self._next_end(held) != timer:
                self.handle.registerTimer(self._next_end(held))
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def _ms(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def _as_key(clip: Column, kind: str) -> tuple[Column, Callable[[Column], Column]]:
    """A clip's name as a string, so that Python loses no digit beside a null, and the way back."""
    if kind == "binary":
        return F.hex(clip), F.unhex
    if kind == "timestamp":
        return F.unix_micros(clip).cast("string"), lambda c: F.timestamp_micros(c.cast("long"))
    if kind in ("float", "double"):  # one zero
        return (clip + F.lit(0).cast(kind)).cast("string"), lambda c: c.cast(kind)
    return clip.cast("string"), lambda c: c.cast(kind)


def run_fold(df: DataFrame, clip: str, ts: str, order: str, value: str, fold: Fold, delay: str, grain: str, idle: str, buckets: int = 256) -> DataFrame:
    """(clip, columns of the fold, late) of a stream with a row's time in ts and its place in the clip, a long, in order.

    delay: how far the watermark is behind the latest row. idle: the longest time without rows, counted in whole spans, within a clip.
    buckets: clips share the state of so many; more of them hold fewer rows each. A clip's name is of an atomic type.
    """
    if not 0 < _ms(grain) or _ms(idle) % _ms(grain):
        raise ValueError("idle must be a multiple of grain")
    # Spark runs a processor in a Python process of the driver too, which files sent to executors don't reach.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    key, back = _as_key(F.col(clip), df.schema[clip].dataType.simpleString())
    schema = StructType.fromDDL(f"`{clip}` string, {fold.columns}, late boolean")
    marked = with_watermark(df, ts, delay)
    rows = marked.filter(F.col(ts).isNotNull()).select(key.alias("clip"), F.unix_millis(ts).alias("ms"), F.col(order).cast("long").alias("at"), F.col(value).cast("double").alias("value"))
    rows = rows.select(F.pmod(F.xxhash64("clip"), F.lit(buckets)).cast("int").alias("_bucket"), "*").mapInArrow(_packed, "_bucket int, _rows binary")
    processor = _InOrder(fold, schema.names, _ms(grain), _ms(idle))
    made = rows.groupBy("_bucket").transformWithStateInPandas(processor, outputStructType=schema, outputMode="append", timeMode="eventTime")
    return made.withColumn(clip, back(F.col(clip)))


def _null(x: float) -> float | None:
    return None if x != x else x


def repeats(threshold: float, order: str = "pos", value: str = "value") -> Fold:
    """Greedy dedup by squared difference from the last kept row (FIL03c); a row without a value is never kept."""

    def step(state, at, values):
        last, rows = NAN if state is None else state[0], []
        for place, x in zip(at, values, strict=True):
            kept = x == x and not (x - last) * (x - last) < threshold
            rows.append((place, _null(x), kept))
            last = x if kept else last
        return rows, (last,)

    return Fold(f"`{order}` long, `{value}` double, kept boolean", "last double", step, lambda state: [], lambda at, x: (at, _null(x), False))


def cuts(threshold: float, order: str = "pos", value: str = "value") -> Fold:
    """Each row against the one before it (CUT01b); beside a row without a value is no cut."""

    def step(state, at, values):
        before = [NAN if state is None else state[0], *values[:-1]]
        return [(p, _null(x), (x - b) * (x - b) > threshold) for p, x, b in zip(at, values, before, strict=True)], (values[-1],)

    return Fold(f"`{order}` long, `{value}` double, is_cut boolean", "last double", step, lambda state: [], lambda at, x: (at, _null(x), False))


def successors(order: str = "pos", value: str = "value") -> Fold:
    """Each row with the value of the next one, the last of a clip with none (STR04)."""

    def step(state, at, values):
        if state is not None:
            at, values = [state[0], *at], [state[1], *values]
        return [(p, _null(x), _null(y)) for p, x, y in zip(at[:-1], values[:-1], values[1:], strict=True)], (at[-1], values[-1])

    return Fold(f"`{order}` long, `{value}` double, successor double", "at long, last double", step, lambda state: [(state[0], _null(state[1]), None)], lambda at, x: (at, _null(x), None))


def slots(n: int, d: int, threshold: float = 0.0, value: str = "value") -> Fold:
    """Smooth dedup and resampling by n / d (INT01, INT05); the rows dropped at a clip's end are paid out as its tail (INT09)."""

    def step(state, at, values):
        pos, kept_pos, last = (0, 0, NAN) if state is None else state
        rows = []
        for x in values:
            pos += 1
            if x != x or (x - last) * (x - last) < threshold:
                continue
            if last == last:
                for slot in range(kept_pos * n // d + 1, pos * n // d):
                    t = (slot * d - kept_pos * n) / (n * (pos - kept_pos))
                    rows.append((slot, "interp", (1 - t) * last + t * x))
            rows.append((pos * n // d, "real", x))
            kept_pos, last = pos, x
        return rows, (pos, kept_pos, last)

    def end(state):
        pos, kept_pos, last = state
        return [(slot, "tail", last) for slot in range(kept_pos * n // d + 1, pos * n // d + 1)] if last == last else []

    return Fold(f"slot long, kind string, `{value}` double", "pos long, kept_pos long, last double", step, end, lambda at, x: (None, "late", _null(x)))


def session_totals(value: str = "value") -> Fold:
    """One row for each session of a clip, given when it is over: its first and last place, its rows and their sum (STR08)."""

    def step(state, at, values):
        known = [x for x in values if x == x]
        first, _, n, total = state or (at[0], at[0], 0, 0.0)
        return [], (first, at[-1], n + len(at), total + sum(known))

    return Fold("first_at long, last_at long, n long, total double", "first_at long, last_at long, n long, total double", step, lambda state: [tuple(state)], lambda at, x: (at, at, 1, _null(x)))


@contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None, prompt: bool = True) -> Iterator[None]:
    """Queries that are started inside keep their state with RocksDB, write what changed at each checkpoint, and deal state out to so many partitions (those of the session).

    prompt: what a micro-batch's watermark has passed comes out in one without rows behind it, and not in the next one with rows.
    """
    settings = SETTINGS | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}) | ({} if prompt else {"spark.sql.streaming.noDataMicroBatches.enabled": "false"})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _write(df: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")


def run(df: DataFrame, out: str, checkpoint: str, partitions: int | None = None) -> None:
    """Runs a stream over all that is there and adds what it gives to the folder `out`; started again with its checkpoint it goes on, with the partitions of its first start."""
    with rocksdb(df.sparkSession, partitions):
        query = _write(df, out, checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _lay(rows: DataFrame, path: str, ts: str, lots: int = 0) -> Any:
    """Writes rows, each part to a folder of its own if there are parts; gives the latest time."""
    seen = Observation()
    stray = ~F.coalesce(F.col("_lot").between(0, lots - 1), F.lit(False)) if lots else F.lit(False)
    rows.observe(seen, F.max(ts).alias("latest"), F.count_if(stray).alias("stray")).write.partitionBy(*["_lot"] * bool(lots)).parquet(path)
    if seen.get["stray"]:
        raise ValueError(f"{seen.get['stray']} rows are of no part")
    return seen.get["latest"]


def replay(parts: list[DataFrame] | DataFrame, over: Callable[[DataFrame], DataFrame], ts: str, beyond: str, stops: set[int] | None = None, lots: int = 0) -> DataFrame:
    """What a stream operator gives for the rows of parts that arrive one after another, a micro-batch each, with the query stopped and started again between them.

    parts: tables, or one with the number of a row's part, below `lots`, in its column _lot, which is read and dealt out once.
    stops: the numbers of the parts before which that is so; without, all but the first. It always is before the last one. With that comes a row of
    no clip, `beyond` later than all others, so that the watermark passes them. State has a partition for each core. What a part lets come out
    does so with the next one, as each micro-batch costs seconds whatever it holds.
    """
    one = isinstance(parts, DataFrame)
    n, rows = (lots, parts.drop("_lot")) if one else (len(parts), parts[0])
    spark, schema, last = rows.sparkSession, rows.schema, n - 1
    folder = scratch_folder(spark, "replay")
    stops = {*(range(n) if stops is None else stops), last}
    partitions, query = spark.sparkContext.defaultParallelism, None
    waiting = [f"{folder}/next/{'_lot=' * one}{k}" for k in range(n)]
    latest = [_lay(parts, f"{folder}/next", ts, n)] if one else [_lay(part, path, ts) for part, path in zip(parts, waiting, strict=True)]
    latest = max(filter(None, latest), default=None)

    def stream() -> DataFrame:
        return over(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in"))

    def arrive(k: int) -> None:
        make_folder(spark, waiting[k])  # a part without rows has none
        move(spark, waiting[k], f"{folder}/in/{k}")  # at once, so that a part isn't seen by halves

    make_folder(spark, f"{folder}/in")
    try:
        for k in range(last):
            if query is not None and k in stops:
                query.stop()
                query = None
            if query is None:
                with rocksdb(spark, partitions, prompt=False):
                    query = _write(stream(), f"{folder}/out", f"{folder}/state").start()
            arrive(k)
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()
    if latest is not None:
        end = [(F.lit(latest) + F.expr(f"interval {beyond}") if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        spark.range(1).select(*end).write.mode("append").parquet(waiting[last])
    arrive(last)
    run(stream(), f"{folder}/out", f"{folder}/state", partitions)
    return spark.read.schema(stream().schema).parquet(f"{folder}/out")
