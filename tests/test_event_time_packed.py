"""Rows reach Python and state packed, spans are folded together, and a replay has a micro-batch for each part."""

import os
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from seqengine.streaming import event_time, progress

from .test_event_time import SCHEMA, row
from .test_event_time_buckets import DAY, lots_of
from .test_event_time_buckets import run as run_rows


def packed(rows, batch=7):
    """The tables of packed rows, by bucket, of rows (bucket, clip, ms, at, value)."""
    columns = zip(*rows, strict=True)
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
    whole = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["_bucket", "clip", "ms", "at", "value"])
    return pa.Table.from_batches(event_time._packed(whole.slice(k, batch) for k in range(0, len(whole), batch)))


def test_rows_are_packed():
    """One row for each bucket, however many rows there are; nulls, places above 2^53 and the order of rows stay."""
    rng, big = random.Random(3), 2**53
    rows = [(rng.randrange(4), rng.choice(["a", "b", None]), rng.randrange(10**6), rng.choice([None, big + k]), rng.choice([None, 1.0, 2.5])) for k in range(5000)]
    made = packed(rows)
    assert sorted(made["_bucket"].to_pylist()) == [0, 1, 2, 3]
    step = event_time._InOrder(event_time.repeats(4.0), ["c", "pos", "value", "kept", "late"], DAY, DAY)
    for bucket, some in zip(made["_bucket"].to_pylist(), made["_rows"].to_pylist(), strict=True):
        came = step._came(pd.DataFrame({"_bucket": [bucket], "_rows": [some]}))
        assert list(zip(*came.to_pydict().values(), strict=True)) == [r[1:] for r in rows if r[0] == bucket]


def test_packed_rows_give_what_rows_give(monkeypatch):
    for fold in (event_time.successors(), event_time.repeats(4.0), event_time.slots(5, 2, 1.0), event_time.session_totals()):
        plain, calls = run_rows(fold, lots_of(20))
        with monkeypatch.context() as m:
            came = event_time._InOrder._came

            def through(self, part):
                table = packed(list(part.itertuples(index=False, name=None)))
                return came(self, pd.DataFrame({"_bucket": table["_bucket"].to_pylist(), "_rows": table["_rows"].to_pylist()}))

            m.setattr(event_time._InOrder, "_came", through)
            assert str(run_rows(fold, lots_of(20))) == str((plain, calls))  # NaN is not itself


@pytest.mark.parametrize("together", [1, 10, 50_000])
def test_spans_are_folded_together(monkeypatch, together):
    """A clip is folded once for all spans that are due, in parts of so many rows, and the result doesn't depend on that."""
    monkeypatch.setattr(event_time, "FOLDED", together)
    lots = [[(c, d, 10 * d, float(d % 3)) for d in days for c in ("a", "b", None)] for days in (range(9), range(12, 20), range(40, 50))]
    steps, fold = [], event_time.session_totals()
    counted = fold._replace(step=lambda *given: steps.append(1) or fold.step(*given))
    found, _ = run_rows(counted, lots, idle=2)
    assert sorted(((str(c), *rest) for c, *rest in found)) == sorted((c, 10 * a, 10 * (b - 1), b - a, sum(float(d % 3) for d in range(a, b)), False) for c in ("a", "b", "None") for a, b in ((0, 9), (12, 20), (40, 50)))
    assert len(steps) == 3 * 27 if together == 1 else len(steps) < 3 * 27
    assert together < 50_000 or len(steps) == 3 * 6  # the last span of a lot is due with the next one


def test_runs():
    assert list(event_time._runs(np.array([3, 3, 1, 1, 1, 2]))) == [(0, 2), (2, 5), (5, 6)]
    assert list(event_time._runs(np.array([7]))) == [(0, 1)] and not list(event_time._runs(np.array([], dtype=int)))


def test_a_micro_batch_for_each_part(spark, tmp_path, monkeypatch):
    """Two starts where one stop is asked for, and a micro-batch for each part and one for what is owed at the end; the same rows however often it was stopped."""
    rng = random.Random(5)
    rows = [row(c, 3 * i, i, rng.choice([0.0, 1.0, 9.0, None])) for c in ("a", "b", None) for i in range(60)]
    lots = [[r for r in rows if r[2] // 15 == k] for k in range(4)]
    lots[2].append(row("a", 1, 99, 7.0))
    over = lambda s: event_time.run_fold(s, "c", "ts", "pos", "value", event_time.repeats(4.0), "10 minutes", "10 minutes", "1 day")
    found = {}
    for name, stops, starts in (("each", None, 4), ("once", {3}, 2)):
        monkeypatch.setattr(event_time, "scratch_folder", lambda spark, _, name=name: f"file://{tmp_path}/{name}")
        with progress.watching(spark) as seen:
            made = event_time.replay([spark.createDataFrame(lot, SCHEMA) for lot in lots], over, "ts", "10 days", stops)
        found[name] = sorted(map(str, made.collect()))
        assert len(seen.ended) == starts
        assert len([x for x in os.listdir(tmp_path / name / "state" / "commits") if x.isdigit()]) == len(lots) + 1
    assert found["each"] == found["once"] and len(found["once"]) == 181
    assert [r.pos for r in made.collect() if r.late] == [99]
