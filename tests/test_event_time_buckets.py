"""Clips share the state of their bucket: calls to Spark don't grow with the clips."""

import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from seqengine.operators import dedup
from seqengine.streaming import event_time

from .test_event_time import SCHEMA, row

DAY = 86_400_000


class Handle:
    """Keeps state in memory, and counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.kept = 0, set(), {}

    def __getattr__(self, name):
        def called(*given):
            self.calls += 1
            return getattr(self, f"_{name}")(*given)

        return called

    def _registerTimer(self, at):
        self.timers.add(at)

    def _getMapState(self, *_):
        kept = {}
        return Counted(self, containsKey=kept.__contains__, getValue=kept.get, updateValue=kept.__setitem__, removeKey=kept.pop, keys=lambda: list(kept))

    def _getListState(self, *_):
        kept = []
        return Counted(self, exists=lambda: bool(kept), get=lambda: list(kept), put=lambda rows: kept.__setitem__(slice(None), rows), clear=kept.clear)


class Counted:
    def __init__(self, handle, **methods):
        self.handle, self.methods = handle, methods

    def __getattr__(self, name):
        self.handle.calls += 1
        return self.methods[name]


def run(fold, lots, idle=60):
    """(rows, calls) of one bucket; a row of a lot is (clip, day, place, value), and the watermark stands half a day before the latest one."""
    names = ["c", *(x.split()[0].strip("`") for x in fold.columns.split(", ")), "late"]
    step, handle, mark, out = event_time._InOrder(fold, names, DAY, idle * DAY), Handle(), 0, []
    step.init(handle)
    for lot in [*lots, []]:
        table = pd.DataFrame([(0, c, d * DAY, p, x) for c, d, p, x in lot], columns=["b", "c", "ms", "at", "x"])
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
        made = list(step.handleInputRows((0,), iter([table]), now)) if lot else []
        mark = max([mark, *(d * DAY - DAY // 2 for _, d, _, _ in lot)]) if lot else mark + 1000 * DAY
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
        for at in sorted(t for t in handle.timers if t < mark):
            handle.timers.remove(at)
            made += step.handleExpiredTimer((0,), now, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
        out += [tuple(r) for table in made for r in table.itertuples(index=False)]
    return out, handle.calls


def lots_of(clips):
    return [[(str(c), d, 100 * d + c, float(c + d)) for c in range(clips) for d in range(low, low + 3)] for low in (0, 3, 6)]


def test_calls_do_not_grow_with_clips():
    for fold in (event_time.successors(), event_time.repeats(4.0), event_time.slots(5, 2, 1.0), event_time.session_totals()):
        few, many = run(fold, lots_of(3)), run(fold, lots_of(300))
        assert many[1] == few[1] and len(many[0]) == 100 * len(few[0])


def test_clips_of_a_bucket_stay_apart():
    found = {(c, p): (x, y) for c, p, x, y, late in run(event_time.successors(), lots_of(5))[0] if not late}
    assert found.keys() == {(str(c), 100 * d + c) for c in range(5) for d in range(9)}
    assert all(pd.isna(y) if p // 100 == 8 else y == x + 1 for (c, p), (x, y) in found.items())


def test_large_names_beside_a_null(spark):
    """Names come out as they went in, digit by digit; late rows, too; a bucket holds many clips."""
    rng, big = random.Random(2), 2**53
    rows = [row(None if c == 3 else str(big + c), i * 3, i, rng.choice([0.0, 1.0, 9.0])) for c in range(7) for i in range(20)]
    lots = [[r for r in rows if r[2] < 15], [r for r in rows if r[2] >= 15]]
    lots[1].append(row(str(big + 1), 0, 99, 5.0))
    parts = [spark.createDataFrame(lot, SCHEMA).withColumn("c", F.col("c").cast("long")) for lot in lots]
    over = lambda s: event_time.run_fold(s, "c", "ts", "pos", "value", event_time.repeats(4.0), "10 minutes", "10 minutes", "1 day", buckets=2)
    found = event_time.replay(parts, over, "ts", "10 days").collect()
    assert [(r.c, r.pos) for r in found if r.late] == [(big + 1, 99)]
    marked = dedup.mark_repeats(spark.createDataFrame(rows, SCHEMA), "c", ["pos"], "value", "mse", 4.0)
    as_text = lambda c: None if c is None else str(c)
    assert sorted(((as_text(r.c), r.pos, r.kept) for r in found if not r.late), key=str) == sorted(((r.c, r.pos, r.kept) for r in marked.collect()), key=str)


def test_tails_and_sessions_of_each_clip():
    """What the clips of a bucket are owed at their ends doesn't mix."""
    lots = [[(c, d, d, float(c == "a" or d == 0)) for c in ("a", "b", None) for d in (0, 1)], [("b", 9, 9, 0.0)]]
    slots, _ = run(event_time.slots(2, 1, 0.5), lots)
    assert sorted((str(c), s, k) for c, s, k, _, _ in slots) == sorted([("a", 2, "real"), ("a", 3, "tail"), ("a", 4, "tail"), *((c, s, "real") for c in ("b", "None") for s in (2, 4)), *((c, 3, "interp") for c in ("b", "None")), ("b", 5, "tail"), ("b", 6, "tail")])
    sessions, _ = run(event_time.session_totals(), lots, idle=2)
    assert sorted((str(c), *rest) for c, *rest in sessions) == [("None", 0, 1, 2, 1.0, False), ("a", 0, 1, 2, 2.0, False), ("b", 0, 1, 2, 1.0, False), ("b", 9, 9, 1, 0.0, False)]
