"""Streams in event time: late and mixed rows, many batches, stops and restarts, last rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from seqengine.operators import dedup
from seqengine.streaming import event_time

START = datetime.datetime(2024, 1, 1)
SCHEMA = "c string, ts timestamp, pos long, value double"


def row(clip, minute, pos, value):
    return (clip, START + datetime.timedelta(minutes=minute), pos, value)


def replayed(spark, lots, fold, delay="30 minutes", grain="10 minutes", idle="1 day"):
    parts = [spark.createDataFrame(lot, SCHEMA) for lot in lots]
    return event_time.replay(parts, lambda s: event_time.run_fold(s, "c", "ts", "pos", "value", fold, delay, grain, idle), "ts", "10 days").collect()


def test_mixed_rows_equal_the_batch(spark):
    """Rows within the delay come in any order and lot; those beyond are late; a null clip is a clip."""
    rng, rows = random.Random(4), []
    for clip in ("a", "b", None):
        rows += [row(clip, i * 3, i, rng.choice([0.0, 1.0, 2.0, 30.0, None, float("nan")])) for i in range(80)]
    lots = [[] for _ in range(4)]
    for r in rows:
        lot = min(3, r[2] // 20 + (rng.random() < 0.3 and r[2] % 20 > 13))
        lots[lot].append(r)
    for lot in lots:
        rng.shuffle(lot)
    late = row("a", 5, 1000, 7.0)
    lots[3].append(late)
    found = replayed(spark, lots, event_time.repeats(4.0))
    assert [(r.c, r.pos, r.value) for r in found if r.late] == [("a", 1000, 7.0)]
    marked = dedup.mark_repeats(spark.createDataFrame(rows, SCHEMA), "c", ["pos"], "value", "mse", 4.0)
    assert {(r.c, r.pos, r.kept) for r in found if not r.late} == {(r.c, r.pos, r.kept) for r in marked.collect()} and len(found) == 241


def test_last_rows_and_tails(spark):
    lots = [[row("a", 0, 1, 5.0), row("a", 1, 2, 5.0)], [row("a", 20, 3, 9.0), row("b", 20, 1, None)], [row("a", 40, 4, 9.0), row("a", 41, 5, 9.0)]]
    found = replayed(spark, lots, event_time.successors())
    assert sorted(((r.c, r.pos, r.successor) for r in found), key=str) == [("a", 1, 5.0), ("a", 2, 9.0), ("a", 3, 9.0), ("a", 4, 9.0), ("a", 5, None), ("b", 1, None)]
    found = replayed(spark, lots, event_time.slots(2, 1, 1.0))
    assert sorted((r.slot, r.kind, r.value) for r in found) == [(2, "real", 5.0), (3, "interp", 6.0), (4, "interp", 7.0), (5, "interp", 8.0), (6, "real", 9.0)] + [(s, "tail", 9.0) for s in (7, 8, 9, 10)]


@pytest.mark.parametrize("together", [True, False])
def test_sessions_do_not_depend_on_lots(spark, together):
    rows = [row("a", m, m, 1.0) for m in (0, 5, 29, 55, 60, 200)] + [row("b", 100, 100, None)]
    lots = [rows] if together else [[r] for r in sorted(rows, key=lambda r: r[2])]
    found = replayed(spark, lots, event_time.session_totals(), delay="0 minutes", idle="20 minutes")
    # 29 and 55 have two empty spans between them (30 and 40), which is idle and not longer; 60 and 200 have more.
    assert sorted((r.c, r.first_at, r.last_at, r.n, r.total) for r in found) == [("a", 0, 60, 5, 5.0), ("a", 200, 200, 1, 1.0), ("b", 100, 100, 1, 0.0)]


def test_steps_in_parts():
    """A fold gives the same however its rows are cut."""
    rng = random.Random(1)
    at, values = list(range(60)), [rng.choice([0.0, 1.0, 5.0, event_time.NAN]) for _ in range(60)]
    for fold in (event_time.repeats(4.0), event_time.cuts(4.0), event_time.successors(), event_time.slots(5, 2, 4.0), event_time.session_totals()):
        rows, state = fold.step(None, at, values)
        whole = rows + fold.end(state)
        rows, state = [], None
        for k in range(0, 60, 7):
            more, state = fold.step(state, at[k : k + 7], values[k : k + 7])
            rows += more
        assert str(rows + fold.end(state)) == str(whole)


def test_bounds(spark):
    stream = spark.readStream.format("rate").load().select(F.lit("a").alias("c"), F.col("timestamp").alias("ts"), F.col("value").alias("pos"), F.lit(1.0).alias("value"))
    with pytest.raises(ValueError):
        event_time.run_fold(stream, "c", "ts", "pos", "value", event_time.cuts(1.0), "1 hour", "10 minutes", "15 minutes")
    with pytest.raises(ValueError):
        event_time.run_fold(stream, "c", "ts", "pos", "value", event_time.cuts(1.0), "1 hour", "0 minutes", "15 minutes")
