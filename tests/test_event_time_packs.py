"""Rows of many small spans wait in state as one pack, and a replay deals its table out once."""

import random

import pytest
from pyspark.sql import functions as F

from seqengine.streaming import event_time, progress

from .test_event_time import SCHEMA, row
from .test_event_time_buckets import run as run_rows


def spread(days):
    """Three lots of so many days each, with four rows of each clip and day; every lot brings one row of the day before it."""
    rng, lots = random.Random(days), []
    for lot in range(3):
        low = lot * days
        lots.append([(c, d, 10 * d + k, rng.choice([0.0, 1.0, 9.0])) for d in range(low, low + days) for c in ("a", "b", None) for k in range(4)])
        if lot:
            lots[-1].append(("a", low - 1, 10 * low - 1, 5.0))
    return lots


def test_calls_do_not_grow_with_spans():
    for fold in (event_time.successors(), event_time.repeats(4.0), event_time.slots(5, 2, 1.0), event_time.session_totals()):
        (few, calls), (many, more) = run_rows(fold, spread(3)), run_rows(fold, spread(60))
        assert more == calls and len(many) >= len(few)


@pytest.mark.parametrize("folded", [1, 7, 30, 100])
def test_rows_in_memory_are_bounded(monkeypatch, folded):
    """However few rows may be folded together, the result stays; no more are read at once than those and one span's, or one pack."""
    for fold in (event_time.successors(), event_time.repeats(4.0), event_time.slots(5, 2, 1.0), event_time.session_totals()):
        whole, _ = run_rows(fold, spread(8))
        with monkeypatch.context() as m:
            m.setattr(event_time, "FOLDED", folded)
            sizes, by_clip = [], event_time._InOrder._by_clip
            m.setattr(event_time._InOrder, "_by_clip", lambda self, rows: sizes.append(len(rows)) or by_clip(self, rows))
            packs, to_bytes = [], event_time._to_bytes
            m.setattr(event_time, "_to_bytes", lambda rows: packs.append((len(rows), len(set(rows["span"].to_pylist())))) or to_bytes(rows))
            parts, _ = run_rows(fold, spread(8))
        assert sorted(map(str, parts)) == sorted(map(str, whole))
        assert max(sizes) < folded + 13 and all(n <= folded or spans == 1 for n, spans in packs)


@pytest.mark.parametrize("folded", [1, 50_000])
def test_rows_of_one_place_stay_as_they_came(monkeypatch, folded):
    """Through packs that begin at other spans, and when these are dealt out."""
    monkeypatch.setattr(event_time, "FOLDED", folded)
    lots = [[("a", 5, 1, 1.0), ("a", 6, 1, 2.0)], [("a", 6, 1, 3.0), ("a", 4 + 2, 1, 4.0)], [("a", 5 + 1, 1, 5.0), ("a", 7, 1, 6.0)]]
    found, _ = run_rows(event_time.successors(), lots)
    assert [x for _, _, x, _, late in sorted(found, key=lambda r: r[2]) if not late] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert {x: y for _, _, x, y, _ in found if x < 6} == {1.0: 2.0, 2.0: 3.0, 3.0: 4.0, 4.0: 5.0, 5.0: 6.0}


def test_a_table_is_dealt_out_once(spark, monkeypatch):
    """The rows of one table with their parts' numbers come as those of a table for each part; a part may be empty, and no row is without one."""
    rng = random.Random(7)
    rows = [(*row(c, 3 * i, i, rng.choice([0.0, 1.0, 9.0, None])), (0, 0, 2, 3)[i // 15]) for c in ("a", "b", None) for i in range(60)]
    rows.append((*row("a", 1, 99, 7.0), 3))
    table = spark.createDataFrame(rows, f"{SCHEMA}, _lot int")
    over = lambda s: event_time.run_fold(s, "c", "ts", "pos", "value", event_time.repeats(4.0), "10 minutes", "10 minutes", "1 day")
    written, lay = [], event_time._lay
    monkeypatch.setattr(event_time, "_lay", lambda *given: written.append(given) or lay(*given))
    found = event_time.replay(table, over, "ts", "10 days", {3}, lots=4).collect()
    assert len(written) == 1
    lots = [table.filter(F.col("_lot") == k).drop("_lot") for k in range(4)]
    assert sorted(map(str, found)) == sorted(map(str, event_time.replay(lots, over, "ts", "10 days", {3}).collect()))
    assert len(found) == len(rows) and [r.pos for r in found if r.late] == [99]
    for stray in (4, -1, None):
        with pytest.raises(ValueError):
            event_time.replay(table.withColumn("_lot", F.lit(stray).cast("int")), over, "ts", "10 days", {3}, lots=4)


def test_all_of_ended_queries_is_seen(spark):
    """Nothing of a query that is over is left to a listener that comes after."""
    lots = [spark.createDataFrame([row("a", 60 * k, k, 1.0)], SCHEMA) for k in range(2)]
    with progress.watching(spark) as seen:
        event_time.replay(lots, lambda s: event_time.run_fold(s, "c", "ts", "pos", "value", event_time.cuts(1.0), "10 minutes", "10 minutes", "1 day"), "ts", "10 days")
    assert len(seen.ended) == 2 and all(x.is_set() for x in seen.ended.values())
