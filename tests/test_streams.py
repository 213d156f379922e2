"""Streams give what the batch forms give, and carry their state between micro-batches."""

import pytest
from pyspark.sql import functions as F

from seqengine.operators import dedup, resample
from seqengine.streaming import processors


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(c, i, float((i * 7 * c) % 5 * 10)) for c in (1, 2) for i in range(1, 13)]
    for low in (1, 7):
        part = [r for r in rows if low <= r[1] < low + 6]
        spark.createDataFrame(part, "c int, pos long, value double").coalesce(1).write.parquet(f"{tmp_path}/p{low}")
        next((tmp_path / f"p{low}").glob("*.parquet")).rename(tmp_path / f"{low}.parquet")
    return str(tmp_path)


def test_stream_equals_batch(spark, folder):
    batch = spark.read.parquet(*(f"{folder}/{n}.parquet" for n in (1, 7)))
    stream = processors.source(spark, folder, "*.parquet")
    kept = {(r.c, r.pos): r.kept for r in processors.run_available(processors.mark_repeats(stream, "c", "pos", "value", 150.0)).collect()}
    marked = dedup.mark_repeats(batch, "c", ["pos"], "value", "mse", 150.0)
    assert kept == {(r.c, r.pos): r.kept for r in marked.collect()} and len(kept) == 24
    out = processors.run_available(processors.interpolate(stream, "c", "pos", "value", 5, 2, 150.0))
    whole = resample.interpolate(marked.filter("kept"), "c", "pos", "value", 5, 2)
    as_set = lambda df: {(r.c, r.slot, r.kind, round(r.value, 9)) for r in df.collect()}
    assert as_set(out) == as_set(whole)


def test_nulls_and_successors(spark, tmp_path):
    """Nulls are dropped as in the batch form, the null after a row does not make its repeat new; a row is emitted with its successor."""
    values = [1.0, 1.0, None, 1.0, 9.0, None, 9.0, 2.0]
    for k, low in enumerate((0, 3, 6)):
        part = [(1, i + 1, values[i]) for i in range(low, min(low + 3, 8))] + [(2, i + 1, None) for i in range(low, low + 2)]
        spark.createDataFrame(part, "c int, pos long, value double").coalesce(1).write.parquet(f"{tmp_path}/p{k}")
        next((tmp_path / f"p{k}").glob("*.parquet")).rename(tmp_path / f"{k}.parquet")
    batch = spark.read.parquet(*(f"{tmp_path}/{k}.parquet" for k in range(3)))
    stream = processors.source(spark, str(tmp_path), "*.parquet")
    found = processors.run_available(processors.mark_repeats(stream, "c", "pos", "value", 4.0))
    marked = dedup.mark_repeats(batch, "c", ["pos"], "value", "mse", 4.0)
    assert {(r.c, r.pos, r.kept) for r in found.collect()} == {(r.c, r.pos, r.kept) for r in marked.collect()}
    assert sorted(r.pos for r in found.filter("kept").collect()) == [1, 5, 8]
    out = processors.run_available(processors.interpolate(stream, "c", "pos", "value", 2, 1, 4.0))
    whole = resample.interpolate(marked.filter("kept"), "c", "pos", "value", 2, 1)
    as_set = lambda df: {(r.c, r.slot, r.kind, round(r.value, 9)) for r in df.collect()}
    assert as_set(out) == as_set(whole)
    after = {(r.c, r.pos): r.successor for r in processors.run_available(processors.with_successor(stream, "c", "pos", "value")).collect()}
    assert {p: v for (c, p), v in after.items() if c == 1} == dict(zip(range(1, 8), values[1:], strict=True))
    cuts = processors.run_available(processors.mark_cuts(stream, "c", "pos", "value", 4.0)).filter("is_cut").collect()
    assert [(r.c, r.pos) for r in cuts] == [(1, 5), (1, 8)]


def test_idle_clips_end(spark):
    """What is held back of a clip comes out when no row of it has come for a while."""
    rates = spark.readStream.format("rate").option("rowsPerSecond", 2).load().filter("value = 0").selectExpr("1 as c", "value as pos", "5.0D as value")
    query = processors.with_successor(rates, "c", "pos", "value", idle="1 second").writeStream.format("memory").queryName("ended").outputMode("append").start()
    try:
        for _ in range(40):
            query.awaitTermination(1)
            if rows := spark.table("ended").collect():
                break
        assert [(r.c, r.pos, r.value, r.successor) for r in rows] == [(1, 0, 5.0, None)]
    finally:
        query.stop()


def test_windows_need_a_watermark(spark, folder):
    stream = processors.source(spark, folder, "*.parquet").withColumn("ts", F.timestamp_seconds("pos").cast("timestamp_ntz"))
    counted = processors.windowed_counts(stream, "ts", "10 seconds", "5 seconds", None, ["c"])
    assert counted.isStreaming and dict(counted.dtypes)["n"] == "bigint"
