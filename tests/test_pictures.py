"""Numbered pictures: codec, round trips, holes, failing tasks."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqengine.sources import pictures


@pytest.mark.parametrize("depth", [8, 16])
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_codec(depth, channels):
    rng = np.random.default_rng(depth + channels)
    pixels = rng.integers(0, 1 << depth, (5, 7, channels))
    found, own = pictures.decode_png(pictures.encode_png(pixels, depth))
    assert own == depth and (found == pixels).all()


def test_all_filters():
    """Rows that are written as differences from the left, above, their mean and the nearest of three."""
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (10, 6, 3))
    raw = bytearray()
    for y in range(10):
        kind = y % 5
        raw.append(kind)
        for x in range(6):
            for c in range(3):
                left = int(pixels[y, x - 1, c]) if x else 0
                above = int(pixels[y - 1, x, c]) if y else 0
                corner = int(pixels[y - 1, x - 1, c]) if x and y else 0
                nearest = min((abs(left + above - corner - v), i, v) for i, v in enumerate((left, above, corner)))[2]
                raw.append((int(pixels[y, x, c]) - (0, left, above, (left + above) // 2, nearest)[kind]) % 256)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = pictures.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 10, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", zlib.compress(bytes(raw))) + chunk(b"IEND", b"")
    assert (pictures.decode_png(data)[0] == pixels).all()
    for broken in (b"GIF", data[:20], data.replace(struct.pack(">IIBBBBB", 6, 10, 8, 2, 0, 0, 0), struct.pack(">IIBBBBB", 6, 10, 8, 3, 0, 0, 0))):
        with pytest.raises(ValueError):
            pictures.decode_png(broken)


def made(spark, numbers):
    rows = spark.createDataFrame([(n,) for n in numbers], "number long").repartition(3)
    return rows.select("number", F.lit(2).alias("height"), F.lit(3).alias("width"), F.lit(1).alias("channels"), F.lit(8).alias("depth"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: (k + F.col("number")).cast("int")).alias("pixels"))


def test_round_trip(spark, tmp_path):
    pictures.register(spark)
    df, where = made(spark, range(7, 30)), f"{tmp_path}/run/frames_%05d.png"
    df.write.format("numbered_pictures").mode("append").save(where)
    assert sorted(os.listdir(tmp_path / "run")) == [f"frames_{n:05d}.png" for n in range(7, 30)]
    (tmp_path / "run" / "frames_7.png").write_bytes(b"another name")
    found = spark.read.format("numbered_pictures").option("per_task", 10).load(where)
    assert found.rdd.getNumPartitions() == 3 and sorted(found.collect()) == sorted(df.collect())
    with pytest.raises(PySparkException, match="has pictures"):
        df.write.format("numbered_pictures").mode("append").save(where)
    made(spark, range(3)).write.format("numbered_pictures").mode("overwrite").save(where)
    assert sorted(r.number for r in found.sparkSession.read.format("numbered_pictures").load(where).collect()) == [0, 1, 2]


def test_single_pictures(spark, tmp_path):
    pictures.register(spark)
    made(spark, [4]).drop("number").write.format("numbered_pictures").mode("append").save(f"file://{tmp_path}/one.png")
    found = spark.read.format("numbered_pictures").load(f"{tmp_path}/one.png").collect()
    assert [(r.number, r.height, r.width, r.pixels) for r in found] == [(None, 2, 3, [4, 5, 6, 7, 8, 9])]
    with pytest.raises(PySparkException, match="2 pictures for one name"):
        made(spark, [1, 2]).write.format("numbered_pictures").mode("append").save(f"{tmp_path}/two.png")
    assert os.listdir(tmp_path) == ["one.png"]


@pytest.mark.parametrize(("numbers", "says"), [([1, 2, 4], "comes after 2"), ([1, 2, 2], "comes twice"), ([1, -2], "the number -2")])
def test_holes_leave_nothing(spark, tmp_path, numbers, says):
    pictures.register(spark)
    with pytest.raises(PySparkException, match=says):
        made(spark, numbers).write.format("numbered_pictures").mode("append").save(f"{tmp_path}/f_%03d.png")
    assert os.listdir(tmp_path) == []


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    pictures.register(spark)
    broken = made(spark, range(20)).withColumn("pixels", F.when(F.col("number") == 13, F.array(F.lit(999))).otherwise(F.col("pixels")))
    with pytest.raises(PySparkException):
        broken.write.format("numbered_pictures").mode("append").save(f"{tmp_path}/f_%03d.png")
    assert os.listdir(tmp_path) == []


def test_holes_and_patterns_in_reading(spark, tmp_path):
    pictures.register(spark)
    for n in (1, 2, 4):
        (tmp_path / f"f_{n:03d}.png").write_bytes(pictures.encode_png(np.zeros((1, 1, 1)), 8))
    with pytest.raises(PySparkException, match="comes after 2"):
        spark.read.format("numbered_pictures").load(f"{tmp_path}/f_%03d.png").collect()
    with pytest.raises(PySparkException, match="no picture"):
        spark.read.format("numbered_pictures").load(f"{tmp_path}/g_%03d.png").collect()
    for bad in ("a_%d_%d.png", "a_%s.png", "a_%d.jpg"):
        with pytest.raises(ValueError):
            pictures.Numbered.of(f"{tmp_path}/{bad}")
    assert pictures.Numbered.of("x/a_%05d.png").number("a_123456.png") == 123456 and pictures.Numbered.of("x/a_%05d.png").number("a_0123456.png") is None
