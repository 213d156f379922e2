"""Transforms from matches, halos, band joins and look-ups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqengine.operators import bands, quality, smooth, transforms


def planted(rng, n, turn, size, dx, dy, wrong, noise=0.0):
    x, y = rng.uniform(0, 640, n), rng.uniform(0, 360, n)
    a, b = size * math.cos(turn), size * math.sin(turn)
    u, v = a * x - b * y + dx + rng.normal(0, noise, n), b * x + a * y + dy + rng.normal(0, noise, n)
    bad = rng.permutation(n) < wrong * n
    u[bad], v[bad] = rng.uniform(0, 640, bad.sum()), rng.uniform(0, 360, bad.sum())
    return [tuple(map(float, r)) for r in zip(x, y, u, v)]


SCHEMA = "pair string, x double, y double, u double, v double"


def test_planted_turns_with_wrong_matches(spark):
    rng, rows, expected = np.random.default_rng(1), [], {}
    for k in range(12):
        turn, size, dx, dy = rng.uniform(-0.4, 0.4), rng.uniform(0.8, 1.2), rng.uniform(-30, 30), rng.uniform(-30, 30)
        expected[str(k)] = (turn, size, dx, dy)
        rows += [(str(k), *r) for r in planted(rng, 200, turn, size, dx, dy, 0.3, 0.2)]
    rows += [("few", *r) for r in planted(rng, 9, 0.1, 1.0, 5, 5, 0)] + [("same", 1.0, 1.0, 4.0, 5.0)] * 12 + [("0", None, 1.0, 1.0, 1.0), ("0", 1.0, 1.0, float("nan"), 1.0)]
    found = {r.pair: r for r in transforms.pair_transforms(spark.createDataFrame(rows, SCHEMA), "pair", "x", "y", "u", "v").collect()}
    for k, (turn, size, dx, dy) in expected.items():
        r = found[k]
        assert (r.angle, r["size"]) == pytest.approx((turn, size), abs=1e-3) and (r.dx, r.dy) == pytest.approx((dx, dy), abs=0.5)
        assert r.n == 200 and 138 <= r.inliers <= 150 and r.score == pytest.approx(0.7 * r.inliers / 200 + 0.3)
    assert (found["few"].dx, found["few"].score, found["few"]["size"]) == (0, 0, 1)
    assert (found["same"].dx, found["same"].dy, found["same"].angle) == (3, 4, 0)


def test_plain_fit_and_turn_alone(spark):
    rng = np.random.default_rng(2)
    rows = planted(rng, 50, 0.2, 1.1, 7, -3, 0, 1.0)
    df = spark.createDataFrame([("a", *r) for r in rows], SCHEMA)
    x, y, u, v = np.array(rows).T
    design = np.concatenate([np.column_stack([x, -y, np.ones(50), np.zeros(50)]), np.column_stack([y, x, np.zeros(50), np.ones(50)])])
    a, b, dx, dy = np.linalg.lstsq(design, np.concatenate([u, v]), rcond=None)[0]
    r = transforms.pair_transforms(df, "pair", "x", "y", "u", "v", rounds=0).first()
    assert (r.dx, r.dy, r.angle, r["size"]) == pytest.approx((dx, dy, math.atan2(b, a), math.hypot(a, b)), abs=1e-8)
    still = transforms.pair_transforms(df, "pair", "x", "y", "u", "v", with_size=False).first()
    assert (still.inliers < 2) == (still.score == 0)
    turned = spark.createDataFrame([("a", *r) for r in planted(rng, 50, 0.2, 1.0, 7, -3, 0.2, 1.0)], SCHEMA)
    r = transforms.pair_transforms(turned, "pair", "x", "y", "u", "v", with_size=False).first()
    assert r["size"] == pytest.approx(1) and r.angle == pytest.approx(0.2, abs=0.02)
    assert transforms.pair_transforms(df.limit(0), "pair", "x", "y", "u", "v").isEmpty()


def test_from_descriptors_to_a_transform(spark):
    """Points of two frames meet by their descriptors, and then by a turn."""
    rng = np.random.default_rng(3)
    places = planted(rng, 60, 0.1, 1.0, 12, 4, 0)
    vectors = rng.normal(size=(60, 16))
    schema = "pair string, point int, vec array<double>, px double, py double"
    now = spark.createDataFrame([("a", i, vectors[i].tolist(), p[0], p[1]) for i, p in enumerate(places)], schema)
    then = spark.createDataFrame([("a", 100 + i, (vectors[i] + rng.normal(0, 0.05, 16)).tolist(), p[2], p[3]) for i, p in enumerate(places)], schema)
    near = quality.mutual_matches(quality.point_distances(now, then, "pair", "point", "vec"), "pair", "point")
    met = transforms.matched_points(near, now, then, "pair", "point", "other", "px", "py")
    r = transforms.pair_transforms(met, "pair", "x", "y", "u", "v").first()
    assert (r.n, r.inliers) == (60, 60) and (r.angle, r.dx, r.dy) == pytest.approx((0.1, 12, 4), abs=1e-8)


@pytest.mark.parametrize("core", [1, 7, 64, 5000])
def test_halos_give_the_whole_clip(spark, core):
    rng, rows, clips = np.random.default_rng(4), [], {}
    for clip, n in (("long", 500), ("short", 9), (None, 40), ("one", 1), ("flat", 30)):
        clips[clip] = np.full(n, 3.0) if clip == "flat" else rng.normal(size=n).cumsum()
        rows += [(clip, i + 1, float(x)) for i, x in enumerate(clips[clip])]
    df = spark.createDataFrame(rows, "c string, pos int, x double").repartition(3)
    found = smooth.jacobi_paths(df, "c", "pos", "x", rounds=10, core=core).collect()
    assert len(found) == len(rows)
    for clip, values in clips.items():
        own = [r.smoothed for r in sorted((r for r in found if r.c == clip), key=lambda r: r.pos)]
        assert own == pytest.approx(smooth.jacobi(values, 10), abs=1e-9)


def test_a_long_clip_is_dealt_out(spark):
    df = spark.range(1, 2001).select(F.lit(1).alias("c"), F.col("id").alias("pos"), F.lit(2000).alias("n"))
    sizes = bands.with_halo(df, "pos", 100, 30, "n").groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.count_if("own").alias("own")).collect()
    assert len(sizes) == 20 and {r.own for r in sizes} == {100} and max(r.rows for r in sizes) == 160


@pytest.mark.parametrize("width", [1, 3, 50])
def test_bands_like_all_pairs(spark, width):
    rng, rows = np.random.default_rng(5), []
    for clip, n in (("a", 40), (None, 7), ("b", 1)):
        rows += [(clip, i + 1, rng.normal(size=4).tolist()) for i in range(n)]
    rows.append(("a", 41, [0.0] * 4))
    df = spark.createDataFrame(rows, "c string, pos long, vec array<double>")
    similar = bands.self_similarity(df, "c", "pos", "vec", width)
    cosine = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b) or 1))
    expected = {(c, p, q): cosine(x, y) for c, p, x in rows for d, q, y in rows if c == d and p < q <= p + width}
    found = {(r.c, r.pos, r.other_pos): r.similarity for r in similar.collect()}
    assert found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k], abs=1e-12) for k in found)
    for r in bands.lookup_rows(similar, df, "c", "pos", width).collect():
        near = lambda q: 1.0 if q == r.pos else expected.get((r.c, min(r.pos, q), max(r.pos, q)), 0.0)  # noqa: E731, B023
        assert r.band == pytest.approx([near(r.pos + k) for k in range(-width, width + 1)], abs=1e-12)


@pytest.mark.parametrize("most_bytes", [0, 1 << 20])
def test_longest_known(spark, most_bytes):
    table = spark.createDataFrame([("rife", 1), ("rife-4.6", 2), ("rife-4.6-lite", 3), ("span", 4)], "method string, height int")
    names = ["rife", "rife-4.6", "rife-4.6-lite-directml", "rife-4.6-heavy", "rifex", "rife-4.60", "span-ncnn", "", None, "other", "span-ncnn"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    found = {r.i: r.height for r in quality.longest_known(df, "name", table, "method", most_bytes=most_bytes).collect()}
    assert [found[i] for i in range(len(names))] == [1, 2, 3, 2, None, 1, 4, None, None, None, 4]
