"""Names that are given in rounds equal those that are given one by one."""

import random

import pytest

from seqengine.operators import naming

from .test_runs import brute_names


@pytest.mark.parametrize("seed", range(4))
def test_like_one_by_one(spark, seed):
    rng = random.Random(seed)
    pool = ["a.mp4", "a-1.mp4", "a-2.mp4", "a-1-1.mp4", "a-3.mp4", "a-01.mp4", "b", "b-1", "b-1-2", "c.d.mkv", "c.d-1.mkv", "x/y.z/n", "-1", "-1-1"]
    wanted = [rng.choice(pool[: rng.choice([2, 5, 14])]) for _ in range(60)]
    there = rng.sample([*pool, "a-4.mp4", "a-5.mp4", "b-2", "q"], 6) if seed % 2 else []
    df = spark.createDataFrame([(i, n) for i, n in enumerate(wanted)] + [(99, None)], "i int, name string").repartition(5)
    disk = spark.createDataFrame([(n,) for n in there] + [(None,)], "path string") if there else None
    out = naming.unique_names_spread(df, "name", ["i"], taken=disk)
    assert out.columns == ["i", "name", "unique_name"]
    assert [r.unique_name for r in out.orderBy("i").collect()] == [*brute_names(wanted, there), None]


def test_long_runs_take_few_rounds(spark):
    """Hundreds of numbered names before, beside and on disk are passed at once."""
    wanted = [f"a-{k}" for k in range(1, 200)] + ["a"] * 300 + ["a-350", "a-201"] + ["a"] * 5
    there = [f"a-{k}" for k in range(150, 320)]
    df = spark.createDataFrame(list(enumerate(wanted)), "i int, name string")
    rounds = []
    whole = naming._held
    naming._held = lambda *args: rounds.append(1) or whole(*args)
    try:
        found = naming.unique_names_spread(df, "name", ["i"], taken=spark.createDataFrame([(n,) for n in there], "n string")).orderBy("i").collect()
    finally:
        naming._held = whole
    assert [r.unique_name for r in found] == brute_names(wanted, there) and len(rounds) < 12


def test_one_family_in_many_ranges(spark):
    df = spark.range(5000).selectExpr("id", "'clip.mp4' as name").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert naming._ranked(df, "name", ["id"]).select("_part").distinct().count() == 4
        found = naming.unique_names_spread(df, "name", ["id"])
        assert found.filter("unique_name = if(id = 0, 'clip.mp4', concat('clip-', id, '.mp4'))").count() == 5000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    found = naming.unique_names_spread(df, "name", ["id"])
    assert found.filter("unique_name = if(id = 0, 'clip.mp4', concat('clip-', id, '.mp4'))").count() == 5000
    assert naming.unique_names_spread(df.limit(0), "name", ["id"]).isEmpty()
