"""Progress of streams, names beside those on disk, closest names, robust lines by group, jobs' options."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqengine.functions import names
from seqengine.functions.weights import shared_samples
from seqengine.operators import normalise, resample
from seqengine.plans import spec
from seqengine.sources import readers
from seqengine.streaming import processors, progress


def test_progress_of_two_queries(spark, tmp_path):
    spark.range(30).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    with progress.watching(spark) as seen:
        for name in ("plain", "with_measures"):
            rows = progress.measured(stream, "m", low=F.min("id"), high=F.max("id")) if name == "with_measures" else stream
            query = rows.writeStream.format("noop").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
            query.awaitTermination()
            assert seen.wait(query)
        found = seen.table(spark).collect()
    assert [(r.rows, r.measure) for r in found if r.query == "plain"] == [(30, None)]
    assert {(r.measure, r.value) for r in found if r.query == "with_measures"} == {("m.low", 0.0), ("m.high", 29.0)}
    assert progress.Progress().table(spark).isEmpty()


def brute_names(wanted, there):
    taken, out = set(there), []
    for one in wanted:
        free, k = one, 0
        dot = one.rfind(".", one.rfind("/") + 1)
        root, ext = (one[:dot], one[dot:]) if dot >= 0 else (one, "")
        while free in taken:
            k += 1
            free = f"{root}-{k}{ext}"
        taken.add(free)
        out.append(free)
    return out


def test_names_on_disk_are_taken(spark):
    wanted = ["a.mp4", "a.mp4", "a-1.mp4", "b.mkv", "a.mp4", "c", "c", "a-1.mp4", "d.mp4"]
    there = ["a.mp4", "a-2.mp4", "c-1", "z.mp4", "a.mp4", "a.mkv"]
    df = spark.createDataFrame(list(enumerate(wanted)), "i int, name string").withColumn("path", F.lit("x"))
    disk = spark.createDataFrame([(n,) for n in there] + [(None,)], "path string")
    out = names.unique_names(df, "name", ["i"], taken=disk)
    assert out.columns == ["i", "name", "path", "unique_name"]
    assert [r.unique_name for r in out.orderBy("i").collect()] == brute_names(wanted, there)
    assert [r.unique_name for r in names.unique_names(df, "name", ["i"]).orderBy("i").collect()] == brute_names(wanted, [])
    assert [r.unique_name for r in names.unique_names(df, "name", ["i"], taken=disk.limit(0)).orderBy("i").collect()] == brute_names(wanted, [])


def test_closest_by_ratio(spark):
    words = ["interpolate_metod", "zzz", None, "dedup", "interpolate_metod"]
    choices = ["interpolate_method", "interpolate_factor", "dedup", "dedup_method", "upscale"]
    found = {}
    for r in names.closest_by_ratio(spark.createDataFrame([(w,) for w in words], "w string"), "w", choices).orderBy("w", "rank").collect():
        found.setdefault(r.w, []).append(r.choice)
    assert found == {w: near for w in set(words) - {None} if (near := names.suggest(w, choices))} and "zzz" not in found


def test_robust_lines_by_group(spark):
    rng, rows, lines = np.random.default_rng(6), [], {}
    for g in range(4):
        x = rng.random(60)
        y = (g - 1.5) * x + g + rng.normal(0, 0.02, 60)
        y[:9] += 3
        lines[g] = normalise.robust_line(x, y)
        rows += [(g, float(a), float(b)) for a, b in zip(x, y, strict=True)]
    rows += [(0, None, 1.0), (1, 1.0, None), (9, 2.0, 5.0), (9, 2.0, 7.0)]
    found = {r.g: (r.n, r.scale, r["shift"]) for r in normalise.robust_lines(spark.createDataFrame(rows, "g int, x double, y double"), "g", "x", "y").collect()}
    for g, line in lines.items():
        assert found[g][0] == 60 and found[g][1:] == pytest.approx(line, abs=1e-9)
    assert found[9][:2] == (2, None)


def test_jobs(spark):
    df = spark.createDataFrame([(m, s) for m in ("ssim", "SSIM-cuda", "mse", "vmaf", "flownets", "other") for s in (0, 35, 100)], "m string, s int")
    dedup_at, cut_at = spec.job_thresholds(F.col("m"), F.col("s"))
    for r in df.select("m", "s", dedup_at.alias("d"), cut_at.alias("c")).collect():
        assert (r.d, r.c) == pytest.approx((spec.dedup_threshold(r.m.lower(), r.s), spec.cut_threshold(r.m.lower(), r.s)))
    rows = spark.createDataFrame([('{"k": 3, "more": [1]}',), ("no",), (None,), ("{}",)], "t string")
    assert [r.o and r.o.k for r in rows.select(spec.job_options(F.col("t"), "k int").alias("o")).collect()] == [3, None, None, None]
    found = spark.range(5).select(resample.ladder(F.col("id").cast("int")).alias("t")).collect()
    assert [len(r.t) for r in found] == [0, 1, 2, 3, 4] and found[3].t == pytest.approx([0.25, 0.5, 0.75]) and found[2].t == pytest.approx(spark.range(1).select(resample.ladder(2).alias("t")).first().t)
    assert shared_samples(8, 180.0) == pytest.approx([0.125, 0.25, 0.75, 0.875]) and shared_samples(4, 360.0) == pytest.approx([0.25, 0.5, 0.75]) and shared_samples(4, 0.0) == []


def test_path_lists(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.mp4\n\n  'b c.mp4' \t\n\"d.mp4\"\n\t \n")
    assert sorted(r.path for r in readers.path_list(spark, str(tmp_path / "list.txt")).collect()) == ["a.mp4", "b c.mp4", "d.mp4"]


def test_stop_within(spark):
    rates = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    query = processors.sample_by_clock(rates, lambda rows: None, "1 second", f"{processors.scratch_folder(spark, 'rate')}/state")
    assert processors.stop_within(query, 20) and not query.isActive


def test_defaults_and_implied_capabilities(spark):
    assert spec.with_implied({"upscale_factor": 2}) == {"upscale_factor": 2, "upscale": True}
    everything = spec.DEFAULTS | {"dedup_sens": 20.0, "resize": False, "resize_factor": 3, "upscale": False}
    out = spec.with_implied(everything, given=set())
    assert {k for k, v in out.items() if v is True} == {"dedup", "resize"} and out["upscale"] is False
    assert not spec.with_implied(everything, given={"resize"})["resize"]
    assert set(spec.DEFAULTS) == set(spec.IMPLIES)
    jobs = ['{"upscale_factor": 3, "upscale": false, "dedup": true, "x": 1}', '{"moblur_factor": 8, "moblur_strength": "equal", "resize": "TRUE"}', "{}", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(jobs)], "i int, t string").select("i", spec.job_options(F.col("t"), "map<string, string>").alias("o"))
    found = rows.select("i", spec.job_capabilities(F.col("o")).alias("c"), spec.unknown_options(F.col("o"), [*spec.IMPLIES, *spec.IMPLIES.values()]).alias("u")).orderBy("i").collect()
    assert [(r.c, r.u) for r in found] == [(["dedup"], ["x"]), (["moblur", "resize"], []), ([], []), (None, None)]


def test_sequences_with_holes(spark):
    paths = [f"run/a_{n:04d}.PNG" for n in (3, 4, 5)] + [f"b{n}.png" for n in (1, 40, 42)] + ["c7.jpg", "none.png", "a_0003.png", "run/a_0004.PNG"]
    found = {(r.prefix, r.ext): r for r in readers.image_sequences(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    whole = found["run/a_", "png"]
    assert (whole.n, whole.low, whole.high, whole.whole, whole.pattern, whole.missing) == (3, 3, 5, True, "run/a_%04d.png", [])
    assert found["b", "png"].missing == list(range(2, 12)) and found["b", "png"].pattern is None
    assert not found["c", "jpg"].whole and found["a_", "png"].n == 1 and len(found) == 4


def test_blends_by_name(spark):
    t = F.col("t")
    rows = spark.createDataFrame([(0.25,), (0.5,), (0.75,)], "t double")
    found = {m: [r.x for r in rows.select(resample.blended(m, F.lit(10.0), F.lit(20.0), t).alias("x")).collect()] for m in resample.BLENDS}
    assert found == {"linear": [12.5, 15.0, 17.5], "hold": [10.0] * 3, "nearest": [10.0, 20.0, 20.0], "smooth": [11.5625, 15.0, 18.4375]}
    assert rows.select(resample.blended("nearest", F.array(F.lit(1.0)), F.array(F.lit(2.0)), t, True).alias("x")).first().x == [1.0]
    with pytest.raises(ValueError, match="unknown interpolation"):
        resample.blended("no", t, t, t)
    resample.register_blend("twice")(lambda a, b, t: 2 * a)
    try:
        assert rows.select(resample.blended("twice", F.lit(4.0), t, t).alias("x")).first().x == 8
    finally:
        del resample.BLENDS["twice"]


def test_linear_projections_commute(spark):
    df = spark.createDataFrame([(1, i, [float(i % 3), float(i * i)]) for i in range(1, 9)], "c int, pos long, v array<double>")
    made = [resample.interpolate_around(df, "c", "pos", "v", 5, 2, lambda v: F.concat(v, F.transform(v, lambda x: 2 * x)), first).collect() for first in (True, False)]
    assert sorted((r.slot, [round(x, 9) for x in r.value]) for r in made[0]) == sorted((r.slot, [round(x, 9) for x in r.value]) for r in made[1])


def test_colours(spark):
    cases = [("bt709", "yuv420p", "bt709"), ("unknown", "yuv420p", "bt2020c"), ("bt2020nc", None, "smpte2084"), ("bt2020", None, None), (None, "bt2020", "gamma")]
    df = spark.createDataFrame(cases, "s string, p string, t string")
    found = [tuple(r.c) for r in df.select(names.colour_conversion(F.col("s"), F.col("p"), F.col("t")).alias("c")).collect()]
    assert found == [("bt709", "bt709", "bt709"), ("bt2020nc", "bt2020", None), ("bt2020nc", "bt2020", "smpte2084"), ("bt2020nc", "bt2020", None), ("bt2020nc", "bt2020", None)]
