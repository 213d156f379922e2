"""Operators on small hand-made sequences."""

import pytest
from pyspark.sql import functions as F

from seqengine.functions import metrics, names, rates
from seqengine.operators import blur, cuts, dedup, normalise, quality, resample, smooth, windows
from seqengine.operators.clips import recurrent, with_position
from seqengine.plans.spec import Pipeline
from seqengine.sources import readers, writers


def clip(spark, values, name=1):
    return spark.createDataFrame([(name, i + 1, None if v is None else float(v)) for i, v in enumerate(values)], "c int, pos long, value double")


def values(df, *columns, order="pos"):
    rows = [tuple(r[c] for c in columns) for r in df.orderBy(order).collect()]
    return [r[0] for r in rows] if len(columns) == 1 else rows


def test_reference_advances_only_on_keep(spark):
    drift = clip(spark, [0, 3, 6, 9])  # each close to the one before, not to the kept one
    assert values(dedup.mark_repeats(drift, "c", ["pos"], "value", "mad", 5), "kept") == [True, False, True, False]
    same = clip(spark, [0.5, 0.5, 0.5])
    assert values(dedup.mark_repeats(same, "c", ["pos"], "value", "mse", 10), "kept") == [True, False, False]
    # strict: a distance at the threshold is no repetition
    assert values(dedup.mark_repeats(clip(spark, [0, 5]), "c", ["pos"], "value", "mse", 25), "kept") == [True, True]
    assert values(dedup.mark_repeats(clip(spark, [1, None, 1]), "c", ["pos"], "value", "mse", 1), "kept") == [True, False, False]
    with pytest.raises(ValueError):
        dedup.mark_repeats(same, "c", ["pos"], "value", "sim", 1)


def test_dedup_by_clip_over_vectors(spark):
    rows = spark.createDataFrame([(1, 1, [0.0, 1.0]), (1, 2, [0.0, 1.0]), (2, 1, [0.0, 1.0]), (2, 2, [1.0, 0.0])], "c int, pos long, v array<double>")
    marked = dedup.mark_repeats(rows, "c", ["pos"], "v", "ssim", 0.9)
    assert sorted((r.c, r.pos) for r in marked.filter("kept").collect()) == [(1, 1), (2, 1), (2, 2)]


def test_positions_by_bucket(spark):
    rows = spark.createDataFrame([(c, t * 1.7 % 13) for c in (1, 2) for t in range(40)], "c int, t double").distinct()
    plain = with_position(rows, "c", ["t"])
    spread = with_position(rows, "c", ["t"], bucket=F.floor(F.col("t") / 3))
    assert {tuple(r) for r in spread.select("c", "t", "pos").collect()} == {tuple(r) for r in plain.collect()}


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_spread_dedup_equals_the_fold(spark, size):
    steps = [(i * 37 % 11) * 0.6 + i * 0.4 for i in range(60)] + [5.0] * 20
    rows = clip(spark, steps).union(clip(spark, [1, None, 1, 2, 9], name=2))
    whole = dedup.mark_repeats(rows, "c", ["pos"], "value", "mad", 2.5).collect()
    spread = dedup.mark_repeats_spread(rows, "c", "pos", "value", "mad", 2.5, rows_per_chunk=size).collect()
    assert {(r.c, r.pos, r.kept) for r in spread} == {(r.c, r.pos, r.kept) for r in whole} and len(spread) == 85


def test_dropped_rows_land_on_the_next_kept_one(spark):
    marked = dedup.mark_repeats(clip(spark, [0, 0, 0, 9, 9]), "c", ["pos"], "value", "mse", 1)
    assert values(dedup.keep_first_of_repeats(marked, "c"), "pos", "dups_before") == [(1, 0), (4, 2)]
    assert dedup.trailing_repeats(marked, "c").first()["trailing"] == 1
    assert dedup.drop_counts(marked, "c").first()[1:] == (5, 3, 2)


def test_cut_compares_with_the_row_before(spark):
    drift = clip(spark, [0, 3, 6, 90, 91])
    marked = cuts.mark_cuts(drift, "c", ["pos"], "value", "squared", 25)
    assert values(marked, "is_cut") == [False, False, False, True, False]
    shots = cuts.with_shots(marked, "c", ["pos"])
    assert values(shots, "shot_id") == [0, 0, 0, 1, 1]
    assert values(windows.with_successor(shots, "c", "pos", "value"), "successor") == [3, 6, None, 91, None]
    assert values(cuts.cut_seconds(marked, "c", F.lit(2.0)), "cut_sec", order="cut_sec") == [1.5]


def test_rising_edge_and_adaptive(spark):
    rows = clip(spark, [9, 9, 0, 9, 9])
    assert values(cuts.rising_edges(rows, "c", ["pos"], F.col("value") > 5), "is_cut") == [False, False, False, True, False]
    jump = clip(spark, [0, 1, 2, 3, 50, 51, 52])
    assert values(cuts.adaptive_cuts(jump, "c", ["pos"], "value", 3, 5), "is_cut").index(True) == 4


def test_overlapping_windows_answer_once(spark):
    rows = clip(spark, range(230))
    spread = cuts.overlapping_windows(rows, "c")
    assert spread.filter("core").groupBy("pos").count().filter("count <> 1").isEmpty()
    assert spread.filter("core").count() == 230
    assert spread.filter("place < 0 or place >= 100").isEmpty()


def plan(spark, prev, cur, n, d):
    rows = spark.createDataFrame([(1, prev), (1, cur)], "c int, pos long")
    return [r.t for r in resample.gap_plan(rows, "c", "pos", n, d).orderBy("slot").collect()]


def test_gap_plan(spark):
    assert plan(spark, 0, 2, 2, 1) == [0.25, 0.5, 0.75]
    assert plan(spark, 3, 6, 2, 1) == pytest.approx([k / 6 for k in range(1, 6)])
    assert plan(spark, 0, 2, 3, 1) == pytest.approx([k / 6 for k in range(1, 6)])
    assert plan(spark, 0, 2, 5, 2) == pytest.approx([0.2, 0.4, 0.6, 0.8])
    assert plan(spark, 0, 1, 1, 1) == [] and plan(spark, 0, 4, 1, 1) == [0.25, 0.5, 0.75]


@pytest.mark.parametrize(("span", "factor", "old"), [(2, 2, 2), (3, 2, 4), (6, 2, 10), (12, 2, 22), (2, 3, 3), (4, 4, 12), (1, 2, 0)])
def test_cut_split(spark, span, factor, old):
    split = spark.range(1).select(resample.hold_before_cut(F.lit(0), F.lit(span), factor, 1).alias("k")).first()["k"]
    assert split == old and span * factor - 1 - old == factor - 1


@pytest.mark.parametrize(("n", "d"), [(2, 1), (5, 2), (3, 1), (1, 1)])
def test_every_slot_once(spark, n, d):
    marked = dedup.mark_repeats(clip(spark, [0, 0, 5, 5, 5, 9, 20, 20]), "c", ["pos"], "value", "mse", 1)
    out = resample.interpolate(marked.filter("kept"), "c", "pos", "value", n, d, tail=dedup.trailing_repeats(marked, "c"))
    slots = values(out, "slot", order="slot")
    assert slots == list(range(n // d, 8 * n // d + 1))


def test_holds(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, False), (1, 4, 10.0, True), (1, 5, 20.0, False)], "c int, pos long, value double, is_cut boolean")
    out = resample.interpolate(rows, "c", "pos", "value", 2, 1, cut="is_cut")
    assert values(out, "slot", "kind", "value", order="slot") == [(2, "real", 0), (3, "hold_prev", 0), (4, "hold_prev", 0), (5, "hold_prev", 0), (6, "hold_prev", 0), (7, "hold_cur", 10), (8, "real", 10), (9, "interp", 15), (10, "real", 20)]
    capped = resample.interpolate(rows, "c", "pos", "value", 2, 1, max_span=2)
    assert [r[1] for r in values(capped, "slot", "kind", order="slot")].count("hold_prev") == 5
    same = resample.interpolate(rows, "c", "pos", "value", 2, 1, max_span=3)
    assert same.filter("kind = 'hold_prev'").isEmpty()


def test_pipeline(spark):
    rows = clip(spark, [0, 0, 5, 5, 9])
    out = Pipeline("c", ("pos",), "value", smooth_dedup=True, dedup="mse", dedup_sens=1.0, factor=2.0).run(rows)
    assert values(out, "slot", order="slot") == list(range(2, 11))
    trimmed = Pipeline("c", ("pos",), "value", in_sec=1.0, out_sec=3.0, fps=1.0).run(rows)
    assert values(trimmed, "value") == [0, 5]


def test_blur(spark):
    rows = clip(spark, [0, 8, 0])
    out = values(blur.blur(rows, "c", "pos", "value", 8, 180.0, "equal", out="b"), "b")
    assert out[0] == 0 and out[2] == 0 and out[1] == pytest.approx((6 + 7 + 8 + 7 + 6) / 5)
    still = values(blur.blur(clip(spark, [0.5] * 3), "c", "pos", "value", gamma=2.2, out="b"), "b")
    assert still == pytest.approx([0.5] * 3)
    assert values(blur.blur(rows, "c", "pos", "value", 8, 0.0, out="b"), "b") == [0, 8, 0]


def test_mask(spark):
    row = spark.range(1).select(blur.masked(F.lit(1.0), F.lit(3.0), F.lit(0.5)).alias("h"), blur.masked(F.lit(1.0), F.lit(3.0), F.lit(0.0)).alias("z"), blur.mask_weight(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("w")).first()
    assert tuple(row) == (2.0, 1.0, 0.0)


def test_moving_average(spark):
    out = values(smooth.moving_average(clip(spark, [0, 3, 6]), "c", "pos", "value", 1, "m"), "m")
    assert out == pytest.approx([1, 3, 5])
    assert values(smooth.moving_average(clip(spark, [0, 3]), "c", "pos", "value", 1, "m"), "m") == [0, 3]


def test_normalise(spark):
    rows = spark.createDataFrame([(1, [0.0, 5.0, 10.0]), (2, [float("nan")] * 2), (3, [])], "k int, v array<double>")
    out = {r.k: r.normalised for r in normalise.normalise_rows(rows, "v", 0.0, 1.0).collect()}
    assert out == {1: [0.0, 0.5, 1.0], 2: [0.0, 0.0], 3: []}
    assert rows.select(normalise.median(F.col("v")).alias("m")).first()["m"] == 5.0


def test_metrics(spark):
    a, b = F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0))
    row = spark.range(1).select(metrics.mse(a, b), metrics.mad(a, b), metrics.ssim(a, a), metrics.psnr(F.lit(0.0)), metrics.cosine(a, b)).first()
    assert tuple(row) == pytest.approx((0.5, 0.5, 1.0, 99.0, 0.5**0.5))


def test_rates(spark):
    clips = spark.createDataFrame(
        [(1, 24000, 1001, 24000, 1001, False, None), (2, 30, 1, 24, 1, False, None), (3, 30, 1, 29, 1, True, None), (4, 30, 0, 0, 0, False, 25.0), (5, 0, 0, 0, 0, False, None)],
        "k int, fps_num long, fps_den long, avg_num long, avg_den long, is_vfr boolean, fps double",
    )
    more = clips.selectExpr("*", "cast(null as bigint) nb_frames", "10d duration", "1920 width", "1080 height", "'FFV1' codec", "'yuv420p' pix_fmt")
    out = {r.k: r for r in readers.probe(more).collect()}
    assert [out[k].source_fps for k in range(1, 6)] == pytest.approx([24000 / 1001, 24, 29, 25, 1])
    assert out[4].total_frames == 250 and not out[1].hardware and out[1].aspect_ratio == 1.78
    scale = spark.createDataFrame([(1.0,), (0.0,), (0.6,)], "s double").select(rates.dynamic_scale(F.col("s")).alias("x")).collect()
    assert [r.x for r in scale] == [2.0, 0.5, 1.0]
    row = spark.range(1).select(rates.trim_start(F.lit(10.0), 0.25), rates.trim_end(F.lit(10.0), 0.25, 0.26), rates.pad_to(F.lit(13), F.lit(8)), rates.even_size(F.lit(101), 0.5)).first()
    assert tuple(row) == (2, 3, 3, 50)


def test_names(spark):
    df = spark.createDataFrame([(1, "a.mp4"), (2, "a.mp4"), (3, "b")], "k int, n string")
    assert [r.unique_name for r in names.unique_names(df, "n", ["k"]).orderBy("k").collect()] == ["a.mp4", "a-1.mp4", "b"]
    many = ["a.mp4", "a.mp4", "a-1.mp4", "a-1.mp4", "x/a.mp4", "a", "a", "a-1", None, "a.mp4", "v1.2/b", "v1.2/b", "a-1-1.mp4"]
    df = spark.createDataFrame(list(enumerate(many)), "k int, n string").repartition(4)
    found = [r.unique_name for r in names.unique_names(df, "n", ["k"]).orderBy("k").collect()]
    assert found == ["a.mp4", "a-1.mp4", "a-1-1.mp4", "a-1-2.mp4", "x/a.mp4", "a", "a-1", "a-1-1", None, "a-2.mp4", "v1.2/b", "v1.2/b-1", "a-1-1-1.mp4"]
    safe = spark.createDataFrame([("a b<c>:d\t",)], "n string").select(names.safe_name(F.col("n")).alias("s")).first().s
    assert safe == "a b_c__d_"
    listed = spark.createDataFrame([(" 0a.mp4 ; b.mp4;; 1c ",)], "l string")
    assert [r.path for r in readers.split_inputs(listed, "l").collect()] == ["0a.mp4", "b.mp4", "1c"]
    paths = spark.createDataFrame([(f"x/f{i:04d}.png",) for i in (1, 2, 4)] + [(f"y/g{i}.PNG",) for i in (1, 2)], "path string")
    assert {r.prefix: r.whole for r in readers.image_sequences(paths).collect()} == {"x/f": False, "y/g": True}
    row = spark.range(1).select(names.parse_size(F.lit("1280x720"))[1].alias("h"), names.parse_size(F.lit("1280"))[0].alias("w"), names.truncated(F.lit("a" * 99)).alias("t"), names.human_size(F.lit(1536)).alias("s")).first()
    assert row.h == 720 and row.w is None and len(row.t) == 60 and row.s == "1.5 KB"
    urls = spark.createDataFrame([("https://www.youtube.com/watch?v=1",), ("https://notyoutube.com/x",)], "u string")
    assert [r.ok for r in urls.select(readers.is_video_url("u").alias("ok")).collect()] == [True, False]


def test_quality(spark):
    numbers = spark.createDataFrame([(1, 1), (1, 4), (2, 7)], "g int, n int")
    assert sorted(r.missing for r in quality.missing_numbers(numbers, "g", "n").collect()) == [2, 3]
    rows = clip(spark, range(100)).withColumn("pos", F.col("pos") - 1)
    assert quality.even_samples(rows, "c", "pos", 30).count() == 30
    same = quality.clip_quality(rows, rows, "c", "pos", "value").first()
    assert (same.samples, same.mse, same.psnr) == (30, 0.0, 99.0)
    points = spark.createDataFrame([(1, 1.0, 1.0, 5.0), (1, 2.0, 2.0, 9.0), (1, 50.0, 50.0, 1.0), (1, 8.0, 2.0, 7.0), (2, 2.0, 2.0, 3.0)], "c int, x double, y double, s double")
    assert sorted(r.s for r in quality.suppress(points, "c", "x", "y", "s", 5).collect()) == [1.0, 3.0, 7.0, 9.0]
    values = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 40, 41, 45)] + [(None,)], "v double")
    assert [r.cluster for r in quality.two_clusters(values, "v").orderBy("v").collect()] == [None, 0, 0, 0, 1, 1, 1]


def test_sinks(spark, tmp_path):
    rows = clip(spark, [1, 2, 3])
    assert writers.write_clips(rows, f"{tmp_path}/clips", "c", ["pos"]) == 3
    assert spark.read.parquet(f"{tmp_path}/clips").count() == 3
    with pytest.raises(RuntimeError):
        writers.write_checked(rows, f"{tmp_path}/short", expected=4)
    writers.write_cut_list(spark.createDataFrame([(2.5,), (1.0,)], "cut_sec double"), f"{tmp_path}/cuts")
    assert [r.value for r in spark.read.text(f"{tmp_path}/cuts").collect()] == ["1.0", "2.5"]
    (tmp_path / "list.txt").write_text("\"a.mp4\"\n\n b.mp4 \n")
    assert [r.path for r in readers.path_list(spark, str(tmp_path / "list.txt")).collect()] == ["a.mp4", "b.mp4"]


def test_null_clips_are_one_clip(spark):
    rows = spark.createDataFrame([(None, 1, 1.0), (None, 2, 1.0), (1.5, 1, 1.0), (None, 3, 9.0), (float("nan"), 1, 4.0), (float("nan"), 2, 4.0)], "c double, pos int, value double")
    kept = dedup.mark_repeats(rows.filter("not isnan(c) or c is null"), "c", ["pos"], "value", "mse", 1.0)
    assert {(r.c, r.pos): r.kept for r in kept.collect()} == {(None, 1): True, (None, 2): False, (None, 3): True, (1.5, 1): True}


def test_numbers_are_cut_by_mse_only(spark):
    rows = clip(spark, [1, 2, 90])
    with pytest.raises(ValueError, match="ssim"):
        Pipeline("c", ("pos",), "value", interpolate=True, scene_change="ssim").run(rows)
    assert Pipeline("c", ("pos",), "value", smooth_dedup=True).normalised().dedup == "ssim"


def test_scaling_and_interpolation_commute(spark):
    """INT12: a pointwise linear kernel may come before or after resampling."""
    rows = clip(spark, [3, 7, 1, 12])
    first = resample.interpolate(rows.withColumn("value", F.col("value") * 2 + 1), "c", "pos", "value", 5, 2)
    last = resample.interpolate(rows, "c", "pos", "value", 5, 2).withColumn("value", F.col("value") * 2 + 1)
    as_set = lambda df: {(r.slot, r.kind, round(r.value, 9)) for r in df.collect()}
    assert as_set(first) == as_set(last)


def test_recurrent_resets(spark):
    rows = clip(spark, [1, 2, 3, 4]).withColumn("anew", F.col("pos") == 3)
    out = recurrent(rows, "c", ["pos"], "value", lambda s, x: ((s or 0) + x, float((s or 0) + x)), "total", reset="anew")
    assert [r.total for r in out.orderBy("pos").collect()] == [1, 3, 3, 7]
