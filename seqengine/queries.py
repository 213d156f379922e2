"""Registered queries of the sequence operators over the test tables, with SQL for each that SQL can express.

`events` are scalar sequences by user, `embeddings` sequences of vectors by label,
`lineitem` and `orders` ledgers. Every query reads its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics, names, rates
from .functions.weights import blend_weights, shutter_samples
from .operators import blur, cuts, dedup, detections, kernels, motion, normalise, quality, resample, smooth, windows
from .operators.clips import ordered, with_position
from .plans.spec import Pipeline
from .sources import readers
from .streaming import event_time, processors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CUT = 2500.0


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, event_id, value, pos."""
    rows = readers.signal(spark, f"{sf}/events.parquet", "user_id", ["ts", "event_id"], "value")
    return with_position(rows, "user_id", ["ts", "event_id"]).drop("ts")


def thumbs(spark: SparkSession, sf: str) -> DataFrame:
    """label, vec_id, vec (64 values scaled to [0, 1] by the logistic function), pos."""
    rows = readers.vectors(spark, f"{sf}/embeddings.parquet", "label", ["vec_id"], "embedding")
    return with_position(rows.withColumn("vec", F.transform("vec", metrics.sigmoid)), "label", ["vec_id"])


P = "p AS (SELECT user_id, event_id, CAST(value AS DOUBLE) AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"
V = "v AS (SELECT label, vec_id, list_transform(embedding, lambda x: 1 / (1 + exp(-CAST(x AS DOUBLE)))) AS vec, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings)"


def _fold_sql(repeat: str) -> str:
    """p, and r with `kept`, by walking each clip row by row; repeat compares p.value with r.ref."""
    return f"""WITH RECURSIVE {P}, r AS (
  SELECT user_id, event_id, pos, value, value AS ref, TRUE AS kept FROM p WHERE pos = 1
  UNION ALL
  SELECT p.user_id, p.event_id, p.pos, p.value, CASE WHEN {repeat} THEN r.ref ELSE p.value END, NOT ({repeat}) FROM r JOIN p ON p.user_id = r.user_id AND p.pos = r.pos + 1
)"""


MSE25 = _fold_sql("(p.value - r.ref) * (p.value - r.ref) < 25")
KEPT = f"{MSE25}, k AS (SELECT user_id, event_id, pos, value, pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) - 1 AS gap FROM r WHERE kept)"


def _vector_fold_sql(repeat: str) -> str:
    return f"""WITH RECURSIVE {V}, r AS (
  SELECT label, vec_id, pos, vec AS ref, TRUE AS kept FROM v WHERE pos = 1
  UNION ALL
  SELECT v.label, v.vec_id, v.pos, CASE WHEN {repeat} THEN r.ref ELSE v.vec END, NOT ({repeat}) FROM r JOIN v ON v.label = r.label AND v.pos = r.pos + 1
) SELECT label, vec_id, kept FROM r"""


def _ssim_sql(a: str, b: str) -> str:
    ma, mb = f"list_avg({a})", f"list_avg({b})"
    va = f"(list_sum(list_transform({a}, lambda x: x * x)) / len({a}) - {ma} * {ma})"
    vb = f"(list_sum(list_transform({b}, lambda x: x * x)) / len({b}) - {mb} * {mb})"
    cov = f"(list_dot_product({a}, {b}) / len({a}) - {ma} * {mb})"
    return f"((2 * {ma} * {mb} + 0.0001) * (2 * {cov} + 0.0009) / (({ma} * {ma} + {mb} * {mb} + 0.0001) * ({va} + {vb} + 0.0009)))"


def _mse_sql(a: str, b: str) -> str:
    return f"((list_dot_product({a}, {a}) + list_dot_product({b}, {b}) - 2 * list_dot_product({a}, {b})) / len({a}))"


# --- greedy dedup -------------------------------------------------------------------------


def marked(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.mark_repeats(events(spark, sf), "user_id", ["pos"], "value", "mse", 25.0)


@query(f"{MSE25} SELECT user_id, event_id, pos, kept FROM r")
def dedup_mse_events(spark, sf):
    return marked(spark, sf).select("user_id", "event_id", "pos", "kept")


@query(_fold_sql("abs(p.value - r.ref) < 5") + " SELECT user_id, event_id, pos, kept FROM r")
def dedup_mad_events(spark, sf):
    return dedup.mark_repeats(events(spark, sf), "user_id", ["pos"], "value", "mad", 5.0).select("user_id", "event_id", "pos", "kept")


@query(_vector_fold_sql(_mse_sql("v.vec", "r.ref") + " < 0.0012"))
def dedup_mse_vectors(spark, sf):
    return dedup.mark_repeats(thumbs(spark, sf), "label", ["pos"], "vec", "mse", 0.0012).select("label", "vec_id", "kept")


@query(_vector_fold_sql(_ssim_sql("r.ref", "v.vec") + " >= 0.5"))
def dedup_ssim_vectors(spark, sf):
    return dedup.mark_repeats(thumbs(spark, sf), "label", ["pos"], "vec", "ssim", 0.5).select("label", "vec_id", "kept")


@query(f"{MSE25} SELECT user_id, count(*) AS consumed, count(*) FILTER (NOT kept) AS dropped, count(*) FILTER (kept) AS emitted FROM r GROUP BY user_id")
def dedup_counts(spark, sf):
    return dedup.drop_counts(marked(spark, sf), "user_id")


@query(f"{KEPT} SELECT user_id, event_id, pos, value, coalesce(gap, 0) AS dups_before FROM k")
def dups_before(spark, sf):
    return dedup.keep_first_of_repeats(marked(spark, sf), "user_id").select("user_id", "event_id", "pos", "value", "dups_before")


@query(f"{MSE25} SELECT user_id, max(pos) FILTER (kept) AS last_pos, max(pos) - max(pos) FILTER (kept) AS trailing FROM r GROUP BY user_id")
def trailing_repeats(spark, sf):
    return dedup.trailing_repeats(marked(spark, sf), "user_id")


# --- cuts ---------------------------------------------------------------------------------

C = f"{P}, c AS (SELECT *, coalesce((value - lag(value) OVER w) * (value - lag(value) OVER w) > {CUT}, FALSE) AS is_cut FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos))"


def cut_rows(spark: SparkSession, sf: str) -> DataFrame:
    return cuts.mark_cuts(events(spark, sf), "user_id", ["pos"], "value", "squared", CUT)


@query(f"WITH {C} SELECT user_id, event_id, is_cut FROM c")
def cut_mse_events(spark, sf):
    return cut_rows(spark, sf).select("user_id", "event_id", "is_cut")


@query(f"WITH {V}, l AS (SELECT *, lag(vec) OVER (PARTITION BY label ORDER BY pos) AS prev FROM v) SELECT label, vec_id, coalesce({_ssim_sql('prev', 'vec')} < 0.45, FALSE) AS is_cut FROM l")
def cut_ssim_vectors(spark, sf):
    return cuts.mark_cuts(thumbs(spark, sf), "label", ["pos"], "vec", "ssim", 0.45).select("label", "vec_id", "is_cut")


S = f"{C}, s AS (SELECT *, CAST(sum(CAST(is_cut AS INT)) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shot_id FROM c)"


@query(f"WITH {S} SELECT user_id, shot_id, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n_rows FROM s GROUP BY user_id, shot_id")
def shots(spark, sf):
    return cuts.shot_bounds(cuts.with_shots(cut_rows(spark, sf), "user_id", ["pos"]), "user_id")


@query(f"WITH {S} SELECT user_id, event_id, shot_id, CASE WHEN NOT lead(is_cut) OVER w THEN lead(value) OVER w END AS successor FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)")
def successor_within_shot(spark, sf):
    shot = cuts.with_shots(cut_rows(spark, sf), "user_id", ["pos"])
    return windows.with_successor(shot, "user_id", "pos", "value").select("user_id", "event_id", "shot_id", "successor")


@query(f"WITH {C} SELECT user_id, round(10.0 + (pos - 1) / 24.0, 6) AS cut_sec FROM c WHERE is_cut")
def autoclip_threshold(spark, sf):
    found = cuts.cut_seconds(cut_rows(spark, sf), "user_id", F.lit(24.0), start=10.0)
    return found.select("user_id", r6("cut_sec").alias("cut_sec"))


@query(
    f"""WITH {P}, d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) AS change FROM p),
n AS (SELECT *, (sum(change) OVER w - change) / (count(change) OVER w - 1) AS others FROM d WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT user_id, event_id, round(change / others, 6) AS ratio, coalesce(change / others >= 3 AND change >= 15, FALSE) AS is_cut FROM (SELECT user_id, event_id, change, CASE WHEN others > 0 THEN others END AS others FROM n)"""
)
def autoclip_adaptive(spark, sf):
    found = cuts.adaptive_cuts(events(spark, sf), "user_id", ["pos"], "value", 3.0, 15.0)
    return found.select("user_id", "event_id", r6("ratio").alias("ratio"), "is_cut")


@query(f"WITH {P} SELECT user_id, event_id, coalesce(value > 80 AND NOT (lag(value) OVER (PARTITION BY user_id ORDER BY pos) > 80), FALSE) AS is_cut FROM p")
def autoclip_rising_edge(spark, sf):
    return cuts.rising_edges(events(spark, sf), "user_id", ["pos"], F.col("value") > 80).select("user_id", "event_id", "is_cut")


@query(
    f"""WITH {P}, s AS (SELECT user_id, event_id, value, pos - 1 + 25 AS place FROM p), w AS (SELECT *, unnest(range(CASE WHEN place < 100 THEN 0 ELSE (place - 100) // 50 + 1 END, place // 50 + 1)) AS window_id FROM s)
SELECT user_id, window_id, count(*) AS n_rows, round(sum(value), 6) AS total, count(*) FILTER (place - window_id * 50 >= 25 AND place - window_id * 50 < 75) AS n_core FROM w GROUP BY user_id, window_id"""
)
def window_batches_100_50(spark, sf):
    spread = cuts.overlapping_windows(events(spark, sf), "user_id", 100, 50, 25)
    return spread.groupBy("user_id", "window_id").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum("value")).alias("total"), F.count_if("core").alias("n_core"))


# --- windows ------------------------------------------------------------------------------


@query(f"WITH {P} SELECT user_id, event_id, len(list(value) OVER w) AS n, round(sum(value) OVER w, 6) AS total FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING)")
def window_past_future(spark, sf):
    framed = windows.row_frame(events(spark, sf), "user_id", "pos", "value", 2, 3)
    total = F.aggregate("frame", F.lit(0.0), lambda a, x: a + x)
    return framed.select("user_id", "event_id", F.size("frame").cast("bigint").alias("n"), r6(total).alias("total"))


@query(f"WITH {P} SELECT user_id, event_id, lag(value, 2) OVER w AS before_2, lead(value, 3) OVER w AS after_3 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)")
def demand_windows(spark, sf):
    past, future = windows.chained_demand((1, 1), (1, 2))
    rows = events(spark, sf)
    return rows.select("user_id", "event_id", windows.at_offset("user_id", "pos", "value", -past).alias("before_2"), windows.at_offset("user_id", "pos", "value", future).alias("after_3"))


@query(
    f"""WITH {P}, w AS (SELECT user_id, event_id, pos, list(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS f, first_value(value) OVER (PARTITION BY user_id ORDER BY pos) AS a, nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY pos) AS b FROM p)
SELECT user_id, event_id, round(CASE WHEN pos > 8 THEN list_sum(f[3:]) + a + b ELSE list_sum(f) END, 6) AS total FROM w"""
)
def anchored_window(spark, sf):
    framed = windows.anchored_frame(events(spark, sf), "user_id", "pos", "value", 8)
    return framed.select("user_id", "event_id", r6(F.aggregate("frame", F.lit(0.0), lambda a, x: a + x)).alias("total"))


# --- resampling ---------------------------------------------------------------------------


def _gaps_sql(source: str, n: int, d: int, clip: str = "user_id") -> str:
    """g: a row for each slot between neighbouring rows of source (clip, pos, value)."""
    return f"""n AS (SELECT *, lag(pos) OVER (PARTITION BY {clip} ORDER BY pos) AS prev_pos, lag(value) OVER (PARTITION BY {clip} ORDER BY pos) AS prev_value FROM {source}),
g AS (SELECT *, (slot * {d} - prev_pos * {n}) / CAST({n} * (pos - prev_pos) AS DOUBLE) AS t FROM (SELECT *, unnest(range(prev_pos * {n} // {d} + 1, pos * {n} // {d})) AS slot FROM n WHERE prev_pos IS NOT NULL))"""


def _linear_sql(source: str, n: int, d: int) -> str:
    return f"""SELECT user_id, pos * {n} // {d} AS slot, 'real' AS kind, round(value, 6) AS value FROM {source}
UNION ALL SELECT user_id, slot, 'interp', round((1 - t) * prev_value + t * value, 6) FROM g"""


@query(f"WITH {P}, {_gaps_sql('p', 2, 1)} SELECT user_id, prev_pos, pos AS cur_pos, slot, round(t, 6) AS t FROM g")
def gap_plan_int(spark, sf):
    plan = resample.gap_plan(events(spark, sf), "user_id", "pos", *rates.rationalise(2.0))
    return plan.withColumn("t", r6("t"))


@query(f"WITH {P}, {_gaps_sql('p', 5, 2)} SELECT user_id, prev_pos, pos AS cur_pos, slot, round(t, 6) AS t FROM g")
def gap_plan_fractional(spark, sf):
    plan = resample.gap_plan(events(spark, sf), "user_id", "pos", *rates.rationalise(2.5))
    return plan.withColumn("t", r6("t"))


def _rounded(out: DataFrame) -> DataFrame:
    return out.withColumn("value", r6("value"))


@query(f"WITH {P}, {_gaps_sql('p', 2, 1)} {_linear_sql('p', 2, 1)}")
def interpolate_linear_2x(spark, sf):
    return _rounded(resample.interpolate(events(spark, sf), "user_id", "pos", "value", 2, 1))


@query(f"WITH {P}, {_gaps_sql('p', 5, 2)} {_linear_sql('p', 5, 2)}")
def interpolate_linear_2_5x(spark, sf):
    return _rounded(resample.interpolate(events(spark, sf), "user_id", "pos", "value", 5, 2))


@query(
    f"""WITH {V}, n AS (SELECT *, lag(vec) OVER (PARTITION BY label ORDER BY pos) AS prev FROM v)
SELECT label, 2 * pos AS slot, 'real' AS kind, round(list_sum(vec), 6) AS total FROM v
UNION ALL SELECT label, 2 * pos - 1, 'interp', round(0.5 * list_sum(prev) + 0.5 * list_sum(vec), 6) FROM n WHERE prev IS NOT NULL"""
)
def interpolate_vectors(spark, sf):
    out = resample.interpolate(thumbs(spark, sf), "label", "pos", "vec", 2, 1)
    return out.select("label", "slot", "kind", r6(F.aggregate("value", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(
    f"""WITH {P}, a AS (SELECT *, coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY pos), value) AS after FROM p), {_gaps_sql('a', 2, 1)}
SELECT user_id, slot, round(u, 6) AS t, round((1 - u) * (1 - u) * prev_value + 2 * u * (1 - u) * value + u * u * after, 6) AS value FROM (SELECT *, 0.5 + 0.5 * t - 0.0001 AS u FROM g)"""
)
def interpolate_lookahead(spark, sf):
    out = resample.look_ahead(events(spark, sf), "user_id", "pos", "value", 2, 1)
    return _rounded(out).withColumn("t", r6("t"))


@query(f"{KEPT}, q AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS pos FROM k), {_gaps_sql('q', 2, 1)} {_linear_sql('q', 2, 1)}")
def plain_dedup_interpolate(spark, sf):
    spec = Pipeline("user_id", ("pos",), "value", dedup="mse", dedup_sens=25.0, interpolate=True, factor=2.0)
    return _rounded(spec.run(events(spark, sf)))


TAIL = "SELECT user_id, unnest(range(last_pos * {n} // {d} + 1, (last_pos + dropped) * {n} // {d} + 1)) AS slot, 'tail' AS kind, round(value, 6) AS value FROM (SELECT user_id, max(pos) FILTER (kept) AS last_pos, max(pos) - max(pos) FILTER (kept) AS dropped, max_by(value, pos) FILTER (kept) AS value FROM r GROUP BY user_id)"


@query(f"{KEPT}, {_gaps_sql('k', 2, 1)} {_linear_sql('k', 2, 1)} UNION ALL {TAIL.format(n=2, d=1)}")
def smooth_dedup(spark, sf):
    return flagship(spark, sf)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Smooth dedup of events and interpolation at twice the rate, tails included."""
    rows = marked(spark, sf)
    kept = rows.filter("kept").select("user_id", "pos", "value")
    return _rounded(resample.interpolate(kept, "user_id", "pos", "value", 2, 1, tail=dedup.trailing_repeats(rows, "user_id")))


WIDE = _fold_sql("(p.value - r.ref) * (p.value - r.ref) < 900") + ", k AS (SELECT user_id, pos, value FROM r WHERE kept)"


@query(
    f"""{WIDE}, {_gaps_sql('k', 5, 2)} SELECT user_id, pos * 5 // 2 AS slot, 'real' AS kind, round(value, 6) AS value FROM k
UNION ALL SELECT user_id, slot, CASE WHEN pos - prev_pos > 2 THEN 'hold_prev' ELSE 'interp' END, round(CASE WHEN pos - prev_pos > 2 THEN prev_value ELSE (1 - t) * prev_value + t * value END, 6) FROM g"""
)
def smooth_dedup_capped(spark, sf):
    kept = dedup.mark_repeats(events(spark, sf), "user_id", ["pos"], "value", "mse", 900.0).filter("kept")
    return _rounded(resample.interpolate(kept, "user_id", "pos", "value", 5, 2, max_span=2))


@query(
    f"""{WIDE}, c AS (SELECT *, coalesce((value - lag(value) OVER w) * (value - lag(value) OVER w) > {CUT}, FALSE) AS is_cut FROM k WINDOW w AS (PARTITION BY user_id ORDER BY pos)), {_gaps_sql('c', 3, 1)},
h AS (SELECT *, slot - prev_pos * 3 <= greatest(0, (pos - 1) * 3 - prev_pos * 3) AS old FROM g)
SELECT user_id, pos * 3 AS slot, 'real' AS kind, round(value, 6) AS value FROM c
UNION ALL SELECT user_id, slot, CASE WHEN is_cut AND old THEN 'hold_prev' WHEN is_cut THEN 'hold_cur' ELSE 'interp' END, round(CASE WHEN is_cut AND old THEN prev_value WHEN is_cut THEN value ELSE (1 - t) * prev_value + t * value END, 6) FROM h"""
)
def cut_hold_split(spark, sf):
    kept = dedup.mark_repeats(events(spark, sf), "user_id", ["pos"], "value", "mse", 900.0).filter("kept")
    kept = cuts.mark_cuts(kept, "user_id", ["pos"], "value", "squared", CUT)
    return _rounded(resample.interpolate(kept, "user_id", "pos", "value", 3, 1, cut="is_cut"))


@query(f"WITH {P}, {_gaps_sql('p', 2, 1)}, o AS ({_linear_sql('p', 2, 1)}) SELECT user_id, slot, round(slot / 24.0, 6) AS slow_sec, round(slot / 48.0, 6) AS out_sec FROM o")
def slowmo_timeline(spark, sf):
    out = resample.interpolate(events(spark, sf), "user_id", "pos", "value", 2, 1)
    slow = resample.timeline(out, F.col("slot"), 24.0, 2.0, True).withColumnRenamed("out_sec", "slow_sec")
    both = resample.timeline(slow, F.col("slot"), 24.0, 2.0, False)
    return both.select("user_id", "slot", r6("slow_sec").alias("slow_sec"), r6("out_sec").alias("out_sec"))


@query(f"WITH {P} SELECT user_id, event_id, pos FROM p WHERE pos - 1 >= CAST(round_even(1.25 * 10, 0) AS BIGINT) AND pos - 1 < greatest(CAST(round_even(1.25 * 10, 0) AS BIGINT) + 1, CAST(round_even(3.45 * 10, 0) AS BIGINT))")
def trim_range(spark, sf):
    fps, at = F.lit(10.0), F.col("pos") - 1
    rates.check_trim(1.25, 3.45)
    return events(spark, sf).filter((at >= rates.trim_start(fps, 1.25)) & (at < rates.trim_end(fps, 1.25, 3.45))).select("user_id", "event_id", "pos")


@query(
    f"""WITH {P}, c AS (SELECT user_id, floor(value / 8) AS x0, floor(pos / 5.0) AS y0, value / 8 - floor(value / 8) AS fx, pos / 5.0 - floor(pos / 5.0) AS fy, value FROM p),
e AS (SELECT user_id, x0 + i AS cx, y0 + j AS cy, CASE WHEN i = 1 THEN fx ELSE 1 - fx END * CASE WHEN j = 1 THEN fy ELSE 1 - fy END AS w, value FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(i, j))
SELECT user_id, CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, round(sum(w * value), 10) AS total, round(sum(w), 10) AS weight FROM e GROUP BY ALL"""
)
def scatter_splat(spark, sf):
    out = resample.splat(events(spark, sf), "user_id", F.col("value") / 8, F.col("pos") / 5.0, F.col("value"))
    return out.select("user_id", "cx", "cy", F.round("total", 10).alias("total"), F.round("weight", 10).alias("weight"))


# --- metadata and names -------------------------------------------------------------------


@query("WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), s AS (SELECT l_orderkey, unnest(range(min(l_linenumber), max(l_linenumber) + 1)) AS missing FROM l GROUP BY l_orderkey) SELECT l_orderkey, CAST(missing AS INT) AS missing FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.l_orderkey = s.l_orderkey AND l.l_linenumber = s.missing)")
def sequence_gaps(spark, sf):
    return quality.missing_numbers(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query(
    r"""WITH n AS (SELECT p_partkey, regexp_replace(p_name, '[<>:"/\\|?*\x00-\x1F]', '_', 'g') || '-Size' || p_size || '.mp4' AS name FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN name ELSE left(name, length(name) - 4) || '-' || k || '.mp4' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) - 1 AS k FROM n)"""
)
def unique_output_names(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet")
    named = parts.select("p_partkey", names.output_name(F.col("p_name"), [("Size", F.col("p_size"))], "mp4").alias("name"))
    return names.unique_names(named, "name", ["p_partkey"]).select("p_partkey", "unique_name")


@query(
    """WITH c AS (SELECT o_orderkey, 24000 + o_orderkey % 7 * 1000 AS rn, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1001 END AS rd, 24000 + o_orderkey % 5 * 900 AS an, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 1000 END AS ad, o_orderkey % 3 = 0 AS vfr, CASE WHEN o_orderkey % 2 = 0 THEN 25.0 END AS f, o_totalprice / 1000 AS duration FROM orders),
r AS (SELECT *, CASE WHEN rn > 0 AND rd > 0 THEN CAST(rn AS DOUBLE) / rd END AS nominal, CASE WHEN an > 0 AND ad > 0 THEN CAST(an AS DOUBLE) / ad END AS average FROM c),
s AS (SELECT *, coalesce(CASE WHEN average IS NOT NULL AND (vfr OR coalesce(abs(nominal - average) > 0.01 * greatest(nominal, average), FALSE)) THEN average END, nominal, f, 1.0) AS fps FROM r)
SELECT o_orderkey, round(fps, 6) AS fps, CAST(trunc(duration * fps) AS BIGINT) AS total_frames FROM s"""
)
def fps_resolution(spark, sf):
    key = F.col("o_orderkey")
    clips = spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey",
        (24000 + key % 7 * 1000).alias("fps_num"),
        F.when(key % 11 == 0, 0).otherwise(1001).alias("fps_den"),
        (24000 + key % 5 * 900).alias("avg_num"),
        F.when(key % 13 == 0, 0).otherwise(1000).alias("avg_den"),
        (key % 3 == 0).alias("is_vfr"),
        F.when(key % 2 == 0, 25.0).alias("fps"),
        (F.col("o_totalprice") / 1000).alias("duration"),
        F.lit(0).cast("bigint").alias("nb_frames"),
        F.lit(1920).alias("width"),
        F.lit(1080).alias("height"),
        F.lit("h264").alias("codec"),
        F.lit("yuv420p").alias("pix_fmt"),
    )
    return readers.probe(clips).select("o_orderkey", r6("source_fps").alias("fps"), "total_frames")


# --- blur and masks -----------------------------------------------------------------------


def _blur_sql(scheme: str, gamma: bool = False) -> str:
    before, after = shutter_samples(8, 180.0)
    weights = blend_weights(len(before) + 1 + len(after), scheme)
    x = "(value / 500)" if gamma else "value"
    a, b, c = x.replace("value", "prev"), x, x.replace("value", "next")
    samples = [f"((1 - {t}) * {a} + {t} * {b})" for t in before] + [b] + [f"((1 - {t}) * {b} + {t} * {c})" for t in after]
    if gamma:
        total = "least(greatest(pow(" + " + ".join(f"CAST({w!r} AS DOUBLE) * pow(least(greatest({s}, 0.0), 1.0), 2.2)" for w, s in zip(weights, samples, strict=True)) + ", 1 / 2.2), 0.0), 1.0)"
    else:
        total = " + ".join(f"CAST({w!r} AS DOUBLE) * {s}" for w, s in zip(weights, samples, strict=True))
    return f"WITH {P}, n AS (SELECT *, lag(value) OVER w AS prev, lead(value) OVER w AS next FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)) SELECT user_id, event_id, round(CASE WHEN prev IS NULL OR next IS NULL THEN {x} ELSE {total} END, 6) AS blurred FROM n"


def _blurred(scheme: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf):
        out = blur.blur(events(spark, sf), "user_id", "pos", "value", 8, 180.0, scheme)
        return out.select("user_id", "event_id", r6("blurred").alias("blurred"))

    return run


for _name, _scheme in (("gaussian", "gaussian_sym"), ("equal", "equal"), ("pyramid", "pyramid"), ("ascending", "ascending"), ("descending", "descending")):
    QUERIES[f"motion_blur_{_name}"] = _blurred(_scheme)
    SQL[f"motion_blur_{_name}"] = _blur_sql(_scheme)


@query(_blur_sql("gaussian_sym", gamma=True))
def motion_blur_gamma(spark, sf):
    scaled = events(spark, sf).withColumn("value", F.col("value") / 500)
    return blur.blur(scaled, "user_id", "pos", "value", 8, 180.0, "gaussian_sym", gamma=2.2).select("user_id", "event_id", r6("blurred").alias("blurred"))


@query(
    f"""WITH {V}, m AS (SELECT vec AS weight FROM v WHERE vec_id = (SELECT min(vec_id) FROM v)), n AS (SELECT *, lag(vec) OVER (PARTITION BY label ORDER BY pos) AS prev FROM v)
SELECT label, vec_id, round(list_sum(list_transform(range(1, 65), lambda i: prev[i] + weight[i] * ((prev[i] + vec[i]) / 2 - prev[i]))), 6) AS total FROM n, m WHERE prev IS NOT NULL"""
)
def masked_interpolation(spark, sf):
    rows = thumbs(spark, sf)
    mask = rows.orderBy("vec_id").limit(1).select(F.col("vec").alias("weight"))
    gaps = resample.gaps(rows, "label", "pos", "vec").filter("prev_pos is not null")
    out = blur.with_mask(gaps, mask)
    middle = resample.blended("linear", F.col("prev_value"), F.col("vec"), F.lit(0.5), vector=True)
    blended = blur.masked_vectors(F.col("prev_value"), middle, F.col("weight"))
    return out.select("label", "vec_id", r6(F.aggregate(blended, F.lit(0.0), lambda a, x: a + x)).alias("total"))


# --- smoothing ----------------------------------------------------------------------------


def _motion(spark: SparkSession, sf: str) -> DataFrame:
    """Moves of each row: half the change of value, with a score from the value."""
    rows = events(spark, sf)
    moves = resample.gaps(rows, "user_id", "pos", "value").withColumn("dx", F.coalesce((F.col("value") - F.col("prev_value")) / 2, F.lit(0.0)))
    scored = smooth.scene_weight(moves, "user_id", "pos", 0.4 + (F.col("value") % 10) / 20)
    return smooth.trajectory(scored, "user_id", "pos", ["dx"])


T = f"""{P}, mv AS (SELECT *, coalesce((value - lag(value) OVER w) / 2, 0.0) AS dx, least(greatest(((0.4 + (value % 10) / 20) - 0.5) / 0.25, 0.0), 1.0) AS base, lag(pos) OVER w IS NULL OR lead(pos) OVER w IS NULL AS edge FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
wt AS (SELECT *, CASE WHEN edge THEN 0.0 WHEN base < 0.65 THEN base * base ELSE base END AS weight FROM mv), tr AS (SELECT *, sum(dx * weight) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path_dx FROM wt)"""
AVG5 = """ma AS (SELECT *, (sum(path_dx) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(0, 2 - (pos - 1)) * first_value(path_dx) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + greatest(0, 2 - (n - pos)) * last_value(path_dx) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 5 AS smooth_dx
FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM tr) WINDOW w AS (PARTITION BY user_id ORDER BY pos))"""


@query(f"WITH {T} SELECT user_id, event_id, round(weight, 6) AS weight, round(path_dx, 10) AS path_dx FROM tr")
def trajectory_cumsum(spark, sf):
    return _motion(spark, sf).select("user_id", "event_id", r6("weight").alias("weight"), F.round("path_dx", 10).alias("path_dx"))


@query(f"WITH {T}, {AVG5} SELECT user_id, event_id, round(smooth_dx, 10) AS smooth_dx FROM ma")
def trajectory_moving_average(spark, sf):
    out = smooth.moving_average(_motion(spark, sf), "user_id", "pos", "path_dx", 2, "smooth_dx")
    return out.select("user_id", "event_id", F.round("smooth_dx", 10).alias("smooth_dx"))


#: Curves between equal rows pass through means of round numbers; this keeps them off the ties of rounding.
OFF_TIES = 0.0000031416


def _smoothest_sql(source: str, clip: str) -> str:
    """s (clip, pos, x) of source (clip, pos, weight, path): the banded system row by row, eliminated downwards and put in upwards."""
    return f"""n AS (SELECT *, count(*) OVER (PARTITION BY {clip}) AS n FROM {source}),
w AS (SELECT {clip}, pos, n, path, weight AS w0, lag(weight, 1, 0) OVER o AS w1, lag(weight, 2, 0) OVER o AS w2, lag(weight, 3, 0) OVER o AS w3 FROM n WINDOW o AS (PARTITION BY {clip} ORDER BY pos)),
e AS (SELECT *, CASE WHEN pos <= n - 1 THEN w0 ELSE 0 END / (n - 1) AS a0, w1 / (n - 1) AS a1,
  CASE WHEN pos <= n - 2 THEN w0 ELSE 0 END / (n - 2) AS b0, CASE WHEN pos <= n - 1 THEN w1 ELSE 0 END / (n - 2) AS b1, w2 / (n - 2) AS b2,
  CASE WHEN pos <= n - 3 THEN w0 ELSE 0 END / (n - 3) AS c0, CASE WHEN pos <= n - 2 THEN w1 ELSE 0 END / (n - 3) AS c1, CASE WHEN pos <= n - 1 THEN w2 ELSE 0 END / (n - 3) AS c2, w3 / (n - 3) AS c3 FROM w WHERE n >= 8),
m AS (SELECT {clip}, pos, n, 0.001 / n + a0 + a1 + b0 + 4 * b1 + b2 + c0 + 9 * c1 + 9 * c2 + c3 AS d, -a0 - 2 * b0 - 2 * b1 - 3 * c0 - 9 * c1 - 3 * c2 AS u, b0 + 3 * c0 + 3 * c1 AS v, -c0 AS z, 0.001 / n * path AS y FROM e),
f AS (
  SELECT {clip}, pos, n, d, u, v, z, y, [1, 0, 0, 0]::DOUBLE[] AS p1, [1, 0, 0, 0]::DOUBLE[] AS p2 FROM m WHERE pos = 1
  UNION ALL
  SELECT m.{clip}, m.pos, m.n, m.d - f.u * f.u / f.d - p1[2] * p1[2] / p1[1] - p2[3] * p2[3] / p2[1], m.u - f.u * f.v / f.d - p1[2] * p1[3] / p1[1], m.v - f.u * f.z / f.d, m.z, m.y - f.u * f.y / f.d - p1[2] * p1[4] / p1[1] - p2[3] * p2[4] / p2[1], [f.d, f.v, f.z, f.y], p1
  FROM f JOIN m ON m.{clip} = f.{clip} AND m.pos = f.pos + 1
),
s AS (
  SELECT {clip}, pos, y / d AS x, 0::DOUBLE AS x1, 0::DOUBLE AS x2 FROM f WHERE pos = n
  UNION ALL
  SELECT f.{clip}, f.pos, (f.y - f.u * s.x - f.v * s.x1 - f.z * s.x2) / f.d, s.x, s.x1 FROM s JOIN f ON f.{clip} = s.{clip} AND f.pos = s.pos - 1
)"""


@query(f"WITH RECURSIVE {T}, given AS (SELECT user_id, pos, weight, path_dx AS path FROM tr), {_smoothest_sql('given', 'user_id')} SELECT user_id, pos, round(x + {OFF_TIES}, 5) AS smooth_path_dx FROM s UNION ALL SELECT user_id, pos, round(path + {OFF_TIES}, 5) FROM n WHERE n < 8")
def trajectory_quadratic(spark, sf):
    out = smooth.smooth_paths(_motion(spark, sf), "user_id", "pos", ["path_dx"])
    return out.select("user_id", "pos", F.round(F.col("smooth_path_dx") + OFF_TIES, 5).alias("smooth_path_dx"))


@query(
    f"""WITH RECURSIVE p AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos, CAST(value AS DOUBLE) AS path, least(greatest((value % 10) / 8 - 0.2, 0.0), 1.0) AS weight FROM events),
{_smoothest_sql('p', 'event_type')} SELECT event_type, pos, round(x, 4) AS smooth_value FROM s UNION ALL SELECT event_type, pos, round(path, 4) FROM n WHERE n < 8"""
)
def trajectory_quadratic_spread(spark, sf):
    """Long clips in runs of 100 blocks, and these in runs again."""
    rows = readers.signal(spark, f"{sf}/events.parquet", "event_type", ["ts", "event_id"], "value")
    rows = with_position(rows, "event_type", ["ts", "event_id"], bucket=F.col("ts").cast("date"))
    rows = rows.withColumn("weight", metrics.clamp((F.col("value") % 10) / 8 - 0.2))
    out = smooth.smooth_paths(rows, "event_type", "pos", ["value"], run=100)
    return out.select("event_type", "pos", F.round("smooth_value", 4).alias("smooth_value"))


@query(f"WITH {T}, {AVG5} SELECT user_id, event_id, round(value + (smooth_dx - path_dx), 10) AS steadied FROM ma")
def stabilise_correction(spark, sf):
    out = smooth.moving_average(_motion(spark, sf), "user_id", "pos", "path_dx", 2, "smooth_dx")
    fixes = out.select("user_id", "pos", (F.col("smooth_dx") - F.col("path_dx")).alias("fix_dx"))
    fixed = smooth.correct(events(spark, sf), fixes, "user_id", "pos", ["dx"])
    return fixed.select("user_id", "event_id", F.round(F.col("value") + F.col("fix_dx"), 10).alias("steadied"))


# --- ranges -------------------------------------------------------------------------------

Q = f"{V}, q AS (SELECT *, quantile_cont(x, 0.02) AS low, quantile_cont(x, 0.98) AS high FROM (SELECT label, vec_id, pos, vec, unnest(vec) AS x FROM v) GROUP BY label, vec_id, pos, vec)".replace("SELECT *, quantile", "SELECT label, vec_id, pos, vec, quantile")


@query(f"WITH {Q} SELECT label, vec_id, round(low, 6) AS low, round(high, 6) AS high, round(list_sum(list_transform(vec, lambda x: least(greatest((x - low) / greatest(high - low, 0.000001), 0.0), 1.0))), 6) AS total FROM q")
def normalise_quantile(spark, sf):
    out = normalise.normalise_rows(thumbs(spark, sf), "vec")
    total = F.aggregate("normalised", F.lit(0.0), lambda a, x: a + x)
    return out.select("label", "vec_id", r6(normalise.quantile(F.col("vec"), 0.02)).alias("low"), r6(normalise.quantile(F.col("vec"), 0.98)).alias("high"), r6(total).alias("total"))


@query(
    f"""WITH RECURSIVE {Q.replace('0.02', '0.01').replace('0.98', '0.99')}, r AS (SELECT label, vec_id, pos, low AS a, high AS b FROM q WHERE pos = 1 UNION ALL
SELECT label, vec_id, pos, CASE WHEN jump THEN low ELSE a + 0.02 * least(greatest(low - a, -0.05 * span), 0.05 * span) END, CASE WHEN jump THEN high ELSE b + 0.02 * least(greatest(high - b, -0.05 * span), 0.05 * span) END
FROM (SELECT *, share > 3 OR share < 1 / 3.0 OR abs(low - a) / span > 2 AS jump FROM (SELECT *, greatest(high - low, 0.000001) / span AS share FROM (SELECT q.label, q.vec_id, q.pos, q.low, q.high, r.a, r.b, greatest(r.b - r.a, 0.000001) AS span FROM r JOIN q ON q.label = r.label AND q.pos = r.pos + 1))))
SELECT label, vec_id, round(a, 6) AS stable_low, round(b, 6) AS stable_high FROM r"""
)
def normalise_slow_range(spark, sf):
    rows = thumbs(spark, sf).select("label", "vec_id", "pos", normalise.quantile(F.col("vec"), 0.01).alias("low"), normalise.quantile(F.col("vec"), 0.99).alias("high"))
    out = normalise.slow_range(rows, "label", ["pos"], "low", "high")
    return out.select("label", "vec_id", r6("stable_low").alias("stable_low"), r6("stable_high").alias("stable_high"))


#: Pictures of 8 x 8, and where each place was in the picture before: moves of one place, surroundings of one place, there and back again.
MATCHED = f"""{Q}, now AS (SELECT label, vec_id, pos, list_transform(vec, lambda x: least(greatest((x - low) / greatest(high - low, 0.000001), 0.0), 1.0)) AS now FROM q),
pairs AS (SELECT a.label, a.pos, 0 AS way, a.now AS own, b.now AS far FROM now a JOIN now b ON a.label = b.label AND a.pos = b.pos + 1 UNION ALL SELECT a.label, a.pos, 1, b.now, a.now FROM now a JOIN now b ON a.label = b.label AND a.pos = b.pos + 1),
places AS (SELECT k, k // 8 AS y, k % 8 AS x, dy, dx, list_transform(range(0, 9), lambda o: least(greatest(k // 8 + o // 3 - 1, 0), 7) * 8 + least(greatest(k % 8 + o % 3 - 1, 0), 7) + 1) AS near,
  list_transform(range(0, 9), lambda o: least(greatest(k // 8 + dy + o // 3 - 1, 0), 7) * 8 + least(greatest(k % 8 + dx + o % 3 - 1, 0), 7) + 1) AS there FROM (SELECT unnest(range(0, 64)) AS k), (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx) WHERE k // 8 + dy BETWEEN 0 AND 7 AND k % 8 + dx BETWEEN 0 AND 7),
best AS MATERIALIZED (SELECT label, pos, way, k, arg_min(dy * 8 + dx, (round(list_sum(list_transform(range(1, 10), lambda o: abs(own[near[o]] - far[there[o]]))), 9), dy * dy + dx * dx, dy, dx)) AS move FROM pairs, places GROUP BY label, pos, way, k),
matched AS MATERIALIZED (SELECT a.label, a.pos, list(CASE WHEN a.move + b.move = 0 THEN a.k + a.move + 1 ELSE 0 END ORDER BY a.k) AS match FROM best a JOIN best b ON a.label = b.label AND a.pos = b.pos AND a.way = 0 AND b.way = 1 AND b.k = a.k + a.move GROUP BY a.label, a.pos)"""


def _robust_line_sql(inner: str, rounds: int = 3) -> str:
    """inner (pts: points x and y), with a and b of y ~ a * x + b; far points weigh less in each round."""
    total = lambda x: f"list_sum(list_transform(range(1, len(pts) + 1), lambda i: ws[i] * ws[i] * {x}))"
    sums = f"{total('1')} AS s, {total('pts[i].x')} AS sx, {total('pts[i].y')} AS sy, {total('pts[i].x * pts[i].x')} AS sxx, {total('pts[i].x * pts[i].y')} AS sxy"
    out = f"SELECT *, list_transform(pts, lambda p: 1::DOUBLE) AS ws FROM ({inner})"
    for k in range(rounds + 1):
        out = f"SELECT *, (sy - a * sx) / s AS b FROM (SELECT *, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS a FROM (SELECT *, {sums} FROM ({out})))"
        if k < rounds:
            out = f"SELECT * EXCLUDE (off), list_transform(off, lambda o: least(1.0, 1.5 * greatest(list_median(off) * 1.4826, 0.01) / (o + 0.000001))) AS ws FROM (SELECT * EXCLUDE (s, sx, sy, sxx, sxy, a, b, ws), list_transform(pts, lambda p: abs(p.y - (a * p.x + b))) AS off FROM ({out}))"
    return out


POINTS = """SELECT n.label, n.vec_id, n.pos, n.now, list_filter(list_transform(range(1, 65), lambda k: CASE WHEN match[k] > 0 THEN {'x': n.now[k], 'y': r.kept[match[k]], 's': r.now[match[k]]} END),
  lambda p: p IS NOT NULL AND abs(p.s - p.x) < 0.12 AND p.x > 0.02 AND p.x < 0.98 AND p.y > 0.02 AND p.y < 0.98) AS pts FROM r JOIN now n ON n.label = r.label AND n.pos = r.pos + 1 JOIN matched m ON m.label = n.label AND m.pos = n.pos"""


@query(f"WITH {MATCHED} SELECT label, pos, CAST(len(list_filter(match, lambda m: m > 0)) AS INT) AS n, CAST(list_sum(match) AS BIGINT) AS places FROM matched")
def block_motion(spark, sf):
    rows = normalise.normalise_rows(thumbs(spark, sf), "vec").select("label", "pos", "normalised")
    met = motion.with_matches(rows, "label", "pos", "normalised", 8, 8, reach=1, block=1).filter("match is not null")
    return met.select("label", "pos", F.size(F.filter("match", lambda m: m >= 0)).alias("n"), F.aggregate("match", F.lit(0).cast("long"), lambda a, m: a + m + 1).alias("places"))


@query(
    f"""WITH RECURSIVE {MATCHED}, r AS (SELECT label, vec_id, pos, now, now AS kept FROM now WHERE pos = 1 UNION ALL SELECT label, vec_id, pos, now, list_transform(now, lambda x: least(greatest(x * scale + shift, 0.0), 1.0)) FROM (
SELECT *, CASE WHEN len(pts) >= 0.08 * 64 THEN 1 + 0.75 * (least(greatest(a, 0.9), 1.1) - 1) ELSE 1.0 END AS scale, CASE WHEN len(pts) >= 0.08 * 64 THEN 0.75 * least(greatest(b, -0.04), 0.04) ELSE 0.0 END AS shift FROM ({_robust_line_sql(POINTS)})))
SELECT label, vec_id, round(list_sum(kept), 6) AS total FROM r"""
)
def normalise_steady(spark, sf):
    out = motion.steady_pictures(thumbs(spark, sf).select("label", "vec_id", "pos", "vec"), "label", ["pos"], "vec", 8, 8, reach=1, block=1)
    return out.select("label", "vec_id", r6(F.aggregate("steady", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"WITH {V}, l AS (SELECT *, lag(vec) OVER (PARTITION BY label ORDER BY pos) AS prev FROM v), s AS (SELECT label, vec_id, {_ssim_sql('prev', 'vec')} AS sim FROM l WHERE prev IS NOT NULL), g AS (SELECT *, log2(least(greatest(0.5 + 1.5 * sim * sim, 0.5), 2.0)) AS e FROM s) SELECT label, vec_id, CASE WHEN e < -0.5 THEN 0.5 WHEN e < 0.5 THEN 1.0 ELSE 2.0 END AS scale FROM g")
def dynamic_scale(spark, sf):
    paired = resample.gaps(thumbs(spark, sf), "label", "pos", "vec").filter("prev_pos is not null")
    return paired.select("label", "vec_id", rates.dynamic_scale(metrics.ssim(F.col("prev_value"), F.col("vec"))).alias("scale"))


# --- comparisons, summaries, rankings -----------------------------------------------------


@query(
    f"""WITH {P}, o AS (SELECT user_id, pos - 1 AS pos, value * 0.9 AS value, count(*) OVER (PARTITION BY user_id) AS n_out FROM p WHERE pos % 2 = 1 OR TRUE), i AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS pos, value, count(*) OVER (PARTITION BY user_id) AS n_in FROM p WHERE pos % 2 = 1),
k AS (SELECT DISTINCT user_id, CAST(round_even(j * (n_out - 1) / CAST(greatest(least(30, n_out) - 1, 1) AS DOUBLE), 0) AS BIGINT) AS pos FROM (SELECT user_id, n_out, unnest(range(0, least(30, n_out))) AS j FROM (SELECT DISTINCT user_id, n_out FROM o))),
a AS (SELECT o.*, CAST(round_even(o.pos / CAST(greatest(n_out - 1, 1) AS DOUBLE) * (n_in - 1), 0) AS BIGINT) AS in_pos FROM o JOIN k USING (user_id, pos) JOIN (SELECT DISTINCT user_id, n_in FROM i) USING (user_id)),
e AS (SELECT a.user_id, (a.value - i.value) * (a.value - i.value) AS m FROM a JOIN i ON i.user_id = a.user_id AND i.pos = a.in_pos)
SELECT user_id, count(*) AS samples, round(avg(m), 6) AS mse, round(avg(CASE WHEN m = 0 THEN 99.0 ELSE 10 * log10(65025.0 / m) END), 6) AS psnr FROM e GROUP BY user_id"""
)
def quality_alignment(spark, sf):
    rows = events(spark, sf)
    outputs = rows.select("user_id", (F.col("pos") - 1).alias("pos"), (F.col("value") * 0.9).alias("value"))
    inputs = rows.filter("pos % 2 = 1").select("user_id", ((F.col("pos") - 1) / 2).cast("bigint").alias("pos"), "value")
    out = quality.clip_quality(outputs, inputs, "user_id", "pos", "value")
    return out.select("user_id", "samples", r6("mse").alias("mse"), r6("psnr").alias("psnr"))


@query(
    """WITH b AS (SELECT vec_id, unnest(range(0, 10)) AS k, embedding AS e FROM embeddings), d AS (SELECT vec_id, CAST(k AS INT) AS class_id, abs(CAST(e[k * 6 + 1] AS DOUBLE)) AS x1, abs(CAST(e[k * 6 + 2] AS DOUBLE)) AS y1, abs(CAST(e[k * 6 + 3] AS DOUBLE)) AS x2, abs(CAST(e[k * 6 + 4] AS DOUBLE)) AS y2, 1 / (1 + exp(-CAST(e[k * 6 + 5] AS DOUBLE))) AS conf FROM b)
SELECT vec_id, class_id, round(x1 * 10, 6) AS x1, round(y1 * 10, 6) AS y1, round(x2 * 10, 6) AS x2, round(y2 * 10, 6) AS y2, round(conf, 6) AS conf, 'class' || class_id || ' ' || CAST(trunc(conf * 100) AS INT) || '%' AS caption FROM d WHERE conf > 0.5"""
)
def detections_filter_rescale(spark, sf):
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: x)
    box = lambda k: F.struct(*(F.abs(F.get(e, F.lit(k * 6 + i))).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), metrics.sigmoid(F.get(e, F.lit(k * 6 + 4))).alias("conf"), F.lit(k).alias("class_id"))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.array(*(box(k) for k in range(10))).cast(detections.BOXES).alias("boxes"))
    boxes = detections.rescaled(detections.confident(F.col("boxes"), 0.5), F.lit(10.0), F.lit(10.0))
    out = detections.box_rows(rows.select("vec_id", boxes.alias("boxes")), ["vec_id"], "boxes")
    label = F.concat(F.lit("class"), "class_id")
    return out.select("vec_id", "class_id", *(r6(c).alias(c) for c in ("x1", "y1", "x2", "y2", "conf")), detections.caption(label, F.col("conf")).alias("caption"))


@query(f"WITH {V} SELECT label, vec_id, round(list_sum(list_transform(vec, lambda x: least(greatest((floor(x * 255) / 255) * 1.2 - 0.1, 0.0), 1.0))), 6) AS total FROM v")
def restore_chain(spark, sf):
    steps = [kernels.from_unit, kernels.to_unit, lambda v: F.transform(v, lambda x: metrics.clamp(x * 1.2 - 0.1))]
    out = kernels.chain(thumbs(spark, sf), "vec", steps, "restored")
    return out.select("label", "vec_id", r6(F.aggregate("restored", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(
    f"""WITH {V}, c AS (SELECT label, vec_id, j, (vec[j // 4 * 16 + j % 4 * 2 + 1] + vec[j // 4 * 16 + j % 4 * 2 + 2] + vec[j // 4 * 16 + j % 4 * 2 + 9] + vec[j // 4 * 16 + j % 4 * 2 + 10]) / 4 AS x FROM (SELECT label, vec_id, vec, unnest(range(0, 16)) AS j FROM v))
SELECT label, vec_id, round(sum(x), 6) AS total, round(max(x), 6) AS top FROM c GROUP BY label, vec_id"""
)
def downscale_half(spark, sf):
    small = thumbs(spark, sf).withColumn("small", kernels.box_mean(F.col("vec"), 8, 8))
    return small.select("label", "vec_id", r6(F.aggregate("small", F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(F.array_max("small")).alias("top"))


def _kernel(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf):
        out = kernels.apply_kernel(thumbs(spark, sf), "vec", name, 8, 8, "made")
        return out.select("label", "vec_id", F.size("made").alias("n"), r6(F.aggregate("made", F.lit(0.0), lambda a, x: a + x)).alias("total"))

    return run


QUERIES |= {"sharpen_cas": _kernel("sharpen"), "line_darken": _kernel("line_darken"), "upscale_2x": _kernel("upscale_2x")} | {f"line_thin_{v}": _kernel(f"line_thin_{v}") for v in kernels.THINNERS}
SQL["upscale_2x"] = f"WITH {V} SELECT label, vec_id, CAST(256 AS INT) AS n, round(4 * list_sum(vec), 6) AS total FROM v"
PIXELS = f"{V}, px AS (SELECT label, vec_id, k // 8 AS i, k % 8 AS j, vec[k + 1] AS x FROM (SELECT label, vec_id, vec, CAST(unnest(range(0, 64)) AS INT) AS k FROM v))"
SQL["line_darken"] = f"""WITH {PIXELS},
near AS (SELECT p.vec_id, p.label, p.i, p.j, p.x AS own, q.x, q.i - p.i AS di, q.j - p.j AS dj FROM px p JOIN px q ON p.vec_id = q.vec_id AND abs(p.i - q.i) <= 1 AND abs(p.j - q.j) <= 1),
e AS (SELECT vec_id, label, i, j, any_value(own) AS own, sqrt(pow(sum(x * dj * (2 - abs(di))), 2) + pow(sum(x * di * (2 - abs(dj))), 2)) AS edge FROM near GROUP BY vec_id, label, i, j),
r AS (SELECT *, (edge - min(edge) OVER v) / (max(edge) OVER v - min(edge) OVER v) AS share FROM e WINDOW v AS (PARTITION BY vec_id)),
thin AS (SELECT p.vec_id, p.i, p.j, min(q.share) AS share FROM r p JOIN r q ON p.vec_id = q.vec_id AND abs(p.i - q.i) <= 1 AND abs(p.j - q.j) <= 1 GROUP BY p.vec_id, p.i, p.j),
soft AS (SELECT p.vec_id, p.i, p.j, sum(q.share * exp(-(pow(q.i - p.i, 2) + pow(q.j - p.j, 2)) / 2)) / pow(1 + 2 * exp(-0.5), 2) AS taken FROM thin p JOIN thin q ON p.vec_id = q.vec_id AND abs(p.i - q.i) <= 1 AND abs(p.j - q.j) <= 1 GROUP BY p.vec_id, p.i, p.j)
SELECT label, vec_id, CAST(count(*) AS INT) AS n, round(sum(least(greatest(own - 0.7 * taken, 0.0), 1.0)), 6) AS total FROM r JOIN soft USING (vec_id, i, j) GROUP BY label, vec_id"""
SQL["sharpen_cas"] = f"""WITH {PIXELS.replace("px AS", "px AS MATERIALIZED")},
near AS (SELECT p.vec_id, p.label, p.i, p.j, q.x, di, dj FROM px p, (SELECT unnest(range(-3, 4)) AS di) a, (SELECT unnest(range(-3, 4)) AS dj) b, px q WHERE q.vec_id = p.vec_id AND q.i = least(greatest(p.i + di, 0), 7) AND q.j = least(greatest(p.j + dj, 0), 7)),
m AS (SELECT *, CASE WHEN abs(di) > 2 OR abs(dj) > 2 THEN 0.0 ELSE [0, 0.0625, 0.125, 0.0625, 0, 0.0625, 0, -0.125, 0, 0.0625, 0.125, -0.125, -0.5, -0.125, 0.125, 0.0625, 0, -0.125, 0, 0.0625, 0, 0.0625, 0.125, 0.0625, 0][greatest(di + 2, 0) * 5 + dj + 3] END AS w FROM near),
f AS (SELECT vec_id, label, i, j, max(x) FILTER (di = 0 AND dj = 0) AS own, sum(x) FILTER (abs(di) + abs(dj) = 1) AS four, min(x) FILTER (abs(di) + abs(dj) <= 1) AS low, max(x) FILTER (abs(di) + abs(dj) <= 1) AS high,
  min(x) FILTER (abs(di) <= 1 AND abs(dj) <= 1) AS low9, max(x) FILTER (abs(di) <= 1 AND abs(dj) <= 1) AS high9, sum(w * x) AS lap, sqrt(greatest(avg(x * x) - pow(avg(x), 2), 0) + 0.000001) AS contrast FROM m GROUP BY vec_id, label, i, j),
s AS (SELECT vec_id, sum(pow(lap / (contrast + 0.001), 2) * contrast) / (sum(contrast) + 0.000001) AS score FROM f GROUP BY vec_id),
a AS (SELECT vec_id, least(1 - least(greatest((ln(score + 0.0001) + 2.31) / 1.12, 0), 1), 0.9) AS amount FROM s),
o AS (SELECT vec_id, label, own, four, -sqrt(least(greatest(least(low + low9, 2 - (high + high9)) / greatest(high + high9, 0.0001), 0), 1)) / (8 - 3 * amount) AS w FROM f JOIN a USING (vec_id))
SELECT label, vec_id, CAST(count(*) AS INT) AS n, round(sum(least(greatest((own + w * four) / (1 + 4 * w), 0.0), 1.0)), 6) AS total FROM o GROUP BY label, vec_id"""


@query("SELECT l_suppkey, l_linenumber, l_extendedprice, l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_extendedprice DESC, l_orderkey DESC, l_partkey DESC) AS k FROM lineitem) WHERE k = 1")
def best_format_per_key(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return quality.best_per_key(rows, ["l_suppkey", "l_linenumber"], [], ["l_extendedprice", "l_orderkey", "l_partkey"])


@query(f"WITH {V} SELECT label, vec_id, CAST(rank AS INT) AS rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(list_sum(vec), 9) DESC, vec_id) AS rank FROM v) WHERE rank <= 5")
def topk_keypoints(spark, sf):
    scored = thumbs(spark, sf).withColumn("score", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 9))
    return quality.top_k(scored, "label", [F.desc("score"), F.col("vec_id")], 5).select("label", "vec_id", "rank")


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value > 20) AS succeeded, count(*) FILTER (NOT value > 20) AS failed, round(avg(value) FILTER (value > 20), 6) AS mean_seconds FROM events GROUP BY event_type")
def batch_summary(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "value")
    return quality.batch_summary(rows, "event_type", F.col("value") > 20, F.col("value")).withColumn("mean_seconds", r6("mean_seconds"))


@query("SELECT l_suppkey, l_returnflag, count(*) AS n, round(median(l_extendedprice), 4) AS middle, round(quantile_cont(l_extendedprice, 0.98), 4) AS high FROM lineitem GROUP BY ALL")
def ledger_quantiles(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_returnflag", "l_extendedprice")
    return rows.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("l_extendedprice"), 4).alias("middle"), F.round(F.percentile("l_extendedprice", F.lit(0.98)), 4).alias("high"))


LEDGER = "SELECT l_suppkey AS user_id, l_orderkey AS event_id, CAST(l_extendedprice AS DOUBLE) AS value, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS pos FROM lineitem"


@query(f"WITH p AS ({LEDGER}), {_gaps_sql('p', 2, 1)} SELECT user_id AS l_suppkey, count(*) AS n, round(sum((1 - t) * prev_value + t * value), 4) AS total FROM g GROUP BY user_id")
def ledger_resampled(spark, sf):
    rows = readers.signal(spark, f"{sf}/lineitem.parquet", "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], "l_extendedprice")
    rows = with_position(rows, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]).select("l_suppkey", "pos", "value")
    out = resample.interpolate(rows, "l_suppkey", "pos", "value", 2, 1).filter("kind = 'interp'")
    return out.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT conv_id, turn, role, CASE WHEN role <> lag(role) OVER w THEN TRUE ELSE FALSE END AS is_cut, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS short_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_changes(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    before = F.lag("role").over(ordered("conv_id", "turn"))
    return rows.select("conv_id", "turn", "role", F.coalesce(F.col("role") != before, F.lit(False)).alias("is_cut"), names.truncated(F.col("text")).alias("short_text"))


# --- streams ------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return processors.source(spark, sf, "events.parquet").select("user_id", "event_id", F.col("value").cast("double").alias("value"))


STREAM_P = "p AS (SELECT user_id, event_id, CAST(value AS DOUBLE) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events)"


@query(f"{MSE25.replace(P, STREAM_P)} SELECT user_id, event_id, kept FROM r")
def stream_dedup(spark, sf):
    return processors.run_available(processors.mark_repeats(_stream(spark, sf), "user_id", "event_id", "value", 25.0)).select("user_id", "event_id", "kept")


@query(f"WITH {C.replace(P, STREAM_P)} SELECT user_id, event_id, is_cut FROM c")
def stream_cut(spark, sf):
    return processors.run_available(processors.mark_cuts(_stream(spark, sf), "user_id", "event_id", "value", CUT)).select("user_id", "event_id", "is_cut")


@query(f"{KEPT.replace(P, STREAM_P)}, {_gaps_sql('k', 5, 2)} {_linear_sql('k', 5, 2)}")
def stream_gap_plan(spark, sf):
    return _rounded(processors.run_available(processors.interpolate(_stream(spark, sf), "user_id", "event_id", "value", 5, 2, 25.0)))


def _arrivals(spark: SparkSession, sf: str, late: bool) -> DataFrame:
    """The events with the number of their lot, of five of six days each; with late, every fiftieth row comes one lot later."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", F.col("value").cast("double").alias("value"))
    lot = F.least(F.floor((F.dayofmonth("ts") - 1) / 6) + F.when(F.lit(late) & (F.col("event_id") % 50 == 7), 1).otherwise(0), F.lit(4))
    return rows.withColumn("_lot", lot.cast("int"))


def _replayed(spark: SparkSession, sf: str, fold: event_time.Fold, late: bool, idle: str = "60 days") -> DataFrame:
    over = lambda stream: event_time.run_fold(stream, "user_id", "ts", "event_id", "value", fold, "12 hours", "1 day", idle)
    return event_time.replay(_arrivals(spark, sf, late), over, "ts", "100 days", stops={4}, lots=5)


#: Rows as they come in lots, and which of them are late: their day was past when the watermark stood 12 hours before the latest row of all lots before.
ARRIVED = """lots AS (SELECT *, CAST(value AS DOUBLE) AS x, epoch_ms(ts) AS ms, epoch_ms(ts) // 86400000 AS day, least((day(ts) - 1) // 6 + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END, 4) AS lot FROM events),
marks AS (SELECT lot, max(max(ms)) OVER (ORDER BY lot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 43200000 AS mark FROM lots GROUP BY lot),
came AS (SELECT lots.*, coalesce((day + 1) * 86400000 <= mark, FALSE) AS late FROM lots JOIN marks USING (lot)),
p AS (SELECT user_id, event_id, x AS value, row_number() OVER (PARTITION BY user_id ORDER BY day, event_id) AS pos FROM came WHERE NOT late)"""


@query(f"WITH {STREAM_P} SELECT user_id, event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY pos) AS successor FROM p")
def stream_look_ahead(spark, sf):
    return _replayed(spark, sf, event_time.successors("event_id"), False).select("user_id", "event_id", "value", "successor")


@query(MSE25.replace(P, ARRIVED) + " SELECT user_id, event_id, value, kept, FALSE AS late FROM r UNION ALL SELECT user_id, event_id, x, FALSE, TRUE FROM came WHERE late")
def stream_late_dedup(spark, sf):
    return _replayed(spark, sf, event_time.repeats(25.0, "event_id"), True)


@query(
    KEPT.replace(P, ARRIVED) + f""", {_gaps_sql('k', 5, 2)}, ends AS (SELECT user_id, (SELECT max(pos) FROM p WHERE p.user_id = k.user_id) AS last, max(pos) AS kept_pos, arg_max(value, pos) AS value FROM k GROUP BY user_id)
{_linear_sql('k', 5, 2)} UNION ALL SELECT user_id, unnest(range(kept_pos * 5 // 2 + 1, last * 5 // 2 + 1)), 'tail', round(value, 6) FROM ends UNION ALL SELECT user_id, NULL, 'late', round(x, 6) FROM came WHERE late"""
)
def stream_late_slots(spark, sf):
    return _rounded(_replayed(spark, sf, event_time.slots(5, 2, 25.0), True).drop("late"))


@query(
    f"""WITH {ARRIVED}, c AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day, event_id) > 2 AS starts FROM came WHERE NOT late),
n AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY user_id ORDER BY day, event_id ROWS UNBOUNDED PRECEDING) AS session FROM c)
SELECT user_id, arg_min(event_id, (day, event_id)) AS first_at, arg_max(event_id, (day, event_id)) AS last_at, count(*) AS n, round(sum(x), 4) AS total, FALSE AS late FROM n GROUP BY user_id, session
UNION ALL SELECT user_id, event_id, event_id, 1, round(x, 4), TRUE FROM came WHERE late"""
)
def stream_sessions(spark, sf):
    return _replayed(spark, sf, event_time.session_totals(), True, "1 day").withColumn("total", F.round("total", 4))


HOLED = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(value AS DOUBLE) END"
HOLED_P = STREAM_P.replace("CAST(value AS DOUBLE)", HOLED)


@query(_fold_sql("coalesce(p.value IS NULL OR (p.value - r.ref) * (p.value - r.ref) < 25, FALSE)").replace(P, HOLED_P).replace("value AS ref, TRUE AS kept", "value AS ref, value IS NOT NULL AS kept") + " SELECT user_id, event_id, kept FROM r")
def stream_dedup_nulls(spark, sf):
    rows = _stream(spark, sf).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return processors.run_available(processors.mark_repeats(rows, "user_id", "event_id", "value", 25.0)).select("user_id", "event_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from . import queries_bands, queries_meta, queries_runs  # noqa: E402, F401  register more queries above
