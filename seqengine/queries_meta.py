"""More registered queries: metadata, names, sizes, thresholds, ranges, matches, recurrent and pairwise kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics, names, rates
from .operators import blur, cuts, dedup, kernels, matching, normalise, quality, resample
from .operators.clips import recurrent, with_position
from .plans import spec
from .queries import MSE25, P, S, V, _ssim_sql, _vector_fold_sql, cut_rows, events, query, r6, thumbs
from .sources import readers


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet")


def _choose(by: Column, values: list[str | None]) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _chosen(by: str, values: list[str | None]) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"[{listed}][CAST({by} % {len(values)} AS INT) + 1]"


# --- metadata and names -------------------------------------------------------------------

CODECS, FORMATS = ["h264", "FFV1", "rawvideo", "hevc", None, "vp6f"], ["yuv420p", "bgr24", "gbrp", None, "RGB48le", "p010le", "ya8"]


@query(
    f"""SELECT p_partkey, NOT coalesce(lower(codec) IN ('rawvideo', 'ffv1', 'vp6f'), FALSE) AND NOT coalesce(regexp_matches(lower(pix), '^(bgr|rgb|gbr|pal|ya)'), FALSE) AS hardware
FROM (SELECT p_partkey, {_chosen('p_partkey', CODECS)} AS codec, {_chosen('p_partkey', FORMATS)} AS pix FROM part)"""
)
def hardware_decoding(spark, sf):
    ok = names.can_decode_in_hardware(_choose(F.col("p_partkey"), CODECS), _choose(F.col("p_partkey"), FORMATS))
    return parts(spark, sf).select("p_partkey", ok.alias("hardware"))


ENCODERS = ["x264", "x264_10bit", "nvenc_h264", "qsv_h265_10bit", "prores", "prores_segment", "png", "jpeg", "x265_10bit", "av1", "hevc_amf_10bit"]


@query(
    f"""SELECT p_partkey, CASE WHEN clear AND e <> 'prores_segment' THEN 'yuva444p10le' WHEN gray THEN CASE WHEN eight THEN 'yuv420p' ELSE 'yuv444p10le' END WHEN e IN ('x264_10bit', 'x265_10bit') THEN 'yuv420p10le' WHEN e = 'nvenc_h264' THEN 'yuv420p'
WHEN e IN ('hevc_amf_10bit', 'qsv_h265_10bit') THEN 'p010le' WHEN e = 'prores' THEN 'yuv444p10le' WHEN e = 'png' THEN CASE WHEN eight THEN 'rgb24' ELSE 'rgb48le' END WHEN e = 'jpeg' THEN 'yuvj444p' WHEN eight THEN 'yuv420p' ELSE 'yuv444p10le' END AS stored
FROM (SELECT p_partkey, {_chosen('p_partkey', ENCODERS)} AS e, p_size % 2 = 0 AS eight, p_size % 5 = 0 AS gray, p_size % 7 = 0 AS clear FROM part)"""
)
def pixel_formats(spark, sf):
    size = F.col("p_size")
    stored = names.pixel_format(_choose(F.col("p_partkey"), ENCODERS), size % 2 == 0, size % 5 == 0, size % 7 == 0)
    return parts(spark, sf).select("p_partkey", stored.alias("stored"))


EXTENSIONS, VIDEO = ["mp4", "webm", "WEBM", "mkv"], ["libx264", "vp9", "vp9_qsv", "av1", "hevc"]
SPACES = ["bt709", "bt2020nc", None, "bt2020c", "bt601"]


@query(
    f"""SELECT p_partkey, CASE WHEN lower(x) = 'webm' AND c NOT LIKE 'vp9%' THEN 'vp9' ELSE c END AS codec, coalesce(s IN ('bt2020', 'bt2020nc', 'bt2020c'), FALSE) OR coalesce(t IN ('bt2020', 'bt2020nc', 'bt2020c'), FALSE) AS wide
FROM (SELECT p_partkey, {_chosen('p_partkey', EXTENSIONS)} AS x, {_chosen('p_partkey', VIDEO)} AS c, {_chosen('p_partkey', SPACES)} AS s, {_chosen('p_size', SPACES)} AS t FROM part)"""
)
def containers_and_gamuts(spark, sf):
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    codec = names.container_codec(_choose(key, EXTENSIONS), _choose(key, VIDEO))
    wide = names.is_wide_gamut(_choose(key, SPACES), none, _choose(F.col("p_size"), SPACES))
    return parts(spark, sf).select("p_partkey", codec.alias("codec"), wide.alias("wide"))


PATHS = ["a/b.MP4", "c.txt", "d.tar.webm", "noext", "e.ts", "f/g.h/i", "j.ogv"]


@query(f"SELECT p_partkey, coalesce(lower(regexp_extract(f, '\\.([^./]+)$', 1)) IN ('mp4', 'mkv', 'webm', 'avi', 'mov', 'gif', 'm4v', 'm2ts', 'mts', 'mpg', 'mpeg', 'm2v', 'flv', 'wmv', 'ogv'), FALSE) AS readable FROM (SELECT p_partkey, {_chosen('p_partkey', PATHS)} AS f FROM part)")
def readable_inputs(spark, sf):
    return parts(spark, sf).select("p_partkey", names.is_readable(_choose(F.col("p_partkey"), PATHS)).alias("readable"))


@query("SELECT r_name, path FROM (SELECT r_name, trim(unnest(string_split(listed, ';'))) AS path FROM (SELECT r_name, string_agg(n_name, ' ; ' ORDER BY n_name) || ';' AS listed FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)) WHERE path <> ''")
def listed_inputs(spark, sf):
    nation, region = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("nation", "region"))
    met = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    listed = met.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), " ; ").alias("listed"))
    split = listed.select("r_name", F.explode(F.transform(F.split("listed", ";"), lambda x: F.trim(x))).alias("path"))
    again = readers.split_inputs(listed, "listed").distinct()
    return split.join(again, "path").select("r_name", "path")


SIZES = ["1280x720", " 640 X 480 ", "12x", "x9", "1920*1080", "7x5x3", "100x200"]


@query(
    f"""SELECT p_partkey, CASE WHEN ok THEN CAST(regexp_extract(t, '^\\s*(\\d+)\\s*[xX]\\s*(\\d+)\\s*$', 1) AS INT) ELSE -1 END AS width, CASE WHEN ok THEN CAST(regexp_extract(t, '^\\s*(\\d+)\\s*[xX]\\s*(\\d+)\\s*$', 2) AS INT) ELSE -1 END AS height
FROM (SELECT p_partkey, t, regexp_matches(t, '^\\s*(\\d+)\\s*[xX]\\s*(\\d+)\\s*$') AS ok FROM (SELECT p_partkey, {_chosen('p_partkey', SIZES)} AS t FROM part))"""
)
def parsed_sizes(spark, sf):
    width, height = names.parse_size(_choose(F.col("p_partkey"), SIZES))
    return parts(spark, sf).select("p_partkey", F.coalesce(width, F.lit(-1)).alias("width"), F.coalesce(height, F.lit(-1)).alias("height"))


@query(
    """SELECT p_partkey, (m - s % m) % m AS missing, CAST(greatest(64, 64 / CAST(scale AS DOUBLE)) AS BIGINT) AS multiple, CAST(ceil(s / 14.0) * 14 AS BIGINT) AS high, CAST(2 * round_even(s * 0.5 / 2, 0) AS BIGINT) AS half, round(s / 37.0, 2) AS ratio
FROM (SELECT p_partkey, CAST(p_size * 29 AS BIGINT) AS s, CAST([1, 2, 4, 8, 16][CAST(p_partkey % 5 AS INT) + 1] AS BIGINT) AS m, [0.25, 0.5, 1.0, 2.0][CAST(p_partkey % 4 AS INT) + 1] AS scale FROM part)"""
)
def paddings(spark, sf):
    side, key = (F.col("p_size") * 29).cast("bigint"), F.col("p_partkey")
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (key % n + 1).cast("int"))
    out = {"missing": rates.pad_to(side, at([1, 2, 4, 8, 16], 5).cast("bigint")), "multiple": rates.padding_multiple(at([0.25, 0.5, 1.0, 2.0], 4)), "high": rates.patch_size(side, "high"), "half": rates.even_size(side, 0.5), "ratio": rates.aspect_ratio(side, F.lit(37))}
    return parts(spark, sf).select("p_partkey", *(c.alias(n) for n, c in out.items()))


JOB_METHODS = ["ssim", "mse", "vmaf", "flownets", "ssim-cuda", None]


@query(
    f"""WITH j AS (SELECT p_partkey, {_chosen('p_partkey', JOB_METHODS)} AS method, CAST(p_size AS DOUBLE) AS s FROM part)
SELECT p_partkey, round(CASE WHEN method LIKE 'ssim%' THEN 1 - s / 1000 WHEN method = 'vmaf' THEN 100 - s / 10 WHEN method = 'flownets' THEN s / 100 ELSE s END, 6) AS dedup,
  round(CASE WHEN method LIKE 'ssim%' THEN s / 100 WHEN method = 'mse' THEN (100 - s) * 50 ELSE 1 - s / 100 END, 6) AS cut FROM j"""
)
def thresholds(spark, sf):
    """Parts as jobs, each with a method and a sensitivity of its own."""
    dedup_at, cut_at = spec.job_thresholds(_choose(F.col("p_partkey"), JOB_METHODS), F.col("p_size"))
    return parts(spark, sf).select("p_partkey", r6(dedup_at).alias("dedup"), r6(cut_at).alias("cut"))


WORDS = ["EGYPT", "FRANCE", "GERMANY", "INDIA", "IRAN", "IRAQ", "JAPAN", "PERU"]


@query(f"""SELECT n_name, choice, CAST(rank AS INT) AS rank FROM (SELECT n_name, choice, row_number() OVER (PARTITION BY n_name ORDER BY levenshtein(n_name, choice), choice) AS rank FROM (SELECT DISTINCT n_name FROM nation), (SELECT unnest({WORDS}) AS choice)) WHERE rank <= 3""")
def closest_names(spark, sf):
    return names.closest(spark.read.parquet(f"{sf}/nation.parquet"), "n_name", WORDS).select("n_name", "choice", "rank")


FORMAT_SQL = "f AS (SELECT l_orderkey, CASE WHEN l_partkey % 9 > 0 THEN l_partkey % 2000 END AS width, l_suppkey % 13 * 90 AS height, CASE l_linenumber % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'vp9' END AS vcodec FROM lineitem)"


def _formats(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    codec = F.when(F.col("l_linenumber") % 3 == 0, "none").when(F.col("l_linenumber") % 3 == 1, "vp9")
    return rows.select("l_orderkey", F.when(F.col("l_partkey") % 9 > 0, F.col("l_partkey") % 2000).alias("width"), (F.col("l_suppkey") % 13 * 90).alias("height"), codec.alias("vcodec"))


@query(
    f"""WITH {FORMAT_SQL}, h AS (SELECT DISTINCT l_orderkey, height FROM f WHERE width IS NOT NULL AND height >= 240 AND vcodec IS NOT NULL AND vcodec <> 'none'), l AS (SELECT l_orderkey, list(height ORDER BY height DESC) AS heights FROM h GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN len(heights) > 2 THEN array_to_string(heights[:2], ', ') || ', … ' || (len(heights) - 2) || ' more' ELSE array_to_string(heights, ', ') END AS shown FROM l"""
)
def playable_resolutions(spark, sf):
    found = quality.resolutions(quality.playable(_formats(spark, sf)), "l_orderkey")
    return found.select("l_orderkey", quality.preview(F.transform("heights", lambda h: h.cast("string")), 2).alias("shown"))


@query("SELECT DISTINCT l_linestatus, l_returnflag FROM lineitem")
def distinct_listing(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_linestatus", "l_returnflag").distinct()


@query(
    """SELECT o_orderkey, (err IS NULL OR (want IS NOT NULL AND done >= want)) AND done >= coalesce(want, 0) AND (NOT makes OR coalesce(bytes > 0, FALSE)) AS ok, CASE WHEN secs > 0 THEN round(done / secs * 2, 6) END AS fps
FROM (SELECT o_orderkey, o_orderkey % 100 AS done, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 90 END AS want, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' END AS err, o_orderkey % 2 = 0 AS makes, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 END AS bytes, CAST(o_orderkey % 6 AS DOUBLE) AS secs FROM orders)"""
)
def run_outcomes(spark, sf):
    k = F.col("o_orderkey")
    done, seconds = k % 100, (k % 6).cast("double")
    ok = quality.outcome(done, F.when(k % 3 > 0, k % 90), F.when(k % 4 == 0, "failed"), k % 2 == 0, F.when(k % 5 > 0, k % 7))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", ok.alias("ok"), r6(quality.throughput(done, seconds, 2.0)).alias("fps"))


# --- ranges, weights, histograms ----------------------------------------------------------

X = f"WITH {V}, x AS (SELECT label, vec_id, vec, unnest(vec) AS x FROM v)"


@query(f"{X}, m AS (SELECT vec_id, median(x) AS middle FROM x GROUP BY vec_id) SELECT vec_id, round(any_value(middle), 6) AS middle, round(1.4826 * median(abs(x - middle)), 6) AS spread FROM x JOIN m USING (vec_id) GROUP BY vec_id")
def robust_spreads(spark, sf):
    vec = F.col("vec")
    return thumbs(spark, sf).select("vec_id", r6(normalise.median(vec)).alias("middle"), r6(normalise.robust_spread(vec)).alias("spread"))


@query(f"{X} SELECT vec_id, count(*) FILTER (x > 0.3) AS n, round(sum(x) FILTER (x > 0.3), 6) AS total FROM x GROUP BY vec_id")
def finite_values(spark, sf):
    holes = F.transform("vec", lambda x: F.when(x > 0.3, x).when(x > 0.2, F.lit(float("nan"))).when(x > 0.1, F.lit(float("inf"))))
    kept = normalise.finite(holes)
    return thumbs(spark, sf).select("vec_id", F.size(kept).cast("bigint").alias("n"), r6(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS price FROM lineitem GROUP BY l_suppkey")
def weighted_prices(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rows.groupBy("l_suppkey").agg(F.round(metrics.weighted_mean(F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")), 4).alias("price"))


@query(f"{X} SELECT vec_id, round((sum(x) - count(*) * min(x)) / (max(x) - min(x)), 6) AS total FROM x GROUP BY vec_id")
def min_max_vectors(spark, sf):
    return thumbs(spark, sf).select("vec_id", r6(F.aggregate(metrics.min_max(F.col("vec")), F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(
    f"""WITH {V}, h AS (SELECT label, vec_id, pos, list_transform(range(0, 8), lambda b: CAST(len(list_filter(vec, lambda x: CAST(least(greatest(floor(x * 8), 0), 7) AS INT) = b)) AS DOUBLE)) AS bins FROM v), l AS (SELECT *, lag(bins) OVER (PARTITION BY label ORDER BY pos) AS prev FROM h)
SELECT vec_id, bins[3] AS third, round(list_dot_product(prev, bins) / (sqrt(list_dot_product(prev, prev)) * sqrt(list_dot_product(bins, bins))), 6) AS likeness FROM l"""
)
def histogram_similarity(spark, sf):
    binned = thumbs(spark, sf).withColumn("bins", metrics.histogram(F.col("vec"), 8))
    paired = resample.gaps(binned, "label", "pos", "bins")
    return paired.select("vec_id", F.get("bins", F.lit(2)).alias("third"), r6(metrics.cosine(F.col("prev_value"), F.col("bins"))).alias("likeness"))


@query(f"WITH {V} SELECT vec_id, round(list_sum(list_transform(vec, lambda x: floor(x * 255) / 255)), 6) AS total, CAST(list_sum(list_transform(vec, lambda x: floor(x * 255))) AS BIGINT) AS whole FROM v")
def unit_integers(spark, sf):
    bytes_ = kernels.from_unit(F.col("vec"))
    total = F.aggregate(kernels.to_unit(bytes_), F.lit(0.0), lambda a, x: a + x)
    return thumbs(spark, sf).select("vec_id", r6(total).alias("total"), F.aggregate(bytes_, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("whole"))


@query(f"WITH {V}, m AS (SELECT vec_id, vec[4] AS alpha, 0.299 * vec[1] + 0.587 * vec[2] + 0.114 * vec[3] AS luma FROM v) SELECT vec_id, round(luma, 6) AS luma, round(1 - (1 - luma) * alpha, 6) AS weight, round(luma, 6) AS opaque FROM m")
def mask_weights(spark, sf):
    c = [F.get("vec", F.lit(i)) for i in range(4)]
    return thumbs(spark, sf).select("vec_id", r6(metrics.luma(*c[:3])).alias("luma"), r6(blur.mask_weight(*c)).alias("weight"), r6(blur.mask_weight(*c[:3])).alias("opaque"))


@query("SELECT p_partkey, CAST(i AS INT) AS i, round(i / CAST(p_size % 9 + 1 AS DOUBLE), 6) AS t FROM (SELECT *, unnest(range(1, p_size % 9 + 1)) AS i FROM part)")
def even_ladders(spark, sf):
    rungs = parts(spark, sf).select("p_partkey", F.posexplode(resample.ladder(F.col("p_size") % 9)).alias("i", "t"))
    return rungs.select("p_partkey", (F.col("i") + 1).alias("i"), r6("t").alias("t"))


# --- one long clip over many tasks ---------------------------------------------------------


@query(f"{MSE25} SELECT user_id, event_id, pos, kept FROM r")
def dedup_mse_events_spread(spark, sf):
    """As dedup_mse_events, with positions counted by day and clips folded in chunks, for clips too long for a task."""
    rows = readers.signal(spark, f"{sf}/events.parquet", "user_id", ["ts", "event_id"], "value")
    rows = with_position(rows, "user_id", ["ts", "event_id"], bucket=F.date_trunc("day", "ts")).drop("ts")
    return dedup.mark_repeats_spread(rows, "user_id", "pos", "value", "mse", 25.0, rows_per_chunk=50).select("user_id", "event_id", "pos", "kept")


# --- kernels, matches, points -------------------------------------------------------------


@query(_vector_fold_sql("100 * greatest(0, " + _ssim_sql("r.ref", "v.vec") + ") >= 50"))
def dedup_similarity_vectors(spark, sf):
    return dedup.mark_repeats(thumbs(spark, sf), "label", ["pos"], "vec", "vmaf", 50.0).select("label", "vec_id", "kept")


@query(
    f"""WITH RECURSIVE {S}, r AS (SELECT user_id, event_id, pos, value AS smooth FROM s WHERE pos = 1
UNION ALL SELECT s.user_id, s.event_id, s.pos, CASE WHEN s.is_cut THEN s.value ELSE 0.8 * r.smooth + 0.2 * s.value END FROM r JOIN s ON s.user_id = r.user_id AND s.pos = r.pos + 1)
SELECT user_id, event_id, round(smooth, 6) AS smooth FROM r"""
)
def recurrent_average(spark, sf):
    def kernel(state, x):
        new = x if state is None else 0.8 * state + 0.2 * x
        return new, new

    out = recurrent(cut_rows(spark, sf), "user_id", ["pos"], "value", kernel, "smooth", reset="is_cut")
    return out.select("user_id", "event_id", r6("smooth").alias("smooth"))


@query(f"WITH {V}, l AS (SELECT *, lag(vec) OVER (PARTITION BY label ORDER BY pos) AS prev FROM v) SELECT vec_id, coalesce(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(vec[i] - prev[i], 2)))) > 0.3, FALSE) AS is_cut FROM l")
def cut_by_kernel(spark, sf):
    paired = resample.gaps(thumbs(spark, sf), "label", "pos", "vec")
    scored = kernels.apply_pair_kernel(paired, "prev_value", "vec", lambda a, b: np.sqrt(((b - a) ** 2).sum(axis=1)), "score")
    return scored.select("vec_id", (F.col("score") > 0.3).alias("is_cut"))


MATCH_SQL = f"WITH {V}, d AS (SELECT a.label, a.vec_id AS point, b.vec_id AS other, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.vec[i] - b.vec[i], 2)))), 9) AS distance FROM v a JOIN v b ON a.label = b.label AND a.pos % 2 = 1 AND b.pos % 2 = 0)"


def _frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = thumbs(spark, sf)
    return rows.filter("pos % 2 = 1"), rows.filter("pos % 2 = 0")


@query(f"{MATCH_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY label, point ORDER BY distance, other) AS a, row_number() OVER (PARTITION BY label, other ORDER BY distance, point) AS b FROM d) SELECT label, point, other FROM n WHERE a = 1 AND b = 1")
def mutual_matches(spark, sf):
    found = matching.mutual(*_frames(spark, sf), "label", "vec_id", "vec", block=20)
    return found.select("label", F.col("vec_id").alias("point"), "other")


@query(
    f"""{MATCH_SQL}, n AS (SELECT label, point, min(distance) AS d1, max(distance) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY label, point ORDER BY distance) AS k FROM d) WHERE k <= 2 GROUP BY label, point HAVING count(*) = 2),
g AS (SELECT * FROM n WHERE d1 < 0.97 * d2) SELECT label, point, round(d1, 6) AS d1 FROM g WHERE label IN (SELECT label FROM g GROUP BY label HAVING count(*) >= 5)"""
)
def ratio_matches(spark, sf):
    found = matching.distinct(*_frames(spark, sf), "label", "vec_id", "vec", 0.97, 5, block=20)
    return found.select("label", F.col("vec_id").alias("point"), r6("distance").alias("d1"))


@query(f"WITH {P}, q AS (SELECT user_id, event_id, value AS x, CAST(pos AS DOUBLE) AS y, event_id % 97 AS score FROM p) SELECT user_id, event_id FROM q a WHERE NOT EXISTS (SELECT 1 FROM q b WHERE b.user_id = a.user_id AND abs(b.x - a.x) <= 8 AND abs(b.y - a.y) <= 8 AND b.score > a.score)")
def suppressed_points(spark, sf):
    rows = events(spark, sf).select("user_id", "event_id", F.col("value").alias("x"), F.col("pos").cast("double").alias("y"), (F.col("event_id") % 97).alias("score"))
    return quality.suppress(rows, "user_id", "x", "y", "score", 8).select("user_id", "event_id")


@query(f"WITH {P}, o AS (SELECT user_id, pos * 10 AS slot, pos FROM p WHERE pos % 2 = 0 UNION ALL SELECT user_id, pos * 10 + 1, pos FROM p WHERE pos % 3 = 0 UNION ALL SELECT user_id, pos * 10, pos FROM p WHERE pos % 2 = 1) SELECT user_id, slot, pos, row_number() OVER (PARTITION BY user_id ORDER BY slot) AS place FROM o")
def ordered_union(spark, sf):
    """Three parts of a clip that interleave; rows that two of them have stay twice, and all go by their slots."""
    rows = events(spark, sf).select("user_id", (F.col("pos") * 10).alias("slot"), "pos")
    again = rows.filter("pos % 3 = 0").withColumn("slot", F.col("slot") + 1)
    both = quality.ordered_union(rows.filter("pos % 2 = 0"), again, rows.filter("pos % 2 = 1"))
    return with_position(both, "user_id", ["slot"], "place")


@query(f"WITH {P}, a AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) AS change FROM p) SELECT user_id, event_id, coalesce(change > 20, FALSE) AS is_cut FROM a")
def cut_by_change(spark, sf):
    return cuts.mark_cuts(events(spark, sf), "user_id", ["pos"], "value", "squared", 400.0).select("user_id", "event_id", "is_cut")
