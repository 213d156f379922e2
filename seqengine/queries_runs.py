"""Registered queries of sources, sinks, progress, jobs' options and robust summaries over the given tables."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from .functions import names
from .functions.weights import shared_samples
from .operators import naming, normalise, quality, resample
from .plans import spec
from .queries import P, QUERIES, SQL, V, _gaps_sql, _robust_line_sql, events, query, r6, thumbs
from .queries_meta import parts
from .session import scratch_folder
from .sources import pictures, readers, writers
from .streaming import processors, progress

# --- pictures, lists and texts that are written and read again ----------------------------


@query(f"WITH {V}, o AS (SELECT *, row_number() OVER (ORDER BY label, vec_id) - 1 AS number FROM v) SELECT CAST(number AS BIGINT) AS number, CAST(8 AS INT) AS height, CAST(8 AS INT) AS width, CAST(list_sum(list_transform(vec, lambda x: CAST(round(x * 65535, 0) AS BIGINT))) AS BIGINT) AS total FROM o")
def pictures_round_trip(spark, sf):
    """Vectors as numbered pictures of 16 bits, written by tasks and read by ranges of numbers."""
    pictures.register(spark)
    # numbers from counts by label, so that no task sees all rows
    rows = thumbs(spark, sf)
    before = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select(F.col("label").alias("_label"), (F.coalesce(F.sum("_n").over(quality.Window.orderBy("label").rowsBetween(quality.Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    pixels = F.transform("vec", lambda x: F.round(x * 65535).cast("int"))
    made = rows.join(before, F.col("label") == F.col("_label")).select((F.col("_before") + F.col("pos") - 1).alias("number"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.lit(16).alias("depth"), pixels.alias("pixels"))
    where = f"{scratch_folder(spark, 'pictures')}/frames_%06d.png"
    made.write.format("numbered_pictures").mode("append").save(where)
    found = spark.read.format("numbered_pictures").option("per_task", 64).load(where)
    return found.select("number", "height", "width", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"WITH {P}, c AS (SELECT pos, value, lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS prev FROM p WHERE user_id % 10 = 3) SELECT DISTINCT round(pos / 25.0, 2) AS cut_sec FROM c WHERE (value - prev) * (value - prev) > 400")
def cut_list(spark, sf):
    """The seconds of the cuts in the clips of some users, as a text file with a number a line, read again."""
    rows = events(spark, sf).filter("user_id % 10 = 3")
    before = F.lag("value").over(quality.Window.partitionBy("user_id").orderBy("pos"))
    found = rows.withColumn("jump", (F.col("value") - before) * (F.col("value") - before)).filter("jump > 400").select(F.round(F.col("pos") / 25, 2).alias("cut_sec")).distinct()
    where = f"{scratch_folder(spark, 'cuts')}/list"
    writers.write_cut_list(found, where)
    return spark.read.text(where).select(F.col("value").cast("double").alias("cut_sec"))


@query("SELECT p_name || ' ' || p_partkey || '.mp4' AS path FROM part WHERE p_partkey % 5 <> 0")
def listed_paths(spark, sf):
    """A text file of paths with blank lines, quotes and blanks around some, and what is read of it."""
    path = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".mp4"))
    kind = F.col("p_partkey") % 5
    line = F.when(kind == 0, F.lit("  ")).when(kind == 1, path).when(kind == 2, F.concat(F.lit('"'), path, F.lit('"'))).when(kind == 3, F.concat(F.lit("  '"), path, F.lit("' "))).otherwise(F.concat(path, F.lit("\t")))
    where = f"{scratch_folder(spark, 'paths')}/list"
    parts(spark, sf).select(line.alias("value")).write.text(where)
    return readers.path_list(spark, where)


# --- streams and their progress -----------------------------------------------------------


@query("SELECT user_id, event_id, CAST(value AS DOUBLE) AS value FROM events")
def stream_sampled(spark, sf):
    """All rows of a stream, handed over by the clock; the query is cancelled with time for the batch in work."""
    stream = processors.source(spark, sf, "events.parquet").select("user_id", "event_id", F.col("value").cast("double").alias("value"))
    folder, shown = scratch_folder(spark, "sampled"), threading.Event()

    def show(rows):
        rows.write.mode("append").parquet(f"{folder}/shown")
        shown.set()

    query = processors.sample_by_clock(stream, show, "1 second", f"{folder}/state")
    query.processAllAvailable()
    if not processors.stop_within(query, 30) or not shown.is_set():
        raise RuntimeError("the stream was cut off")
    return spark.read.schema(stream.schema).parquet(f"{folder}/shown")


@query("SELECT CAST(least((day(ts) - 1) // 6, 4) AS BIGINT) AS batch, count(*) AS rows, count(*) AS seen, count(*) FILTER (value > 20) AS above FROM events GROUP BY ALL")
def stream_progress(spark, sf):
    """How many rows each micro-batch read, and what its observed measures say, from the progress of the query."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "value")
    lot = F.least(F.floor((F.dayofmonth("ts") - 1) / 6), F.lit(4))
    folder = scratch_folder(spark, "progress")
    with progress.watching(spark) as seen:
        for k in range(5):
            rows.filter(lot == k).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            measured = progress.measured(stream, "measures", seen=F.count(F.lit(1)), above=F.count_if(F.col("value") > 20))
            run = measured.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            run.awaitTermination()
            if not seen.wait(run):
                raise RuntimeError("the progress did not come")
        table = seen.table(spark)
    pick = lambda name: F.max(F.when(F.col("measure") == f"measures.{name}", F.col("value"))).cast("long").alias(name)
    return table.groupBy("batch").agg(F.max("rows").alias("rows"), pick("seen"), pick("above"))


# --- options, samples and names -----------------------------------------------------------


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS total, count(*) FILTER (json_extract(props, '$.absent') IS NULL) AS without FROM events GROUP BY event_type")
def job_options(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_type", spec.job_options(F.col("props"), "k long, absent string").alias("o"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("o.k").alias("total"), F.count_if(F.col("o.absent").isNull()).alias("without"))


#: Orders as jobs, whose options are JSON.
JOBS = """jobs AS (SELECT o_orderkey, '{' || concat_ws(', ', CASE WHEN o_orderkey % 2 = 0 THEN '"upscale_factor": ' || o_orderkey % 5 END, CASE WHEN o_orderkey % 3 = 0 THEN '"upscale": ' || CASE WHEN o_orderkey % 4 < 2 THEN 'false' ELSE 'true' END END,
  CASE WHEN o_orderkey % 5 = 0 THEN '"dedup_sens": 35' END, CASE WHEN o_orderkey % 7 = 0 THEN '"moblur_strength": "equal", "odd_' || o_orderkey % 3 || '": 1' END, '"input": "a.mp4"') || '}' AS text FROM orders)"""


def _jobs(spark, sf):
    key = F.col("o_orderkey")
    given = [
        F.when(key % 2 == 0, F.concat(F.lit('"upscale_factor": '), (key % 5).cast("string"))),
        F.when(key % 3 == 0, F.concat(F.lit('"upscale": '), F.when(key % 4 < 2, F.lit("false")).otherwise(F.lit("true")))),
        F.when(key % 5 == 0, F.lit('"dedup_sens": 35')),
        F.when(key % 7 == 0, F.concat(F.lit('"moblur_strength": "equal", "odd_'), (key % 3).cast("string"), F.lit('": 1'))),
        F.lit('"input": "a.mp4"'),
    ]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *given), F.lit("}"))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", spec.job_options(text, "map<string, string>").alias("options"))


@query(
    f"""WITH {JOBS}, k AS (SELECT o_orderkey, text, json_keys(text) AS keys FROM jobs)
SELECT o_orderkey, concat_ws(',', CASE WHEN list_contains(keys, 'dedup_sens') THEN 'dedup' END, CASE WHEN list_contains(keys, 'moblur_strength') THEN 'moblur' END,
  CASE WHEN coalesce(text LIKE '%"upscale": true%', FALSE) OR (list_contains(keys, 'upscale_factor') AND text NOT LIKE '%"upscale": false%') THEN 'upscale' END) AS capabilities,
  coalesce(array_to_string(list_sort(list_filter(keys, lambda k: k LIKE 'odd%')), ','), '') AS extra FROM k"""
)
def implied_capabilities(spark, sf):
    jobs = _jobs(spark, sf)
    known = sorted({*spec.IMPLIES, *spec.IMPLIES.values(), "input"})
    return jobs.select("o_orderkey", F.concat_ws(",", spec.job_capabilities(F.col("options"))).alias("capabilities"), F.concat_ws(",", spec.unknown_options(F.col("options"), known)).alias("extra"))


COLOURS = ["bt709", "bt2020", "bt2020nc", "bt2020c", "smpte170m", None, "unknown"]
CURVES = ["smpte2084", "arib-std-b67", "bt709", "gamma22", None, "bt2020-10", "bt2020c", "unknown", "linear"]


@query(
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {[x or 'none' for x in COLOURS]}[CAST(l_partkey % 7 AS INT) + 1] AS space, {[x or 'none' for x in CURVES]}[CAST(l_suppkey % 9 AS INT) + 1] AS curve FROM lineitem),
w AS (SELECT *, space IN ('bt2020', 'bt2020nc', 'bt2020c') OR curve IN ('bt2020', 'bt2020nc', 'bt2020c') AS wide FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN wide THEN 'bt2020nc' ELSE 'bt709' END AS matrix, CASE WHEN wide THEN 'bt2020' ELSE 'bt709' END AS primaries,
  CASE WHEN NOT wide THEN 'bt709' WHEN curve IN ('smpte2084', 'arib-std-b67', 'bt2020-10', 'bt709', 'linear') THEN curve END AS curve FROM w"""
)
def colour_conversions(spark, sf):
    pick = lambda by, values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col(by) % len(values) + 1).cast("int"))
    made = names.colour_conversion(pick("l_partkey", COLOURS), F.lit("yuv420p"), pick("l_suppkey", CURVES))
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", made.alias("c")).select("l_orderkey", "l_linenumber", "l_partkey", "c.*")


@query(
    r"""WITH p AS (SELECT DISTINCT 'o' || l_orderkey // 4 || '/f_' AS prefix, 7 * (l_orderkey % 4) + l_linenumber AS number FROM lineitem), g AS (SELECT prefix, count(*) AS n, min(number) AS low, max(number) AS high FROM p GROUP BY prefix),
m AS (SELECT e.prefix, e.missing, row_number() OVER (PARTITION BY e.prefix ORDER BY e.missing) AS k FROM (SELECT prefix, unnest(range(low, high + 1)) AS missing FROM g) e LEFT JOIN p ON e.prefix = p.prefix AND e.missing = p.number WHERE p.number IS NULL),
h AS (SELECT prefix, array_to_string(list(missing ORDER BY missing), ',') AS missing FROM m WHERE k <= 10 GROUP BY prefix)
SELECT g.prefix, n, low, high, n >= 2 AND high - low + 1 = n AS whole, CASE WHEN n >= 2 AND high - low + 1 = n THEN g.prefix || '%05d.png' END AS pattern, coalesce(missing, '') AS missing FROM g LEFT JOIN h ON g.prefix = h.prefix"""
)
def numbered_sequences(spark, sf):
    """Lines of four orders as the numbers of a sequence of images: whole ones have a pattern, others the first ten numbers that they lack."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    number = 7 * (F.col("l_orderkey") % 4) + F.col("l_linenumber")
    path = F.format_string("o%d/f_%05d.png", F.floor(F.col("l_orderkey") / 4), number.cast("long"))
    found = readers.image_sequences(rows.select(path.alias("path")))
    return found.select("prefix", "n", "low", "high", "whole", "pattern", F.concat_ws(",", F.transform("missing", lambda x: x.cast("string"))).alias("missing"))


# --- interpolation by method and before or after a projection -----------------------------

SHARES = {"linear": "t", "hold": "0", "nearest": "CASE WHEN t < 0.5 THEN 0 ELSE 1 END", "smooth": "t * t * (3 - 2 * t)"}


def _by_method(method):
    def run(spark, sf):
        out = resample.interpolate(events(spark, sf), "user_id", "pos", "value", 5, 2, method=method)
        return out.withColumn("value", r6("value"))

    return run


for _method, _share in SHARES.items():
    if _method != "linear":
        QUERIES[f"interpolate_{_method}"] = _by_method(_method)
        SQL[f"interpolate_{_method}"] = f"WITH {P}, {_gaps_sql('p', 5, 2)} SELECT user_id, pos * 5 // 2 AS slot, 'real' AS kind, round(value, 6) AS value FROM p UNION ALL SELECT user_id, slot, 'interp', round(prev_value + ({_share}) * (value - prev_value), 6) FROM g"


@query(
    f"""WITH {V}, n AS (SELECT *, lag(vec) OVER (PARTITION BY label ORDER BY pos) AS prev FROM v)
SELECT label, 2 * pos AS slot, round(list_sum(list_transform(vec, lambda x: x * x)), 6) AS first, round(list_sum(list_transform(vec, lambda x: x * x)), 6) AS last FROM v
UNION ALL SELECT label, 2 * pos - 1, round(list_sum(list_transform(range(1, 65), lambda i: pow((prev[i] + vec[i]) / 2, 2))), 6), round(list_sum(list_transform(range(1, 65), lambda i: (prev[i] * prev[i] + vec[i] * vec[i]) / 2)), 6) FROM n WHERE prev IS NOT NULL"""
)
def interpolate_first_or_last(spark, sf):
    """Twice the rate around a projection that isn't linear (the squares): interpolation before and after it."""
    rows, total = thumbs(spark, sf), F.aggregate("value", F.lit(0.0), lambda a, x: a + x)
    made = [resample.interpolate_around(rows, "label", "pos", "vec", 2, 1, lambda v: F.transform(v, lambda x: x * x), first).select("label", "slot", r6(total).alias(name)) for first, name in ((True, "first"), (False, "last"))]
    return made[0].join(made[1], ["label", "slot"])


ANGLES = [0.0, 90.0, 180.0, 360.0]


@query(
    """WITH j AS (SELECT o_orderkey, 2 + o_orderkey % 7 AS factor, [0, 90, 180, 360][CAST(o_orderkey % 4 AS INT) + 1] / 720.0::DOUBLE AS half FROM orders),
k AS (SELECT *, unnest(range(1, factor)) AS k FROM j), n AS (SELECT * FROM k WHERE k <= floor(factor * half) OR k >= greatest(1, ceil(factor * (1 - half))))
SELECT j.o_orderkey, CAST(count(k) AS INT) AS n, round(coalesce(sum(k / CAST(j.factor AS DOUBLE)), 0), 6) AS total FROM j LEFT JOIN n USING (o_orderkey) GROUP BY j.o_orderkey"""
)
def shared_shutter_samples(spark, sf):
    """Orders as jobs with a factor and a shutter angle: the times of an interval that a window on either side needs."""
    known = F.array(*(F.array(*(F.array(*map(F.lit, shared_samples(2 + f, a))).cast("array<double>") for a in ANGLES)) for f in range(7)))
    at = F.element_at(F.element_at(known, (F.col("o_orderkey") % 7 + 1).cast("int")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", at.alias("times"))
    return rows.select("o_orderkey", F.size("times").alias("n"), r6(F.aggregate("times", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(
    r"""WITH n AS (SELECT p_partkey, p_brand || '.mp4' AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
t AS (SELECT DISTINCT p_brand || '.mp4' AS name FROM part WHERE p_partkey % 50 = 7)
SELECT p_partkey, CASE WHEN k - CASE WHEN t.name IS NULL THEN 1 ELSE 0 END = 0 THEN n.name ELSE left(n.name, length(n.name) - 4) || '-' || (k - CASE WHEN t.name IS NULL THEN 1 ELSE 0 END) || '.mp4' END AS unique_name FROM n LEFT JOIN t USING (name)"""
)
def names_beside_those_on_disk(spark, sf):
    rows = parts(spark, sf).select("p_partkey", F.concat("p_brand", F.lit(".mp4")).alias("name"))
    there = rows.filter("p_partkey % 50 = 7").select("name")
    return names.unique_names(rows, "name", ["p_partkey"], taken=there).select("p_partkey", "unique_name")


@query(SQL["names_beside_those_on_disk"])
def names_given_in_rounds(spark, sf):
    """The same names for families of any size: ranks first, then rounds in which rows move past names that others hold."""
    rows = parts(spark, sf).select("p_partkey", F.concat("p_brand", F.lit(".mp4")).alias("name"))
    there = rows.filter("p_partkey % 50 = 7").select("name")
    return naming.unique_names_spread(rows, "name", ["p_partkey"], taken=there).select("p_partkey", "unique_name")


# --- robust summaries ---------------------------------------------------------------------


@query(
    f"""WITH g AS (SELECT l_suppkey, list({{'x': CAST(l_quantity AS DOUBLE), 'y': CAST(l_extendedprice AS DOUBLE) / 1000}} ORDER BY l_orderkey, l_linenumber, l_partkey) AS pts FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, len(pts) AS n, round(a, 6) AS scale, round(b, 6) AS shift FROM ({_robust_line_sql('SELECT * FROM g')})"""
)
def robust_lines(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"))
    return normalise.robust_lines(rows, "l_suppkey", "x", "y").select("l_suppkey", "n", r6("scale").alias("scale"), r6("shift").alias("shift"))


@query(
    """WITH RECURSIVE v AS (SELECT event_id, CAST(value AS DOUBLE) AS v FROM events), m AS (SELECT 0 AS k, min(v) AS a, max(v) AS b FROM v UNION ALL
SELECT k + 1, (SELECT avg(v) FROM v WHERE abs(v - a) <= abs(v - b)), coalesce((SELECT avg(v) FROM v WHERE abs(v - a) > abs(v - b)), b) FROM m WHERE k < 20)
SELECT event_id, CASE WHEN abs(v - a) <= abs(v - b) THEN 0 ELSE 1 END AS cluster FROM v, (SELECT * FROM m WHERE k = 20)"""
)
def two_clusters(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("value").cast("double").alias("v"))
    return quality.two_clusters(rows, "v").select("event_id", F.col("cluster").cast("int").alias("cluster"))
