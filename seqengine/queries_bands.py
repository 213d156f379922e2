"""Registered queries of matched points, halos, band joins and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import bands, quality, smooth, transforms
from .queries import P, V, events, query, r6, thumbs

# --- transforms of pairs ------------------------------------------------------------------

#: Points of each supplier, turned and shifted by its own amounts; three of ten are somewhere else.
PLANTED = """m AS (SELECT l_suppkey, x, y, cos(turn) * x - sin(turn) * y + l_suppkey % 7 + CASE WHEN wrong THEN 40 + l_partkey % 60 ELSE 0 END AS u, sin(turn) * x + cos(turn) * y - l_suppkey % 5 - CASE WHEN wrong THEN 30 + l_partkey % 45 ELSE 0 END AS v, 1 - (l_linenumber - 1) / 10.0::DOUBLE AS likeness
FROM (SELECT *, CAST(l_extendedprice AS DOUBLE) / 500 AS x, CAST(l_quantity AS DOUBLE) * 4 AS y, (l_suppkey % 10) / 100.0::DOUBLE AS turn, (l_orderkey + l_linenumber) % 10 < 3 AS wrong FROM lineitem))"""


def _fit_sql(source: str, out: str, weight: str, with_size: bool) -> str:
    """out: source with a, b, dx, dy of the least weighted squares of its supplier, and how far each match is off."""
    across = "sum(w * ((x - mx) * (v - mv) - (y - my) * (u - mu))) OVER s"
    along = "sum(w * ((x - mx) * (u - mu) + (y - my) * (v - mv))) OVER s"
    spread = "sum(w * ((x - mx) * (x - mx) + (y - my) * (y - my))) OVER s" if with_size else "sqrt(pow(along, 2) + pow(across, 2))"
    window = "WINDOW s AS (PARTITION BY l_suppkey)"
    return f"""{out}0 AS (SELECT *, sum(w) OVER s AS sw, sum(w * x) OVER s / sum(w) OVER s AS mx, sum(w * y) OVER s / sum(w) OVER s AS my, sum(w * u) OVER s / sum(w) OVER s AS mu, sum(w * v) OVER s / sum(w) OVER s AS mv FROM (SELECT *, {weight} AS w FROM {source}) {window}),
{out}1 AS (SELECT *, {along} AS along, {across} AS across FROM {out}0 {window}), {out}2 AS (SELECT *, {spread} AS spread FROM {out}1 {window}),
{out}3 AS (SELECT * EXCLUDE (spread, along, across), along / spread AS a, across / spread AS b FROM {out}2), {out}4 AS (SELECT *, mu - (a * mx - b * my) AS dx, mv - (b * mx + a * my) AS dy FROM {out}3),
{out} AS (SELECT * EXCLUDE (w, sw, mx, my, mu, mv), sqrt(pow(a * x - b * y + dx - u, 2) + pow(b * x + a * y + dy - v, 2)) AS off FROM {out}4)"""


def _robust_sql(rounds: int, with_size: bool) -> str:
    parts = [PLANTED, _fit_sql("m", "f", "1::DOUBLE", with_size), "r0 AS (SELECT *, greatest(2 * avg(off) OVER (PARTITION BY l_suppkey), 2.5) AS s FROM f)"]
    for k in range(rounds):
        parts.append(_fit_sql(f"(SELECT * EXCLUDE (a, b, dx, dy, off), off AS was FROM r{k})", f"g{k}", "1 / pow(1 + pow(was / s, 2), 2)", with_size))
        parts.append(f"r{k + 1} AS (SELECT * EXCLUDE (s, was), greatest(s / 2, 2.5) AS s FROM g{k})")
    parts.append(_fit_sql(f"(SELECT * EXCLUDE (a, b, dx, dy, off), off <= 2.5 AS fits FROM r{rounds})", "last", "CASE WHEN fits THEN 1::DOUBLE ELSE 0 END", with_size))
    return "WITH " + ",\n".join(parts)


def _planted(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    turn, wrong = (F.col("l_suppkey") % 10) / 100, (F.col("l_orderkey") + F.col("l_linenumber")) % 10 < 3
    x, y = F.col("l_extendedprice").cast("double") / 500, F.col("l_quantity").cast("double") * 4
    u = F.cos(turn) * x - F.sin(turn) * y + F.col("l_suppkey") % 7 + F.when(wrong, 40 + F.col("l_partkey") % 60).otherwise(0)
    v = F.sin(turn) * x + F.cos(turn) * y - F.col("l_suppkey") % 5 - F.when(wrong, 30 + F.col("l_partkey") % 45).otherwise(0)
    return rows.select("l_suppkey", x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"), (1 - (F.col("l_linenumber") - 1) / 10).alias("likeness"))


def _rounded(found):
    return found.select("l_suppkey", "n", "inliers", *((r6(c) + 0.0).alias(c) for c in ("dx", "dy", "angle", "size", "score")))


TRANSFORM = "round(any_value(dx), 6) + 0::DOUBLE AS dx, round(any_value(dy), 6) + 0::DOUBLE AS dy, round(any_value(atan2(b, a)), 6) + 0::DOUBLE AS angle, round(any_value(sqrt(a * a + b * b)), 6) AS size"


@query(f"WITH {PLANTED}, {_fit_sql('m', 'f', '1::DOUBLE', True)} SELECT l_suppkey, count(*) AS n, count(*) AS inliers, {TRANSFORM}, round(0.7 + 0.3 * avg(likeness), 6) AS score FROM f GROUP BY l_suppkey HAVING count(*) >= 10")
def transforms_plain(spark, sf):
    found = transforms.pair_transforms(_planted(spark, sf), "l_suppkey", "x", "y", "u", "v", "likeness", rounds=0)
    return _rounded(found).filter("n >= 10")


@query(f"{_robust_sql(10, False)} SELECT l_suppkey, count(*) AS n, count(*) FILTER (fits) AS inliers, {TRANSFORM}, round(0.7 * count(*) FILTER (fits) / count(*) + 0.3 * avg(likeness) FILTER (fits), 6) AS score FROM last GROUP BY l_suppkey HAVING count(*) >= 10")
def transforms_robust(spark, sf):
    found = transforms.pair_transforms(_planted(spark, sf), "l_suppkey", "x", "y", "u", "v", "likeness", with_size=False)
    return _rounded(found).filter("n >= 10")


# --- halos and bands ----------------------------------------------------------------------


def _taps(weight: str, x: str) -> str:
    return " + ".join(f"CASE WHEN i + ({d}) BETWEEN 1 AND len(given) THEN {weight} * exp({-d * d}::DOUBLE) * {x.replace('$', f'i + ({d})')} ELSE 0 END" for d in (-3, -2, -1, 1, 2, 3))


@query(
    f"""WITH RECURSIVE {P}, j AS (SELECT user_id, 0 AS k, given, given AS now FROM (SELECT user_id, list(value ORDER BY pos) AS given FROM p GROUP BY user_id) UNION ALL
SELECT user_id, k + 1, given, list_transform(range(1, len(given) + 1), lambda i: (given[i] + {_taps('100', 'now[$]')}) / (1 + {_taps('100', '1')})) FROM j WHERE k < 4 AND len(given) >= 12)
SELECT p.user_id, pos, round(now[pos], 6) AS smoothed FROM p JOIN (SELECT user_id, arg_max(now, k) AS now FROM j GROUP BY user_id) l ON p.user_id = l.user_id"""
)
def smoothed_over_halos(spark, sf):
    """Chunks of ten rows with halos of twelve, as four rounds look three rows further each."""
    out = smooth.jacobi_paths(events(spark, sf), "user_id", "pos", "value", rounds=4, core=10)
    return out.select("user_id", "pos", r6("smoothed").alias("smoothed"))


@query(f"WITH {V} SELECT a.label, a.pos, b.pos AS other_pos, round(list_cosine_similarity(a.vec, b.vec), 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND b.pos BETWEEN a.pos + 1 AND a.pos + 5")
def self_similarity(spark, sf):
    found = bands.self_similarity(thumbs(spark, sf), "label", "pos", "vec", 5)
    return found.withColumn("similarity", r6("similarity"))


@query(f"WITH {V}, s AS (SELECT a.label, a.pos, b.pos - a.pos AS step, list_cosine_similarity(a.vec, b.vec) AS x FROM v a JOIN v b ON a.label = b.label AND abs(b.pos - a.pos) <= 5) SELECT label, pos, CAST(11 AS INT) AS n, round(sum(x * (step + 6)), 6) AS total FROM s GROUP BY label, pos")
def similarity_bands(spark, sf):
    rows = thumbs(spark, sf)
    out = bands.lookup_rows(bands.self_similarity(rows, "label", "pos", "vec", 5), rows, "label", "pos", 5)
    total = F.aggregate(F.transform("band", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("label", "pos", F.size("band").alias("n"), r6(total).alias("total"))


# --- look-ups -----------------------------------------------------------------------------

METHODS = """t AS (SELECT method, min(p_partkey) AS first_part FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN regexp_extract(p_type, '^\\S+ \\S+') ELSE regexp_extract(p_type, '^\\S+') END AS method FROM part WHERE p_size <= 10) GROUP BY method)"""


@query(
    f"""WITH {METHODS}, c AS (SELECT p_partkey, method, first_part, row_number() OVER (PARTITION BY p_partkey ORDER BY length(method) DESC) AS k FROM part JOIN t ON p_type = method OR starts_with(p_type, method || ' '))
SELECT part.p_partkey, method, first_part FROM part LEFT JOIN (SELECT * FROM c WHERE k = 1) c ON part.p_partkey = c.p_partkey"""
)
def longest_known_methods(spark, sf):
    """Each part's type looked up among types and beginnings of types, the longest first."""
    rows = spark.read.parquet(f"{sf}/part.parquet")
    beginning = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.regexp_extract("p_type", r"^\S+ \S+", 0)).otherwise(F.regexp_extract("p_type", r"^\S+", 0))
    table = rows.filter("p_size <= 10").select(beginning.alias("method"), "p_partkey").groupBy("method").agg(F.min("p_partkey").alias("first_part"))
    return quality.longest_known(rows.select("p_partkey", "p_type"), "p_type", table, "method", " ").select("p_partkey", "method", "first_part")
