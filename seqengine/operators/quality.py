"""Comparison of outputs with inputs, sampling, and summaries (JON02, TOP03, AGG01-AGG04, AGG12)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics


def even_samples(df: DataFrame, clip: str, pos: str, k: int) -> DataFrame:
    """At most k rows of each clip at even distances, the first and last among them (TOP03). pos counts from 0."""
    n = df.groupBy(clip).agg(F.count(F.lit(1)).alias("_n"))
    many = F.least(F.lit(k), F.col("_n"))
    at = F.rint(F.col("_i") * (F.col("_n") - 1) / F.greatest(many - 1, F.lit(1))).cast("bigint")
    picks = n.withColumn("_i", F.explode(F.sequence(F.lit(0), many - 1))).select(clip, at.alias(pos)).distinct()
    return df.join(picks, [clip, pos])


def align_nearest(outputs: DataFrame, inputs: DataFrame, clip: str, pos: str) -> DataFrame:
    """outputs with in_pos, the input position at the same share of the clip (JON02). Positions count from 0."""
    n_out = outputs.groupBy(clip).agg((F.max(pos) + 1).alias("_n_out"))
    n_in = inputs.groupBy(clip).agg((F.max(pos) + 1).alias("_n_in"))
    share = F.col(pos) / F.greatest(F.col("_n_out") - 1, F.lit(1))
    return outputs.join(n_out, clip).join(n_in, clip).withColumn("in_pos", F.rint(share * (F.col("_n_in") - 1)).cast("bigint")).drop("_n_out", "_n_in")


def clip_quality(outputs: DataFrame, inputs: DataFrame, clip: str, pos: str, payload: str, k: int = 30, peak: float = 255.0) -> DataFrame:
    """Mean squared error and PSNR of at most k output rows of each clip against the inputs at their share (AGG04)."""
    aligned = even_samples(align_nearest(outputs, inputs, clip, pos), clip, pos, k)
    source = inputs.select(clip, F.col(pos).alias("in_pos"), F.col(payload).alias("_source"))
    each = aligned.join(source, [clip, "in_pos"]).withColumn("_mse", metrics.squared_difference(F.col(payload), F.col("_source")))
    return each.groupBy(clip).agg(F.count(F.lit(1)).alias("samples"), F.avg("_mse").alias("mse"), F.avg(metrics.psnr(F.col("_mse"), peak)).alias("psnr"))


def batch_summary(df: DataFrame, group: str, ok, seconds) -> DataFrame:
    """Runs, failures and mean time of each group (AGG03)."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.avg(F.when(ok, seconds)).alias("mean_seconds"))


def throughput(rows, seconds, factor: float = 1.0):
    """AGG02."""
    return F.when(seconds > 0, rows / seconds * factor)


def best_per_key(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """One row for each key, the largest by the order given (AGG12). The order leaves no ties, so the
    result doesn't depend on that of the rows."""
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *columns)).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in columns))


def top_k(df: DataFrame, clip: str, order: list, k: int) -> DataFrame:
    """The first k rows of each clip in an order (TOP01, STB10)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(clip).orderBy(*order))).filter(F.col("rank") <= k)


def suppress(df: DataFrame, clip: str, x: str, y: str, score: str, radius: float) -> DataFrame:
    """Points without a better one at most `radius` away in both directions (STB10). Points meet by cells of the grid."""
    near = F.explode(F.array(*(F.struct((F.floor(F.col(x) / radius) + i).alias("gx"), (F.floor(F.col(y) / radius) + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    others = df.select(clip, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(score).alias("_score"), near.alias("_g")).select(F.col(clip).alias("_clip"), "_x", "_y", "_score", "_g.gx", "_g.gy")
    own = df.withColumn("_gx", F.floor(F.col(x) / radius)).withColumn("_gy", F.floor(F.col(y) / radius))
    same = (F.col(clip) == F.col("_clip")) & (F.col("_gx") == F.col("gx")) & (F.col("_gy") == F.col("gy"))
    better = (F.abs(F.col(x) - F.col("_x")) <= radius) & (F.abs(F.col(y) - F.col("_y")) <= radius) & (F.col("_score") > F.col(score))
    return own.join(others, same & better, "left_anti").drop("_gx", "_gy")


def point_distances(points: DataFrame, others: DataFrame, pair: str, point: str, vector: str) -> DataFrame:
    """(pair, point, other, distance) for the points of two frames of a pair, which have a few hundred points each (JON07)."""
    far = others.select(F.col(pair).alias("_pair"), F.col(point).alias("other"), F.col(vector).alias("_other"))
    met = points.select(pair, point, vector).join(far, F.col(pair) == F.col("_pair"))
    squared = F.aggregate(F.zip_with(vector, "_other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, d: t + d)
    return met.select(pair, point, "other", F.sqrt(squared).alias("distance"))


def mutual_matches(distances: DataFrame, pair: str, point: str, other: str = "other", distance: str = "distance") -> DataFrame:
    """Points that are each other's nearest; of equal distances the first by name (JON07)."""
    nearest = distances.groupBy(pair, point).agg(F.min(F.struct(distance, other)).alias("n")).select(pair, point, f"n.{other}", f"n.{distance}")
    back = distances.groupBy(pair, other).agg(F.min(F.struct(distance, point)).alias("n")).select(pair, other, f"n.{point}")
    return nearest.join(back, [pair, point, other])


def ratio_test(matches: DataFrame, pair: str, point: str, distance: str, ratio: float = 0.8, least: int = 10) -> DataFrame:
    """Matches whose nearest distance is well below the second, of pairs with enough of them (FIL10)."""
    rank = F.row_number().over(Window.partitionBy(pair, point).orderBy(distance))
    near = matches.withColumn("_r", rank).filter("_r <= 2").groupBy(pair, point).agg(F.min(F.when(F.col("_r") == 1, F.col(distance))).alias("d1"), F.min(F.when(F.col("_r") == 2, F.col(distance))).alias("d2"))
    kept = near.filter(F.col("d1") < ratio * F.col("d2"))
    return kept.join(kept.groupBy(pair).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(pair), pair)


def missing_numbers(df: DataFrame, group: str, number: str) -> DataFrame:
    """(group, missing): the numbers between a group's least and greatest that it lacks (SRC08, SET03)."""
    spans = df.groupBy(group).agg(F.min(number).alias("_low"), F.max(number).alias("_high"))
    every = spans.select(group, F.explode(F.sequence("_low", "_high")).alias(number))
    return every.join(df.select(group, number), [group, number], "left_anti").withColumnRenamed(number, "missing")


def ordered_union(*parts: DataFrame) -> DataFrame:
    """All rows of parts with the same columns (SET01, SET02, SRC11); their order is that of their slots."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def outcome(delivered, expected, error, produces_output, output_bytes):
    """Whether a run succeeded (SNK17): no error, unless all expected rows were delivered; and an output that isn't empty."""
    whole = F.coalesce(expected.isNotNull() & (delivered >= expected), F.lit(False))
    return (error.isNull() | whole) & (delivered >= F.coalesce(expected, F.lit(0))) & (~produces_output | F.coalesce(output_bytes > 0, F.lit(False)))


def playable(formats: DataFrame, least: int = 240) -> DataFrame:
    """Formats with a size, of at least `least` rows of pixels, and a real video codec (FIL07)."""
    return formats.filter(F.col("width").isNotNull() & (F.col("height") >= least) & F.col("vcodec").isNotNull() & (F.col("vcodec") != "none"))


def resolutions(formats: DataFrame, key: str) -> DataFrame:
    """(key, heights): the distinct heights of each key, the largest first (SRT02, AGG13)."""
    return formats.groupBy(key).agg(F.sort_array(F.collect_set("height"), asc=False).alias("heights"))


def preview(values, most: int = 5):
    """The first of a list, and how many more there are (LIM02)."""
    shown = F.array_join(F.slice(values, 1, most), ", ")
    return F.when(F.size(values) > most, F.concat(shown, F.lit(", … "), F.size(values) - most, F.lit(" more"))).otherwise(shown)


def two_clusters(df: DataFrame, value: str, rounds: int = 20, out: str = "cluster") -> DataFrame:
    """df with 0 or 1: the nearer of two means of a number, from its least and greatest value on, until they stay (AGG15).

    Only the two means come to the driver. A null value has no cluster.
    """
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    a, b = ends["a"], ends["b"]
    for _ in range(rounds if a is not None else 0):
        low = F.abs(F.col(value) - F.lit(a)) <= F.abs(F.col(value) - F.lit(b))
        means = df.agg(F.avg(F.when(low, F.col(value))).alias("a"), F.avg(F.when(~low, F.col(value))).alias("b")).first()
        new = (means["a"], means["b"] if means["b"] is not None else b)
        if new == (a, b):
            break
        a, b = new
    near = F.abs(F.col(value) - F.lit(a).cast("double")) <= F.abs(F.col(value) - F.lit(b).cast("double"))
    return df.withColumn(out, F.when(near, 0).when(~near, 1))


def longest_known(df: DataFrame, name: str, table: DataFrame, key: str, separator: str = "-", most_bytes: int = 16 << 20) -> DataFrame:
    """df with `table`'s columns for the longest beginning of a name that it knows, cut at separators from the end (JON05).

    A name meets the table once for each of its beginnings, and the longest that is met stays; without any, the columns are
    null. key is unique in table, which goes to every task if its text has at most `most_bytes`. Columns of table must not be in df.
    """
    words = F.split(name, re.escape(separator))
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), separator))
    names = df.select(name).filter(F.col(name).isNotNull()).distinct()
    tried = names.select(name, F.explode(starts).alias("_start"))
    columns = table.columns
    size = table.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*columns)))), F.lit(0))).first()[0]
    met = tried.join(F.broadcast(table) if size <= most_bytes else table, F.col("_start") == F.col(key))
    best = met.groupBy(name).agg(F.max_by(F.struct(*columns), F.length("_start")).alias("_best")).select(F.col(name).alias("_name"), "_best")
    found = df.join(best, F.col(name) == F.col("_name"), "left")
    return found.select(*df.columns, *(F.col(f"_best.{c}").alias(c) for c in columns))
