"""Sources of clips and of metadata about them (SRC01-SRC17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, rates


def signal(spark: SparkSession, path: str, clip: str, order: list[str], value: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A Parquet table as scalar sequences; only the columns named are read (SRC01)."""
    return spark.read.parquet(path).select(clip, *order, F.col(value).cast("double").alias("value"), *keep)


def vectors(spark: SparkSession, path: str, clip: str, order: list[str], vector: str) -> DataFrame:
    """A Parquet table as sequences of arrays."""
    return spark.read.parquet(path).select(clip, *order, F.col(vector).cast("array<double>").alias("vec"))


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file with a path in each line: blank lines are left out, quotes taken off (SRC10)."""
    stripped = lambda text: F.btrim(text, F.lit(" \t\r\n\x0b\x0c"))
    line = stripped(F.regexp_replace(stripped(F.col("value")), r"^[\"']+|[\"']+$", ""))
    return spark.read.text(path).select(line.alias("path")).filter("path <> ''")


def split_inputs(df: DataFrame, column: str) -> DataFrame:
    """A row for each of several inputs in one text (SRC11)."""
    return df.select(F.explode(F.transform(F.split(column, ";"), lambda x: F.trim(x))).alias("path")).filter("path <> ''")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """The readable files of a folder, sorted, with their bytes' length (SRC09, SRT01)."""
    found = spark.read.format("binaryFile").load(path).select("path", "length")
    return found.filter(names.is_readable(F.col("path"))).orderBy("path")


def is_video_url(url: str):
    """Is the host of a URL one of the video site's? (SRC12; nothing is downloaded)"""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host.rlike(r"(^|\.)(youtube\.com|youtu\.be)$")


def image_sequences(paths: DataFrame, path: str = "path", named: int = 10) -> DataFrame:
    """Numbered images by prefix and extension: counts, ends, whether it is whole and of two or more, the pattern by which a whole one
    is read (with the digits of its first path), and at most `named` of the numbers that it lacks (SRC08)."""
    prefix, number, ext = names.sequence_parts(F.col(path))
    digits = F.length(F.regexp_extract(path, r"(\d+)\.[A-Za-z0-9]+$", 1))
    parts = paths.select(prefix.alias("prefix"), number.alias("number"), ext.alias("ext"), F.struct(F.col(path).alias("p"), digits.alias("digits")).alias("_first")).filter("number is not null")
    out = parts.groupBy("prefix", "ext").agg(F.countDistinct("number").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"), F.min("_first")["digits"].alias("_digits"))
    whole = (F.col("n") >= 2) & (F.col("high") - F.col("low") + 1 == F.col("n"))
    pattern = F.concat("prefix", F.lit("%0"), F.col("_digits").cast("string"), F.lit("d."), "ext")
    out = out.withColumn("whole", whole).withColumn("pattern", F.when(whole, pattern)).drop("_digits")
    # a hole begins behind a number whose next one isn't the next
    numbers = parts.select("prefix", "ext", "number").distinct()
    after = F.lead("number").over(Window.partitionBy("prefix", "ext").orderBy("number"))
    holes = numbers.withColumn("_next", after).filter(F.col("_next") > F.col("number") + 1)
    holes = holes.withColumn("missing", F.explode(F.sequence(F.col("number") + 1, F.least(F.col("_next") - 1, F.col("number") + named))))
    first = F.row_number().over(Window.partitionBy("prefix", "ext").orderBy("missing"))
    holes = holes.withColumn("_k", first).filter(F.col("_k") <= named).groupBy("prefix", "ext").agg(F.sort_array(F.collect_list("missing")).alias("missing"))
    return out.join(holes, ["prefix", "ext"], "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<bigint>")))


def probe(clips: DataFrame) -> DataFrame:
    """Metadata rows with the resolved rate, number of rows, aspect ratio and whether hardware can decode them (SRC02, SRC06, SRC07)."""
    c = F.col
    fps = rates.resolve_fps(c("fps_num"), c("fps_den"), c("avg_num"), c("avg_den"), c("is_vfr"), c("fps"))
    out = clips.withColumn("source_fps", fps)
    return out.withColumns(
        {
            "total_frames": rates.total_frames(c("nb_frames"), c("duration"), c("source_fps")),
            "aspect_ratio": rates.aspect_ratio(c("width"), c("height")),
            "hardware": names.can_decode_in_hardware(c("codec"), c("pix_fmt")),
        }
    )
