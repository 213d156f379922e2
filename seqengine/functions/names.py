"""Names of outputs, texts and choices."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..operators.clips import fold

#: Extensions of readable inputs, and of media that are named but skipped.
READABLE = ["mp4", "mkv", "webm", "avi", "mov", "gif", "m4v", "m2ts", "mts", "mpg", "mpeg", "m2v", "flv", "wmv", "ogv"]
SKIPPED = ["ts", "vob", "asf", "rm", "rmvb", "3gp", "divx", "mxf", "f4v", "y4m"]
#: Codecs that hardware decoders don't take.
SOFTWARE_CODECS = ["rawvideo", "ffv1", "ffvhuff", "huffyuv", "lagarith", "utvideo", "qtrle", "qdraw", "8bps", "cinepak", "msrle", "msvideo1", "rle", "vp6", "vp6a", "vp6f"]


#: Characters that file systems refuse.
UNSAFE = r'[<>:"/\\|?*\x00-\x1F]'


def safe_name(name: Column) -> Column:
    """Characters that file systems refuse become underscores; spaces stay (SNK11)."""
    return F.regexp_replace(name, UNSAFE, "_")


def output_name(stem: Column, features: list[tuple[str, Column | None]], extension: str) -> Column:
    """stem-Feature{value}… in the given order, features of null are left out (SNK11)."""
    parts = [safe_name(stem)] + [F.when(v.isNotNull(), F.concat(F.lit(f"-{n}"), v.cast("string"))) if v is not None else F.lit(f"-{n}") for n, v in features]
    return F.concat(F.concat_ws("", *parts), F.lit(f".{extension}"))


def unique_names(df: DataFrame, name: str, order: list[str], out: str = "unique_name", taken: DataFrame | None = None) -> DataFrame:
    """Adds a name that is unique in df: one that is taken gets the least of -1, -2, … before its extension that is free (SNK12).

    Names are handed out in order among those that can meet: equal but for such suffixes. The
    names of one such family are kept in memory by the task that deals with it. A null name
    stays null. taken: a table of names (one column) that are there already, as on disk, and go to no row.
    """
    def family(of: Column) -> Column:
        root, ext = F.regexp_extract(of, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(of, r"^(.*?)(\.[^./]*)?$", 2)
        return F.coalesce(F.concat(F.regexp_replace(root, r"(-\d+)+$", ""), F.lit("\0"), ext), F.lit(""))

    rows = df.withColumn("_family", family(F.col(name))).withColumn("_there", F.lit(False))
    if taken is not None:
        there = taken.select(F.col(taken.columns[0]).alias(name)).filter(F.col(name).isNotNull()).distinct()
        there = there.withColumn("_family", family(F.col(name))).withColumn("_there", F.lit(True))
        # only those that can meet a row
        rows = rows.unionByName(there.join(rows.select("_family").distinct(), "_family", "left_semi"), allowMissingColumns=True)

    def step(rows, state):
        taken, following = state or (set(), {})
        made = []
        for one, there in zip(rows[name].tolist(), rows["_there"].tolist(), strict=True):
            if there or one is None or one != one:
                if there:
                    taken.add(one)
                made.append(None)
                continue
            free = one
            if one in taken:
                dot = one.rfind(".", one.rfind("/") + 1)
                root, ext = (one[:dot], one[dot:]) if dot >= 0 else (one, "")
                k = following.get(one, 1)
                while (free := f"{root}-{k}{ext}") in taken:
                    k += 1
                following[one] = k + 1
            taken.add(free)
            made.append(free)
        return rows.assign(**{out: made}), (taken, following)

    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    made = fold(rows.withColumn("_late", ~F.col("_there")), "_family", ["_late", *order], step, f"{schema}, `_late` boolean, `{out}` string")
    return made.filter("not _there").drop("_family", "_there", "_late")


def is_readable(path: Column) -> Column:
    """SRC09: the extension is on the list."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(READABLE)


def sequence_parts(path: Column) -> tuple[Column, Column, Column]:
    """prefix, counter and extension of a numbered image (SRC08); the counter is null otherwise."""
    pattern = r"^(.*?)(\d+)\.([A-Za-z0-9]+)$"
    digits = F.regexp_extract(path, pattern, 2)
    return F.regexp_extract(path, pattern, 1), F.when(digits != "", digits.cast("bigint")), F.lower(F.regexp_extract(path, pattern, 3))


def parse_size(text: Column) -> tuple[Column, Column]:
    """Width and height of WIDTHxHEIGHT, null if it isn't one (PRJ04)."""
    pattern = r"^\s*(\d+)\s*[xX]\s*(\d+)\s*$"
    return tuple(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i).cast("int")) for i in (1, 2))


def truncated(text: Column, most: int = 60) -> Column:
    """Long texts end in three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def human_size(size: Column) -> Column:
    """1.5 KB and so on."""
    out = F.concat(F.format_number(size / 1024**3, 1), F.lit(" GB"))
    for unit, power in (("MB", 2), ("KB", 1)):
        out = F.when(size < 1024 ** (power + 1), F.concat(F.format_number(size / 1024**power, 1), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)


def duration(seconds: Column) -> Column:
    """Minutes and seconds."""
    return F.concat((seconds / 60).cast("bigint"), F.lit("m "), F.pmod(seconds.cast("bigint"), F.lit(60)), F.lit("s"))


def suggest(word: str, choices: list[str], n: int = 3, cutoff: float = 0.4) -> list[str]:
    """The closest choices to a mistyped one (FIL09, TOP02)."""
    return difflib.get_close_matches(word, choices, n=n, cutoff=cutoff)


def closest(df: DataFrame, word: str, choices: list[str], n: int = 3) -> DataFrame:
    """For each word of df its n closest choices by edit distance; choices is a short list, as of options (TOP02)."""
    ranked = F.array_sort(F.array(*(F.struct(F.levenshtein(word, F.lit(c)).alias("distance"), F.lit(c).alias("choice")) for c in sorted(set(choices)))))
    met = df.select(word).distinct().select(word, F.posexplode(F.slice(ranked, 1, n)).alias("rank", "one"))
    return met.select(word, F.col("one.choice").alias("choice"), F.col("one.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))


def closest_by_ratio(df: DataFrame, word: str, choices: list[str], n: int = 3, cutoff: float = 0.4) -> DataFrame:
    """For each word of df at most n choices whose likeness (twice the matching characters over all) is `cutoff` at least, the likest first (FIL09, TOP02)."""

    @F.pandas_udf(ArrayType(StringType()))
    def near(words):
        return words.map(lambda w: [] if w is None else suggest(w, choices, n, cutoff))

    met = df.select(word).distinct().select(word, F.posexplode(near(word)).alias("rank", "choice"))
    return met.select(word, "choice", (F.col("rank") + 1).alias("rank"))


def can_decode_in_hardware(codec: Column, pixel_format: Column) -> Column:
    """SRC02: neither the codec nor the pixel format rules it out; unknown ones are allowed."""
    return ~F.coalesce(F.lower(codec).isin(SOFTWARE_CODECS), F.lit(False)) & ~F.coalesce(F.lower(pixel_format).rlike(r"^(bgr|rgb|gbr|pal|ya)"), F.lit(False))


#: Transfer curves that can be handed on as they are.
TRANSFERS = ["smpte2084", "arib-std-b67", "bt2020-10", "bt2020-12", "bt709", "smpte428", "linear", "iec61966-2-1"]


def colour_conversion(space: Column, pixel_format: Column, transfer: Column) -> Column:
    """SNK06: matrix, primaries and curve of the output; a wide source keeps its own curve if it is a known one, and has none otherwise."""
    wide = is_wide_gamut(space, pixel_format, transfer)
    own = F.when(transfer.isin(TRANSFERS), transfer)
    pick = lambda yes, no: F.when(wide, yes).otherwise(F.lit(no))
    return F.struct(pick(F.lit("bt2020nc"), "bt709").alias("matrix"), pick(F.lit("bt2020"), "bt709").alias("primaries"), pick(own, "bt709").alias("curve"))


def is_wide_gamut(space: Column, pixel_format: Column, transfer: Column) -> Column:
    """SNK06: any of the three names BT.2020."""
    wide = ["bt2020", "bt2020nc", "bt2020c"]
    return F.coalesce(space.isin(wide), F.lit(False)) | F.coalesce(pixel_format.isin(wide), F.lit(False)) | F.coalesce(transfer.isin(wide), F.lit(False))


#: Encoders that store one format, whatever the picture; png by depth; all others as the last row.
STORED = {
    "hevc_amf_10bit": "p010le",
    "jpeg": "yuvj444p",
    "nvenc_h264": "yuv420p",
    "nvenc_h265_10bit": "p010le",
    "prores": "yuv444p10le",
    "qsv_h265_10bit": "p010le",
    "x264_10bit": "yuv420p10le",
    "x264_animation_10bit": "yuv420p10le",
    "x265_10bit": "yuv420p10le",
}
BY_DEPTH = {"png": ("rgb24", "rgb48le"), "": ("yuv420p", "yuv444p10le")}


def pixel_format(encoder: Column, eight_bit: Column, grayscale: Column, transparent: Column) -> Column:
    """The stored pixel format for an encoder name and the kind of picture (SNK05)."""
    depth = lambda pair: F.when(eight_bit, F.lit(pair[0])).otherwise(F.lit(pair[1]))
    table = F.create_map(*(F.lit(x) for pair in STORED.items() for x in pair))
    own = F.coalesce(table[encoder], F.when(encoder == "png", depth(BY_DEPTH["png"])), depth(BY_DEPTH[""]))
    return F.when(transparent & (encoder != "prores_segment"), F.lit("yuva444p10le")).otherwise(F.when(grayscale, depth(BY_DEPTH[""])).otherwise(own))


def container_codec(extension: Column, codec: Column) -> Column:
    """SNK13: a WebM file takes VP9."""
    return F.when((F.lower(extension) == "webm") & ~codec.startswith("vp9"), F.lit("vp9")).otherwise(codec)
