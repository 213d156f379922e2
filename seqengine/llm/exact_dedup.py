"""Exact duplicate removal by distributed most-significant-digit radix partitioning.

Texts are split by their leading bytes, then each group by its next bytes, and so on with
longer digits, until a group holds one document or its documents have ended. Documents
that end together in one group have equal bytes, so no digest decides equality.

Rows and edge cases: a null text counts as empty; empty texts are equal to each other; a
null doc_id stays only if no equal text has an id; a row repeated with id and text counts
in group_size each time and one of the rows stays; an empty table gives an empty result.
Extra columns are ignored by `exact_groups` and kept by `drop_exact_copies`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, numbered, whole_text, without


def exact_groups(docs: DataFrame, first_digit: int = 64, growth: int = 16) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    first_digit: bytes in the first digit; each later digit is growth times as wide.
    """
    own, uid = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return _groups(own.withColumnRenamed(uid, "uid"), first_digit, growth).drop("uid")


def _groups(docs: DataFrame, first_digit: int = 64, growth: int = 16) -> DataFrame:
    """The same for docs (uid, doc_id, text), with uid; one row of each group is kept."""
    rows = docs.select("uid", "doc_id", F.lit(0).cast("long").alias("gid"), lower_ascii(whole_text()).cast("binary").alias("rest"))
    width, done, first = first_digit, [], True
    while True:
        level = materialize(_split(rows, width, first), "radix")
        done.append(level.filter("done").drop("done", "rest"))
        rows = level.filter("not done").select("uid", "doc_id", "gid", "rest", "text_sha256")
        if rows.isEmpty():
            break
        width, first = width * growth, False
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    single = out.filter("group_size = 1").select("uid", "doc_id", F.col("doc_id").alias("keep_id"), "group_size", F.lit(True).alias("kept"), "text_sha256")
    copies = out.filter("group_size > 1")
    stays = copies.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("gid").agg(F.min("uid").alias("stays"))
    copies = copies.join(stays.withColumnRenamed("gid", "of"), F.struct("gid") == F.struct("of"), "left").select(
        "uid", "doc_id", "keep_id", "group_size", F.coalesce(F.col("uid") == F.col("stays"), F.lit(False)).alias("kept"), "text_sha256"
    )
    return single.unionByName(copies)


def _split(rows: DataFrame, width: int, first: bool) -> DataFrame:
    """Splits the groups of rows (uid, doc_id, gid, rest) by the next width bytes.

    The groups are counted with sums made before the shuffle. Their keys meet the rows in
    a sort-merge join with a shuffle of its own on both sides (a struct of the keys), so
    that the adaptive skew join can split a group that holds much of the table.
    """
    keyed = rows.withColumn("digit", F.substring("rest", 1, width))
    groups = keyed.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"), F.min("uid").alias("new_gid"))
    groups = groups.filter("n > 1").select(F.struct("gid", "digit").alias("of"), "n", "top", "new_gid")
    met = keyed.join(groups, F.struct("gid", "digit") == F.col("of"), "left")
    ended = F.col("new_gid").isNull() | (F.octet_length("digit") < width)
    return met.select(
        "uid",
        "doc_id",
        F.coalesce("new_gid", "uid").alias("gid"),
        F.when(F.col("new_gid").isNull(), F.col("doc_id")).otherwise(F.col("top")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        (F.sha2("rest", 256) if first else F.col("text_sha256")).alias("text_sha256"),
        ended.alias("done"),
        F.when(~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs, with all their columns, with one row of each text: that with the largest doc_id.

    Rows are told apart by a number of their own, so that ids that are null or repeated do no harm.
    """
    own, uid = numbered(docs)
    found = _groups(own.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return without(own, uid, found.filter("not kept"), "gone").select(*docs.columns)
