"""Unique names for any number of rows (SNK12): the result of `names.unique_names`, with no family of names in one task.

Rows that ask for one name get it and its numbered forms in their order, so a row's rank is the least number it can have. Names are
then given in rounds: each row stands at one number, a name goes to the first of the rows that stand at it, and
the others move on, past all numbers in a row that rows before them hold; those behind them in the same list keep their distance. A name that is
held by an earlier row is never free again for a later one, so rows only move forward, and the end is what
giving names one by one would make. Ranks and distances are counted in ranges of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_PARTS = r"^(.*?)(\.[^./]*)?$"
_NUMBERED = r"^(.*)-([1-9]\d{0,17})(\.[^./]*)?$"


def _numbered(name: Column, k: Column) -> Column:
    """The k-th form of a name, which is itself for 0."""
    root, ext = F.regexp_extract(name, _PARTS, 1), F.regexp_extract(name, _PARTS, 2)
    return F.when(k == 0, name).otherwise(F.concat(root, F.lit("-"), k.cast("string"), ext))


def _ranked(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """df, written, with _uid, _part (a range of rows in order of name and order) and _rank (from 0) among the rows of a name."""
    ranged = df.repartitionByRange(name, *order).sortWithinPartitions(name, *order)
    rows = materialize(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_uid", F.monotonically_increasing_id()), "ranged")
    counts = rows.groupBy(F.col(name).alias("_of"), F.col("_part").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(name, "_part").orderBy(*order)) - 1
    met = rows.withColumn("_inside", inside).join(counts.select("_of", "_at", before.alias("_before")), (F.col(name) == F.col("_of")) & (F.col("_part") == F.col("_at")))
    return met.withColumn("_rank", F.col("_before") + F.col("_inside")).drop("_of", "_at", "_before", "_inside")


def _held(state: DataFrame, taken: DataFrame | None) -> DataFrame:
    """(held, best, list) of each name that a row stands at: the first such row and the name it asked for; both are null for names that are taken from the start."""
    found = state.groupBy(_numbered(F.col("_name"), F.col("_k")).alias("held")).agg(F.min(F.struct("_order", "_name")).alias("_first")).select("held", F.col("_first._order").alias("best"), F.col("_first._name").alias("list"))
    if taken is None:
        return found
    gone = F.col("_gone").isNotNull()
    met = found.join(taken.withColumnRenamed("held", "_gone"), F.col("held") == F.col("_gone"), "full")
    return met.select(F.coalesce("held", "_gone").alias("held"), F.when(~gone, F.col("best")).alias("best"), F.when(~gone, F.col("list")).alias("list"))


def unique_names_spread(df: DataFrame, name: str, order: list[str], out: str = "unique_name", taken: DataFrame | None = None) -> DataFrame:
    """df with names as `names.unique_names` gives them. order tells all rows apart; a null name stays null."""
    rows = df.filter(F.col(name).isNotNull())
    base = _ranked(rows, name, order)
    state = base.select("_uid", "_part", F.col(name).alias("_name"), F.struct(*order).alias("_order"), F.col("_rank").cast("long").alias("_rank"), F.col("_rank").cast("long").alias("_k"))
    state = materialize(state, "names")
    there = None
    if taken is not None:
        there = materialize(taken.select(F.col(taken.columns[0]).alias("held")).filter("held is not null").distinct(), "taken")
    while True:
        held = materialize(_held(state, there), "held")
        at = state.join(held, _numbered(F.col("_name"), F.col("_k")) == F.col("held")).filter(F.col("best").isNull() | (F.col("best") < F.col("_order")))
        lost = materialize(at.select("_uid", "_name", "_order", "_k"), "lost")
        if lost.isEmpty():
            break
        # numbers in a row of the lists that lost, which rows of other lists hold
        own = F.concat(F.regexp_extract("held", _NUMBERED, 1), F.regexp_extract("held", _NUMBERED, 3))
        foreign = held.filter(F.col("held").rlike(_NUMBERED)).select(own.alias("_of"), F.regexp_extract("held", _NUMBERED, 2).cast("long").alias("p"), "best", "list").filter(F.col("list").isNull() | (F.col("list") != F.col("_of")))
        foreign = foreign.join(lost.select(F.col("_name").alias("_of")).distinct(), "_of", "left_semi")
        island = F.col("p") - F.row_number().over(Window.partitionBy("_of").orderBy("p"))
        islands = foreign.withColumn("_i", island).groupBy("_of", "_i").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.max("best").alias("worst"))
        met = lost.join(islands, (F.col("_name") == F.col("_of")) & F.col("_k").between(F.col("low"), F.col("high")), "left")
        past = F.col("low").isNotNull() & F.coalesce(F.col("worst") < F.col("_order"), F.lit(True))
        moved = met.select(F.col("_uid").alias("_moved"), F.when(past, F.col("high") + 1).otherwise(F.col("_k") + 1).alias("_next"))
        ahead = state.join(moved, F.col("_uid") == F.col("_moved"), "left").withColumn("_ahead", F.coalesce("_next", "_k") - F.col("_rank")).drop("_moved", "_next", "_k")
        # the farthest of all rows before, in the ranges before and in the same one
        ranges = ahead.groupBy(F.col("_name").alias("_of"), F.col("_part").alias("_at")).agg(F.max("_ahead").alias("_most"))
        earlier = F.max("_most").over(Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
        ranges = ranges.select("_of", "_at", earlier.alias("_earlier"))
        here = F.max("_ahead").over(Window.partitionBy("_name", "_part").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
        ahead = ahead.withColumn("_here", here).join(ranges, (F.col("_name") == F.col("_of")) & (F.col("_part") == F.col("_at")))
        k = F.col("_rank") + F.greatest("_here", F.coalesce("_earlier", F.col("_here")))
        state = materialize(ahead.select("_uid", "_part", "_name", "_order", "_rank", k.alias("_k")), "names")
    given = state.select(F.col("_uid").alias("_given"), _numbered(F.col("_name"), F.col("_k")).alias(out))
    made = base.join(given, F.col("_uid") == F.col("_given")).select(*df.columns, out)
    return made.unionByName(df.filter(F.col(name).isNull()).withColumn(out, F.lit(None).cast("string")))
