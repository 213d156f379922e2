"""Helpers shared by the training-data operators: columns, scratch tables, words, links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, kept in the shared folder with a number for each row, and the name of that column."""
    uid = fresh(docs, "uid")
    return materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "documents"), uid


def small(rows: DataFrame, most: int = 50_000, text: str | None = None, most_bytes: int = 16 << 20) -> bool:
    """Is it little enough to be sent to every task: at most so many rows, and so many bytes of its text column?"""
    if rows.limit(most + 1).count() > most:
        return False
    return text is None or rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0] <= most_bytes


def without(docs: DataFrame, uid: str, gone: DataFrame, name: str, most: int = 1_000_000) -> DataFrame:
    """docs without the rows whose number is a uid of gone. So many numbers (8 bytes each) at most go to every task; more meet docs in a shuffled join."""
    gone = materialize(gone.select(F.col("uid").alias(uid)), name)
    return docs.join(F.broadcast(gone) if small(gone, most) else gone, uid, "left_anti")


#: For bytes.translate: A-Z to a-z.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words; a bounded cache spares hashing the frequent ones again."""

    def __init__(self, most: int = 100_000):
        import xxhash

        self.most, self.known, self.digest = most, {}, xxhash.xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, out = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                if len(known) >= self.most:
                    known.clear()
                h = known[w] = self.digest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; empty if there are fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:m].copy()
    with np.errstate(over="ignore"):
        for i in range(1, n):
            out = out * _MIX + words[i : i + m]
        return mix64(out)


def in_slices(batches: Iterator, rows: int = 1024) -> Iterator:
    """The Arrow batches in slices of at most so many rows. What Arrow holds without use goes back after each batch, as workers wait for later stages with all they have."""
    import pyarrow as pa

    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
        del batch
        pa.default_memory_pool().release_unused()


def byte_texts(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, nulls as empty ones."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, comp) for each id in edges (a, b): comp is the smallest id that can be reached.

    Takes the smallest label among neighbours, then the label's own label, until nothing
    changes. All steps are joins and aggregates, the hub of a large star included: its
    edges are summed before the shuffle or split by the adaptive skew join.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = both.union(edges.select(F.col("b"), F.col("a"))).filter("src <> dst").distinct()
    both = materialize(both, "edges")
    labels = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("comp"))
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "comp"), "dst").groupBy("src").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.id == near.src).select("id", "comp", F.least("comp", "near").alias("new"))
        above = labels.select(F.col("id").alias("top"), F.col("comp").alias("top_comp"))
        step = step.join(above, F.col("new") == F.col("top"), "left")
        step = materialize(step.select("id", F.least("new", F.coalesce("top_comp", "new")).alias("comp"), F.col("comp").alias("old")), "labels")
        if step.filter("comp <> old").isEmpty():
            return step.select("id", "comp")
        labels = step.select("id", "comp")
