"""A corpus from raw documents to packed sequences: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents. What a stage has left in the executors' memory goes before the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqengine.llm.common import read_table
from seqengine.llm.decontaminate import drop_contaminated
from seqengine.llm.exact_dedup import drop_exact_copies
from seqengine.llm.neardup import drop_near_duplicates
from seqengine.llm.packing import pack_documents
from seqengine.llm.quality import drop_low_quality, train_quality
from seqengine.session import let_go, scratch_folder, temporary_tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train_quality(docs, read_table(spark, sf_dir, "labels"))
    return drop_low_quality(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_go(spark)
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_go(spark)
    return drop_near_duplicates(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_go(spark)
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_go(spark)
    return pack_documents(docs, capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: A fitted classifier, MinHash and a tokeniser have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = scratch_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        with temporary_tables():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
