"""The stages, one by one, on a small corpus with planted rows; and the operators without the package on the workers' path."""

import os
import subprocess
import sys

import corpus_pipeline

from .conftest import DOCS, invented


def test_pipeline(spark, rng, tmp_path):
    good = [(i, invented(rng, rng.randint(30, 90))) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "###" for w in invented(rng, 50).split())) for i in range(60)]
    words = good[7][1].split()
    near = (2000, " ".join(words[:-1] + ["changed"]))
    item = invented(rng, 20)
    leak = (2002, f"{invented(rng, 30)} {item} {invented(rng, 30)}")
    rows = good + bad + [near, (2001, good[5][1].upper().lower()), leak]
    # rows without ids stay or go by their texts; columns of any name are kept
    odd = [(None, f"{invented(rng, 40)}"), (None, good[9][1]), (None, f"{item} {invented(rng, 40)}"), (7, invented(rng, 40))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + odd], DOCS).selectExpr("*", "1 as uid", "'k' as _key")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            texts = [r.text for r in docs.collect()]
        left.append({r.doc_id for r in docs.select("doc_id").collect()} - {None})
    assert odd[0][1] in texts and odd[3][1] in texts and odd[2][1] not in texts and texts.count(good[9][1]) == 1
    every = {i for i, _ in rows}
    assert left[0] == every - {i for i, _ in bad}
    assert left[1] == left[0] - {5} and left[2] == left[1] - {2000}
    assert left[3] == left[2] - {2002} and left[4] == left[3]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} - {None} == left[4]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_empty_corpus(spark, tmp_path):
    for table, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


ALONE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from seqengine.llm.decontaminate import drop_contaminated
from seqengine.llm.packing import pack_documents
from seqengine.operators.dedup import mark_repeats
docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0)], "c int, pos int, value double")
print("LEFT", [r.doc_id for r in drop_contaminated(docs, items).collect()], pack_documents(docs).count(), mark_repeats(rows, "c", ["pos"], "value", "mse", 1.0).filter("kept").count())
"""


def test_the_package_ships_itself(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", ALONE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "LEFT [2] 2 1" in said.stdout, said.stderr[-2000:]
