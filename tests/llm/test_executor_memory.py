"""What stages leave in the memory of executors and their Python workers."""

import time

import pyarrow as pa

from seqengine.llm.common import in_slices
from seqengine.llm.neardup import near_duplicates

from .conftest import DOCS, invented


def _held(spark) -> float:
    """MB of blocks in the executors' memory."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().toSeq()
    return sum(status.apply(k)._1() - status.apply(k)._2() for k in range(status.size())) / 2**20


def test_broadcast_tables_of_past_queries_go(spark, rng):
    from seqengine.session import let_go

    rows = [(i, invented(rng, 40), "en", "s", 1) for i in range(60)]
    rows += [(100 + i, f"{rows[i][1]} more", "en", "s", 1) for i in range(30)]
    let_go(spark)
    before = _held(spark)
    assert near_duplicates(spark.createDataFrame(rows, DOCS)).filter("not kept").count() == 30
    let_go(spark)
    end = time.time() + 20
    while _held(spark) > before + 4 and time.time() < end:
        time.sleep(0.5)
    assert _held(spark) <= before + 4


def test_slices_keep_all_rows_in_order():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 1, 2500, 1024)]
    slices = list(in_slices(iter(batches)))
    assert [s.num_rows for s in slices] == [1, 1024, 1024, 452, 1024]
    assert [x for s in slices for x in s.column("x").to_pylist()] == [x for b in batches for x in b.column("x").to_pylist()]
