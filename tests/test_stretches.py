"""Many short stretches in one call, whatever the batches."""

import numpy as np
import pyarrow as pa
import pytest

from seqengine.operators import dedup, smooth
from seqengine.operators.clips import by_stretches


@pytest.fixture(params=[1, 3, 10_000])
def batches(request, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stretches_are_whole(spark, batches):
    sizes = {(1.0, 1): 1, (1.0, 2): 7, (None, 1): 3, (None, None): 2, (float("nan"), 1): 5, (2.0, 1): 1, (3.0, 1): 1}
    rows = [(k, c, i) for (k, c), n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k double, c long, i long").repartition(3)

    def run(table, starts):
        counts, i = np.diff(starts), table.column("i").to_pylist()
        whole = [i[s:e] == list(range(e - s)) for s, e in zip(starts, starts[1:], strict=False)]
        assert starts[0] == 0 and starts[-1] == len(table) and (counts > 0).all()
        heads = table.take(starts[:-1]).select(["k", "c"])
        return heads.append_column("n", pa.array(counts)).append_column("whole", pa.array(whole)).append_column("together", pa.array(np.full(len(counts), len(counts))))

    found = by_stretches(df, ["k", "c"], ["i"], run, "k double, c long, n long, whole boolean, together long").collect()
    assert {(str(r.k), r.c, r.n) for r in found} == {(str(k), c, n) for (k, c), n in sizes.items()} and all(r.whole for r in found)
    if batches > 100:
        assert max(r.together for r in found) > 1


def test_halos_keep_large_numbers_beside_nulls(spark, batches):
    """Other columns come out as they went in; stretches of one clip are those of the whole."""
    values = np.random.default_rng(3).normal(size=(2, 45))
    rows = [(c, i + 1, float(values[c, i]), None if i == 7 else 2**53 + 1 + 2 * i) for c in range(2) for i in range(45)]
    df = spark.createDataFrame(rows, "c long, pos long, x double, id long")
    found = {(r.c, r.pos): (r.id, r.smoothed) for r in smooth.jacobi_paths(df, "c", "pos", "x", rounds=4, core=10).collect()}
    assert {k: v[0] for k, v in found.items()} == {(c, p): i for c, p, _, i in rows}
    for c in range(2):
        low, span = values[c].min(), np.ptp(values[c])
        expected = smooth.jacobi((values[c] - low) / span, 4) * span + low
        np.testing.assert_allclose([found[c, p][1] for p in range(1, 46)], expected, atol=1e-12)


@pytest.mark.parametrize("method", ["mse", "mad"])
def test_chunks_of_few_rows(spark, batches, method):
    rng = np.random.default_rng(5)
    rows = [(c, i + 1, None if i % 11 == 5 else float(x), None if i % 9 == 0 else 2**53 + 1 + 2 * i) for c in range(3) for i, x in enumerate(rng.integers(0, 9, 40))]
    df = spark.createDataFrame(rows, "c long, pos long, x double, id long")
    found = dedup.mark_repeats_spread(df, "c", "pos", "x", method, 9.0, rows_per_chunk=6).collect()
    marked = dedup.mark_repeats(df.drop("id"), "c", ["pos"], "x", method, 9.0).collect()
    assert {(r.c, r.pos, r.id): r.kept for r in found}.keys() == {(c, p, i) for c, p, _, i in rows}
    assert {(r.c, r.pos, r.kept) for r in found} == {(r.c, r.pos, r.kept) for r in marked}
