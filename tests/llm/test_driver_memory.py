"""The classifier's fit holds little more than the positions of its rows in the driver."""

import tracemalloc

import numpy as np
import pyarrow as pa

from seqengine.llm import linear, quality


def test_fit_needs_no_copies():
    rng = np.random.default_rng(0)
    found = pa.array([rng.choice(quality.DIMENSIONS, 1500, replace=False).astype(np.int32).tobytes() for _ in range(1500)], pa.binary())
    tracemalloc.start()
    rows = linear.position_rows(pa.chunked_array([found.slice(0, 700), found.slice(700)]))
    quality._fit(rows, np.where(np.arange(1500) % 3 == 0, 1, -1), 1.0, 1.0, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r.tobytes() for r in rows] == found.to_pylist()
    assert most < 22e6  # the positions are 9 MB; unit vectors of all rows at once would be 18 MB more


def test_empty_positions():
    assert [len(r) for r in linear.position_rows(pa.chunked_array([pa.array([b"", b"\1\0\0\0", b""], pa.binary())]))] == [0, 1, 0]
    assert linear.position_rows(pa.chunked_array([], pa.binary())) == []
