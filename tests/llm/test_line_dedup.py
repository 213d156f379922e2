import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqengine.llm.line_dedup import drop_repeated_lines, line_bitmaps, line_report, pack, stream, unpack

BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(texts, min_docs, min_chars=1, keep_first=False):
    """The positions that each text loses."""
    where = defaultdict(list)
    for d, t in enumerate(texts):
        for i, line in enumerate((t or "").split("\n")):
            if len(key_of(line)) >= min_chars:
                where[key_of(line)].append((d, i))
    lost = defaultdict(set)
    for at in where.values():
        if len({d for d, _ in at}) >= min_docs:
            for d, i in sorted(at)[1 if keep_first else 0 :]:
                lost[d].add(i)
    return lost


def left(text, lost):
    return "\n".join(line for i, line in enumerate((text or "").split("\n")) if i not in lost)


def made(rng, n=150):
    common = ["Menu", " menu\t", "MENU", "É", "é", "x", "Read more", "\x0bread MORE\r", "", "  "]
    texts = []
    for d in range(n):
        lines = [rng.choice(common) if rng.random() < 0.6 else f"own line {rng.randrange(40)} of {rng.randrange(5)}" for _ in range(rng.randrange(0, 30))]
        texts.append("\n".join(lines))
    return [*texts, None, "", "\n", "\n\n\n", "x\n" * 500, " x", "x x"]


@pytest.mark.parametrize(("min_docs", "min_chars", "keep_first"), [(10, 1, False), (2, 1, False), (1, 1, True), (10, 3, True), (30, 1, True), (1, 1, False)])
@pytest.mark.parametrize("ranges", [1, 5, 60])
def test_like_brute_force(spark, docs_of, ranges, min_docs, min_chars, keep_first):
    texts = made(random.Random(3))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if ranges == 1 else 10_000)
    try:
        docs = docs_of(list(enumerate(texts))).coalesce(1).withColumn("uid", F.lit("clash")).withColumn("n_lines", F.lit(-1))
        lost = brute(texts, min_docs, min_chars, keep_first)
        rows = drop_repeated_lines(docs, min_docs, min_chars, keep_first)
        assert rows.columns == docs.columns
        found = {r.doc_id: r.text or "" for r in rows.collect()}
        assert found == {d: left(t, lost[d]) for d, t in enumerate(texts)}
        maps = line_bitmaps(docs, min_docs, min_chars, keep_first).collect()
        for r in maps:
            n = len((texts[r.doc_id] or "").split("\n"))
            assert (r.n_lines, r.n_dropped) == (n, len(lost[r.doc_id])) and (r.keep_bitmap is None) == (not lost[r.doc_id])
            if r.keep_bitmap is not None:
                assert set(range(n)) - lost[r.doc_id] == set(unpack(r.keep_bitmap, n).nonzero()[0].tolist())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_report(docs_of, rng):
    texts = made(rng)
    lost = brute(texts, 10)
    expected = {(d, len((t or "").split("\n")), len(lost[d]), hashlib.sha256(left(t, lost[d]).encode()).hexdigest()) for d, t in enumerate(texts)}
    assert {tuple(r) for r in line_report(docs_of(list(enumerate(texts)))).collect()} == expected


def test_repeats_nulls_and_empty_tables(docs_of, empty):
    docs = docs_of([(1, "a\nb"), (1, "a\nb"), (None, "A"), (None, None)])
    assert sorted((r.n_lines, r.n_dropped) for r in line_report(docs, min_docs=3).collect()) == [(1, 0), (1, 1), (2, 1), (2, 1)]
    assert line_report(empty).isEmpty() and drop_repeated_lines(empty).columns == empty.columns and line_bitmaps(empty).isEmpty()


def test_one_range_holds_few_rows():
    """A line of every document is given on while it streams; ends of ranges are settled by their sums."""
    rows = [(1, 0, u, 3, [0, 2]) for u in range(5000)] + [(2, 0, u, 3, [1]) for u in range(4)] + [(3, 0, u, 3, [1]) for u in range(20)] + [(4, 0, 7, 3, [0])]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 100]), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())))], names=["a", "b", "uid", "n_lines", "positions"]) for k in range(0, len(rows), 100)]
    out = [r for b in stream(10, False)(iter(batches)) for r in b.to_pylist()]
    assert sum(r["n"] is None and r["a"] is None for r in out) == 5020
    assert [(r["a"], r["n"], r["uid"]) for r in out if r["n"] is not None] == [(1, 5000, 0), (4, 1, 7)]
    assert [(r["a"], r["uid"]) for r in out if r["n"] is None and r["a"] is not None] == [(4, 7)]


def test_bitmaps(rng):
    for n in (1, 8, 9, 1000):
        gone = sorted(rng.sample(range(n), n // 2))
        assert set(range(n)) - set(gone) == set(unpack(pack(n, gone), n).nonzero()[0].tolist())
