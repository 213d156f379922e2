import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from seqengine.llm.exact_dedup import drop_exact_copies, exact_groups

from .conftest import invented


def brute(rows):
    same = defaultdict(list)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for i, t in rows:
        same[lower(t)].append(i)
    return {(i, max(same[lower(t)]), len(same[lower(t)]), i == max(same[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows}


def test_like_brute_force(docs_of, rng):
    base = [invented(rng, n) for n in (1, 5, 40, 300, 4000)]
    rows, i = [], 0
    for t in base:
        for made in (t, t.upper(), t + "x", t[:-1], t + " É", t + " é", t, t[: len(t) // 2]):
            rows.append((i, made))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "x" * 64), (i + 3, "X" * 64), (i + 4, "x" * 63), (i + 5, "x" * 1088), (i + 6, "x" * 1088), (i + 7, "x" * 1089)]
    found = {tuple(r) for r in exact_groups(docs_of(rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    assert found == brute(rows)


def test_repeats_nulls_and_clashes(docs_of, empty):
    docs = docs_of([(1, "a"), (1, "a"), (None, "A"), (None, "b"), (2, "c")]).withColumn("gid", F.lit("x")).withColumn("kept", F.lit(3))
    found = exact_groups(docs)
    assert found.filter("text_sha256 = sha2('a', 256)").select("keep_id", "group_size").distinct().collect() == [(1, 3)]
    assert found.filter("kept").count() == 3
    assert exact_groups(empty).isEmpty()
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns and {r.text for r in left.collect()} == {"a", "b", "c"}
    assert drop_exact_copies(empty).isEmpty()


def test_rows_in_no_fixed_order(docs_of, rng):
    """Rows whose order differs from one evaluation to the next are numbered once."""
    texts = [invented(rng, rng.choice([1, 1, 3, 40])) for _ in range(60)]
    rows = [(i, texts[i % 60] + "x" * (i % 3)) for i in range(400)]
    shuffled = docs_of(rows).orderBy(F.rand()).repartition(7)
    found = {tuple(r) for r in exact_groups(shuffled).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    assert found == brute(rows)


def test_a_large_group(docs_of):
    docs = docs_of([(i, "same text " * 20) for i in range(500)] + [(i, f"other {i}") for i in range(500, 700)])
    found = exact_groups(docs)
    assert found.filter("kept").count() == 201 and found.agg(F.max("group_size")).first()[0] == 500
