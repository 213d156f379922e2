import re

import pytest

from seqengine.llm.decontaminate import contamination_report, drop_contaminated, find_contamination

from .conftest import invented

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for span, ids in windows.items():
            for k in range(len(w) - len(span) + 1):
                if tuple(w[k : k + len(span)]) == span:
                    hit |= set(range(k, k + len(span)))
                    found |= ids
        out[d] = (len(w), sorted(hit), sorted(found))
    return out


@pytest.mark.parametrize("most", [1 << 24, 0])  # by broadcast, and by shuffled join
def test_like_brute_force(spark, docs_of, rng, most):
    items = [(k, invented(rng, n)) for k, n in enumerate((3, 6, 9, 10, 11, 25, 60))] + [(20, ""), (21, None), (22, "--- ,,"), (23, "two two two two two two two two two two two two")]
    rows = []
    for k, t in items[:7] + items[10:]:
        w = t.split()
        rows += [f"{invented(rng, 30)} {t.upper()}, {invented(rng, 9)}", " ".join(w[:-1]), f"{invented(rng, 5)}. {' '.join(w[:10])}! {invented(rng, 3)}", f"é{t}"]
    rows += [invented(rng, 50), "", None, "two " * 40, " ".join(t for _, t in items if t)]
    docs = list(enumerate(rows))
    benchmark = spark.createDataFrame(items + [items[5]], "item_id long, text string")
    found = find_contamination(docs_of(docs), benchmark, broadcast_bytes=most)
    assert {r.doc_id: (r.n_words, r.hits, r.items) for r in found.collect()} == brute(docs, items)
    clean = {d for d, (_, hits, _) in brute(docs, items).items() if not hits}
    left = drop_contaminated(docs_of(docs), benchmark, broadcast_bytes=most)
    assert left.columns == docs_of(docs).columns and {r.doc_id for r in left.collect()} == clean


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_drop_by_row(spark, docs_of, rng, most):
    """Null and repeated ids: each row goes or stays by its own text; clashing columns are kept."""
    item = invented(rng, 14)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "a clean text"), (None, f"x {item} y"), (7, "clean seven"), (7, item), (8, "z"), (None, None), (7, "")]
    docs = docs_of(rows).selectExpr("*", "1 as uid", "2 as hits", "3 as n_words", "4 as Uid_")
    left = drop_contaminated(docs, benchmark, broadcast_bytes=most)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(((i, t) for i, t in rows if item not in (t or "")), key=str)
    found = find_contamination(docs, benchmark, broadcast_bytes=most).collect()
    assert sorted((r.doc_id or -1, len(r.hits)) for r in found) == [(-1, 0), (-1, 0), (-1, 14), (7, 0), (7, 0), (7, 14), (8, 0)]


def test_long_text(docs_of, spark, rng):
    item, long = invented(rng, 12), invented(rng, 120_000)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    for most in (1 << 24, 0):
        found = find_contamination(docs_of([(1, f"{long} {item} {long}")]), benchmark, broadcast_bytes=most).first()
        assert found.n_words == 240_012 and found.hits == list(range(120_000, 120_012))


def test_empty(spark, docs_of, empty):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    report = contamination_report(find_contamination(docs_of([(1, "a b"), (None, None)]), benchmark))
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in report.collect()) == [(0, 0, False), (2, 0, False)]
    assert find_contamination(empty, benchmark).isEmpty()
