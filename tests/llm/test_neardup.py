from itertools import combinations

import pytest
from pyspark.sql import functions as F

from seqengine.llm import neardup
from seqengine.llm.neardup import drop_near_duplicates, near_duplicates

from .conftest import invented


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split(" ")
        w = [x for x in w if x]
        n = min(words, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


def edited(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k : k + rng.randint(0, 1)] = [invented(rng, 1)]
    return " ".join(w)


def test_like_brute_force(docs_of, rng):
    """Families whose members differ from their first by so many edits that about half have no link to it, chains, and short texts."""
    texts = []
    for size in (60, 150, 400):
        base = invented(rng, size)
        texts += [base] + [edited(rng, base, rng.randint(0, size // 12)) for _ in range(45)]
    chain = invented(rng, 120)
    for _ in range(25):
        texts.append(chain)
        chain = edited(rng, chain, 2)
    passage = invented(rng, 60)
    texts += [f"{invented(rng, 40)} {passage} {invented(rng, 40)}" for _ in range(40)]
    # two thirds of them are one passage: keys without a link; some have a partner
    passage = invented(rng, 200)
    own = [f"{invented(rng, 60)} {passage} {invented(rng, 60)}" for _ in range(40)]
    texts += own + [edited(rng, t, 3) for t in own[::6]]
    long = invented(rng, 100_000)
    texts += [long, long + " and a few words more", "a b c", "A B  C", "a b c d", "a b c d e", "", None, "   "]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    assert {tuple(r) for r in near_duplicates(docs_of(rows), 4, 80).collect()} == brute(rows, 4, 80)


def test_links_without_the_hub(docs_of, rng):
    """Two copies share most of their edits: they are linked to each other, and neither to the first document."""
    base = invented(rng, 200)
    far = edited(rng, base, 14)
    rows = [(0, base), (1, far), (2, edited(rng, far, 1)), *((i, edited(rng, base, 14)) for i in range(3, 30))]
    found = {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows), 4, 80).collect()}
    assert found[1] == found[2] == 1 and found == {i: c for i, _, c, _ in brute(rows, 4, 80)}


def test_edges(docs_of, empty):
    docs = docs_of([(5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five SIX"), (7, "one  two three four five six"), (9, None), (8, "")])
    found = near_duplicates(docs.withColumn("comp", F.lit(1)).withColumn("id", F.lit(2)))
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in found.collect()) == [(-1, 5, False), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (9, 9, True)]
    assert near_duplicates(empty).isEmpty()
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [5, 8, 9]
    with pytest.raises(ValueError):
        near_duplicates(docs, percent=50)


def test_full_sets_tell_strays(spark):
    """What is near a hub is decided on full sets; of classes that aren't, only similar ones meet."""
    rows = spark.createDataFrame([(0, 1, 1, 1), (0, 2, 1, 2), (0, 3, 1, 3), (0, 5, 1, 5), (0, 6, 1, 6)], "key long, id long, hub long, comp long")
    bounds = neardup.Bounds(80)
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    texts = spark.createDataFrame([(1, words(0, 100)), (2, words(24, 124)), (3, words(30, 130)), (5, words(44, 144)), (6, words(45, 145))], "id long, text string")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (5, 1), (6, 1)], "a long, b long")
    compared = neardup._compare(pairs, texts, 1, bounds)
    assert {(r.a, r.close, r.covered) for r in compared.collect()} == {(2, True, False), (3, True, False), (5, False, False), (6, False, False)}
    assert (5, 6) in {tuple(r) for r in neardup._strays(rows, compared, texts, 1, bounds).collect()}
    lanes = ", ".join(f"{x} long" for x in neardup.LANES)
    unlike = spark.createDataFrame([(i, 100, *[i * 0x0001000100010001] * 10) for i in (1, 2, 3)], f"id long, n_shingles long, {lanes}")
    assert neardup._near_hubs(rows.filter("id < 4").select("id", "hub"), unlike, bounds, False).count() == 2


def test_chunk_keys(spark, rng):
    """Two classes share a key just if a chunk of theirs has at most one different value."""
    values = [[rng.randrange(1 << 16) for _ in range(40)]]
    for k in (0, 1, 2):  # change k values of each chunk
        values.append([v ^ 0x8001 if i % 4 < k else v for i, v in enumerate(values[0])])
    lane = lambda v: [int.from_bytes(b"".join(x.to_bytes(2, "little") for x in v[i : i + 4]), "little", signed=True) for i in range(0, 40, 4)]
    classes = spark.createDataFrame([(i, *lane(v)) for i, v in enumerate(values)], "id long, " + ", ".join(f"{x} long" for x in neardup.LANES))
    keys = {i: {r.key for r in neardup.chunk_keys(classes).filter(f"id = {i}").collect()} for i in range(4)}
    assert [len(keys[0] & keys[i]) for i in range(4)] == [40, 40, 10, 0] and len(keys[0] & keys[2]) == 10


def test_drop_by_row(spark, docs_of):
    """Null and repeated ids, and columns named like the operator's own: one row of each group stays, in whatever order ids come."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    more = text + " more"
    rows = [(3, text), (5, more), (5, "another clean text of its own words that nobody else has"), (None, more), (None, "a clean text without an id but of some length"), (7, None), (7, ""), (None, None), (9, "x y"), (9, "x y"), (None, "q r s"), (None, "Q r  s")]
    docs = docs_of(rows).withColumn("uid", F.lit(4)).withColumn("UID_", F.lit(5)).withColumn("stays", F.lit(True))
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    found = sorted(((r.doc_id or 0, r.text) for r in left.collect()), key=str)
    texts = [t for _, t in found]
    assert (3, text) in found and more not in texts and rows[2] in found and texts.count("x y") == 1
    assert texts.count(None) == 2 and texts.count("") == 1 and len([t for t in texts if (t or "").lower().startswith("q")]) == 1 and len(found) == 8
