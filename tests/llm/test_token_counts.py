import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqengine.llm.packing import default_ranks, encoder
from seqengine.llm.token_counts import SPECIAL, PieceCounts, apply_edit_lists, apply_edits, build, count_edited, count_trees, edit

from .conftest import invented


def full_count():
    encode = encoder(default_ranks()).encode
    return lambda text: len(encode(text, allowed_special="all"))


@pytest.fixture(scope="module")
def counter():
    return PieceCounts(default_ranks())


@pytest.mark.parametrize("seed", range(6))
def test_edits_equal_a_full_count(counter, seed):
    rng = random.Random(seed)
    full = full_count()
    text = invented(rng, rng.choice([0, 3, 400, 1500]), "abé 's1.\n  ")
    tree = build(text, counter, 8)
    for _ in range(40):
        kind = rng.random()
        inserted = "" if kind < 0.3 else rng.choice([" ", "\n\n", "'s", "x", "  word", invented(rng, 5), invented(rng, 400) if kind > 0.95 else "!"])
        pos, removed = rng.randint(0, len(text) + 3), rng.choice([0, 0, 1, 5, 60, 10**9 if kind > 0.97 else 2])
        text, tree, _ = edit(text, tree, pos, removed, inserted, counter, 8)
        assert tree.tokens[1] == full(text) and tree.chars[1] == len(text)
        leaves = tree.chars[tree.width :]
        assert leaves.sum() == len(text)


def test_only_a_part_is_encoded(counter):
    text = invented(random.Random(1), 20_000)
    tree = build(text, counter, 64)
    _, _, n = edit(text, tree, len(text) // 2, 3, "new words", counter, 64)
    assert n < 3000


def test_tables(spark, docs_of, empty):
    rows = [(1, "hello big world"), (1, "hello big world"), (2, None), (3, ""), (None, "x"), (4, "<|endoftext|> end")]
    trees = count_trees(docs_of(rows))
    full = full_count()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in trees.collect()) == sorted((i or 0, full(t or "")) for i, t in rows)
    edits = spark.createDataFrame([(1, 2, 0, 5, "bye"), (1, 1, 6, 4, None), (3, 1, 99, 4, "new"), (9, 1, 0, 0, "x"), (2, 1, None, None, "y")], "doc_id long, seq int, pos long, removed long, inserted string")
    out = sorted((r.doc_id or 0, r.text, r.n_tokens) for r in apply_edits(trees, edits).collect())
    assert [t for _, t, _ in out] == ["x", "bye world", "bye world", "y", "new", "<|endoftext|> end"]
    assert all(n == full(t) for _, t, n in out)
    assert apply_edits(count_trees(empty), edits).isEmpty()
    assert apply_edit_lists(trees.selectExpr("*", "cast(null as array<struct<pos: long, removed: long, inserted: string>>) as edits")).count() == 6


def test_insertion_behind_an_empty_leaf(counter):
    full = full_count()
    text = " word" * 16
    tree = build(text, counter, 2)
    text, tree, _ = edit(text, tree, 10, 30, "", counter, 2)
    leaves = tree.chars[tree.width :].tolist()
    at = next(i for i in range(1, len(leaves)) if leaves[i] and not leaves[i - 1])
    text, tree, _ = edit(text, tree, sum(leaves[:at]), 0, "s", counter, 2)
    assert "words" in text and tree.tokens[1] == full(text) and tree.chars[1] == len(text)


COUNTER = PieceCounts(default_ranks())
PIECES = st.sampled_from([" word", "x", "  ", "\n", "'s", "don't", "12", "!", "é", SPECIAL, SPECIAL[:6], SPECIAL[6:], "日本", " "])


@given(st.data(), st.sampled_from([1, 4, 64]))
@settings(max_examples=250, deadline=None)
def test_edits_at_leaf_starts(data, leaf):
    """Deletions over whole leaves, then insertions where leaves begin and end: equal to a full count each time."""
    full = full_count()
    text = "".join(data.draw(st.lists(PIECES, max_size=60 if leaf < 64 else 400)))
    tree = build(text, COUNTER, leaf)
    assert tree.tokens[1] == full(text)
    for _ in range(data.draw(st.integers(1, 6))):
        starts = [0, len(text)]
        for n in tree.chars[tree.width :].tolist():
            starts.append(starts[-1] + n if len(starts) > 2 else n)
        pos = min(max(data.draw(st.sampled_from(starts)) + data.draw(st.integers(-1, 1)), 0), len(text))
        removed = data.draw(st.sampled_from([0, 0, 1, 3, 7, 40, 300]))
        inserted = "".join(data.draw(st.lists(PIECES, max_size=3)))
        text, tree, _ = edit(text, tree, pos, removed, inserted, COUNTER, leaf)
        assert tree.tokens[1] == full(text) and tree.chars[1] == len(text)


def test_one_pass_like_two(docs_of):
    rows = [(1, "hello big world " * 300), (1, "again"), (None, None), (2, f"a{SPECIAL}b"), (3, "")]
    docs = docs_of(rows).selectExpr("*", "array(struct(2L as pos, 3L as removed, 'zz' as inserted), struct(900L as pos, 0L as removed, cast(null as string) as inserted)) as edits", "'x' as tree", "7 as n_tokens")
    one = {(r.doc_id, r.text, r.n_tokens_before, r.n_tokens, r.n_encoded_chars) for r in count_edited(docs).collect()}
    kept = count_trees(docs).withColumn("edits", F.expr("array(struct(2L as pos, 3L as removed, 'zz' as inserted), struct(900L as pos, 0L as removed, cast(null as string) as inserted))"))
    assert one == {(r.doc_id, r.text, r.n_tokens_before, r.n_tokens, r.n_encoded_chars) for r in apply_edit_lists(kept).collect()} and len(one) == 5
