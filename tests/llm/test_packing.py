import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqengine.llm.packing import PIECES, best_fit, cut, default_ranks, encoder, pack_documents, pack_pieces, plan

from .conftest import invented

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@given(st.lists(st.integers(1, 32), max_size=120))
@settings(max_examples=150, deadline=None)
def test_plan_uses_each_piece_once(lengths):
    counts = np.bincount(lengths, minlength=33)
    used = Counter()
    for held, times in plan(counts.copy(), 32):
        assert times > 0 and sum(held) <= 32
        for x in held:
            used[x] += times
    assert used == Counter(lengths)


def test_plan_is_near_the_best_known():
    for low, high in ((1, 1025), (1, 700), (300, 600)):
        lengths = np.random.default_rng(0).integers(low, high, 5000)
        counts = np.bincount(lengths, minlength=1025)
        made = sum(times for _, times in plan(counts, 1024))
        assert made <= 1.004 * sum(times for _, times in best_fit(counts.astype(np.int64), 1024, [])) + 1


def test_exact_complements_are_used():
    counts = np.bincount([7, 3, 7, 3, 4, 3, 3, 6, 2, 1, 1], minlength=11)
    assert sum(t for _, t in plan(counts, 10)) == 4


@pytest.mark.parametrize("length", [1, 1023, 1024, 1025, 2048, 5000])
def test_cut(length):
    parts = cut(length, 1024)
    assert sum(n for _, n in parts) == length and all(n == 1024 for _, n in parts[1:]) and parts[0][0] == 0
    assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))


def test_round_trip_by_the_other_library(docs_of, rng):
    texts = [invented(rng, n, "abcdé ñ,.!1\n") for n in (0, 1, 30, 800, 3000)] + [None, "", "a<|endoftext|>b", "  \n\n\t x", "日本 😀 don't"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pack_documents(docs_of(list(enumerate(texts)))).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


ODD = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\u00a0\u2028aé1'!<|")), max_size=80)


@given(st.lists(ODD, min_size=1, max_size=8), st.sampled_from(["", "<|endoftext|>", " <|endoftext|>", "'ll"]))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(parts, between):
    """The rank file and the tokenizer file give the same ids."""
    text = between.join(parts)
    assert encoder(default_ranks()).encode(text, allowed_special="all") == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_ids_of_long_runs():
    for text in ("a" * 30_000, "ab" * 20_000, "!" * 9_999, " " * 20_000, "日" * 5_000, "1" * 10_000, "\n" * 5_000 + "x", "é" * 7_777):
        assert encoder(default_ranks()).encode(text, allowed_special="all") == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_clashing_columns_and_one_long_piece(docs_of):
    docs = docs_of([(1, "z" * 40_000), (2, "b")]).selectExpr("*", "'x' as piece", "'y' as sequence_id", "0 as uid", "1 as task", "2 as rank")
    rows = pack_documents(docs).collect()
    ids = [*TOKENIZER.encode("z" * 40_000, add_special_tokens=False).ids, 2]
    assert sum(r.length for r in rows if r.doc_id == 1) == len(ids) and {r.doc_id for r in rows} == {1, 2}


def test_one_plan_for_all_tasks(spark):
    """Complements meet though they were cut by different tasks; each place is taken once."""
    rng = np.random.default_rng(2)
    lengths = np.concatenate([np.repeat(700, 300), np.repeat(324, 300), rng.integers(1, 1025, 900)])
    rows = [(int(i), 0, 0, int(n), 7) for i, n in enumerate(lengths)]
    for parts in (1, 9):
        pieces = spark.createDataFrame(rows, PIECES).repartition(parts)
        found = pack_pieces(pieces).toPandas()
        assert sorted(zip(found.doc_id, found.length)) == [(r[0], r[3]) for r in rows] and (found.ids_crc32 == 7).all()
        assert found.sequence_id.nunique() == sum(times for _, times in plan(np.bincount(lengths, minlength=1025), 1024))
        for _, own in found.sort_values("offset").groupby("sequence_id"):
            assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 1024


def test_repeats_and_empty(docs_of, empty):
    rows = pack_documents(docs_of([(1, "a"), (1, "a"), (None, "b")])).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert pack_documents(empty).isEmpty()
