import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqengine.llm.periodic_runs import interned_runs, kept_words, periodic_runs, runs_report, with_planted_runs, z_function


def brute_runs(words, min_length=6, min_exponent=4):
    """{(start, end): period}: every stretch of equal words q apart, cut at both ends, whose smallest period is q."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q), q)
            i = j
    return found


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = sorted((s, e - s, q) for (s, e), q in brute_runs(words).items())
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


@given(st.lists(st.integers(0, 2), max_size=40))
def test_z_function(s):
    assert z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70), min_size=1, max_size=5))
def test_runs_of_small_alphabets(texts):
    assert interned_runs(texts) == [brute_runs(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 8)), max_size=6))
def test_planted_repetitions(parts):
    text = [w for unit, times, more in parts for w in (unit * (times + 1))[: len(unit) * times + more]]
    runs = interned_runs([text, text[::-1]])
    assert runs[0] == brute_runs(text) and runs[1] == brute_runs(text[::-1])


def test_other_bounds_and_one_word():
    text = [b"x"] * 5000 + [b"y"] + [b"x", b"z"] * 300
    assert interned_runs([text], 6, 4) == [{(0, 5000): 1, (5001, 5601): 2}]
    assert interned_runs([[b"x"] * 5, [b"x"] * 6, [], [b"x"] * 5]) == [{}, {(0, 6): 1}, {}, {}]
    assert interned_runs([[b"a", b"b"] * 5], 10, 5) == [{(0, 10): 2}] and interned_runs([[b"a", b"b"] * 5], 11, 5) == [{}]
    assert kept_words(7, {(0, 6): 1}).tolist() == [True] + [False] * 5 + [True]


def test_long_text_in_bounded_time():
    rng = random.Random(1)
    period = [b"%d" % rng.randrange(50) for _ in range(40_000)]
    text = period * 5 + [b"x"] * 300_000 + [b"%d" % rng.randrange(3) for _ in range(100_000)]
    found = interned_runs([text])[0]
    assert found[(0, 200_000)] == 40_000 and found[(200_000, 500_000)] == 1
    words = np.array(text)
    for (s, e), q in found.items():
        assert (words[s : e - q] == words[s + q : e]).all() and e - s >= max(6, 4 * q)


def test_query_like_brute_force(docs_of, rng):
    rows = []
    for i in range(300):
        words = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.choice([0, 1, 2, 7, 30, 90]))]
        if i % 3 == 0 and words:
            words = words[:10] + words[3:8] * rng.randint(2, 7) + [words[0]] * rng.randint(1, 9)
        rows.append((i, rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", " \r\n", "\x0b", "\x0c "]).join(words) + rng.choice(["", " "])))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "  " * 9), (1004, "é é é é é é"), (1005, "\x1c \x1c x"), (1004, "é é é é é é")]
    docs = docs_of(rows).repartition(3).withColumn("runs", F.lit(0)).withColumn("n_words", F.lit(1))
    found = [tuple(r) for r in runs_report(periodic_runs(with_planted_runs(docs))).collect()]
    assert sorted(found, key=str) == sorted((brute_row(*r) for r in rows), key=str)
    small = [tuple(r) for r in runs_report(periodic_runs(with_planted_runs(docs), words_at_once=1)).collect()]
    assert sorted(found, key=str) == sorted(small, key=str)


def test_null_ids_empty_tables_and_bounds(docs_of, empty):
    assert [tuple(r)[1:6] for r in runs_report(periodic_runs(with_planted_runs(docs_of([(None, "x " * 8)])))).collect()] == [(1, 0, 8, 1, 8000)]
    assert periodic_runs(with_planted_runs(empty)).isEmpty()
    with pytest.raises(ValueError):
        periodic_runs(empty, min_exponent=3)
