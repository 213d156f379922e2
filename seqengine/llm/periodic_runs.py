"""Runs of repeated words in documents by Main and Lorentz's divide and conquer.

A run is a stretch of words with a period that no neighbour extends. Words are interned as
numbers. A text is halved, and its halves again; each run lies within some piece and crosses its
middle, and one that is four times its period or more has two periods or more on one side of it:
a square that begins or ends at the middle. Squares are read from the Z-function of that side (of the left one
backwards), and are extended to both sides; equal stretches are taken once, with their smallest period.
All pieces of a level, over many documents, are looked at together: the Z-function is computed only
where some place repeats the first eight words at the middle (or the whole square). That test excludes
nothing but places where there is no square.

Rows and edge cases: words are what stands between blanks (space, and code points 9 to 13), and are equal
when identical; a null, empty or blank text has no words and no run; a text of one repeated word takes
n log n steps; repeated rows and null ids are treated like any; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import byte_texts

RUNS = "array<struct<start: long, length: long, period: long>>"


def z_function(s: list[int]) -> list[int]:
    """For each place, how many elements from there on equal those at the beginning."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    first = s[0] if n else None
    for i in range(1, n):
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        elif s[i] != first:
            continue
        else:
            k = 1
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays, looked at in parts of growing size."""
    n, done, part = min(len(a), len(b)), 0, 64
    while done < n:
        differ = a[done : done + part][: n - done] != b[done : done + part][: n - done]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done += len(differ)
        part *= 2
    return n


def _survivors(words: np.ndarray, middle: np.ndarray, most: np.ndarray, step: int, look: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, period) where the first min(period, look) words on one side of a middle come again a period further.

    step 1 looks at the words from the middle on, -1 at those before it, backwards.
    """
    piece = np.repeat(np.arange(len(middle)), most)
    period = np.arange(1, len(piece) + 1) - np.repeat(np.cumsum(most) - most, most)
    at = middle[piece] if step > 0 else middle[piece] - 1
    for t in range(look):
        offset = np.minimum(period - 1, t)
        same = words[at + step * offset] == words[at + step * (offset + period)]
        piece, period, at = piece[same], period[same], at[same]
        if not len(piece):
            break
    return piece, period


def find_runs(words: np.ndarray, ends: np.ndarray, min_length: int = 6, min_exponent: int = 4, look: int = 8) -> list[dict[tuple[int, int], int]]:
    """For documents, whose words follow each other and end at `ends`: {(start, end): smallest period} of their runs, counted in words
    of the document. A run has min_length words and min_exponent (4 at least) periods or more."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    found: list[dict[tuple[int, int], int]] = [{} for _ in ends]
    known: list[dict[int, list[tuple[int, int]]]] = [{} for _ in ends]
    low, high, doc = begins, ends.astype(np.int64), np.arange(len(ends))
    while True:
        long_enough = high - low >= min_length
        low, high, doc = low[long_enough], high[long_enough], doc[long_enough]
        if not len(low):
            return found
        middle = (low + high) // 2
        for step, most in ((1, (high - middle) // 2), (-1, (middle - low) // 2)):
            piece, period = _survivors(words, middle, most, step, look)
            if len(piece):
                cuts = np.flatnonzero(np.diff(piece)) + 1
                for which, periods in zip(piece[np.concatenate([[0], cuts])], np.split(period, cuts), strict=True):
                    l, m, h, d = int(low[which]), int(middle[which]), int(high[which]), int(doc[which])
                    side = words[m:h] if step > 0 else words[l:m][::-1]
                    z = z_function(side.tolist())
                    covered = 0  # how far a smaller period reaches from the middle
                    for q in periods.tolist():
                        if z[q] < q or covered >= 2 * q:
                            continue  # no square, or one of a smaller period repeated
                        covered = max(covered, q + z[q])
                        first, last = (m, m + 2 * q) if step > 0 else (m - 2 * q, m)
                        if any(s <= first and last <= e for s, e in known[d].get(q, ())):
                            continue
                        begin, end = int(begins[d]), int(ends[d])
                        s = first - _common(words[begin:first][::-1], words[begin + q : first + q][::-1])
                        e = last + _common(words[last:end], words[last - q : end - q])
                        if e - s >= max(min_length, min_exponent * q):
                            known[d].setdefault(q, []).append((s, e))
                            at = (s - begin, e - begin)
                            found[d][at] = min(q, found[d].get(at, q))
        low, high, doc = np.concatenate([low, middle]), np.concatenate([middle, high]), np.concatenate([doc, doc])


def interned_runs(texts: list[list[bytes]], min_length: int = 6, min_exponent: int = 4) -> list[dict[tuple[int, int], int]]:
    """find_runs of texts, each a list of words."""
    ids: dict[bytes, int] = {}
    words = np.array([ids.setdefault(w, len(ids)) for text in texts for w in text], dtype=np.int32)
    return find_runs(words, np.cumsum([len(text) for text in texts]), min_length, min_exponent)


def kept_words(n: int, runs: dict[tuple[int, int], int]) -> np.ndarray:
    """Which words stay when each run is cut to its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    for (s, e), q in runs.items():
        depth[s + q] += 1
        depth[e] -= 1
    return np.cumsum(depth[:-1]) == 0


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, words_at_once: int = 200_000) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (the text's words, each run cut to its first period) for each of docs (doc_id, text).

    min_exponent: four at least, for which a run has two periods on one side of a middle. words_at_once: documents are looked at
    together until they have so many words; a longer one is looked at alone.
    """
    if min_exponent < 4:
        raise ValueError("min_exponent must be four at least")
    ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            split = [t.split() for t in byte_texts(batch.column("text"))]
            start = 0
            while start < len(split):
                stop, size = start + 1, len(split[start])
                while stop < len(split) and size + len(split[stop]) <= words_at_once:
                    size += len(split[stop])
                    stop += 1
                found, collapsed = [], []
                for words, runs in zip(split[start:stop], interned_runs(split[start:stop], min_length, min_exponent), strict=True):
                    found.append([{"start": s, "length": e - s, "period": q} for s, e, q in sorted((s, e, q) for (s, e), q in runs.items())])
                    collapsed.append(b" ".join([words[i] for i in np.flatnonzero(kept_words(len(words), runs))] if runs else words))
                counts = pa.array(list(map(len, split[start:stop])), pa.int64())
                columns = [batch.column("doc_id").slice(start, stop - start), counts, pa.array(found, kind), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])
                start = stop

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def runs_report(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the most periods (start, length, period, exponent_milli) and digests of runs and collapsed text."""
    before = lambda x, y: F.when(x["length"] * y["period"] != y["length"] * x["period"], F.signum(y["length"] * x["period"] - x["length"] * y["period"]).cast("int")).otherwise(
        F.signum(F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"])).cast("int")
    )
    found = found.withColumn("_most", F.get(F.array_sort("runs", before), F.lit(0)))
    most = F.col("_most")
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        most["start"].alias("start"),
        most["length"].alias("length"),
        most["period"].alias("period"),
        F.expr("1000 * _most.length div _most.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs; in a tenth of them, told by the id's checksum, the words from some place on repeat a stretch of themselves."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("_h"))
    words = F.split(F.btrim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "), F.lit(" ")), " ")
    rows = rows.select("doc_id", "text", F.floor(F.col("_h") / 10).alias("_g"), F.when((F.col("_h") % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), words).alias("_words"))
    n = F.size("_words").cast("long")
    a = F.col("_g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("_g") % 8))
    rows = rows.select("doc_id", "text", "_words", a.alias("_a"), p.alias("_p"))
    again = F.array_join(F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))), " ")
    return rows.select("doc_id", F.when(F.col("_words").isNotNull(), again).otherwise(F.col("text")).alias("text"))
