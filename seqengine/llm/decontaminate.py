"""Benchmark decontamination by winnowing.

Of each 5 consecutive hashes of 6-word runs the smallest is a fingerprint. A passage of 10
words has 5 such runs, so a benchmark passage of 10 words that stands in a document gives
both the same fingerprint. Documents' fingerprints are looked up among the benchmark's;
each hit is extended to the passages around it, and words are compared as words, so a
hash never decides. An item of fewer than 10 words is one passage with one fingerprint.

A small benchmark's passages go to every task; beyond a bound on its bytes, fingerprints and
then the passages around hits meet the benchmark in shuffled joins. Both give equal rows.

Rows and edge cases: a null or empty text has no words; an item without words has no
passage; repeated items count once by item_id; repeated documents and null ids each give a
row, and stay or go by themselves; a null item_id is ignored; empty tables give an empty
result or clean documents; other columns are ignored, and kept by `drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import ASCII_LOWER, WordHashes, byte_texts, gram_hashes, in_slices, materialize, numbered, without

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Lower-cases A-Z; any other ASCII that is no letter or digit becomes a space.
_TABLE = bytes(c if c in _KEPT else 0x20 for c in ASCII_LOWER)

FOUND = "doc_id long, n_words long, hits array<int>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """The positions of the smallest hash (the last of equal ones) of each window of consecutive ones."""
    if len(hashes) < window:
        return np.empty(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


def passages_of(words: list[bytes], hashed: WordHashes, passage: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, words, offset of the fingerprint, fingerprint) of each passage of an item."""
    n = min(passage, len(words))
    if not n:
        return
    numbers, run = hashed(words), min(gram, n) if n == passage else n
    hashes = gram_hashes(numbers, run)
    for start in range(len(words) - n + 1):
        own = hashes[start : start + n - run + 1]
        at = int(winnow(own, len(own))[0])
        yield start, n, at, int(own[at])


class Passages:
    """The distinct passages of some benchmark items in arrays sorted by fingerprint, some 40 bytes each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], passage: int, gram: int):
        self.passage, self.gram = passage, gram
        hashed, same = WordHashes(), {}
        self.names = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.names)}
        self.texts = [[same.setdefault(w, w) for w in words] for _, words in items]
        spans: dict[bytes, int] = {}
        found, holders = [], []
        for k, (item, _) in enumerate(items):
            for start, n, at, key in passages_of(self.texts[k], hashed, passage, gram):
                one = spans.setdefault(b" ".join(self.texts[k][start : start + n]), len(spans))
                if one == len(found):
                    found.append((n if n < passage else 0, key, k, start, at))
                holders.append((one, number[item]))
        table = np.array(found, dtype=np.uint64).reshape(-1, 5)
        owned = np.unique(np.array(holders, dtype=np.int64).reshape(-1, 2), axis=0)
        self.holders, self.ends = owned[:, 1].astype(np.int32), np.searchsorted(owned[:, 0], np.arange(len(found) + 1))
        #: by length of a short passage, 0 for whole ones: fingerprints in order, and (text, start, offset, number) of each
        self.runs = {}
        for short in np.unique(table[:, 0]).tolist():
            own = np.flatnonzero(table[:, 0] == short)
            own = own[np.argsort(table[own, 1], kind="stable")]
            self.runs[int(short)] = table[own, 1].copy(), np.column_stack([table[own, 2:].astype(np.int32), own.astype(np.int32)])

    def find(self, words: list[bytes], hashed: WordHashes) -> tuple[list[int], list[str]]:
        """The positions of words inside passages, and the ids of the items whose passages occur."""
        hit, items = np.zeros(len(words), dtype=bool), set()
        numbers = hashed(words)
        for short, (keys, places) in self.runs.items():
            n, run = short or self.passage, short or self.gram
            hashes = gram_hashes(numbers, run)
            at = np.arange(len(hashes)) if short else winnow(hashes, n - run + 1)
            low, high = np.searchsorted(keys, hashes[at]), np.searchsorted(keys, hashes[at], "right")
            for i in np.flatnonzero(high > low):
                for k, begin, offset, one in places[low[i] : high[i]].tolist():
                    start = int(at[i]) - offset
                    if start >= 0 and words[start : start + n] == self.texts[k][begin : begin + n]:
                        hit[start : start + n] = True
                        items.update(self.holders[self.ends[one] : self.ends[one + 1]].tolist())
        return np.flatnonzero(hit).tolist(), [self.names[i] for i in sorted(items)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, passage: int = 10, gram: int = 6, broadcast_bytes: int = 2 << 20) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, hits (positions of hit words), items.

    broadcast_bytes: the passages of a benchmark (item_id, text) of at most so many bytes of
    text go to every task; a larger one meets the documents in shuffled joins.
    """
    ship(docs.sparkSession)
    items, small = _items(benchmark, broadcast_bytes)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not small:
        own, uid = numbered(docs)
        return _by_join(own.withColumnRenamed(uid, "uid"), items, passage, gram).select("doc_id", "n_words", "hits", "items")
    known = _broadcast(items, passage, gram)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashed = WordHashes()
        for batch in batches:
            sizes, hits, names = [], [], []
            for text in byte_texts(batch.column("text")):
                words = words_of(text)
                found = known.value.find(words, hashed)
                sizes.append(len(words))
                hits.append(found[0])
                names.append(found[1])
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "hits", "items"])

    return docs.mapInArrow(scan, FOUND)


def _items(benchmark: DataFrame, broadcast_bytes: int) -> tuple[DataFrame, bool]:
    """The items with an id and a text, and whether they are small enough for every task."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct()
    return items, items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] <= broadcast_bytes


def _broadcast(items: DataFrame, passage: int, gram: int):
    """Made once, of at most broadcast_bytes of text."""
    texts = sorted((r[0], words_of(r[1].encode())) for r in items.collect())
    return items.sparkSession.sparkContext.broadcast(Passages(texts, passage, gram))


def _by_join(docs: DataFrame, items: DataFrame, passage: int, gram: int) -> DataFrame:
    """uid, doc_id, n_words, hits, items of docs (uid, doc_id, text), for a benchmark of any size.

    Only fingerprints with their places meet at first; the passages around the hits follow.
    """

    def spans(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashed = WordHashes()
        for batch in batches:
            rows: list[tuple] = []
            for item, text in zip(batch.column("item_id").to_pylist(), byte_texts(batch.column("text")), strict=True):
                words = words_of(text)
                rows.extend((item, b" ".join(words[start : start + n]), n, at, int(np.uint64(key).view(np.int64))) for start, n, at, key in passages_of(words, hashed, passage, gram))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item_id", "span", "n", "at", "key"])

    theirs = materialize(items.mapInArrow(spans, "item_id string, span binary, n int, at int, key long").distinct(), "passages")
    lengths = theirs.select("n").distinct().limit(passage)  # passage numbers at most
    short = [r[0] for r in lengths.collect() if r[0] < passage]

    def prints(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashed = WordHashes()
        for batch in batches:
            sizes, keys, places, runs, ends = [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [0]
            for text in byte_texts(batch.column("text")):
                words = words_of(text)
                numbers, total = hashed(words), 0
                for n in (0, *short):
                    hashes = gram_hashes(numbers, n or gram)
                    at = np.arange(len(hashes)) if n else winnow(hashes, passage - gram + 1)
                    keys.append(hashes[at])
                    places.append(at)
                    runs.append(np.full(len(at), n or passage, dtype=np.int32))
                    total += len(at)
                sizes.append(len(words))
                ends.append(ends[-1] + total)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(runs))], names=["key", "place", "n"])
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["uid", "n_words", "prints"])

    mine = materialize(docs.select("uid", "text").mapInArrow(prints, "uid long, n_words long, prints array<struct<key: long, place: int, n: int>>"), "fingerprints")
    known = theirs.groupBy("n", "key").agg(F.collect_set("at").alias("offsets"))  # passage numbers at most in a set
    met = mine.select("uid", F.explode("prints").alias("p")).select("uid", "p.*").join(known, ["n", "key"])
    starts = met.select("uid", "n", F.explode(F.transform("offsets", lambda at: F.col("place") - at)).alias("start")).filter("start >= 0").distinct()
    starts = starts.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("starts"))

    def around(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows: list[tuple] = []
            for uid, text, starts in zip(batch.column("uid").to_pylist(), byte_texts(batch.column("text")), batch.column("starts").to_pylist(), strict=True):
                words = words_of(text)
                rows.extend((uid, s["start"], s["n"], b" ".join(words[s["start"] : s["start"] + s["n"]])) for s in starts)
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["uid", "start", "n", "span"])

    own = docs.select("uid", "text").join(starts, "uid").mapInArrow(around, "uid long, start int, n int, span binary")
    own = materialize(own.join(theirs.select("span", "n").distinct(), ["span", "n"]), "hits")
    hits = own.select("uid", F.explode(F.sequence("start", F.expr("start + n - 1"))).alias("hit")).distinct().groupBy("uid").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    names = own.select("uid", "span", "n").distinct().join(theirs.select("span", "n", "item_id").distinct(), ["span", "n"])
    names = names.select("uid", "item_id").distinct().groupBy("uid").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    out = docs.select("uid", "doc_id").join(mine.select("uid", "n_words"), "uid").join(hits, "uid", "left").join(names, "uid", "left")
    return out.select("uid", "doc_id", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination_report(found: DataFrame) -> DataFrame:
    """Counts and a digest of the items from the rows of find_contamination."""
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, passage: int = 10, gram: int = 6, broadcast_bytes: int = 2 << 20) -> DataFrame:
    """docs, with all their columns, without the rows in which a passage of the benchmark stands."""
    ship(docs.sparkSession)
    items, small = _items(benchmark, broadcast_bytes)
    if not small:
        own, uid = numbered(docs)
        found = _by_join(own.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), items, passage, gram)
        return without(own, uid, found.filter(F.size("hits") > 0), "gone").select(*docs.columns)
    known = _broadcast(items, passage, gram)

    def clean(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashed = WordHashes()
        for batch in in_slices(batches):
            yield batch.filter(pa.array([not known.value.find(words_of(t), hashed)[0] for t in byte_texts(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
