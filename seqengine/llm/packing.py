"""Packing of tokenised documents into sequences of a fixed length by exact-complement hashing.

Documents become pieces (Spark: one pass, no shuffle). How many pieces there are of each length is all that a plan
needs: for the longest length left, the gap is looked
up among single lengths, then pair sums, then triple sums; a combination that fills the
gap exactly is used as often as the counts allow. What finds no exact complement is
packed by best fit. The plan is made once, for all pieces, from these counts (as many as a sequence has tokens); a piece finds its
place by its rank among the pieces of its length: its rank in the task that cut it, behind those of the tasks before.

Rows and edge cases: a null or empty text is the end token alone; a repeated row or a null
doc_id is packed like any other row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import in_slices, materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


def default_ranks() -> str:
    """The byte-level BPE vocabulary of 50,257 ids, as ranks (the vocabulary of byte_bpe_50k.json)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encoders: dict[str, object] = {}


def encoder(ranks: str):
    """The encoder of a rank file, loaded once in each Python worker."""
    if ranks not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encoders[ranks] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)})
    return _encoders[ranks]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; all but the first are full."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of at most capacity tokens of docs (doc_id, text)."""
    ship(docs.sparkSession)
    ranks = ranks or default_ranks()

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(ranks).encode_to_numpy
        for batch in in_slices(batches):
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or "", allowed_special="all"), end_id).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    for column, x in zip(rows, (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


class Complements:
    """Lengths with counts; finds one to three lengths that are left and sum to a gap."""

    def __init__(self, counts: np.ndarray):
        self.left = counts
        self._index()

    def _index(self) -> None:
        """Which sums one length, two and three lengths make. Counts only fall, so an old
        index names too many sums, never too few; it is made anew when one has gone."""
        self.one = (self.left > 0).astype(np.float64)
        self.two = np.rint(np.convolve(self.one, self.one))[: len(self.one)] > 0
        self.three = np.rint(np.convolve(self.one, self.two.astype(np.float64)))[: len(self.one)] > 0

    def _enough(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[x] >= n for x, n in Counter(lengths).items())

    def _pair(self, taken: tuple[int, ...], gap: int) -> tuple[int, ...] | None:
        if gap < 2 or not self.two[gap]:
            return None
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        for x in a[(self.left[a] > 0) & (self.left[gap - a] > 0)]:
            if self._enough(found := (*taken, int(x), int(gap - x))):
                return found
        return None

    def fill(self, length: int, gap: int) -> tuple[int, ...] | None:
        """(length, and the lengths that fill the gap exactly), the longest ones first."""
        if self.left[gap] and self._enough((length, gap)):
            return length, gap
        if found := self._pair((length,), gap):
            return found
        if gap < 3 or not self.three[gap]:
            return None
        self._index()
        if not self.three[gap]:
            return None
        a = np.arange(gap - 2, 0, -1)
        for x in a[(self.left[a] > 0) & self.two[gap - a]]:
            if self._enough((length, int(x))) and (found := self._pair((length, int(x)), int(gap - x))):
                return found
        return None

    def nearest(self, length: int, gap: int) -> tuple[int, ...]:
        """(length, and one to three lengths that leave the least of the gap), or length alone."""
        for s in range(gap - 1, 0, -1):
            if (self.one[s] or self.two[s] or self.three[s]) and (found := self.fill(length, s)):
                return found
        return (length,)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that share a sequence, number of such sequences), from the count of each length.

    Exact complements are sought for all lengths, or only for those above some part of the
    capacity, which keeps short pieces for the rest; of sixteen such parts the plan of fewest sequences counts.
    """
    plans = [_plan(counts, capacity, down_to) for down_to in range(0, capacity, max(1, capacity // 16))]
    return min(plans, key=lambda found: sum(times for _, times in found))


def _plan(counts: np.ndarray, capacity: int, down_to: int) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(capacity + 1, dtype=np.int64)
    left[: len(counts)] = counts
    out = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    index, part = Complements(left), []
    for length in range(capacity - 1, down_to, -1):
        while left[length]:
            found = index.fill(length, capacity - length) or index.nearest(length, capacity - length)
            need = Counter(found)
            times = min(int(left[x]) // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= n * times
            (out if sum(found) == capacity else part).append((found, times))
    return out + best_fit(left, capacity, part)


def best_fit(left: np.ndarray, capacity: int, part: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each length goes where it leaves the least space, sequences that are
    filled in part included; like sequences are handled together."""
    open_: dict[int, Counter] = defaultdict(Counter)  # by space left
    for held, times in part:
        open_[capacity - sum(held)][held] += times
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            space = next((s for s in range(length, capacity) if open_.get(s)), None)
            if space is None:
                each = min(capacity // length, n)
                open_[capacity - each * length][(length,) * each] += n // each
                n %= each
                continue
            held, many = open_[space].popitem()
            used = min(n, many)
            if many > used:
                open_[space][held] += many - used
            open_[space - length][(*held, length)] += used
            n -= used
    return [(held, many) for same in open_.values() for held, many in same.items()]


class Slots:
    """Where the pieces of each length go: the r-th piece of a length in the run of a plan's entry that holds r."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]]):
        self.runs: dict[int, list[list[int]]] = {}
        taken, base = Counter(), 0
        for lengths, times in planned:
            at = 0
            for x in lengths:
                self.runs.setdefault(x, []).append([taken[x], base, at])
                taken[x] += times
                at += x
            base += times

    def arrays(self) -> dict[int, np.ndarray]:
        """By length: the first rank of each run, and the sequence and the offset of the piece with that rank."""
        return {x: np.array(runs, dtype=np.int64).T for x, runs in self.runs.items()}


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset: a place in a sequence of at most capacity tokens."""
    spark = pieces.sparkSession
    ship(spark)

    def rank(batches: Iterator) -> Iterator:
        """Pieces with the number of the task and their rank among the pieces of their length in it."""
        import pyarrow as pa
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            starts = np.searchsorted(length[order], length[order])
            ranks = np.empty(len(length), dtype=np.int64)
            ranks[order] = seen[length[order]] + np.arange(len(length)) - starts
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), task, dtype=np.int32)), pa.array(ranks)], names=[*batch.schema.names, "task", "rank"])

    columns = PIECES.replace(" long", "").replace(" int", "").split(", ")
    kept = materialize(pieces.select(*columns).mapInArrow(rank, f"{PIECES}, task int, rank long"), "pieces")
    counts = materialize(kept.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length
        totals[row["length"]] = row["n"]
    shared = spark.sparkContext.broadcast(Slots(plan(totals, capacity)).arrays())
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        slots = shared.value
        for batch in batches:
            length, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            for x in np.unique(length).tolist():
                own = np.flatnonzero(length == x)
                first, base, at = slots[x]
                run = np.searchsorted(first, ranks[own], side="right") - 1
                sequence[own], offset[own] = base[run] + ranks[own] - first[run], at[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    met = kept.join(before.hint("merge"), ["task", "length"])
    return met.select(*columns, (F.col("before") + F.col("rank")).alias("rank")).mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, ranks: str | None = None) -> DataFrame:
    """Tokenises docs (doc_id, text) and packs them; one row per piece."""
    return pack_pieces(token_pieces(docs, capacity, end_id, ranks), capacity)
