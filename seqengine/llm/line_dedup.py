"""Removal of lines that many documents share: hashes in ranges, sorted by document and position.

Each document's lines become keys (stripped, A-Z lower-cased) and those 128-bit hashes, one row
for each different key with all of its positions. The rows are dealt out by ranges of (hash,
document), so that a line that a third of all documents share is cut into as many ranges as it
needs, and are sorted within each. One pass then streams through a range and says which rows go; it
holds less than `min_docs` rows. Only the first and the last hash of a range can go on in another:
for these a count is given, two rows a task, and what is still open is settled from the sums.
The result is a compressed bitmap of kept lines for each document; texts aren't shuffled for it.

Rows and edge cases: a null or empty text is one empty line; each row is a document of its own,
even one whose id is null or repeated; the earlier of two rows is that which was read first, so which
one keeps a line under `keep_first` is set by the order of the input's files and rows; keys of fewer code points than
`min_chars` never go; equal keys are told by 128 bits of hash; an empty table gives an empty
result. Other columns are ignored by `line_bitmaps` and kept by `drop_repeated_lines`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import ASCII_LOWER, byte_texts, fresh, materialize, numbered, whole_text

#: What is stripped at both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
KEYS = "a long, b long, uid long, n_lines int, positions array<int>"
STREAMED = f"{KEYS}, n long"
BITMAPS = "uid long, n_lines int, n_dropped int, keep_bitmap binary"


def code_points(text: bytes) -> int:
    return len(text) - sum(map(text.count, CONTINUED)) if not text.isascii() else len(text)


CONTINUED = [bytes([b]) for b in range(0x80, 0xC0)]


def pack(n_lines: int, dropped: np.ndarray) -> bytes:
    """The bitmap of kept lines: a bit each, the first line lowest, compressed."""
    keep = np.ones(n_lines, dtype=bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n_lines, bitorder="little").astype(bool)


def line_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(a, b, uid, n_lines, positions) for each different key of each of docs (uid, text); a and b are its hash."""

    def keys(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest as digest

        for batch in batches:
            hashes, uids, counts, starts, places = [], [], [], [0], []
            for uid, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                lines, own = text.split(b"\n"), {}
                for i, line in enumerate(lines):
                    key = line.strip(BLANKS).translate(ASCII_LOWER)
                    if len(key) >= min_chars and (min_chars <= 1 or code_points(key) >= min_chars):
                        own.setdefault(key, []).append(i)
                for key, at in own.items():
                    hashes.append(digest(key))
                    places += at
                    starts.append(len(places))
                uids += [uid] * len(own)
                counts += [len(lines)] * len(own)
            halves = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
            positions = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(places, pa.int32()))
            columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(uids, pa.int64()), pa.array(counts, pa.int32()), positions]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "uid", "n_lines", "positions"])

    return docs.select("uid", "text").mapInArrow(keys, KEYS)


def stream(min_docs: int, keep_first: bool):
    """For mapInArrow over one range of rows (a, b, uid, n_lines, positions), sorted by hash and uid.

    Gives rows to drop (hash null), rows that other ranges decide (with hash), and for the range's
    first and last hash how many rows it has here and the least uid of these (n set, positions null).
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("uid", pa.int64()), ("n_lines", pa.int32()), ("positions", pa.list_(pa.int32())), ("n", pa.int64())])

        def gone(rows, settled: np.ndarray):
            """Rows to drop; those not settled carry their hash."""
            known = pa.array(settled)
            null = pa.nulls(len(rows), pa.int64())
            a, b = (pa.compute.if_else(known, null, rows.column(k)) for k in (0, 1))
            return pa.RecordBatch.from_arrays([a, b, rows.column(2), rows.column(3), rows.column(4).cast(pa.list_(pa.int32())), null], schema=schema)

        def without_first(rows, firsts: np.ndarray):
            """The same rows without the first position of those marked."""
            column = rows.column(4)
            starts = column.offsets.to_numpy().astype(np.int64)
            mask = np.ones(int(starts[-1] - starts[0]), dtype=bool)
            mask[starts[:-1][firsts] - starts[0]] = False
            ends = np.concatenate([[0], np.cumsum(np.diff(starts) - firsts)]).astype(np.int32)
            values = column.values.slice(int(starts[0]), len(mask)).filter(pa.array(mask))
            made = pa.ListArray.from_arrays(pa.array(ends), values)
            return pa.RecordBatch.from_arrays([*rows.columns[:4], made], names=rows.schema.names)

        def count(key: tuple[int, int], n: int, first: int):
            columns = [pa.array([x], pa.int64()) for x in (*key, first)] + [pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int32())), pa.array([n], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        # The open run: its key, rows seen before `held`, its least uid, is it the range's first; held: its rows that wait.
        key, before, least, opening, held = None, 0, None, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
            a, b, uid = (rows.column(k).to_numpy() for k in range(3))
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            sizes = np.diff(np.append(starts, len(a)))
            totals = sizes.copy()
            goes_on = key == (int(a[0]), int(b[0]))
            if goes_on:
                totals[0] += before
            elif key is not None:  # all rows of the open run were given before; now it's closed
                if opening:
                    yield count(key, before, least)
                opening, before = False, 0
            run_least = uid[starts].copy()
            if goes_on:
                run_least[0] = least
            run_of = np.repeat(np.arange(len(starts)), sizes)
            many = totals >= min_docs
            first_of_run = np.zeros(len(a), dtype=bool)
            first_of_run[starts] = True
            if goes_on and before:
                first_of_run[0] = False
            is_edge = np.zeros(len(starts), dtype=bool)
            is_edge[0] = opening
            closed = np.arange(len(starts)) < len(starts) - 1
            give = many[run_of] | (is_edge & closed)[run_of]
            settled = many[run_of]
            if keep_first:
                settled = settled & ~(first_of_run & is_edge[run_of])
                inner = first_of_run & settled
            if give.any():
                out = rows.filter(pa.array(give))
                if keep_first:
                    out = without_first(out, inner[give])
                yield gone(out, settled[give])
            last = len(starts) - 1
            if opening and last > 0:
                yield count((int(a[0]), int(b[0])), int(totals[0]), int(run_least[0]))
            opening = opening and last == 0
            key, least = (int(a[-1]), int(b[-1])), int(run_least[last])
            held = None if many[last] else rows.slice(int(starts[last]))
            before = int(totals[last]) if many[last] else 0
        if key is None:
            return
        n = before + (len(held) if held is not None else 0)
        yield count(key, n, least)
        if held is not None:
            yield gone(held, np.zeros(len(held), dtype=bool))

    return run


def dropped_positions(keys: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """(uid, n_lines, positions) to drop, some rows for a document."""
    ranged = keys.repartitionByRange("a", "b", "uid").sortWithinPartitions("a", "b", "uid")
    found = materialize(ranged.mapInArrow(stream(min_docs, keep_first), STREAMED), "streamed")
    # Two rows a task at most.
    edges = found.filter("n is not null").groupBy("a", "b").agg(F.sum("n").alias("total"), F.min("uid").alias("least"))
    waiting = found.filter("n is null and a is not null").join(F.broadcast(edges), ["a", "b"])
    waiting = waiting.filter(F.col("total") >= min_docs)
    positions = F.col("positions")
    if keep_first:
        positions = F.when(F.col("uid") == F.col("least"), F.slice(positions, 2, F.size(positions))).otherwise(positions)
    waiting = waiting.select("uid", "n_lines", positions.alias("positions"))
    return found.filter("n is null and a is null").select("uid", "n_lines", "positions").unionByName(waiting).filter(F.size("positions") > 0)


def _bitmaps(own: DataFrame, uid: str, min_docs: int, min_chars: int, keep_first: bool) -> DataFrame:
    """(uid, n_lines, n_dropped, keep_bitmap) for those of own that lose a line."""
    keys = materialize(line_keys(own.select(F.col(uid).alias("uid"), "text"), min_chars), "line-keys")
    lost = dropped_positions(keys, min_docs, keep_first)
    lost = lost.groupBy("uid").agg(F.first("n_lines").alias("n_lines"), F.flatten(F.collect_list("positions")).alias("positions"))

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts = batch.column("n_lines").to_pylist()
            places = [np.asarray(p.values) for p in batch.column("positions")]
            maps = [pack(n, at) for n, at in zip(counts, places, strict=True)]
            columns = [batch.column("uid"), pa.array(counts, pa.int32()), pa.array(list(map(len, places)), pa.int32()), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "n_lines", "n_dropped", "keep_bitmap"])

    return lost.mapInArrow(made, BITMAPS)


def _n_lines(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1).cast("int")


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep_bitmap for each row of docs (doc_id, text); `unpack` reads a bitmap. Null: all lines stay.

    min_docs: keys of that many documents or more are repeated. keep_first: the first line of a
    repeated key stays, all others of it go, also further ones in the same document; else all go.
    """
    own, uid = numbered(docs.select("doc_id", "text", _n_lines(whole_text()).alias("n_lines")))
    found = _bitmaps(own, uid, min_docs, min_chars, keep_first).withColumnRenamed("uid", uid).drop("n_lines")
    return own.drop("text").join(found, uid, "left").select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "keep_bitmap")


@F.pandas_udf(StringType())
def kept_lines(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    """The lines of a text that its bitmap keeps; null where there is none."""

    def one(t, bits):
        if bits is None:
            return None
        lines = (t or "").split("\n")
        return "\n".join([lines[i] for i in np.flatnonzero(unpack(bits, len(lines)))])

    return pd.Series([one(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs, with all their columns, without the repeated lines; a text that loses none is as it was.

    counts: names of two more columns, how many lines a text had and how many of them went.
    """
    own, uid = numbered(docs)
    found = _bitmaps(own, uid, min_docs, min_chars, keep_first)
    bits, lost = fresh(docs, "keep_bitmap"), fresh(docs, "n_dropped")
    found = found.select(F.col("uid").alias(uid), F.col("keep_bitmap").alias(bits), F.col("n_dropped").alias(lost))
    met = own.join(found.hint("merge"), uid, "left")  # bitmaps grow with the input: never sent to every task, however few they are
    text = F.coalesce(kept_lines(F.when(F.col(bits).isNotNull(), F.col("text")), F.col(bits)), F.col("text"))
    more = []
    if counts:
        more = [_n_lines(whole_text()).alias(counts[0]), F.coalesce(lost, F.lit(0)).alias(counts[1])]
    return met.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], *more)


def line_report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row of docs (doc_id, text)."""
    left = drop_repeated_lines(docs.select("doc_id", "text"), min_docs, min_chars, counts=("n_lines", "n_dropped"))
    return left.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(whole_text().cast("binary"), 256).alias("kept_sha256"))
