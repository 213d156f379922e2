"""Edit-aware token counts.

For each document a segment tree is kept: its leaves are runs of pre-tokens (the pieces
that byte-level BPE never merges across) with their characters and tokens, and each inner
node has the sums of its two children. An edit finds its leaves by descending the tree,
cuts pre-tokens anew from one leaf (and as many characters as a special token has) before it
until the cuts meet an old leaf's start after it, encodes only those, and updates the sums
above. The result equals a full count.

Rows and edge cases: a null or empty text has no token; the string of a special token is that
one token, as in packing; an edit beyond the text is moved to its end, a null part of an edit is 0 or
empty, a null list is no edit; repeated documents are counted each, and edits of a
repeated id go to each of its rows; a null doc_id gets no edits by join; empty tables give
empty results; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .packing import default_ranks, encoder

TREES = "doc_id long, text string, n_tokens long, tree struct<chars: array<int>, tokens: array<int>>"
EDITED = "doc_id long, text string, n_tokens_before long, n_tokens long, n_encoded_chars long, tree struct<chars: array<int>, tokens: array<int>>"
EDITS = "array<struct<pos: long, removed: long, inserted: string>>"


#: A piece of its own wherever it stands.
SPECIAL = "<|endoftext|>"


class PieceCounts:
    """Pre-tokens of texts and their token counts; a bounded cache keeps the frequent ones."""

    def __init__(self, ranks: str, most: int = 300_000):
        import public_tokenizers
        import regex

        self.cut = regex.compile(public_tokenizers.PATTERN)
        self.encode, self.known, self.most = encoder(ranks).encode_ordinary, {}, most

    def pieces(self, text: str, start: int = 0) -> Iterator[str]:
        """The pre-tokens of a text from a place on at which one begins."""
        while start < len(text):
            special = text.find(SPECIAL, start)
            end = special if special >= 0 else len(text)
            for m in self.cut.finditer(text, start, end):
                yield m[0]
            if special >= 0:
                yield SPECIAL
            start = end + len(SPECIAL)

    def whole(self, text: str) -> list[str]:
        return list(self.pieces(text)) if SPECIAL in text else self.cut.findall(text)

    def counts(self, pieces: list[str]) -> list[int]:
        known, out = self.known, []
        for p in pieces:
            n = known.get(p)
            if n is None:
                if len(known) >= self.most:
                    known.clear()
                n = len(self.encode(p)) if p != SPECIAL else 1
                if len(p) <= 64:
                    known[p] = n
            out.append(n)
        return out


class CountTree:
    """A segment tree as two heaps: node i has the sums of nodes 2i and 2i+1; leaves are the last half."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens

    @classmethod
    def of_leaves(cls, chars: list[int], tokens: list[int]) -> CountTree:
        width = 1 << max(len(chars) - 1, 0).bit_length()
        heaps = []
        for leaves in (chars, tokens):
            heap = np.zeros(2 * width, dtype=np.int64)
            heap[width : width + len(leaves)] = leaves
            level = width
            while level > 1:
                heap[level // 2 : level] = heap[level : 2 * level : 2] + heap[level + 1 : 2 * level : 2]
                level //= 2
            heaps.append(heap)
        return cls(*heaps)

    @property
    def width(self) -> int:
        return len(self.chars) // 2

    def leaf_at(self, pos: int) -> tuple[int, int]:
        """(leaf that holds character pos, its start); the last leaf with characters for a pos at the end."""
        node, start = 1, 0
        pos = min(pos, max(int(self.chars[1]) - 1, 0))
        while node < self.width:
            node *= 2
            if pos - start >= self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.width, start

    def replace(self, first: int, chars: list[int], tokens: list[int]) -> None:
        """Sets len(chars) leaves from the first on, and the sums above them."""
        for heap, leaves in ((self.chars, chars), (self.tokens, tokens)):
            low, high = self.width + first, self.width + first + len(leaves)
            heap[low:high] = leaves
            while low > 1:
                low, high = low // 2, (high - 1) // 2 + 1
                for node in range(low, high):
                    heap[node] = heap[2 * node] + heap[2 * node + 1]


def leaves_of(pieces: list[str], counts: list[int], leaf: int) -> tuple[list[int], list[int]]:
    starts = range(0, len(pieces), leaf)
    return [sum(map(len, pieces[i : i + leaf])) for i in starts], [sum(counts[i : i + leaf]) for i in starts]


def build(text: str, counter: PieceCounts, leaf: int) -> CountTree:
    pieces = counter.whole(text)
    return CountTree.of_leaves(*leaves_of(pieces, counter.counts(pieces), leaf))


def edit(text: str, tree: CountTree, pos: int, removed: int, inserted: str, counter: PieceCounts, leaf: int) -> tuple[str, CountTree, int]:
    """The text and tree after one edit, and the number of characters cut and encoded anew."""
    pos = min(max(pos, 0), len(text))
    removed = min(max(removed, 0), len(text) - pos)
    new = text[:pos] + inserted + text[pos + removed :]
    if not text or not new:
        return new, build(new, counter, leaf), len(new)
    first, start = tree.leaf_at(pos)
    # a leaf with characters before it (edits leave empty ones), and room for a special token that the edit completes
    before = start
    while first and (start == before or pos - start < len(SPECIAL)):
        first -= 1
        start -= int(tree.chars[tree.width + first])
    shift, settled = len(inserted) - removed, pos + len(inserted)
    # starts of old leaves behind the edit, in new positions, as far as they are needed
    last, ahead = first, start
    pieces: list[str] = []
    at = start
    for piece in counter.pieces(new, start):
        pieces.append(piece)
        at += len(piece)
        while last < tree.width and (ahead + shift < at or ahead < pos + removed):
            ahead += int(tree.chars[tree.width + last])
            last += 1
        if at >= settled and ahead + shift == at and ahead >= pos + removed:
            break
    if at == len(new):
        last = tree.width
    counts, width = counter.counts(pieces), last - first
    if last == tree.width:
        last = max(int(np.flatnonzero(tree.chars[tree.width :])[-1]) + 1, first + 1)
        width = last - first
    if len(pieces) > 4 * leaf * width:
        # too many for these leaves: the tree is laid out anew, from the counts of the leaves
        chars, tokens = leaves_of(pieces, counts, leaf)
        old_chars, old_tokens = tree.chars[tree.width :].tolist(), tree.tokens[tree.width :].tolist()
        return new, CountTree.of_leaves(old_chars[:first] + chars + old_chars[last:], old_tokens[:first] + tokens + old_tokens[last:]), at - start
    each = max(1, -(-len(pieces) // width))
    chars, tokens = leaves_of(pieces, counts, each)
    tree.replace(first, chars + [0] * (width - len(chars)), tokens + [0] * (width - len(tokens)))
    return new, tree, at - start


def _arrow_tree(trees: list[CountTree]):
    import pyarrow as pa

    kind = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
    return pa.array([{"chars": t.chars.astype(np.int32), "tokens": t.tokens.astype(np.int32)} for t in trees], kind)


def _changed(text: str, tree: CountTree, changes: list[dict] | None, counter: PieceCounts, leaf: int) -> tuple[str, CountTree, int]:
    """The text and tree after some edits, one after another, and how many characters were encoded anew."""
    encoded = 0
    for e in changes or ():
        text, tree, n = edit(text, tree, e["pos"] or 0, e["removed"] or 0, e["inserted"] or "", counter, leaf)
        encoded += n
    return text, tree, encoded


def _edited_batch(batch, before: list[int], changed: list[tuple[str, CountTree, int]]):
    import pyarrow as pa

    texts, trees, encoded = (list(x) for x in zip(*changed, strict=True)) if changed else ([], [], [])
    columns = [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array([int(t.tokens[1]) for t in trees], pa.int64()), pa.array(encoded, pa.int64()), _arrow_tree(trees)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_tokens_before", "n_tokens", "n_encoded_chars", "tree"])


def count_trees(docs: DataFrame, leaf: int = 64, ranks: str | None = None) -> DataFrame:
    """doc_id, text, n_tokens and the segment tree of every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    ranks = ranks or default_ranks()

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = PieceCounts(ranks)
        for batch in batches:
            trees = [build(t or "", counter, leaf) for t in batch.column("text").to_pylist()]
            total = pa.array([int(t.tokens[1]) for t in trees], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), total, _arrow_tree(trees)], names=["doc_id", "text", "n_tokens", "tree"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, TREES)


def apply_edit_lists(trees: DataFrame, edits: str = "edits", leaf: int = 64, ranks: str | None = None) -> DataFrame:
    """Applies each row's list of edits (pos, removed, inserted), one after another, to its text and its kept tree."""
    ship(trees.sparkSession)
    ranks = ranks or default_ranks()

    def apply(batches: Iterator) -> Iterator:
        counter = PieceCounts(ranks)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "tree", "edits")), strict=True)
            changed = [_changed(text or "", CountTree(np.array(tree["chars"], dtype=np.int64), np.array(tree["tokens"], dtype=np.int64)), changes, counter, leaf) for text, tree, changes in rows]
            yield _edited_batch(batch, batch.column("n_tokens").to_pylist(), changed)

    return trees.select("doc_id", "text", "n_tokens", "tree", F.col(edits).cast(EDITS).alias("edits")).mapInArrow(apply, EDITED)


def count_edited(docs: DataFrame, edits: str = "edits", leaf: int = 64, ranks: str | None = None) -> DataFrame:
    """count_trees and apply_edit_lists in one pass over docs (doc_id, text, edits); trees stay in the task."""
    ship(docs.sparkSession)
    ranks = ranks or default_ranks()

    def both(batches: Iterator) -> Iterator:
        counter = PieceCounts(ranks)
        for batch in batches:
            before, changed = [], []
            for text, changes in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                tree = build(text or "", counter, leaf)
                before.append(int(tree.tokens[1]))
                changed.append(_changed(text or "", tree, changes, counter, leaf))
            yield _edited_batch(batch, before, changed)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(edits).cast(EDITS).alias("edits")).mapInArrow(both, EDITED)


def apply_edits(trees: DataFrame, edits: DataFrame, leaf: int = 64, ranks: str | None = None) -> DataFrame:
    """The same for a table of edits (doc_id, seq, pos, removed, inserted) on kept trees.

    A document's edits follow each other, so they come to its rows as one list.
    """
    lists = edits.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    lists = lists.agg(F.sort_array(F.collect_list(F.struct("seq", "pos", "removed", "inserted"))).alias("edits"))
    lists = lists.select("doc_id", F.transform("edits", lambda e: F.struct(e["pos"].alias("pos"), e["removed"].alias("removed"), e["inserted"].alias("inserted"))).alias("edits"))
    return apply_edit_lists(trees.join(lists, "doc_id", "left"), "edits", leaf, ranks)
