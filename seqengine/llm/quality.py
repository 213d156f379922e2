"""Quality classifier: a support vector machine on naive Bayes features.

The n-grams of a text are its lower-cased words, and runs of one to three word shapes
(XX!! for "ERTION!!", with a mark where a word repeats the one before it). Their
indicators are scaled by the log-count ratio of the two classes; a linear hinge-loss
model is fitted to them by dual coordinate descent, and a logistic curve of the margin,
fitted to a part that the model of that step has not seen, gives the score.

The model is fitted on a bounded sample of labelled rows (`sample`); every whole text is
scored. Rows and edge cases: a null or empty text has no n-gram and gets the score of the
bias; without labels of both classes every score is the share of label 1, or 0.5; a null
doc_id is scored and counts as not held out; repeated rows get equal scores, and an id that
is repeated in docs teaches once, by its least text; an empty table
gives an empty result; clashing or further columns are ignored by `score_quality` and kept
by `drop_low_quality`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import ASCII_LOWER, WordHashes, byte_texts, gram_hashes, in_slices
from .linear import dual_coordinate_descent, fold, labelled_sample, logistic_of_margins, position_rows

DIMENSIONS = 1 << 18

_SPACE = bytes(range(9, 14)) + b"\x1c\x1d\x1e\x1f"
#: Letters become X or x, digits 0, white space a space; the rest stays.
_SHAPES = bytes(0x58 if 65 <= c <= 90 else 0x78 if 97 <= c <= 122 or c >= 128 else 0x30 if 48 <= c <= 57 else 0x20 if c in _SPACE else c for c in range(256))
_RUNS = re.compile(rb"x{2,}")
_CAPITALS = re.compile(rb"X{2,}")


class Indicators:
    """The distinct n-grams of a text as positions below DIMENSIONS."""

    def __init__(self) -> None:
        self.words, self.shapes = WordHashes(), WordHashes(50_000)

    def __call__(self, text: bytes) -> np.ndarray:
        words = self.words(text.translate(ASCII_LOWER).split())
        if not len(words):
            return np.empty(0, dtype=np.int32)
        shapes = self.shapes(_CAPITALS.sub(b"XX", _RUNS.sub(b"x", text.translate(_SHAPES))).split())
        # white space beyond ASCII does not split bytes, so both have a word for a word
        shapes = shapes[: len(words)].copy()
        shapes[1:] ^= (words[1 : len(shapes)] == words[: len(shapes) - 1]).astype(np.uint64) << np.uint64(63)
        grams = [words, *(gram_hashes(shapes, n) + np.uint64(n) for n in (1, 2, 3))]
        return np.unique((np.concatenate(grams) >> np.uint64(7)).astype(np.int64) & (DIMENSIONS - 1)).astype(np.int32)


class Model:
    """Weights by position: value[j] for the margin and norm[j] for the length of the vector."""

    def __init__(self, value: np.ndarray, norm: np.ndarray, bias: float, a: float, b: float):
        self.value, self.norm, self.bias, self.a, self.b = value.astype(np.float32), norm.astype(np.float32), bias, a, b

    def margin(self, at: np.ndarray) -> float:
        return float(self.value[at].sum(dtype=np.float64) / max(np.sqrt(self.norm[at].sum(dtype=np.float64)), 1e-12)) + self.bias if len(at) else self.bias

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(at) + self.b, -30, 30))))


def _fit(rows: list[np.ndarray], y: np.ndarray, smooth: float, cost: float, passes: int) -> Model:
    counts = {}
    for sign in (1, -1):
        mine, found = [r for r, s in zip(rows, y, strict=True) if s == sign], np.zeros(DIMENSIONS)
        for r in mine:  # positions of a row are distinct
            found[r] += 1
        counts[sign] = (found + smooth) / (len(mine) + 2 * smooth)
    ratio = np.log(counts[1] / counts[-1])
    w, bias = dual_coordinate_descent(rows, y, ratio, cost, passes)
    return Model(w * ratio, ratio * ratio, bias, 1.0, 0.0)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, sample: int = 12_000, smooth: float = 1.0, cost: float = 1.0, passes: int = 8) -> Model:
    """Fits on at most `sample` labelled rows outside fold 0. Only their positions come to the driver."""
    ship(docs.sparkSession)
    chosen = labelled_sample(labels, label, sample, folds)

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        indicators = Indicators()
        for batch in in_slices(batches):
            found = [indicators(t).tobytes() for t in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(found, pa.binary())], names=["id", "y", "at"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # a repeated id teaches once
    table = texts.mapInArrow(features, "id long, y int, at binary").toArrow()
    order = np.argsort(table.column("id").to_numpy()) if len(table) else []
    at = position_rows(table.column("at"))
    rows, y = [at[i] for i in order], np.array([1 if table.column("y")[int(i)].as_py() else -1 for i in order])
    if len(set(y.tolist())) < 2:
        share = float((y > 0).mean()) if len(y) else 0.5
        zero = np.zeros(DIMENSIONS)
        return Model(zero, zero, 0.0, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    seen = np.arange(len(rows)) % 5 != 0
    a, b = 1.0, 0.0
    if len(set(y[seen].tolist())) == 2 and len(set(y[~seen].tolist())) == 2:
        part = _fit([r for r, s in zip(rows, seen, strict=True) if s], y[seen], smooth, cost, passes)
        a, b = logistic_of_margins(np.array([part.margin(r) for r, s in zip(rows, seen, strict=True) if not s]), y[~seen])
    model = _fit(rows, y, smooth, cost, passes)
    model.a, model.b = a, b
    return model


def score_quality(docs: DataFrame, model: Model, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        indicators = Indicators()
        for batch in in_slices(batches):
            found = [shared.value.score(indicators(t)) for t in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    held_out = F.coalesce(fold("doc_id", folds) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs, with all their columns, without the rows that score below the threshold."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        indicators = Indicators()
        for batch in in_slices(batches):
            yield batch.filter(pa.array([shared.value.score(indicators(t)) >= threshold for t in byte_texts(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
