"""Small sparse linear models for the classifiers: fitted on a bounded sample, applied to every row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(column: str, folds: int) -> Column:
    """crc32 of an id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def labelled_sample(labels: DataFrame, label: str, rows: int, folds: int) -> DataFrame:
    """(id, y) of at most `rows` labelled rows (doc_id, label 0/1) outside fold 0, the first in an order by hash.

    A doc_id with both labels counts as label 1; null ids and labels are left out.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    usable = usable.filter(F.col("y").isin(0, 1) & (fold("id", folds) != 0))
    return usable.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, passes: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model with hinge loss on unit vectors of scaled indicators.

    rows: the indicator positions of each example; y: -1 or 1. The dual of the hinge loss is
    solved one variable at a time; classes weigh alike.
    """
    w, bias = np.zeros(len(scale)), 0.0
    lengths = np.array([max(np.linalg.norm(scale[r]), 1e-12) for r in rows])  # the vectors are made anew in each pass: all of them are many times the rows
    square = np.array([v @ v + 1.0 for v in (scale[r] / length for r, length in zip(rows, lengths, strict=True))])
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    most, alpha, order = cost * 0.5 / share, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            r, v = rows[i], scale[rows[i]] / lengths[i]
            slope = y[i] * (w[r] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), most[i])
            if step := (new - alpha[i]) * y[i]:
                w[r] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def position_rows(column) -> list[np.ndarray]:
    """The rows of an Arrow binary column as 32-bit positions: views of one buffer, none of which is copied."""
    import pyarrow as pa

    rows = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            _, offsets, data = chunk.buffers()
            wide = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
            at = np.frombuffer(offsets, dtype=wide, count=len(chunk) + 1, offset=chunk.offset * np.dtype(wide).itemsize).tolist()
            held = data if data is not None else b""
            rows += [np.frombuffer(held, dtype=np.int32, count=(high - low) // 4, offset=low) if high > low else np.empty(0, dtype=np.int32) for low, high in zip(at, at[1:], strict=False)]
    return rows


def logistic_of_margins(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b), by Newton steps with smoothed targets."""
    ones = float((y > 0).sum())
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    x, beta = np.column_stack([margins, np.ones(len(margins))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (t - p))
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def soft_logistic(x: np.ndarray, p: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Weights (the bias last) of a logistic model of soft labels p, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - q) - keep * beta
        hessian = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return beta
