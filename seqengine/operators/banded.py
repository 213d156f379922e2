"""Symmetric banded systems along a clip, solved in parts (STB05).

The unknowns of a clip are cut into blocks of three, of which each meets only the next one and the one before: a
block tridiagonal system. Runs of blocks are eliminated side by side, all but the last block of each: what they
leave behind is again such a system, of the last blocks only, and is solved in the same way, until
a run holds all that is left. Then each unknown follows from the two last blocks around it, by a join and a sum. No task holds more than
`run` blocks (twice as many at a clip's end), whatever the length of a clip.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship

WIDTH = 3
#: First to third differences.
STENCILS = (np.array([-1.0, 1.0]), np.array([1.0, -2.0, 1.0]), np.array([-1.0, 3.0, -3.0, 1.0]))


def solve_blocks(diagonal: np.ndarray, upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a symmetric block tridiagonal system by cyclic reduction.

    diagonal (k, 3, 3), upper (k, 3, 3): block i against block i + 1 (the last isn't read), right (k, 3, columns).
    Blocks at even places are eliminated at once, and what is left is half as long.
    """
    k = len(diagonal)
    if k == 1:
        return np.linalg.solve(diagonal, right)
    even = np.arange(0, k, 2)
    odd = np.arange(1, k, 2)
    n = right.shape[2]
    # D^-1 times (right, coupling to the block before, coupling to the block after), for even blocks.
    before, after = np.zeros((len(even), WIDTH, WIDTH)), np.zeros((len(even), WIDTH, WIDTH))
    before[1:] = upper[even[1:] - 1].transpose(0, 2, 1)
    has = even < k - 1
    after[has] = upper[even[has]]
    made = np.linalg.solve(diagonal[even], np.concatenate([right[even], before, after], axis=2))
    r, b, a = made[:, :, :n], made[:, :, n : n + WIDTH], made[:, :, n + WIDTH :]
    left = np.arange(len(odd))  # the even block before odd block i is even block i, that after it i + 1
    has = left + 1 < len(even)
    to_left = upper[odd - 1].transpose(0, 2, 1)
    to_right = upper[odd[has]]
    new_right = right[odd] - to_left @ r[left]
    new_diagonal = diagonal[odd] - to_left @ a[left]
    new_upper = np.zeros((len(odd), WIDTH, WIDTH))
    new_right[has] -= to_right @ r[left[has] + 1]
    new_diagonal[has] -= to_right @ b[left[has] + 1]
    new_upper[has] = -to_right @ a[left[has] + 1]
    x = np.empty_like(right)
    x[odd] = solve_blocks(new_diagonal, new_upper, new_right)
    x[even] = r
    x[even[1:]] -= b[1:] @ x[even[1:] - 1]
    inner = even < k - 1
    x[even[inner]] -= a[inner] @ x[even[inner] + 1]
    return x


def smoothness_blocks(weight: np.ndarray, paths: np.ndarray, start: int, n: int, closeness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, upper, first, right) of the rows from `start` on in the system of the smoothest curve.

    The curve has the least sum of the means of weight times its squared first, second and third differences, and of closeness times the
    mean squared distance from a path. weight: of the three rows before `start` too (any numbers at a clip's beginning); paths
    (rows, columns); n: rows of the clip; first: the coupling of the block before with the first. Rows are filled up to
    whole blocks by equations x = 0.
    """
    own = len(paths)
    rows = np.arange(start - WIDTH, start + own)
    band = np.zeros((WIDTH + 1, len(rows)))
    band[0] = closeness / n
    for order, stencil in enumerate(STENCILS, 1):
        share = np.where((rows >= 0) & (rows < n - order), weight, 0.0) / max(n - order, 1)
        for i in range(order + 1):
            moved = np.concatenate([np.zeros(i), share[: len(share) - i]])  # of the difference that begins i rows before
            for j in range(i, order + 1):
                band[j - i] += moved * stencil[i] * stencil[j]
    blocks = -(-own // WIDTH)
    padded = np.zeros((WIDTH + 1, WIDTH * (blocks + 1)))
    padded[:, : len(rows)] = band
    padded[0, len(rows) :] = 1.0
    by_block = padded.reshape(WIDTH + 1, blocks + 1, WIDTH)
    diagonal, upper = np.zeros((blocks + 1, WIDTH, WIDTH)), np.zeros((blocks + 1, WIDTH, WIDTH))
    for x in range(WIDTH):
        for y in range(WIDTH):
            diagonal[:, x, y] = by_block[abs(x - y), :, min(x, y)]
            if y <= x:
                upper[:, x, y] = by_block[WIDTH + y - x, :, x]
    right = np.zeros((blocks * WIDTH, paths.shape[1]))
    right[:own] = closeness / n * paths
    return diagonal[1:], upper[1:], upper[0], right.reshape(blocks, WIDTH, -1)


def _eliminated(diagonal: np.ndarray, upper: np.ndarray, first: np.ndarray, right: np.ndarray, is_last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple, tuple | None]:
    """(g, v, w, to the block before, of the last block): the inner unknowns are g - v x_before - w x_last.

    to the block before: what this run adds to its diagonal and right side, and its coupling to this run's last block.
    of the last block: its diagonal and right side, and its coupling to the block before. None at a clip's end, where all are inner.
    """
    inner = len(diagonal) - (not is_last)
    m = right.shape[2]
    sides = np.zeros((inner, WIDTH, m + 2 * WIDTH))
    sides[:, :, :m] = right[:inner]
    sides[0, :, m : m + WIDTH] = first.T
    if not is_last:
        sides[-1, :, m + WIDTH :] = upper[inner - 1]
    made = solve_blocks(diagonal[:inner], upper[:inner], sides)
    g, v, w = made[:, :, :m], made[:, :, m : m + WIDTH], made[:, :, m + WIDTH :]
    coupling = -first @ w[0]
    back = (-first @ v[0], -first @ g[0], coupling)
    if is_last:
        return g, v, w, back, None
    low = upper[inner - 1].T
    return g, v, w, back, (diagonal[inner] - low @ w[-1], right[inner] - low @ g[-1], coupling)


#: Rows of one run: kind 0 an inner block, 1 what it adds to the block before it, 2 its last block. `block` counts in the clip, `at` among last blocks.
ELIMINATED = "kind int, block long, run long, at long, g array<double>, v array<double>, w array<double>, d array<double>, u array<double>, l array<double>, b array<double>"


def _rows(clip_of: dict, start: int, run: int, parts: tuple) -> pd.DataFrame:
    g, v, w, back, own = parts
    flat = lambda x: list(x.reshape(len(x), -1))
    zero, none = np.zeros(WIDTH * WIDTH), [None]
    frames = [pd.DataFrame({"kind": 0, "block": start + np.arange(len(g)), "run": run, "at": -1, "g": flat(g), "v": flat(v), "w": flat(w)})]
    for kind, block, at, found in ((1, -1, run - 1, back), (2, start + len(g), run, own)):
        if found is not None and at >= 0:
            d, b, coupling = (x.reshape(-1) for x in found)
            u, before = (coupling, zero) if kind == 1 else (zero, coupling)
            frames.append(pd.DataFrame({"kind": [kind], "block": [block], "run": [run], "at": [at], "d": [d], "u": [u], "l": [before], "b": [b]}))
    out = pd.concat(frames).reindex(columns=["kind", "block", "run", "at", "g", "v", "w", "d", "u", "l", "b"])
    out = out.astype(object).where(out.notna(), none[0])
    return out.assign(**clip_of)


def _number(x: Column, runs: Column, size: int) -> Column:
    """The run of a place counted from 0; what is left at the end goes to the last run."""
    return F.least(F.floor(x / size), runs - 1).cast("long")


def _back(found: DataFrame, clip: str, size: int) -> DataFrame:
    """(clip, block, x) from the eliminated runs of a level."""
    inner = found.filter("kind = 0")
    adds = ["d", "u", "l", "b"]
    total = lambda c: F.reduce(F.collect_list(c), F.array_repeat(F.lit(0.0), F.size(F.first(c))), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
    rows = found.filter("kind > 0")
    if rows.isEmpty():
        return inner.select(clip, "block", F.col("g").alias("x"))
    last = rows.groupBy(clip, "at").agg(*[total(c).alias(c) for c in adds], F.max("block").alias("block"))  # two rows each
    solved = materialize(solve(last.select(clip, F.col("at").alias("block"), "d", "u", "l", "b"), clip, size), "last-blocks")
    known = last.select(F.col(clip).alias("_c"), F.col("at").alias("_at"), F.col("block").alias("_block")).join(
        solved.select(F.col(clip).alias("_c2"), F.col("block").alias("_b2"), "x"), F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_at") == F.col("_b2"))
    )
    of = lambda name, shift: solved.select(F.col(clip).alias(f"_c{name}"), (F.col("block") + shift).alias(f"_r{name}"), F.col("x").alias(name))
    met = inner
    for name, shift in (("before", 1), ("after", 0)):
        met = met.join(of(name, shift), F.col(clip).eqNullSafe(F.col(f"_c{name}")) & (F.col("run") == F.col(f"_r{name}")), "left")
    m = (F.size("g") / WIDTH).cast("int")

    def taken(row: Column, column: Column) -> Column:
        terms = [F.get(k, row * WIDTH + q) * F.get(x, column + m * q) for k, x in ((F.col("v"), F.col("before")), (F.col("w"), F.col("after"))) for q in range(WIDTH)]
        return sum((F.coalesce(t, F.lit(0.0)) for t in terms[1:]), F.coalesce(terms[0], F.lit(0.0)))

    x = F.transform("g", lambda value, i: value - taken(F.floor(i / m).cast("int"), (i % m).cast("int")))
    return met.select(clip, "block", x.alias("x")).unionByName(known.select(F.col("_c").alias(clip), F.col("_block").alias("block"), "x"))


def solve(blocks: DataFrame, clip: str, size: int) -> DataFrame:
    """(clip, block, x) of block tridiagonal systems (clip, block from 0 on, d: diagonal, u: coupling to the next block, l: that of the block before with this one, b: right side)."""
    kind = dict(blocks.dtypes)[clip]
    counts = blocks.groupBy(clip).agg(F.count(F.lit(1)).alias("_n")).select(F.col(clip).alias("_clip"), F.greatest(F.floor(F.col("_n") / size), F.lit(1)).alias("_runs"))
    rows = blocks.join(counts, F.col(clip).eqNullSafe(F.col("_clip"))).withColumn("run", _number(F.col("block"), F.col("_runs"), size))

    def eliminate(group):
        group = group.sort_values("block")
        square = lambda c: np.stack(group[c].to_numpy()).reshape(len(group), WIDTH, -1)
        run, is_last = int(group["run"].iloc[0]), bool(group["run"].iloc[0] == group["_runs"].iloc[0] - 1)
        parts = _eliminated(square("d"), square("u"), square("l")[0], square("b"), is_last)
        return _rows({clip: group[clip].iloc[0]}, int(group["block"].iloc[0]), run, parts)

    found = rows.select(clip, "block", "run", "_runs", "d", "u", "l", "b").groupBy(clip, "run").applyInPandas(eliminate, f"{ELIMINATED}, {clip} {kind}")
    return _back(materialize(found, "eliminated"), clip, size)


def smoothest_paths(df: DataFrame, clip: str, pos: str, paths: list[str], weight: str, closeness: float, run: int = 8192) -> DataFrame:
    """(clip, pos, smooth_<path>): the smoothest curves of paths by `pos`, which counts a clip's rows from 1 without holes.

    run: blocks of three rows that a task solves at once. Clips of less than eight rows stay as they are.
    """
    if run < 2:
        raise ValueError("run must be two blocks at least")
    ship(df.sparkSession)
    size = WIDTH * run
    rows = df.select(clip, pos, weight, *paths)
    counts = rows.groupBy(clip).agg(F.count(F.lit(1)).alias("_n")).select(F.col(clip).alias("_clip"), "_n", F.greatest(F.floor(F.col("_n") / size), F.lit(1)).alias("_runs"))
    rows = rows.join(counts, F.col(clip).eqNullSafe(F.col("_clip"))).drop("_clip")
    few, rows = rows.filter("_n < 8"), rows.filter("_n >= 8").withColumn("_at", F.col(pos) - 1)
    own = _number(F.col("_at"), F.col("_runs"), size)
    # A run's first three rows need the weights of the three rows before it.
    next_run = _number(F.col("_at") + WIDTH, F.col("_runs"), size)
    rows = rows.withColumn("run", F.explode(F.array_distinct(F.array(own, next_run)))).withColumn("_own", F.col("run") == own)

    def eliminate(group):
        group = group.sort_values("_at")
        mine = group[group["_own"]]
        start, n, k = int(mine["_at"].iloc[0]), int(mine["_n"].iloc[0]), int(mine["run"].iloc[0])
        w = np.concatenate([np.zeros(WIDTH), group[weight].to_numpy(float)])[-len(mine) - WIDTH :]
        system = smoothness_blocks(w, mine[paths].to_numpy(float), start, n, closeness)
        return _rows({clip: mine[clip].iloc[0]}, start // WIDTH, k, _eliminated(*system, k == mine["_runs"].iloc[0] - 1))

    kind = dict(df.dtypes)[clip]
    found = rows.groupBy(clip, "run").applyInPandas(eliminate, f"{ELIMINATED}, {clip} {kind}")
    solved = _back(materialize(found, "eliminated"), clip, run)
    spread = solved.select(clip, "block", "x", F.explode(F.array(*[F.lit(q) for q in range(WIDTH)])).alias("_q"))
    spread = spread.select(clip, (F.col("block") * WIDTH + F.col("_q") + 1).cast(dict(df.dtypes)[pos]).alias(pos), *[F.get("x", F.col("_q") * len(paths) + i).alias(f"smooth_{p}") for i, p in enumerate(paths)])
    # The last block is filled up beyond a clip's end.
    ends = counts.select(F.col("_clip").alias("_ended"), F.col("_n").alias("_end"))
    spread = spread.join(ends, F.col(clip).eqNullSafe(F.col("_ended")) & (F.col(pos) <= F.col("_end"))).drop("_ended", "_end")
    return spread.unionByName(few.select(clip, pos, *[F.col(p).alias(f"smooth_{p}") for p in paths]))


def smoothest(path: np.ndarray, weight: np.ndarray, closeness: float) -> np.ndarray:
    """The smoothest curve of one short path in memory."""
    n = len(path)
    if n < 8:
        return path
    diagonal, upper, _, right = smoothness_blocks(np.concatenate([np.zeros(WIDTH), weight]), np.asarray(path, dtype=float)[:, None], 0, n, closeness)
    return solve_blocks(diagonal, upper, right).reshape(-1)[:n]
