"""Kernel features and calibrated scores for margin classifiers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.blocks import BLOCK_BYTES, FILE_BLOCKS, few, list_matrix
from tablewright.session import materialize

CELLS = 4_096  # of the range of the margins, when they are counted for calibration
ROWS_AT_ONCE = 512  # rows whose mapped features stay in a core's cache
BLOCK_ROWS = 8_192  # of a block
FOURIER = 512  # random features: kernel values are off by about 1 / sqrt(FOURIER)


@dataclass(frozen=True)
class FourierMap:
    """Features whose inner product approaches the kernel exp(-gamma |x - y|^2)."""

    size: int
    gamma: float
    width: int = FOURIER
    seed: int = 42

    def turns(self) -> np.ndarray:
        """The seeded projections, a column each."""
        random = np.random.default_rng([self.seed, self.size, self.width])
        return random.normal(0.0, (2 * self.gamma) ** 0.5, (self.size, self.width // 2))

    def matrix(self, x: np.ndarray) -> np.ndarray:
        """Cosines and sines of seeded projections: rows of unit length."""
        turns, half = self.turns(), self.width // 2
        out = np.empty((len(x), 2 * half))
        for start in range(0, len(x), ROWS_AT_ONCE):
            part = slice(start, start + ROWS_AT_ONCE)
            # Single precision is far within the error of the draw, and several times faster.
            turned = (x[part] @ turns).astype("f4")
            out[part, :half], out[part, half:] = np.cos(turned), np.sin(turned)
        out *= (2 / self.width) ** 0.5
        return out

    def column(self, features: str) -> Column:
        """The map of a vector column, batch by batch."""
        def mapped(vectors: pd.Series) -> pd.Series:
            x = np.array(vectors.tolist(), float).reshape(len(vectors), -1)
            return pd.Series(list(self.matrix(x)))

        return array_to_vector(F.pandas_udf(mapped, "array<double>")(vector_to_array(F.col(features))))


def hinge_sums(weights: np.ndarray, x: np.ndarray, sides: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Hinge losses and their gradients, summed over rows: a row per learner, the loss first, the intercept last.

    ``sides`` are 1 or -1, ``used`` 1 for the rows that a learner is fitted on, both rows x learners.
    """
    loss, slope = _hinges(x @ weights[:, :-1].T + weights[:, -1], sides, used)
    return np.column_stack([loss, slope.T @ x, slope.sum(axis=0)])


def _hinges(margins: np.ndarray, sides: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = 1 - sides * margins
    return (np.maximum(gap, 0) * used).sum(axis=0), -sides * used * (gap > 0)


class MappedSums:
    """``hinge_sums`` of rows that a map turns, part by part: the mapped features stay in one buffer, in single
    precision, which is far within the error of the draw."""

    def __init__(self, map_: FourierMap, weights: np.ndarray):
        self.turns, self.half, self.scale = map_.turns(), map_.width // 2, (2 / map_.width) ** 0.5
        self.parts = [np.ascontiguousarray(weights[:, k * self.half : (k + 1) * self.half].T, "f4") for k in (0, 1)]
        self.intercepts = weights[:, -1]
        self.room = np.empty((2, ROWS_AT_ONCE, self.half), "f4")

    def add(self, total: np.ndarray, x: np.ndarray, sides: np.ndarray, used: np.ndarray) -> None:
        for start in range(0, len(x), ROWS_AT_ONCE):
            part = slice(start, start + ROWS_AT_ONCE)
            turned = (x[part] @ self.turns).astype("f4")
            mapped = [np.cos(turned, out=self.room[0, : len(turned)]), np.sin(turned, out=self.room[1, : len(turned)])]
            margins = mapped[0] @ self.parts[0] + mapped[1] @ self.parts[1]
            loss, slope = _hinges(margins * self.scale + self.intercepts, sides[part], used[part])
            total[:, 0] += loss
            slopes = np.ascontiguousarray(slope.T, "f4")
            for k, m in enumerate(mapped):
                total[:, 1 + k * self.half : 1 + (k + 1) * self.half] += (slopes @ m) * self.scale
            total[:, -1] += slope.sum(axis=0)


PACKED_ROWS = "n int, x binary, told binary, fold binary"
_PACKED_ROWS = pa.schema([("n", pa.int32()), ("x", pa.binary()), ("told", pa.binary()), ("fold", pa.binary())])


def packed_rows(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of the figures ``_x, _class, _fold`` of some thousand rows: lists cost a pass more than its sums."""
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(size, 1))))

    def packed(batches):
        for batch in batches:
            for start in range(0, len(batch), most):
                some = batch.slice(start, most)
                x = list_matrix(some["_x"], size).astype("f8")
                told, fold = (some[name].to_numpy().astype(kind) for name, kind in (("_class", "i8"), ("_fold", "i4")))
                yield pa.RecordBatch.from_pylist(
                    [{"n": len(some), "x": x.tobytes(), "told": told.tobytes(), "fold": fold.tobytes()}], _PACKED_ROWS)

    return materialize(rows.select("_x", "_class", "_fold").mapInArrow(packed, PACKED_ROWS), "margin-blocks", FILE_BLOCKS)


def minimised(x: np.ndarray, most: int, kept: int = 10, close: float = 1e-6):
    """Limited memory BFGS that yields points, is sent their (value, gradient), and returns the best point."""
    value, slope = yield x
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most):
        way, shares = slope.copy(), []
        for s, y in reversed(pairs):
            shares.append(s @ way / (s @ y))
            way -= shares[-1] * y
        if pairs:
            s, y = pairs[-1]
            way *= s @ y / (y @ y)
        for (s, y), share in zip(pairs, reversed(shares)):
            way += (share - y @ way / (s @ y)) * s
        way = -way
        if way @ slope >= 0:
            way, pairs = -slope, []
        step = 1.0 if pairs else min(1.0, 1 / max(np.linalg.norm(slope), 1e-12))
        for _ in range(20):
            new_value, new_slope = yield x + step * way
            if new_value <= value + 1e-4 * step * (way @ slope):
                break
            step /= 2
        else:
            return x
        pair = (step * way, new_slope - slope)
        if pair[0] @ pair[1] > 1e-14:
            pairs = [*pairs, pair][-kept:]
        small = value - new_value <= close * max(abs(value), abs(new_value), 1e-12)
        x, value, slope = x + step * way, new_value, new_slope
        if small:
            return x
    return x


def fit_margins(rows: DataFrame, map_: FourierMap | None, size: int, learners: list[tuple[int, int]],
                counts: list[int], strength: float, most: int) -> np.ndarray:
    """Weights, the intercept last, of linear margins with least mean hinge loss and penalty: a row per learner.

    ``rows`` has ``_x, _class, _fold``; a learner tells its class from all others on the ``counts`` rows outside
    its fold (-1: on all rows). All learners share each pass, which maps the features anew, so that rows
    stay as narrow as they came; they are packed once and held in memory, with spill to disk.
    """
    width = size if map_ is None else map_.width // 2 * 2
    classes, folds = (np.array(c) for c in zip(*learners))
    blocks = packed_rows(rows, size)
    cells = (blocks.agg(F.sum("n")).first()[0] or 0) * max(width, 1)
    blocks = few(blocks, cells).persist(StorageLevel.MEMORY_AND_DISK)

    def evaluated(points: np.ndarray, asked: list[int]) -> np.ndarray:
        def summed(batches):
            total = np.zeros((len(asked), width + 2))
            mapped = None if map_ is None else MappedSums(map_, points)
            for batch in batches:
                for i in range(len(batch)):
                    x, told, fold = (np.frombuffer(batch[name][i].as_buffer(), kind)
                                     for name, kind in (("x", "f8"), ("told", "i8"), ("fold", "i4")))
                    x = x.reshape(len(told), size)
                    sides = np.where(told[:, None] == classes[asked], 1.0, -1.0)
                    used = (fold[:, None] != folds[asked]).astype(float)
                    if mapped is None:
                        total += hinge_sums(points, x, sides, used)
                    else:
                        mapped.add(total, x, sides, used)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        parts = blocks.mapInArrow(summed, "sums binary").toArrow()["sums"].to_pylist()  # learners x features a task
        return sum((np.frombuffer(p).reshape(len(asked), -1) for p in parts), np.zeros((len(asked), width + 2)))

    searches = [minimised(np.zeros(width + 1), most) for _ in learners]
    points, found = {j: next(search) for j, search in enumerate(searches)}, np.zeros((len(learners), width + 1))
    while points:
        asked = sorted(points)
        sums = evaluated(np.stack([points[j] for j in asked]), asked)
        for row, j in zip(sums, asked):
            n, weights = max(counts[j], 1), points[j]
            penalty = np.append(weights[:-1], 0.0) / (strength * n)
            try:
                points[j] = searches[j].send((row[0] / n + weights @ penalty / 2, row[1:] / n + penalty))
            except StopIteration as done:
                found[j] = done.value
                del points[j]
    blocks.unpersist()
    return found


def margins_of(weights: np.ndarray, map_: FourierMap | None, size: int):
    """A function from an array of features to the array of margins, one per row of ``weights``."""
    @F.arrow_udf("array<double>")
    def margins(vectors: pa.Array) -> pa.Array:
        x = list_matrix(vectors, size).astype(float)
        out = (x if map_ is None else map_.matrix(x)) @ weights[:, :-1].T + weights[:, -1]
        ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return margins


def spread_of_features(rows: DataFrame, features: str) -> tuple[int, float]:
    """Number of features, and the variance over all their values together."""
    cells = rows.select(F.explode(vector_to_array(F.col(features))).alias("x"))
    size = rows.select(F.size(vector_to_array(F.col(features))).alias("n")).first()
    return (size["n"] if size else 0), float(cells.agg(F.var_pop("x")).first()[0] or 0.0)


def margin_cells(margins: DataFrame, margin: str, positive: str, cells: int = CELLS) -> list:
    """``margin, pos, neg`` per cell of the margins' range: the mean margin, and rows of either side.

    At most ``cells`` rows reach the driver, whatever the size of the table.
    """
    low, high = margins.agg(F.min(margin), F.max(margin)).first()
    if low is None:
        return []
    width = (high - low) / cells or 1.0
    cell = F.least(F.floor((F.col(margin) - low) / width), F.lit(cells - 1))
    counted = margins.groupBy(cell.alias("cell")).agg(
        F.avg(margin).alias("margin"), F.sum((F.col(positive) == 1).cast("long")).alias("pos"),
        F.sum((F.col(positive) != 1).cast("long")).alias("neg"))
    return sorted((r["margin"], r["pos"], r["neg"]) for r in counted.collect())


def platt(cells: list[tuple[float, int, int]], rounds: int = 100) -> tuple[float, float]:
    """``(a, b)`` of the share 1 / (1 + exp(a * margin + b)) of least log loss, by damped Newton steps.

    Targets are drawn in from 0 and 1 by the counts of either side, so that separable margins
    give finite shares.
    """
    if not cells:
        return -1.0, 0.0
    margin, pos, neg = (np.array(column, float) for column in zip(*cells))
    high, low = (pos.sum() + 1) / (pos.sum() + 2), 1 / (neg.sum() + 2)
    weight, target = pos + neg, pos * high + neg * low

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float((target * z + (weight * np.logaddexp(0, -z))).sum())

    a, b = 0.0, float(np.log((neg.sum() + 1) / (pos.sum() + 1)))
    for _ in range(rounds):
        share = 1 / (1 + np.exp(np.clip(a * margin + b, -700, 700)))
        slope = target - weight * share
        bend = weight * share * (1 - share) + 1e-12
        gradient = np.array([(slope * margin).sum(), slope.sum()])
        hessian = np.array([[(bend * margin**2).sum(), (bend * margin).sum()], [(bend * margin).sum(), bend.sum()]])
        step = np.linalg.solve(hessian + 1e-12 * np.eye(2), gradient)
        size, now = 1.0, loss(a, b)
        while size > 1e-10 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if abs(size * step).max() < 1e-10:
            break
    return float(a), float(b)


def share_of(margin: Column, a: float, b: float) -> Column:
    """The calibrated share of a margin; it rises with the margin as long as ``a`` is below 0."""
    return 1 / (1 + F.exp(F.lit(min(a, 0.0)) * margin + F.lit(b)))
