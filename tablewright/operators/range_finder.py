"""Principal components of wide tables by a randomised range finder.

The covariance of d columns has d x d cells, which one machine cannot hold for large d. Here
only blocks of d x l cells exist (l: wanted components and a few more). Each pass multiplies
the centred rows, batch by batch, with such a block and adds the products up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Partial products travel in blocks of this many columns, so no cell of a shuffle grows with d.
BLOCK = 512


@dataclass
class Components:
    """``axes`` holds one unit vector per row; ``variances`` their sample variances."""

    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def shares(self) -> np.ndarray:
        return self.variances / self.total if self.total > 0 else np.zeros(len(self.variances))

    def first(self, k: int) -> Components:
        return Components(self.mean, self.axes[:k], self.variances[:k], self.total)

    def count_for(self, share: float) -> int:
        """Fewest components whose shares exceed ``share`` together; all if they never do."""
        over = np.flatnonzero(np.cumsum(self.shares) > share)
        return int(over[0]) + 1 if len(over) else len(self.shares)


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows of a batch as a matrix; rows without a vector are left out."""
    column = batch.column(0)
    column = column.filter(column.is_valid())
    cells = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(cells) != len(column) * width:
        raise ValueError(f"every vector must have {width} values")
    if not np.isfinite(cells).all():
        raise ValueError("vectors hold missing or infinite values: impute them first")
    return cells.reshape(-1, width)


def _blocks(values: np.ndarray):
    """A matrix of d rows as (place, cells) records of ``BLOCK`` rows each."""
    for start in range(0, len(values), BLOCK):
        yield start, values[start : start + BLOCK].ravel().tolist()


def _emit(values: np.ndarray):
    places, cells = zip(*_blocks(values))
    return pa.RecordBatch.from_arrays(
        [pa.array(places, pa.int64()), pa.array(cells, pa.list_(pa.float64()))], ["place", "cells"])


def _added(parts: DataFrame, rows: int, wide: int) -> np.ndarray:
    """Sum of the partial matrices of all partitions, added up block by block on the executors.

    The driver receives ``rows`` x ``wide`` cells in all, however many partitions there were.
    """
    summed = parts.groupBy("place").agg(Summarizer.sum(array_to_vector("cells")).alias("cells"))
    result = np.zeros((rows, wide))
    for row in summed.select("place", vector_to_array("cells").alias("cells")).toLocalIterator():
        block = np.array(row["cells"]).reshape(-1, wide)
        result[row["place"] : row["place"] + len(block)] = block
    return result


def _moments(vectors: DataFrame, width: int) -> tuple[int, np.ndarray, float]:
    """Number of rows, mean and total sample variance, the latter about the first mean."""

    def sums(batches):
        n, total = 0, np.zeros(width)
        for batch in batches:
            rows = _rows(batch, width)
            n += len(rows)
            total += rows.sum(axis=0)
        yield _emit(np.concatenate([total, [float(n)]])[:, None])

    out = _added(vectors.mapInArrow(sums, "place long, cells array<double>"), width + 1, 1)[:, 0]
    n = int(round(out[-1]))
    mean = out[:-1] / max(n, 1)

    def squares(batches):
        total = 0.0
        for batch in batches:
            total += float(((_rows(batch, width) - mean) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["total"])

    spread = vectors.mapInArrow(squares, "total double").agg(F.sum("total")).first()[0] or 0.0
    return n, mean, spread / max(n - 1, 1)


def principal_components(
    vectors: DataFrame, column: str, k: int, oversample: int = 10, passes: int = 4, seed: int = 0
) -> Components:
    """The ``k`` directions of largest variance of the array column ``column``.

    A random block of ``k + oversample`` directions is multiplied with the covariance
    ``passes`` times, orthonormal in between; within the range found the small problem is solved
    exactly. More passes sharpen components whose variances are close. The driver and each task
    hold a few blocks of d x (k + oversample) cells, 2 MB at 5,000 columns and 50 directions, and
    the block is sent to the tasks with the function. Null vectors are left out; vectors of
    uneven length, and NaN or infinite values, are an error. No rows or one row give variances of 0.
    """
    data = vectors.select(column)
    first = data.filter(F.col(column).isNotNull()).select(F.size(column)).first()
    width = first[0] if first else 0
    if not width:
        return Components(np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0)
    data = data.select(F.col(column).cast("array<double>").alias(column))
    n, mean, total = _moments(data, width)
    wide = min(width, k + oversample)
    k = min(k, width)

    def product(basis: np.ndarray) -> np.ndarray:
        def multiply(batches):
            out = np.zeros((width, wide))
            for batch in batches:
                rows = _rows(batch, width) - mean
                out += rows.T @ (rows @ basis)
            yield _emit(out)

        return _added(data.mapInArrow(multiply, "place long, cells array<double>"), width, wide) / max(n - 1, 1)

    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, wide)))
    for _ in range(passes):
        basis, _ = np.linalg.qr(product(basis))
    small = basis.T @ product(basis)
    values, directions = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:k]
    axes = (basis @ directions[:, order]).T
    # An axis and its negative are the same direction: the largest part is made positive.
    largest = axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]
    axes *= np.where(largest < 0, -1.0, 1.0)[:, None]
    return Components(mean, axes, np.maximum(values[order], 0.0), float(total))


def project(df: DataFrame, column: str, components: Components, prefix: str = "pc_") -> DataFrame:
    """``df`` with one column per component: the centred vector along its axis."""
    axes, mean = components.axes, components.mean
    if any(f"{prefix}{i + 1}" in df.columns for i in range(len(axes))):
        raise ValueError(f"the table already has columns named {prefix}1 and on")
    out = T.StructType([*df.schema.fields, T.StructField("_projected", T.ArrayType(T.DoubleType()))])

    def apply(batches):
        for batch in batches:
            cells = batch.column(batch.schema.get_field_index(column))
            valid = np.asarray(cells.is_valid())
            scores = (_rows(pa.RecordBatch.from_arrays([cells], ["v"]), len(mean)) - mean) @ axes.T
            result = [None] * len(cells)
            for i, row in zip(np.flatnonzero(valid), scores.tolist()):
                result[i] = row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(result, pa.list_(pa.float64()))], [*batch.schema.names, "_projected"])

    shown = df.mapInArrow(apply, out)
    return shown.withColumns(
        {f"{prefix}{i + 1}": F.col("_projected")[i] for i in range(len(axes))}).drop("_projected")
