"""Approximate nearest neighbours: inverted cells with coded residuals.

Cell centres are fitted on a bounded sample; every row is indexed: its cell, and one byte per
dimension for what is left after the centre. A query visits its nearest cells, ranks their rows by the
codes, and the best of them by the vectors themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.kinds import quoted
from tablewright.session import materialize

SAMPLE_ROWS = 20_000  # rows that the centres and the scale of the codes are fitted on
BLOCK_ROWS = 4_096  # rows of one block; a larger cell is cut into several
MOST_CELLS = 4_096  # centres that every task holds; beyond, cells grow and are cut into blocks


@dataclass
class Index:
    """Centres, the step of the codes per dimension, rows per cell, and ``key, _cell, _block, _code`` of all rows."""

    centres: np.ndarray
    step: np.ndarray
    counts: np.ndarray
    table: DataFrame
    rows: DataFrame
    key: str
    vector: str
    block_rows: int


def _matrix(vectors: pd.Series, size: int) -> np.ndarray:
    return np.array(vectors.tolist(), float).reshape(len(vectors), size)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by products."""
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0)


def build_index(
    rows: DataFrame, key: str, vector: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS,
    block_rows: int = BLOCK_ROWS, seed: int = 42,
) -> Index:
    """Index every row of ``rows``; null vectors are left out.

    The sample holds about ``sample_rows`` rows, drawn by the hash of the key. By default there
    are as many cells as the root of the number of rows, at most ``MOST_CELLS``. The index is written to the
    shared folder; a hot cell is cut into blocks by the key's hash.
    """
    base = rows.filter(quoted(vector).isNotNull()).select(quoted(key).alias(key), quoted(vector).cast("array<double>").alias("_v"))
    count = base.count()
    first = base.select(F.size("_v").alias("n")).first()
    size = first["n"] if first else 0
    cells = min(cells or max(1, isqrt(count)), MOST_CELLS, max(count, 1))
    if not count:
        empty = base.select(key, F.lit(0).alias("_cell"), F.lit(0).alias("_block"), F.lit(b"").alias("_code"))
        return Index(np.zeros((1, size)), np.ones(size), np.zeros(1), empty, rows, key, vector, block_rows)
    share = min(1.0, sample_rows / count)
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = materialize(base.filter(draw <= share).select(array_to_vector("_v").alias("features"), "_v"), "sample")
    fitted = KMeans(k=cells, seed=seed, maxIter=20).fit(sample) if cells > 1 else None
    centres = np.array(fitted.clusterCenters()) if fitted else np.zeros((1, size))

    def cell_of(vectors: pd.Series) -> pd.Series:
        return pd.Series(_gaps(_matrix(vectors, size), centres).argmin(axis=1).astype("int32"))

    def residual(vectors: pd.Series) -> pd.Series:
        x = _matrix(vectors, size)
        return pd.Series(np.abs(x - centres[_gaps(x, centres).argmin(axis=1)]).tolist())

    far = sample.select(F.pandas_udf(residual, "array<double>")("_v").alias("r"))
    widest = far.agg(*[F.max(F.get("r", i)) for i in range(size)]).first()
    step = np.maximum(np.array([w or 0.0 for w in widest], float), 1e-12) / 127

    def code(vectors: pd.Series, cell: pd.Series) -> pd.Series:
        x = _matrix(vectors, size) - centres[cell.to_numpy()]
        codes = np.clip(np.rint(x / step), -127, 127).astype(np.int8)
        return pd.Series([row.tobytes() for row in codes])

    placed = base.withColumn("_cell", F.pandas_udf(cell_of, "int")("_v"))
    placed = placed.withColumn("_code", F.pandas_udf(code, "binary")("_v", "_cell"))
    table = materialize(placed.select(key, "_cell", "_code"), "index")
    counts = np.zeros(len(centres))
    for row in table.groupBy("_cell").count().collect():  # a row per cell
        counts[row["_cell"]] = row["count"]
    blocks = F.element_at(F.lit([max(1, ceil(n / block_rows)) for n in counts]), F.col("_cell") + 1)
    table = table.withColumn("_block", F.pmod(F.xxhash64(key), blocks).cast("int"))
    return Index(centres, step, counts, table, rows, key, vector, block_rows)


def approximate_neighbors(
    index: Index, queries: DataFrame, key: str, vector: str, k: int = 5, probes: int = 8, refine: int = 4,
) -> DataFrame:
    """``key, neighbor, distance, place`` of about the ``k`` nearest indexed rows of each query.

    ``probes`` cells are visited, and more until they hold ``refine * k`` rows; the best ``refine * k`` by codes are
    ranked by their vectors. With all cells probed and ``refine`` large the result is exact. Equal
    distances go to the smaller key.
    """
    if not index.counts.any():
        types = queries.schema[key].dataType.simpleString(), index.table.schema[index.key].dataType.simpleString()
        return queries.sparkSession.createDataFrame(
            [], f"{key} {types[0]}, neighbor {types[1]}, distance double, place int")
    size, centres, step, counts = len(index.step), index.centres, index.step, index.counts
    want = refine * k

    def visit(vectors: pd.Series) -> pd.Series:
        order = np.argsort(_gaps(_matrix(vectors, size), centres), axis=1, kind="stable")
        held = np.cumsum(counts[order], axis=1)
        last = np.maximum((held < want).sum(axis=1) + 1, probes)
        return pd.Series([[int(c) for c in row[:n] if counts[c] > 0] for row, n in zip(order, last)])

    blocks = F.element_at(F.lit([max(1, ceil(n / index.block_rows)) for n in counts]), F.col("_cell") + 1)
    asked = queries.filter(quoted(vector).isNotNull()).select(
        quoted(key).alias("_qid"), quoted(vector).cast("array<double>").alias("_q"))
    parts = max(1, ceil(asked.count() / index.block_rows))
    asked = asked.withColumn("_part", F.pmod(F.xxhash64("_qid"), F.lit(parts)).cast("int"))
    routed = asked.withColumn("_cell", F.explode(F.pandas_udf(visit, "array<int>")("_q")))
    routed = materialize(routed.withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))), "routed")
    place = ["_cell", "_block", "_part"]
    # A block is copied only to the query parts that visit it.
    visits = materialize(routed.select(*place).distinct(), "visits")
    blocked = index.table.join(visits, ["_cell", "_block"])
    query_type = queries.schema[key].dataType.simpleString()
    key_type = index.table.schema[index.key].dataType.simpleString()

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"_qid": [], "neighbor": [], "_near": []})
        right = right.sort_values(index_key, kind="stable")
        codes = np.frombuffer(b"".join(right["_code"]), np.int8).reshape(-1, size)
        vectors = centres[right["_cell"].to_numpy()] + codes * step
        gaps = _gaps(_matrix(left["_q"], size), vectors)
        take = min(want, len(right))
        best = np.argsort(gaps, axis=1, kind="stable")[:, :take]
        return pd.DataFrame({
            "_qid": np.repeat(left["_qid"].to_numpy(), take), "neighbor": right[index_key].to_numpy()[best.ravel()],
            "_near": np.take_along_axis(gaps, best, axis=1).ravel()})

    index_key = index.key
    found = routed.groupBy(*place).cogroup(blocked.groupBy(*place)).applyInPandas(
        rank, f"_qid {query_type}, neighbor {key_type}, _near double")
    nearest = Window.partitionBy("_qid").orderBy("_near", "neighbor")
    found = found.withColumn("_at", F.row_number().over(nearest)).filter(F.col("_at") <= want)
    given = index.rows.select(quoted(index.key).alias("neighbor"), quoted(index.vector).cast("array<double>").alias("_v"))
    both = found.join(given, "neighbor").join(asked.select("_qid", "_q"), "_qid")
    squares = F.zip_with("_q", "_v", lambda a, b: (a - b) * (a - b))
    both = both.withColumn("distance", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)))
    order = Window.partitionBy("_qid").orderBy("distance", "neighbor")
    return both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(
        F.col("_qid").alias(key), "neighbor", "distance", "place")
