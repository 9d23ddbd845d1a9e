"""Exact k nearest neighbours by cells and blocks.

Training rows fall to their nearest pivot (a cell); a cell is cut into blocks of bounded
size, so a cell that holds a third of all rows is simply many blocks. For each query the
distances to the pivots give an upper bound on its k-th neighbour distance, and cells
that cannot beat it are skipped by the triangle inequality. Queries meet the blocks of
the remaining cells in cogrouped tasks that return k rows per query and block, never
the pairs. Nothing is approximated: a skipped cell provably holds no neighbour.
"""

from __future__ import annotations

from math import ceil, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.kinds import quoted
from tablewright.operators.splits import row_digest
from tablewright.session import materialize

BLOCK_ROWS = 4096
PART_ROWS = 32_768  # queries of a part at most: every block a part visits is copied to it
QUERY_PARTS = 16  # parts that small sets of queries are cut into
PIVOTS = 64  # at least; the number grows with the root of the training rows
_SLACK = 1e-9  # guards the bounds against rounding


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), dtype=np.float64).reshape(len(values), -1)


def _distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances from the differences themselves, a slice of rows at a time."""
    out = np.empty((len(rows), len(others)))
    step = max(1, 4_000_000 // max(1, others.size))
    for start in range(0, len(rows), step):
        gap = rows[start : start + step, None, :] - others[None, :, :]
        out[start : start + step] = np.sqrt((gap * gap).sum(axis=2))
    return out


def _nearest(rows: np.ndarray, others: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``take`` nearest others of each row and their distances, equal ones in the order of the others.

    Products give squared distances to within a bound on their rounding; whatever may be among the nearest by that
    bound is measured again from the differences.
    """
    places, gaps = np.empty((len(rows), take), np.int64), np.empty((len(rows), take))
    squares, size = (others * others).sum(axis=1), rows.shape[1] + 8
    step = max(1, 4_000_000 // max(1, len(others)))
    for start in range(0, len(rows), step):
        some = rows[start : start + step]
        own = (some * some).sum(axis=1)
        rough = own[:, None] + squares - 2 * (some @ others.T)
        slack = 4 * size * np.finfo(float).eps * (own + squares.max(initial=0.0)) * 2
        bound = np.partition(rough, take - 1, axis=1)[:, take - 1] + 2 * slack
        # Not above, so that a value that is no number stays in.
        row, other = np.nonzero(~(rough > bound[:, None]))
        gap = np.empty(len(row))
        for first in range(0, len(row), 100_000):
            part = slice(first, first + 100_000)
            apart = some[row[part]] - others[other[part]]
            gap[part] = np.sqrt((apart * apart).sum(axis=1))
        order = np.lexsort((other, gap, row))
        firsts = np.searchsorted(row[order], np.arange(len(some)))
        best = order[firsts[:, None] + np.arange(take)]
        places[start : start + step], gaps[start : start + step] = other[best], gap[best]
    return places, gaps


def choose_pivots(train: DataFrame, key: str, vector: str, pivots: int) -> np.ndarray:
    """A fixed number of training vectors drawn by hash."""
    picked = (
        train.select(row_digest([key]).alias("_d"), quoted(vector).alias("v"))
        .orderBy("_d")
        .limit(pivots)
        .collect()
    )
    return np.unique(np.array([row["v"] for row in picked], dtype=np.float64), axis=0)


def _with_cell(train: DataFrame, pivots: np.ndarray) -> DataFrame:
    schema = "_cell int, _far double"

    @F.pandas_udf(schema)
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        gaps = _distances(_matrix(vectors), pivots)
        cell = gaps.argmin(axis=1)
        return pd.DataFrame({"_cell": cell.astype("int32"), "_far": gaps[np.arange(len(cell)), cell]})

    return train.withColumn("_at", nearest("_v")).select(
        "_tid", "_v", "_label", F.col("_at._cell").alias("_cell"), F.col("_at._far").alias("_far")
    )


def _candidate_cells(pivots: np.ndarray, counts: np.ndarray, radii: np.ndarray, k: int):
    """Cells a query has to visit, as a pandas function over query vectors."""
    apart = _distances(pivots, pivots)

    def visit(vectors: pd.Series) -> pd.Series:
        gaps = _distances(_matrix(vectors), pivots)
        reach = gaps + radii  # every row of the cell is at most this far
        order = np.argsort(reach, axis=1, kind="stable")
        held = np.cumsum(counts[order], axis=1)
        enough = np.minimum((held < k).sum(axis=1), len(counts) - 1)
        rows = np.arange(len(gaps))
        bound = reach[rows, order[rows, enough]] * (1 + _SLACK) + _SLACK
        home = gaps.argmin(axis=1)
        # Distance to the plane half way between the home pivot and another one.
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (gaps**2 - gaps[rows, home][:, None] ** 2) / (2 * apart[home])
        plane[~np.isfinite(plane)] = 0.0
        nearest = np.maximum(gaps - radii, plane)
        keep = (nearest <= bound[:, None]) & (counts > 0)
        return pd.Series([np.flatnonzero(row).astype("int32").tolist() for row in keep])

    return visit


def nearest_neighbors(
    train: DataFrame,
    queries: DataFrame,
    key: str,
    vector: str,
    label: str,
    k: int = 5,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query key, neighbour, distance, label, place) for the k nearest training rows.

    ``vector`` is an array of numbers. Equal distances go to the smaller neighbour key. Blocks hold
    ``block_rows`` rows, or the root of the training rows if that is more.
    """
    base = train.select(
        quoted(key).alias("_tid"), quoted(vector).alias("_v"), quoted(label).alias("_label")
    )
    centres = choose_pivots(train, key, vector, max(pivots, isqrt(train.count()) // 8))
    # Read twice below; written once, the distances to the pivots are computed once.
    celled = materialize(_with_cell(base, centres), "cells")
    counts, radii = np.zeros(len(centres)), np.zeros(len(centres))
    # One row per pivot, a fixed number.
    for row in celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_far").alias("r")).collect():
        counts[row["_cell"]], radii[row["_cell"]] = row["n"], row["r"]
    n_queries = queries.count()
    block_rows, part_rows = max(block_rows, isqrt(int(counts.sum()))), max(block_rows, min(n_queries // QUERY_PARTS, PART_ROWS))
    blocks = [max(1, ceil(n / block_rows)) for n in counts]
    query_parts = max(1, ceil(n_queries / part_rows))

    block_count = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("_cell") + 1)
    blocked = celled.withColumn("_block", F.pmod(F.xxhash64("_tid"), block_count).cast("int"))

    visit = F.pandas_udf(_candidate_cells(centres, counts, radii, k), "array<int>")
    asked = queries.select(quoted(key).alias("_qid"), quoted(vector).alias("_q"))
    asked = asked.withColumn("_part", F.pmod(F.xxhash64("_qid"), F.lit(query_parts)).cast("int"))
    routed = (
        asked.withColumn("_cell", F.explode(visit("_q")))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), block_count - 1)))
    )

    key_type = train.schema[key].dataType.simpleString()
    label_type = train.schema[label].dataType.simpleString()
    schema = f"_qid {key_type}, _tid {key_type}, _distance double, _label {label_type}"

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"_qid": [], "_tid": [], "_distance": [], "_label": []})
        right = right.sort_values("_tid", kind="stable")
        take = min(k, len(right))
        best, gaps = _nearest(_matrix(left["_q"]), _matrix(right["_v"]), take)
        flat = best.ravel()
        return pd.DataFrame(
            {
                "_qid": np.repeat(left["_qid"].to_numpy(), take),
                "_tid": right["_tid"].to_numpy()[flat],
                "_distance": gaps.ravel(),
                "_label": right["_label"].to_numpy()[flat],
            }
        )

    # A block is copied only to the query parts that visit it.
    routed = materialize(routed, "routed")
    visits = materialize(routed.select("_cell", "_block", "_part").distinct(), "visits")
    blocked = blocked.join(visits, ["_cell", "_block"])
    cell = ["_cell", "_block", "_part"]
    found = routed.groupBy(*cell).cogroup(blocked.groupBy(*cell)).applyInPandas(search, schema)
    place = Window.partitionBy("_qid").orderBy("_distance", "_tid")
    return (
        found.withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= k)
        .select(
            F.col("_qid").alias(key),
            F.col("_tid").alias("neighbor"),
            F.col("_distance").alias("distance"),
            F.col("_label").alias(label),
            "place",
        )
    )


def vote(neighbors: DataFrame, key: str, label: str, output: str = "prediction") -> DataFrame:
    """Majority label per query, the smallest label on ties."""
    counts = neighbors.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("label")))
    return counts.groupBy(key).agg(best.alias("b")).select(key, F.col("b.label").alias(output))


def knn_classify(
    train: DataFrame, queries: DataFrame, key: str, vector: str, label: str, k: int = 5, **options
) -> DataFrame:
    """The queries' keys with the label their k nearest training rows vote for."""
    return vote(nearest_neighbors(train, queries, key, vector, label, k, **options), key, label)
