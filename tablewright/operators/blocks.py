"""Binned rows packed into blocks, for models that pass over their rows many times.

A block holds the bins of some ten thousand rows, feature by feature, in a byte each, with what else a
model keeps per row. Tasks count a block with numpy, so a pass costs a few nanoseconds per row and
feature, and only sums leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import materialize

BLOCK_BYTES = 1 << 20  # of bins
BLOCK_ROWS = 1 << 16
FILE_BLOCKS = 8  # of a written table of blocks: writer and reader hold all blocks of a file at once
TASK_CELLS = 2 << 20  # bins that are worth a task of their own
FEW_SPLITS = 64  # of a tree whose rows are dealt split by split
DIRECT_TASKS = 32  # sums of so many tasks go to the driver as they are
PACKED = "first long, n int, bins binary, y binary"
_PACKED = pa.schema([("first", pa.int64()), ("n", pa.int32()), ("bins", pa.binary()), ("y", pa.binary())])


def code_type(edges: list[list[float]]) -> str:
    """The smallest type that holds a bin."""
    return "u1" if max(map(len, edges), default=0) < 256 else "u4"


def list_matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Rows x ``size`` values of a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) if size else np.zeros((len(column), 0), int)


def binned_values(values: np.ndarray, edges: list[np.ndarray], kind: str) -> np.ndarray:
    """The bins of rows x features of values: the number of edges at or below each; a gap falls in the last."""
    codes = np.empty(values.shape, kind)
    for f, own in enumerate(edges):
        codes[:, f] = np.searchsorted(own, values[:, f], side="right")
    return codes


def pack(rows: DataFrame, size: int, kind: str, edges: list[list[float]] | None = None) -> DataFrame:
    """Blocks of ``_bins, _y`` (a null label is NaN), written to the shared folder. ``first`` numbers the first
    row by ``_id``, by which a partition counts its rows. With ``edges`` the bins are made of the values ``_x``
    on the way."""
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(size, 1)))
    given = "_bins" if edges is None else "_x"
    if edges is not None:
        bounds = [np.array(own, "f8") for own in edges]
        whole = F.array(*[F.get("_x", i).cast("double") for i in range(size)]).cast("array<double>")
        rows = rows.withColumn("_x", F.when(F.size("_x") == size, F.col("_x").cast("array<double>")).otherwise(whole))

    def block(first: int, bins: list[np.ndarray], y: list[np.ndarray]) -> pa.RecordBatch:
        codes = np.concatenate(bins).T
        figures = np.concatenate(y).astype("f8")
        return pa.RecordBatch.from_pylist(
            [{"first": first, "n": len(figures), "bins": codes.astype(kind).tobytes(), "y": figures.tobytes()}], _PACKED)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, labels, first, count = [], [], None, 0
        for batch in batches:
            codes = list_matrix(batch[given], size)
            codes = codes.astype(kind) if edges is None else binned_values(codes.astype("f8"), bounds, kind)
            figures = batch["_y"].to_numpy(zero_copy_only=False)
            ids = batch["_id"].to_numpy()
            for start in range(0, len(figures), most):
                part = slice(start, start + most)
                if count and count + len(figures[part]) > most:
                    yield block(first, held, labels)
                    held, labels, first, count = [], [], None, 0
                first = int(ids[start]) if first is None else first
                held.append(codes[part])
                labels.append(figures[part])
                count += len(figures[part])
        if count:
            yield block(first, held, labels)

    return materialize(rows.select(given, "_y", "_id").mapInArrow(packed, PACKED), "blocks", FILE_BLOCKS)


def unpack(batch: pa.RecordBatch, size: int, kind: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Place in the batch, first row number, bins (features x rows) and labels of each block."""
    for i in range(len(batch)):
        bins = np.frombuffer(batch["bins"][i].as_buffer(), kind).reshape(size, -1)
        yield i, batch["first"][i].as_py(), bins, np.frombuffer(batch["y"][i].as_buffer(), "f8")


def few(blocks: DataFrame, cells: int) -> DataFrame:
    """Blocks of so many bins in a partition per core at most, and in fewer where that gives a task next to
    nothing to do: every task of a pass starts a worker and sends its own sums."""
    cores = max(blocks.sparkSession.sparkContext.defaultParallelism, 1)
    return blocks.coalesce(min(cores, 1 + cells // TASK_CELLS))


def summed(counted: DataFrame, sums: dict[str, str]) -> pa.Table:
    """Sums over the tasks of what ``Histograms`` collected. A few tasks' sums are added on the driver, those of
    many tasks before they reach it."""
    by = ["tree", "node", "feature", "bin"]
    if counted.sparkSession.sparkContext.defaultParallelism > DIRECT_TASKS:
        return counted.groupBy(*by).agg(*[getattr(F, kind)(name).alias(name) for name, kind in sums.items()]).toArrow()
    table = counted.toArrow().group_by(by).aggregate(list(sums.items()))
    return table.rename_columns([*by, *sums] if table.column_names[0] == "tree" else [*sums, *by])


def hashed(first: int, count: int, *salt: int) -> np.ndarray:
    """Shares from 0 to 1, the same for the same row numbers and salt wherever they are drawn."""
    mixed = np.arange(first, first + count, dtype=np.uint64)
    for part in salt:
        mixed ^= np.uint64((part + 1) * 0xD1B54A32D192ED03 % (1 << 64))
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def end_nodes(bins: np.ndarray, feature: np.ndarray, bound: np.ndarray, left: np.ndarray, right: np.ndarray,
              rows: np.ndarray | None = None) -> np.ndarray:
    """The node of a tree (arrays by node; ``feature`` -1 at an end) where each row stops."""
    at = np.zeros(bins.shape[1] if rows is None else len(rows), np.int64)
    if feature[0] < 0:
        return at
    if np.count_nonzero(feature >= 0) <= FEW_SPLITS:
        stack = [(0, None)]
        while stack:
            node, held = stack.pop()  # None: all
            if feature[node] < 0:
                at[held] = node
                continue
            own = bins[feature[node]]
            if held is not None:
                own = own[held if rows is None else rows[held]]
            elif rows is not None:
                own = own[rows]
            below = own < int(bound[node])
            for child, side in ((left[node], below), (right[node], ~below)):
                stack.append((child, np.flatnonzero(side) if held is None else held[side]))
        return at
    rows = np.arange(bins.shape[1]) if rows is None else rows
    flat, width = bins.ravel(), bins.shape[1]
    moving = np.arange(len(rows))  # those not at an end yet
    while len(moving):
        here = at[moving]
        f = feature[here]
        below = flat[f * width + rows[moving]] < bound[here]
        here = np.where(below, left[here], right[here])
        at[moving] = here
        moving = moving[feature[here] >= 0]
    return at


def node_arrays(nodes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature, bin, left and right of a tree's nodes, which lie in the order of their numbers."""
    inner = [node.left is not None for node in nodes]
    return tuple(np.array(found, np.int64) for found in (
        [node.feature if i else -1 for node, i in zip(nodes, inner)], [node.bin for node in nodes],
        [node.left.number if i else node.number for node, i in zip(nodes, inner)],
        [node.right.number if i else node.number for node, i in zip(nodes, inner)]))


class Histograms:
    """Sums per tree, node, feature and bin that one task collects."""

    def __init__(self, names: list[str]):
        self.names = names
        self.sums: dict[tuple[int, int, int], np.ndarray] = {}

    def add(self, tree: int, numbers: np.ndarray, slots: np.ndarray, feature: int, bins: np.ndarray,
            weights: list[np.ndarray | None], span: np.ndarray | None = None) -> None:
        """Count rows by their bin of one feature. ``slots`` is a row's place in ``numbers``; a weight None
        counts rows. The least and highest ``span`` come before the sums, if it is given."""
        width = int(bins.max(initial=0)) + 1
        key = slots * width + bins
        cells = len(numbers) * width
        counted: dict[int, np.ndarray] = {}
        parts = []
        if span is not None:
            for take, start in ((np.minimum, np.inf), (np.maximum, -np.inf)):
                ends = np.full(cells, start)
                take.at(ends, key, span)
                parts.append(ends.reshape(len(numbers), width))
        for weight in weights:
            if id(weight) not in counted:
                counted[id(weight)] = np.bincount(key, weight, cells).reshape(len(numbers), width)
            parts.append(counted[id(weight)])
        found = np.stack(parts, axis=1).astype(float)  # nodes x sums x bins
        plain = 0 if span is None else 2
        for slot, number in enumerate(numbers.tolist()):
            old, new = self.sums.get((tree, number, feature)), found[slot]
            if old is not None:
                if old.shape[1] > width:
                    old, new = new, old
                wide = slice(0, old.shape[1])
                new = new.copy()
                new[plain:, wide] += old[plain:]
                if plain:
                    new[0, wide] = np.minimum(new[0, wide], old[0])
                    new[1, wide] = np.maximum(new[1, wide], old[1])
            self.sums[tree, number, feature] = new

    def batches(self) -> Iterator[pa.RecordBatch]:
        """``tree, node, feature, bin`` and the sums, of bins that hold rows (the last sum counts them)."""
        keys, cells = [], []
        for key, sums in self.sums.items():
            bins = np.flatnonzero(sums[-1])
            keys.append(np.column_stack([np.tile(key, (len(bins), 1)), bins]))
            cells.append(sums[:, bins])
        if keys:
            whole, sums = np.concatenate(keys).astype("i4"), np.concatenate(cells, axis=1)
            columns = [pa.array(np.ascontiguousarray(whole[:, i])) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(np.ascontiguousarray(s)) for s in sums], ["tree", "node", "feature", "bin", *self.names])

    def schema(self) -> str:
        return "tree int, node int, feature int, bin int, " + ", ".join(f"{name} double" for name in self.names)
