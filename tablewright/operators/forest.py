"""Random forests without a depth limit.

The upper part of every tree, down to nodes that hold at most ``local_rows`` rows, is grown level by
level with one aggregate for all open nodes of a group of trees. A node that small is sent whole
to one task, which grows the subtree below it until its leaves are pure. A node that ends with more rows than that (pure, or
its rows all alike) is a leaf at once and sends none. Subtrees stay in a table
on the executors, keyed by tree and node: with deep trees a model is as large as its
data, and the driver holds the upper parts only.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, factorial, isqrt
from random import Random

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.blocks import (
    Histograms, code_type, end_nodes, few, hashed, list_matrix, node_arrays, pack, summed, unpack)
from tablewright.operators.boosting import MAX_BINS, Node, bin_edges, binned
from tablewright.session import materialize

LOCAL_ROWS = 20_000
TREES_AT_ONCE = 10  # trees grown together at least
ROWS_AT_ONCE = 40_000_000  # rows times trees that one group of more trees may have: bounds what a pass shuffles
HISTOGRAM_CELLS = 1 << 24  # sums that a task holds in one pass over the open nodes of a level: 128 MB
SUBTREE = "tree int, node int, feature array<int>, bin array<int>, left array<int>, right array<int>, value array<double>"
_LEVELS = 64  # of an upper part; a path halves its rows only in the best case


@dataclass(frozen=True)
class ForestGrowth:
    trees: int = 100
    depth: int | None = None
    subset: str = "sqrt"  # features tried per node: "sqrt" or "all"
    local_rows: int = LOCAL_ROWS
    bins: int = MAX_BINS
    seed: int = 42


@dataclass
class UpperNode(Node):
    """A node of an upper part; ``sums`` ends with its drawn rows, ``value`` is what it would say as a leaf."""

    value: list[float] | None = None
    pure: bool = False

    def settled(self, growth: ForestGrowth) -> bool:
        """An end that needs no subtree: pure, or with more rows than one task should get, out of depth or
        without a split."""
        return self.left is None and self.value is not None and (self.pure or self.sums[2] > growth.local_rows)


@dataclass
class Forest:
    """Edges per feature, classes (0 for figures), upper parts, and the table of subtrees below those
    ends that are not settled."""

    edges: list[list[float]]
    classes: int
    uppers: list[list[UpperNode]]
    subtrees: DataFrame
    growth: ForestGrowth = ForestGrowth()


_POISSON = np.cumsum([np.exp(-1.0) / factorial(times) for times in range(8)])


def draw_weight(first: int, count: int, tree: int, seed: int) -> np.ndarray:
    """How often a bootstrap sample holds each row: Poisson with mean 1, from a hash of its number."""
    return np.searchsorted(_POISSON, hashed(first, count, seed, tree), side="right")


def _tried(tree: int, node: int, size: int, growth: ForestGrowth) -> list[int]:
    """All features in the order in which a node tries them; the first few are its subset."""
    order = list(range(size))
    Random(f"{growth.seed}:{tree}:{node}").shuffle(order)
    return order


def _subset_size(size: int, growth: ForestGrowth) -> int:
    return max(1, isqrt(size)) if growth.subset == "sqrt" else max(1, size)


def _level(blocks: DataFrame, first: int, uppers: list[list[UpperNode]], taken: dict[tuple[int, int], list[int]],
           size: int, kind: str, classes: int, seed: int) -> pa.Table:
    """Sums per open node, tried feature and bin: weighted rows per class, or least, highest and weighted label."""
    named = [f"s{j}" for j in range(max(classes, 1))]
    sums = {**({} if classes else {"low": "min", "high": "max"}), **dict.fromkeys([*named, "w"], "sum")}
    trees = [node_arrays(nodes) for nodes in uppers]
    tried: list[dict[int, list[int]]] = [{} for _ in uppers]  # per tree and feature: the open nodes that try it
    for (k, number), features in taken.items():
        for f in features:
            tried[k].setdefault(f, []).append(number)
    plans = [{f: np.array(sorted(numbers), np.int64) for f, numbers in own.items()} for own in tried]

    def counted(batches):
        found = Histograms(list(sums))
        for batch in batches:
            for _, start, bins, y in unpack(batch, size, kind):
                for k, tree in enumerate(trees):
                    if not plans[k]:
                        continue
                    at, w = end_nodes(bins, *tree), draw_weight(start, len(y), first + k, seed)
                    is_open = np.zeros(len(tree[0]), bool)
                    is_open[np.concatenate(list(plans[k].values()))] = True
                    kept = np.flatnonzero(is_open[at] & (w > 0))
                    at, w, told = at[kept], w[kept].astype(float), y[kept]
                    for f, numbers in plans[k].items():
                        slot = np.full(len(tree[0]), -1, np.int64)
                        slot[numbers] = np.arange(len(numbers))
                        slots = slot[at]
                        own = slots >= 0
                        if not own.any():
                            continue
                        own = slice(None) if own.all() else own
                        wf, yf = w[own], told[own]
                        parts = [wf * (yf == c) for c in range(classes)] if classes else [wf * yf]
                        found.add(k, numbers, slots[own], f, bins[f][kept[own]], [*parts, wf], None if classes else yf)
        yield from found.batches()

    return summed(blocks.mapInArrow(counted, Histograms(list(sums)).schema()), sums)


def _best(hist: np.ndarray, weight: np.ndarray) -> tuple[float, int, int]:
    """Gain, feature place and bin of the best split. ``hist``: features x bins x sums; ``weight``:
    features x bins. Gain is the sum of squares over weight of both sides, less that of the whole:
    Gini's decrease for classes, the variance's for figures."""
    left, rows = hist.cumsum(axis=1)[:, :-1], weight.cumsum(axis=1)[:, :-1]
    total, count = hist.sum(axis=1)[:, None], weight.sum(axis=1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left**2).sum(axis=2) / rows + ((total - left) ** 2).sum(axis=2) / (count - rows)
    gain = np.where((rows > 0) & (rows < count), gain - (total**2).sum(axis=2) / count, -np.inf)
    # A bin without rows splits like the one before it; argmax takes the first.
    at = int(gain.argmax())
    place, bound = divmod(at, gain.shape[1])
    return float(gain[place, bound]), place, bound + 1


def _passes(taken: dict[tuple[int, int], list[int]], cells: int) -> list[dict[tuple[int, int], list[int]]]:
    """Open nodes with the features they try, in groups whose histograms, of ``cells`` sums a feature, fit a task."""
    groups, held = [{}], 0
    for place, features in taken.items():
        more = len(features) * cells
        if groups[-1] and held + more > HISTOGRAM_CELLS:
            groups.append({})
            held = 0
        groups[-1][place] = features
        held += more
    return groups


def _upper_parts(blocks: DataFrame, first: int, count: int, size: int, kind: str, classes: int, n_rows: int,
                 growth: ForestGrowth) -> list[list[UpperNode]]:
    """Grow trees ``first`` to ``first + count - 1`` until every open node is small enough."""
    uppers = [[UpperNode((0.0, 0.0, n_rows), number=0)] for _ in range(count)]
    m, limit = _subset_size(size, growth), growth.depth if growth.depth is not None else _LEVELS
    opened = [[nodes[0]] if n_rows > growth.local_rows and size else [] for nodes in uppers]
    tries: dict[tuple[int, int], int] = {}
    for _ in range(2 * limit):
        opened = [[n for n in own if n.depth < limit] for own in opened]
        if not any(opened):
            break
        taken = {}
        for k, own in enumerate(opened):
            for n in own:
                start = tries.get((k, n.number), 0)
                order = _tried(first + k, n.number, size, growth)
                taken[k, n.number] = order[:m] if start == 0 else order[m:]
        if not any(taken.values()):
            break
        fresh: list[list[Node]] = [[] for _ in range(count)]
        width, sums = growth.bins + 1, max(classes, 1)
        for part in _passes(taken, width * (sums + (1 if classes else 3))):
            # Bins x tried features per open node: far fewer than rows / local_rows x features x bins.
            hist = _level(blocks, first, uppers, part, size, kind, classes, growth.seed)
            columns = {name: hist[name].to_numpy() for name in hist.column_names}
            grouped: dict[tuple[int, int], list[int]] = {}
            for i, place in enumerate(zip(columns["tree"].tolist(), columns["node"].tolist())):
                grouped.setdefault(place, []).append(i)
            for (k, number), features in part.items():
                node = uppers[k][number]
                found = np.array(grouped.get((k, number), []), np.int64)
                place = np.zeros(size, np.int64)
                place[features] = np.arange(len(features))
                cube, weight = np.zeros((len(features), width, sums)), np.zeros((len(features), width))
                low, high = np.full_like(weight, np.inf), np.full_like(weight, -np.inf)
                cell = place[columns["feature"][found]], columns["bin"][found]
                weight[cell] = columns["w"][found]
                for j in range(sums):
                    cube[(*cell, j)] = columns[f"s{j}"][found]
                if not classes:
                    low[cell], high[cell] = columns["low"][found], columns["high"][found]
                gain, at, bound = _best(cube, weight)
                node.value = (cube[0].sum(axis=0) / max(weight[0].sum(), 1)).tolist()
                node.pure = max(node.value) >= 1 if classes else bool(low[0].min() == high[0].max())
                if gain > -np.inf and not node.pure:
                    node.feature, node.bin, node.gain = features[at], bound, gain
                    nodes = uppers[k]
                    for side, cut in (("left", slice(0, bound)), ("right", slice(bound, None))):
                        n = weight[at, cut].sum()
                        value = (cube[at, cut].sum(axis=0) / n).tolist()
                        pure = max(value) >= 1 if classes else bool(low[at, cut].min() == high[at, cut].max())
                        child = UpperNode((0.0, 0.0, int(n)), node.depth + 1, number=len(nodes), value=value, pure=pure)
                        setattr(node, side, child)
                        nodes.append(child)
                        if n > growth.local_rows and not pure:
                            fresh[k].append(child)
                elif not node.pure and m < size and (k, number) not in tries:
                    tries[k, number] = 1  # none of the subset splits it: try the others
                    fresh[k].append(node)
        opened = fresh
    return uppers


def _search(bins, own, y, w, node, feature) -> tuple[np.ndarray, np.ndarray]:
    """Best split of every node by one feature each: gain (-inf without one), lowest bin on the right, all by
    node. ``own`` are the rows in the order of their ``node``; ``y`` holds a column per class, or the figures."""
    count = len(feature)
    gain, bound = np.full(count, -np.inf), np.zeros(count, np.int64)
    value = bins[own, feature[node]].astype(np.int64)
    order = np.argsort(node * (np.int64(bins.max(initial=0)) + 1) + value, kind="stable")
    node, value, rows = node[order], value[order], own[order]
    weight, sums = w[rows].cumsum(), (y[rows] * w[rows, None]).cumsum(axis=0)
    ends = np.flatnonzero(np.diff(node, append=-1))
    zero = np.zeros((1, sums.shape[1]))
    before, before_sums = np.append(0, weight[ends[:-1]]), np.vstack([zero, sums[ends[:-1]]])
    total, total_sums = weight[ends] - before, sums[ends] - before_sums
    at = np.flatnonzero((node[1:] == node[:-1]) & (value[1:] > value[:-1]))
    if len(at):
        of = node[at]
        left, left_sums = weight[at] - before[of], sums[at] - before_sums[of]
        worth = (left_sums**2).sum(axis=1) / left
        worth += ((total_sums[of] - left_sums) ** 2).sum(axis=1) / (total[of] - left)
        worth -= (total_sums[of] ** 2).sum(axis=1) / total[of]
        best = np.lexsort((-worth, of))  # the first of a node has the highest gain, ties at the lowest bin
        first = best[np.flatnonzero(np.diff(of[best], prepend=-1))]
        gain[of[first]], bound[of[first]] = worth[first], value[at[first] + 1]
    return gain, bound


def grow_subtree(bins: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, depth: int | None, m: int,
                 random: np.random.Generator) -> dict[str, list]:
    """Grow one tree over the given rows until its leaves are pure, or to ``depth`` more levels.

    All open nodes of a level are split together, each by the best of its own ``m`` features; where none of
    these varies, the other features are tried. Values are class shares (``classes`` numbers a
    node) or means. Only rows that are all alike stay in a leaf that is not pure.
    """
    size = bins.shape[1]
    told = np.eye(classes)[y.astype(np.int64)] if classes else y[:, None]
    feature, bound, left, right = ([np.zeros(0, np.int64)] for _ in range(4))
    values = [np.zeros((0, told.shape[1]))]
    own, node, start, count, level = np.arange(len(y)), np.zeros(len(y), np.int64), 0, 1, 0
    while count:
        # Rows are in the order of their node, nodes 0 to count - 1 of this level.
        firsts = np.flatnonzero(np.diff(node, prepend=-1))
        weight = np.add.reduceat(w[own], firsts)
        values.append(np.add.reduceat(told[own] * w[own, None], firsts) / weight[:, None])
        low, high = np.minimum.reduceat(y[own], firsts), np.maximum.reduceat(y[own], firsts)
        best, by, at = np.full(count, -np.inf), np.full(count, -1), np.zeros(count, np.int64)
        if size and (depth is None or level < depth):
            order = random.permuted(np.tile(np.arange(size), (count, 1)), axis=1)
            for step in range(size):
                # The others are tried only by nodes that their subset could not split.
                todo = (low < high) & ((by < 0) | (step < m))
                if not todo.any():
                    break
                some = np.flatnonzero(todo)
                place = np.full(count, -1)
                place[some] = np.arange(len(some))
                kept = todo[node]
                gain, cut = _search(bins, own[kept], told, w, place[node[kept]], order[some, step])
                better = gain > best[some]
                best[some[better]], by[some[better]], at[some[better]] = gain[better], order[some[better], step], cut[better]
        split = by >= 0
        number = np.cumsum(split) - 1
        children = start + count + 2 * number
        here = start + np.arange(count)
        feature.append(by)
        bound.append(np.where(split, at, 0))
        left.append(np.where(split, children, here))
        right.append(np.where(split, children + 1, here))
        kept = split[node]
        own, node = own[kept], node[kept]
        above = bins[own, by[node]] >= at[node]
        node = 2 * number[node] + above
        order = np.argsort(node, kind="stable")
        own, node = own[order], node[order]
        start, count, level = start + count, 2 * int(split.sum()), level + 1
    found = {name: np.concatenate(parts).tolist()
             for name, parts in (("feature", feature), ("bin", bound), ("left", left), ("right", right))}
    return {**found, "value": np.concatenate(values).ravel().tolist()}


def _bytes(codes: np.ndarray) -> pa.Array:
    """Rows of bins as a column of bytes."""
    ends = np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1] * codes.itemsize
    data = np.ascontiguousarray(codes).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def _bins_matrix(column: pa.ChunkedArray, size: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), size)


def _below(depths: dict[int, list[int]], size: int, kind: str, classes: int, m: int, growth: ForestGrowth):
    """What one task does with the rows of one node: the subtree below it as one row."""
    def below(key, table):
        tree, node = key[0].as_py(), key[1].as_py()
        table = table.sort_by("_id")
        left = None if growth.depth is None else growth.depth - depths[tree][node]
        found = grow_subtree(
            _bins_matrix(table["_bins"], size, kind), table["_y"].to_numpy(), table["_w"].to_numpy().astype(float),
            classes, left, m, np.random.default_rng([growth.seed, tree, node]))
        return pa.Table.from_pylist([{"tree": tree, "node": node, **found}], SUBTREE_ARROW)

    return below


def _drawn(first: int, uppers: list[list[UpperNode]], size: int, kind: str, growth: ForestGrowth):
    """What a task does with blocks: the rows drawn by each tree that end where it needs a subtree."""
    trees = [node_arrays(nodes) for nodes in uppers]
    wanted = [np.array([n.left is None and not n.settled(growth) for n in nodes]) for nodes in uppers]

    def rows(batches):
        for batch in batches:
            for _, start, bins, y in unpack(batch, size, kind):
                for k, tree in enumerate(trees):
                    if not wanted[k].any():
                        continue
                    at, w = end_nodes(bins, *tree), draw_weight(start, len(y), first + k, growth.seed)
                    kept = np.flatnonzero(wanted[k][at] & (w > 0))
                    if len(kept):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(kept), first + k, np.int32)), pa.array(at[kept].astype(np.int32)),
                             pa.array(start + kept), _bytes(bins[:, kept].T), pa.array(y[kept]),
                             pa.array(w[kept].astype(np.int32))], ["tree", "node", "_id", "_bins", "_y", "_w"])

    return rows


def trees_at_once(n_rows: int) -> int:
    """Trees of a group. A pass over few rows is mostly its start, so few rows are passed over by more trees."""
    return max(TREES_AT_ONCE, ROWS_AT_ONCE // max(n_rows, 1))


def fit_forest(
    rows: DataFrame, features: str, label: str, classes: int = 0, growth: ForestGrowth = ForestGrowth()
) -> Forest:
    """Fit a forest to an array column of features; ``classes`` 0 averages figures.

    Rows are binned and written once, in blocks. Bootstrap weights come from a hash of the row and the
    tree, the order in which a node tries features from the tree and the node, so a lost
    task draws the same again. Of each group of trees only the rows that end above a subtree are shuffled.
    """
    rows = rows.select(F.col(features).alias("_x"), F.col(label).cast("double").alias("_y"))
    first = rows.select(F.size("_x").alias("n")).first()
    size = first["n"] if first else 0
    edges = bin_edges(rows, "_x", size, growth.bins) if size else []
    kind = code_type(edges)
    blocks = pack(rows.withColumn("_id", F.monotonically_increasing_id()), size, kind, edges)
    n_rows = blocks.agg(F.sum("n")).first()[0] or 0
    together = min(trees_at_once(n_rows), max(growth.trees, 1))
    blocks = few(blocks, n_rows * together).persist(StorageLevel.MEMORY_AND_DISK)
    m = _subset_size(size, growth)
    uppers: list[list[UpperNode]] = []
    tables = []
    for start in range(0, growth.trees if n_rows else 0, together):
        count = min(together, growth.trees - start)
        grown = _upper_parts(blocks, start, count, size, kind, classes, n_rows, growth)
        uppers += grown
        if all(n.left is not None or n.settled(growth) for nodes in grown for n in nodes):
            continue
        depths = {start + k: [node.depth for node in nodes] for k, nodes in enumerate(grown)}
        drawn = blocks.mapInArrow(
            _drawn(start, grown, size, kind, growth), "tree int, node int, _id long, _bins binary, _y double, _w int")
        grown_table = drawn.groupBy("tree", "node").applyInArrow(_below(depths, size, kind, classes, m, growth), SUBTREE)
        tables.append(materialize(grown_table, "subtrees"))
    blocks.unpersist()
    return Forest(edges, classes, uppers, _union(rows.sparkSession, tables), growth)


SUBTREE_ARROW = pa.schema([
    ("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.list_(pa.int32())), ("bin", pa.list_(pa.int32())),
    ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])


def _union(spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
    if not tables:
        return spark.createDataFrame([], SUBTREE)
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def _routed(forest: Forest, size: int, kind: str, sums: int):
    """What a task does with rows: per row the sum of the settled ends' values (tree -1), and a row per
    tree whose subtree has to say."""
    trees = [node_arrays(nodes) for nodes in forest.uppers]
    settled = [np.array([n.settled(forest.growth) for n in nodes]) for nodes in forest.uppers]
    values = [np.array([n.value if s else [0.0] * sums for n, s in zip(nodes, own)])
              for nodes, own in zip(forest.uppers, settled)]

    def rows(batches):
        for batch in batches:
            bins = np.ascontiguousarray(list_matrix(batch["_bins"], size).astype(kind).T)
            total, votes = np.zeros((len(batch), sums)), np.zeros(len(batch), np.int32)
            for k, tree in enumerate(trees):
                at = end_nodes(bins, *tree)
                known = settled[k][at]
                total += values[k][at]
                votes += known
                asked = np.flatnonzero(~known)
                if len(asked):
                    yield from part(batch, asked, k, at[asked].astype(np.int32), _bytes(bins[:, asked].T),
                                    np.zeros((len(asked), sums)), np.zeros(len(asked), np.int32))
            empty = _bytes(np.zeros((len(batch), 0), kind))
            yield from part(batch, np.arange(len(batch)), -1, votes * 0, empty, total, votes)

    def part(batch, kept, tree, node, bins, scores, votes):
        yield pa.RecordBatch.from_arrays(
            [batch["_id"].take(pa.array(kept)), pa.array(np.full(len(kept), tree, np.int32)), pa.array(node), bins,
             _lists(scores), pa.array(votes)], ["_id", "tree", "node", "_bins", "scores", "votes"])

    return rows


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()))


def forest_scores(forest: Forest, rows: DataFrame, features: str, key: str) -> DataFrame:
    """``key, scores``: mean class shares, or the mean, of all trees for every row of ``rows``.

    Rows go through the upper parts in their tasks; where these end without a settled value they meet the subtrees
    by tree and node. Rows of a subtree that many rows share are cut into parts by the key's hash, each with
    a copy of it.
    """
    coded = binned(rows.select(F.col(key).alias("_id"), F.col(features).alias("_x")), "_x", forest.edges)
    coded = coded.select("_id", "_bins")
    size, sums, kind = len(forest.edges), max(forest.classes, 1), code_type(forest.edges)
    id_type = coded.schema["_id"].dataType.simpleString()
    if not forest.uppers:
        return coded.select(F.col("_id").alias(key), F.array(*[F.lit(None).cast("double")] * sums).alias("scores"))
    found = materialize(coded.mapInArrow(
        _routed(forest, size, kind, sums),
        f"_id {id_type}, tree int, node int, _bins binary, scores array<double>, votes int"), "routed")
    # A subtree's rows per tree, if all of a tree's rows met the same one.
    parts = max(1, ceil(found.filter("tree < 0").count() / LOCAL_ROWS))
    routed = found.filter("tree >= 0").withColumn("part", F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int"))
    # A part that no row asks for needs no copy.
    wanted = materialize(routed.select("tree", "node", "part").distinct(), "wanted")
    copies = forest.subtrees.join(wanted, ["tree", "node"])

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            # A node that drew no row in training has no subtree: it does not vote.
            return pa.table({"_id": left["_id"].slice(0, 0), "scores": pa.array([], pa.list_(pa.float64())),
                             "votes": pa.array([], pa.int32())})
        bins = _bins_matrix(left["_bins"], size, kind)
        feature, bound, lower, upper = (np.array(right[c][0].as_py()) for c in ("feature", "bin", "left", "right"))
        value = np.array(right["value"][0].as_py()).reshape(-1, sums)
        at = end_nodes(np.ascontiguousarray(bins.T), feature, bound, lower, upper)
        return pa.table({"_id": left["_id"], "scores": _lists(value[at]), "votes": pa.array(np.ones(len(at), np.int32))})

    by = ("tree", "node", "part")
    own = routed.select(*by, "_id", "_bins").groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(
        walk, f"_id {id_type}, scores array<double>, votes int")
    votes = found.filter("tree < 0").select("_id", "scores", "votes").unionByName(own)
    means = [F.try_divide(F.sum(F.get("scores", k)), F.sum("votes")).alias(f"s{k}") for k in range(sums)]
    found = votes.groupBy("_id").agg(*means)
    return found.select(F.col("_id").alias(key), F.array(*[F.col(f"s{k}") for k in range(sums)]).alias("scores"))
