"""Gradient boosted trees over binned features.

Every round grows one tree, or one per class on shared residuals. A level of a tree is one
aggregate: gradient and Hessian sums per open leaf, feature and bin. Only these sums reach the
driver, where running sums over the bins give the gain of every split.
Growth is best first: of all leaves the one with the highest gain is split next, up to a number of
leaves. A leaf's gain depends on its own rows only, so the leaves that may still be
reached are looked at level by level, all in one pass, and the order is settled afterwards.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from functools import partial
from math import log

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.blocks import (
    FILE_BLOCKS, PACKED, Histograms, code_type, end_nodes, few, hashed, list_matrix, node_arrays, pack, summed, unpack)
from tablewright.session import materialize

SQUARED, LOGISTIC, SOFTMAX = "squared", "logistic", "softmax"
MAX_BINS = 255
CHECKPOINT_ROUNDS = 10  # scores are written to the shared folder this often
FEATURES_AT_ONCE = 100  # features whose quantiles or histograms are taken in one pass
_TIE = 1e-9  # gains this close, relatively, count as equal: sums differ in their last bits
_NOISE = 1e-12  # a gain below this share of what it is the difference of is none


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``leaves`` None means every useful split down to ``depth``."""

    rounds: int = 100
    depth: int = 6
    leaves: int | None = None
    rate: float = 0.1
    ridge: float = 0.0  # added to every Hessian sum
    least_rows: int = 1  # of a leaf
    least_hessian: float = 1e-3  # of a leaf
    sample: float = 1.0  # share of rows that a round learns from
    bins: int = MAX_BINS
    seed: int = 42


@dataclass
class Node:
    """A node of a tree; rows go left where their bin of ``feature`` is below ``bin``."""

    sums: tuple[float, float, int]  # gradient, Hessian, rows
    depth: int = 0
    feature: int = -1
    bin: int = 0
    gain: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None
    number: int = -1


@dataclass
class Tree:
    """A finished tree as arrays; ``feature`` is -1 at a leaf."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)


# --- bins ---------------------------------------------------------------------------


def bin_edges(rows: DataFrame, features: str, size: int, bins: int = MAX_BINS) -> list[list[float]]:
    """Ascending edges per feature of an array column, at most ``bins - 1`` each.

    A value's bin is the number of edges at or below it. Edges are approximate quantiles, so
    a feature of few values has one bin per value (a value rarer than one row in ``8 * bins`` may
    share its neighbour's).
    """
    edges: list[list[float]] = []
    shares = [i / bins for i in range(bins + 1)]
    for start in range(0, size, FEATURES_AT_ONCE):
        names = [f"f{i}" for i in range(start, min(size, start + FEATURES_AT_ONCE))]
        columns = rows.select(*[F.get(features, i).alias(f"f{i}") for i in range(start, start + len(names))])
        for found in columns.approxQuantile(names, shares, 1 / (8 * bins)):
            edges.append(sorted(set(found))[1:][: bins - 1])
    return edges


def binned(rows: DataFrame, features: str, edges: list[list[float]], output: str = "_bins") -> DataFrame:
    """Add the bins of an array column as an array of int; a gap falls in the last bin."""
    parts = [f"_x{i}" for i in range(len(edges))]
    wide = rows.withColumns({p: F.coalesce(F.get(features, i), F.lit(float("inf"))) for i, p in enumerate(parts)})
    cut = [i for i, found in enumerate(edges) if found]
    if cut:
        wide = Bucketizer(
            splitsArray=[[float("-inf"), *edges[i], float("inf")] for i in cut], handleInvalid="keep",
            inputCols=[parts[i] for i in cut], outputCols=[f"_b{i}" for i in cut]).transform(wide)
    codes = [F.least(F.col(f"_b{i}").cast("int"), F.lit(len(edges[i]))) if edges[i] else F.lit(0)
             for i in range(len(edges))]
    return wide.withColumn(output, F.array(*codes)).select(*rows.columns, output)


# --- gradients ----------------------------------------------------------------------


def class_shares(scores: str = "_s") -> str:
    """SQL of the softmax of an array of scores."""
    powers = f"transform({scores}, s -> exp(s - array_max({scores})))"
    return f"transform({powers}, (e, i) -> e / aggregate({powers}, 0D, (a, b) -> a + b))"


def gradients(rows: DataFrame, objective: str, label: str = "_y", scores: str = "_s") -> DataFrame:
    """Add ``_g`` and ``_h``: first and second derivatives of the loss by each score.

    Softmax Hessians carry the factor K / (K - 1) of the diagonal approximation.
    """
    if objective == SQUARED:
        return rows.withColumns({"_g": F.array(F.get(scores, 0) - F.col(label)), "_h": F.array(F.lit(1.0))})
    if objective == LOGISTIC:
        share = 1 / (1 + F.exp(-F.get(scores, 0)))
        rows = rows.withColumn("_p", F.array(share))
        return rows.withColumns({
            "_g": F.array(F.get("_p", 0) - F.col(label)),
            "_h": F.array(F.get("_p", 0) * (1 - F.get("_p", 0)))}).drop("_p")
    rows = rows.withColumn("_p", F.expr(class_shares(scores)))
    return rows.withColumns({
        "_g": F.expr(f"transform(_p, (p, i) -> p - CAST({label} = i AS DOUBLE))"),
        "_h": F.expr(f"transform(_p, p -> p * (1 - p) * size({scores}) / (size({scores}) - 1))")}).drop("_p")


def starting_scores(rows: DataFrame, objective: str, classes: int, label: str = "_y") -> list[float]:
    """The constant scores of least loss: the mean, the log odds, or the log shares."""
    if objective == SQUARED:
        return [float(rows.agg(F.avg(label)).first()[0] or 0.0)]
    counts = {int(r[label]): r["count"] for r in rows.groupBy(label).count().collect()}  # a row per class
    total = sum(counts.values())
    share = [max(counts.get(k, 0), 1e-9) / max(total, 1) for k in range(max(classes, 2))]
    if objective == LOGISTIC:
        return [log(share[1] / share[0])]
    return [log(s) for s in share]


# --- one round ----------------------------------------------------------------------


def derivatives(scores: np.ndarray, y: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray | None]:
    """What ``gradients`` adds, for trees x rows of scores; Hessians that are all 1 are None. A row
    without a label adds nothing to the gradients."""
    if objective == SQUARED:
        return np.where(np.isnan(y), 0.0, scores - y), None
    if objective == LOGISTIC:
        share = 1 / (1 + np.exp(-np.clip(scores, -700, 700)))
        return np.where(np.isnan(y), 0.0, share - y), share * (1 - share)
    share = np.exp(scores - scores.max(axis=0))
    share /= share.sum(axis=0)
    told = y == np.arange(len(scores))[:, None]
    return np.where(np.isnan(y), 0.0, share - told), share * (1 - share) * len(scores) / (len(scores) - 1)


SUMS = {"g": "sum", "h": "sum", "n": "sum"}


def histograms(rows: DataFrame, places: list[str], first: int = 0, count: int | None = None) -> DataFrame:
    """``tree, node, feature, bin, g, h, n`` of all rows that lie in an open leaf, for ``count`` features
    from ``first``.

    ``places`` has SQL per tree that gives a row's open leaf, or null. Each task gives its own sums, at most
    a row per leaf, feature and bin.
    """
    bins = "_bins" if count is None else f"slice(_bins, {first + 1}, {count})"
    at = ", ".join(f"coalesce(cast({place} AS int), -1)" for place in places)
    part = rows.select(F.expr(bins).alias("_bins"), F.expr(f"array({at})").alias("_at"), "_g", "_h")
    trees = len(places)

    def counted(batches):
        sums = Histograms(list(SUMS))
        for batch in batches:
            if not len(batch):
                continue
            g, h, nodes = (list_matrix(batch[c], trees) for c in ("_g", "_h", "_at"))
            codes = list_matrix(batch["_bins"], len(batch["_bins"][0]))
            for k in range(trees):
                kept = nodes[:, k] >= 0
                numbers, slots = np.unique(nodes[kept, k], return_inverse=True)
                for f in range(codes.shape[1]) if len(numbers) else ():
                    sums.add(k, numbers, slots, first + f, codes[kept, f],
                             [np.nan_to_num(g[kept, k]), np.nan_to_num(h[kept, k]), None])
        yield from sums.batches()

    return part.mapInArrow(counted, Histograms(list(SUMS)).schema())


@dataclass(frozen=True)
class Blocks:
    """Packed rows with their scores so far, ``s``, and what a round needs to learn from them."""

    rows: DataFrame
    kind: str
    objective: str
    sample: float = 1.0
    seed: int = 42
    number: int = 0  # of the round


def block_histograms(blocks: Blocks, seen: list[list[Node]], opened: list[set[int]], size: int, first: int,
                     count: int) -> DataFrame:
    """``histograms`` of packed rows. ``seen`` has the nodes of each tree by number, ``opened`` the
    numbers of its open leaves."""
    trees = [node_arrays(nodes) for nodes in seen]
    numbers = [np.array(sorted(own), np.int64) for own in opened]
    slot_of = []
    for nodes, own in zip(seen, numbers):
        slots = np.full(len(nodes), -1, np.int64)
        slots[own] = np.arange(len(own))
        slot_of.append(slots)
    kind, objective, sample, seed, number = blocks.kind, blocks.objective, blocks.sample, blocks.seed, blocks.number

    def counted(batches):
        sums = Histograms(list(SUMS))
        for batch in batches:
            for i, start, bins, y in unpack(batch, size, kind):
                scores = np.frombuffer(batch["s"][i].as_buffer(), "f8").reshape(-1, len(y))
                g, h = derivatives(scores, y, objective)
                drawn = hashed(start, len(y), seed, number) < sample if sample < 1 else None
                for k, tree in enumerate(trees):
                    if not len(numbers[k]):
                        continue
                    slots = slot_of[k][end_nodes(bins, *tree)]
                    kept = slots >= 0 if drawn is None else (slots >= 0) & drawn
                    if kept.all():
                        kept = slice(None)
                    at, gk, hk = slots[kept], g[k][kept], None if h is None else h[k][kept]
                    for f in range(first, first + count):
                        sums.add(k, numbers[k], at, f, bins[f][kept], [gk, hk, None])
        yield from sums.batches()

    return blocks.rows.mapInArrow(counted, Histograms(list(SUMS)).schema())


@dataclass(frozen=True)
class Split:
    """The best split of a leaf by one feature: sums of the lower bins, and of all."""

    tree: int
    node: int
    feature: int
    bin: int
    gain: float
    left: tuple[float, float, int]
    whole: tuple[float, float, int]


def splits_of(table: pa.Table, growth: Growth) -> list[Split]:
    """The best split per tree, leaf and feature of collected ``histograms``; ties go to the lower bin.

    A split at a bin that holds rows sends all lower bins to the left. Its gain is the sum of squared
    gradients over Hessians of both sides, less that of the whole.
    """
    if not len(table):
        return []
    keys = np.stack([table[c].to_numpy().astype(np.int64) for c in ("tree", "node", "feature")], axis=1)
    found, row = np.unique(keys, axis=0, return_inverse=True)
    row = row.ravel()
    at = table["bin"].to_numpy()
    cubes = {}
    for name in ("g", "h", "n"):
        cube = np.zeros((len(found), int(at.max()) + 1))
        cube[row, at] = table[name].to_numpy()
        below = cube.cumsum(axis=1) - cube
        cubes[name] = below, cube.sum(axis=1, keepdims=True) - below, cube
    g, h, n = cubes["g"], cubes["h"], cubes["n"]
    with np.errstate(divide="ignore", invalid="ignore"):
        worth = [g[side] ** 2 / (h[side] + growth.ridge) for side in (0, 1)]
        whole = (g[0] + g[1])[:, :1] ** 2 / ((h[0] + h[1])[:, :1] + growth.ridge)
    enough = n[2] > 0
    for side in (0, 1):
        enough &= (n[side] >= max(growth.least_rows, 1)) & (h[side] >= growth.least_hessian)
    gain = np.where(enough, worth[0] + worth[1] - whole, -np.inf)
    # Sums differ in their last bits from run to run: gains that close count as equal.
    best = np.nan_to_num(gain.max(axis=1), neginf=0.0)[:, None]
    where = (gain >= best - _TIE * np.abs(best)).argmax(axis=1)
    out = []
    for i, (key, b) in enumerate(zip(found.tolist(), where.tolist())):
        if enough[i, b]:
            left = (float(g[0][i, b]), float(h[0][i, b]), int(n[0][i, b]))
            all_ = tuple(a + float(c[1][i, b]) for a, c in zip(left, (g, h, n)))
            out.append(Split(*key, b, float(gain[i, b]), left, (all_[0], all_[1], int(all_[2]))))
    return out


def best_splits(rows: DataFrame | Blocks, places: list, size: int, growth: Growth,
                opened: list[set[int]] | None = None) -> list[Split]:
    """Best splits by every feature. A hundred features' histograms at a time reach the driver: a row per
    open leaf, feature and bin, however many rows and features there are.

    Packed rows take the trees' nodes as ``places`` and their open leaves apart.
    """
    found: list[Split] = []
    for first in range(0, size, FEATURES_AT_ONCE):
        count = min(FEATURES_AT_ONCE, size - first)
        if isinstance(rows, Blocks):
            counted = block_histograms(rows, places, opened, size, first, count)
        else:
            counted = histograms(rows, places, first, count)
        found += splits_of(summed(counted, SUMS), growth)
    return found


def _reachable(seen: list[Node], growth: Growth, lowest: dict[int, float]) -> list[Node]:
    """Nodes that best-first growth may split.

    A node is split after every node whose least gain on the way from the root exceeds its own
    least gain, so one with as many of those as there are splits is never reached.
    """
    if growth.leaves is None:
        return [node for node in seen if node.gain > 0]
    ranked = sorted((lowest[node.number] for node in seen if node.gain > 0), reverse=True)
    least = ranked[growth.leaves - 2] if len(ranked) > growth.leaves - 2 else 0.0
    return [node for node in seen if node.gain > 0 and lowest[node.number] >= least]


def grow_trees(rows: Blocks, count: int, size: int, growth: Growth) -> list[Node]:
    """Grow ``count`` trees over packed rows of ``size`` features, level by level in shared passes."""
    roots = [Node((0.0, 0.0, 0), number=0) for _ in range(count)]
    seen: list[list[Node]] = [[root] for root in roots]
    lowest: list[dict[int, float]] = [{} for _ in range(count)]
    open_nodes = [[root] for root in roots]
    for depth in range(growth.depth):
        if not any(open_nodes):
            break
        numbers = [{node.number: node for node in nodes} for nodes in open_nodes]
        opened = [set(own) for own in numbers]
        for split in sorted(best_splits(rows, seen, size, growth, opened), key=lambda x: x.feature):
            node = numbers[split.tree][split.node]
            if depth == 0:
                node.sums = split.whole
            noise = _NOISE * (split.whole[0] ** 2 / (split.whole[1] + growth.ridge) + split.gain)
            if split.gain > noise and split.gain > node.gain * (1 + _TIE):
                node.gain, node.feature, node.bin = split.gain, split.feature, split.bin
                right = tuple(a - b for a, b in zip(split.whole, split.left))
                node.left, node.right = Node(split.left, depth + 1), Node(right, depth + 1)
        for k in range(count):
            for node in open_nodes[k]:
                lowest[k][node.number] = min(node.gain, lowest[k].get(-1 - node.number, float("inf")))
            chosen = _reachable(seen[k], growth, lowest[k])
            kept = {node.number for node in chosen}
            fresh = []
            for node in open_nodes[k]:
                if node.number not in kept:
                    node.left = node.right = None
                    continue
                for child in (node.left, node.right):
                    child.number = len(seen[k])
                    lowest[k][-1 - child.number] = lowest[k][node.number]  # what it inherits
                    seen[k].append(child)
                    fresh.append(child)
            open_nodes[k] = fresh
    for root in roots:
        _best_first(root, growth.leaves)
    return roots


def numbered(root: Node) -> list[Node]:
    """The nodes of a tree in the order of their new numbers, the root first."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        node.number = len(nodes)
        nodes.append(node)
        if node.left is not None:
            stack += [node.right, node.left]
    return nodes


def _best_first(root: Node, leaves: int | None) -> None:
    """Keep the splits that best-first growth makes; every other node becomes a leaf."""
    queue, splits = [(-root.gain, root.number, root)], 0
    made = set()
    while queue and (leaves is None or splits < leaves - 1):
        _, _, node = heapq.heappop(queue)
        if node.left is None:
            continue
        splits += 1
        made.add(id(node))
        for child in (node.left, node.right):
            heapq.heappush(queue, (-child.gain, child.number, child))
    stack = [root]
    while stack:
        node = stack.pop()
        if id(node) not in made:
            node.left = node.right = None
        else:
            stack += [node.left, node.right]


def leaf_value(node: Node, growth: Growth) -> float:
    """Newton's step for the rows of a leaf, times the learning rate."""
    g, h, _ = node.sums
    return -growth.rate * g / (h + growth.ridge) if h + growth.ridge > 0 else 0.0


def finished(nodes: list[Node], growth: Growth) -> Tree:
    """A grown tree, its nodes by number, as arrays."""
    inner = [node.left is not None for node in nodes]
    return Tree(
        [node.feature if i else -1 for node, i in zip(nodes, inner)], [node.bin for node in nodes],
        [node.left.number if i else node.number for node, i in zip(nodes, inner)],
        [node.right.number if i else node.number for node, i in zip(nodes, inner)],
        [0.0 if i else leaf_value(node, growth) for node, i in zip(nodes, inner)])


# --- all rounds ---------------------------------------------------------------------


@dataclass
class Boosted:
    """Everything a fitted model needs: edges per feature, starting scores, trees per round."""

    objective: str
    edges: list[list[float]]
    start: list[float]
    rounds: list[list[Tree]]


def fit_boosting(
    rows: DataFrame, features: str, label: str, objective: str, classes: int = 1, growth: Growth = Growth()
) -> Boosted:
    """Fit boosted trees to ``rows``, whose ``features`` is an array of double.

    The binned rows are written once; a round reads them with the scores so far, which are
    kept in memory with spill to disk and written to the shared folder every ``CHECKPOINT_ROUNDS``
    rounds, so a lost executor costs at most those rounds. Rounds stop early once no
    tree can be split any more.
    """
    rows = rows.select(F.col(features).alias("_x"), F.col(label).cast("double").alias("_y"))
    first = rows.select(F.size("_x").alias("n")).first()
    size = first["n"] if first else 0
    edges = bin_edges(rows, "_x", size, growth.bins) if size else []
    kind = code_type(edges)
    blocks = pack(rows.withColumn("_id", F.monotonically_increasing_id()), size, kind, edges)
    cells = (blocks.agg(F.sum("n")).first()[0] or 0) * size
    start = starting_scores(rows, objective, classes)
    model = Boosted(objective, edges, start, [])
    scored = few(blocks, cells).mapInArrow(partial(_first_scores, start), SCORED)
    held: list[DataFrame] = []
    for number in range(growth.rounds if size else 0):
        now = scored.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(now)
        learnt = Blocks(now, kind, objective, growth.sample, growth.seed, number)
        roots = grow_trees(learnt, len(start), size, growth)
        while len(held) > 1:
            held.pop(0).unpersist()
        if all(root.left is None for root in roots):
            break
        trees = [finished(numbered(root), growth) for root in roots]
        model.rounds.append(trees)
        scored = now.mapInArrow(partial(_next_scores, trees, size, kind), SCORED)
        if (number + 1) % CHECKPOINT_ROUNDS == 0:
            scored = few(materialize(scored, "scores", FILE_BLOCKS), cells)
    for frame in held:
        frame.unpersist()
    return model


SCORED = f"{PACKED}, s binary"


def _first_scores(start: list[float], batches):
    for batch in batches:
        found = [np.repeat(np.array(start), n.as_py()).tobytes() for n in batch["n"]]
        yield batch.append_column("s", pa.array(found, pa.binary()))


def _next_scores(trees: list[Tree], size: int, kind: str, batches):
    """The scores after one more round."""
    walks = [(tuple(np.array(a, np.int64) for a in (t.feature, t.bin, t.left, t.right)), np.array(t.value)) for t in trees]
    for batch in batches:
        found = []
        for i, _, bins, y in unpack(batch, size, kind):
            scores = np.frombuffer(batch["s"][i].as_buffer(), "f8").reshape(len(trees), len(y)).copy()
            for k, (walk, value) in enumerate(walks):
                scores[k] += value[end_nodes(bins, *walk)]
            found.append(scores.tobytes())
        yield batch.set_column(batch.schema.get_field_index("s"), "s", pa.array(found, pa.binary()))


def raw_scores(model: Boosted, rounds: int | None = None):
    """A function from an array of features to the array of scores, batch by batch."""
    start = np.array(model.start)
    trees = []
    for group in model.rounds[:rounds]:
        for k, tree in enumerate(group):
            feature = np.array(tree.feature)
            edge = np.array([model.edges[f][b - 1] if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.bin)])
            trees.append((k, feature, edge, np.array(tree.left), np.array(tree.right), np.array(tree.value)))

    @F.arrow_udf("array<double>")
    def score(vectors: pa.Array) -> pa.Array:
        x = list_matrix(vectors, len(model.edges)).astype(float)
        out = np.tile(start, (len(x), 1))
        rows = np.arange(len(x))
        for k, feature, edge, left, right, value in trees:
            at = np.zeros(len(x), np.int64)
            while (feature[at] >= 0).any():
                f = feature[at]
                below = x[rows, np.maximum(f, 0)] < edge[at]
                at = np.where(f < 0, at, np.where(below, left[at], right[at]))
            out[:, k] += value[at]
        ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

    return score


def with_scores(df: DataFrame, features: str, model: Boosted, output: str = "_raw", rounds: int | None = None) -> DataFrame:
    """Add the scores of each row, one per tree of a round."""
    return df.withColumn(output, raw_scores(model, rounds)(vector_to_array(F.col(features))))
