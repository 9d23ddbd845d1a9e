"""Boosted trees, forests without a depth limit, kernel margins and their calibration, against plain versions."""

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import boosting, forest, inverted_cells, margins
from tablewright.plans import models


def table(spark, x, y, parts=3):
    frame = pd.DataFrame({"id": range(len(x)), "x": x.tolist(), "label": y.astype(float)})
    rows = spark.createDataFrame(frame, "id long, x array<double>, label double").repartition(parts, "id")
    rows = rows.withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan")))))
    return rows.withColumn("features", array_to_vector("x"))


def column(df, name):
    return np.array([r[0] for r in df.orderBy("id").select(name).collect()])


# --- boosting

def plain_best_first(codes, g, h, growth):
    """Leaf values per row: split the leaf of highest gain, scanning every split of every feature."""
    def best(rows):
        found = (0.0, None)
        for f in range(codes.shape[1]):
            for b in np.unique(codes[rows, f])[1:]:
                low = rows[codes[rows, f] < b]
                high = rows[codes[rows, f] >= b]
                worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + growth.ridge)
                if min(len(low), len(high)) < growth.least_rows or min(h[low].sum(), h[high].sum()) < growth.least_hessian:
                    continue
                gain = worth(low) + worth(high) - worth(rows)
                if gain > found[0] * (1 + 1e-9) and gain > 1e-9:
                    found = (gain, (low, high))
        return found

    leaves, queue, order = [np.arange(len(g))], [], 0
    done = []
    while leaves:
        for rows, depth in [(leaf, 0) if isinstance(leaf, np.ndarray) else leaf for leaf in leaves]:
            gain, parts = best(rows) if depth < growth.depth else (0.0, None)
            heapq.heappush(queue, (-gain, order, rows, parts, depth))
            order += 1
        leaves = []
        if queue and queue[0][3] is not None and len(queue) + len(done) < (growth.leaves or 10**9):
            _, _, rows, parts, depth = heapq.heappop(queue)
            leaves = [(parts[0], depth + 1), (parts[1], depth + 1)]
    value = np.zeros(len(g))
    for _, _, rows, _, _ in queue:
        value[rows] = -growth.rate * g[rows].sum() / (h[rows].sum() + growth.ridge)
    return value


@pytest.mark.parametrize("leaves, depth, ridge, least", [(2, 6, 0.0, 1), (5, 6, 1.0, 1), (9, 4, 0.0, 15), (None, 3, 1.0, 5)])
def test_one_tree_equals_plain_best_first_growth(spark, leaves, depth, ridge, least):
    random = np.random.default_rng(3)
    x = random.integers(0, 12, (240, 3)).astype(float)
    y = np.sin(x[:, 0]) * x[:, 1] + random.normal(size=240) * 0.3
    growth = boosting.Growth(rounds=1, depth=depth, leaves=leaves, ridge=ridge, least_rows=least, rate=0.5)
    rows = table(spark, x, y)
    model = boosting.fit_boosting(rows, "x", "label", boosting.SQUARED, growth=growth)
    found = column(boosting.with_scores(rows, "features", model), F.get("_raw", 0)) - model.start[0]
    expected = plain_best_first(x, y.mean() - y, np.ones(240), growth)
    assert found == pytest.approx(expected, abs=1e-9)
    assert len({round(v, 9) for v in found}) == model.rounds[0][0].leaves() or leaves is None


def test_leaves_bound_the_tree_and_change_it(spark):
    random = np.random.default_rng(4)
    x = random.normal(size=(2_000, 4))
    y = (x[:, 0] * x[:, 1] + random.normal(size=2_000) > 0).astype(float)
    counts = []
    for leaves in (4, 12, 0):
        fitted = models.HistogramBoosting(rounds=2, leaves=leaves, depth=5).fit(table(spark, x, y))
        counts.append([t.leaves() for group in fitted.boosted.rounds for t in group])
    assert counts[0] == [4, 4] and counts[1] == [12, 12] and min(counts[2]) > 12 and max(counts[2]) <= 32


def test_joint_classes_share_residuals(spark):
    random = np.random.default_rng(5)
    x = random.normal(size=(600, 3))
    y = (x[:, 0] > 0.4).astype(int) + (x[:, 1] > 0).astype(int)
    rows = table(spark, x, y)
    fitted = models.BoostedClassifier(rounds=3, depth=2).fit(rows)
    assert all(len(group) == 3 for group in fitted.boosted.rounds)
    losses = []
    for rounds in range(1, 4):
        share = np.array(column(fitted.first_rounds(rounds).transform(rows), vector_to_array("probability")).tolist())
        assert share.sum(axis=1) == pytest.approx(1)
        losses.append(-np.log(share[np.arange(600), y]).mean())
    assert all(b < a for a, b in zip(losses, losses[1:]))
    coded = rows.select(F.col("label").alias("_y"), F.array(*[F.lit(s) for s in fitted.boosted.start]).alias("_s"))
    first = boosting.gradients(coded, boosting.SOFTMAX).groupBy("_y").agg(
        *[F.sum(F.get("_g", k)).alias(f"g{k}") for k in range(3)], F.sum(F.get("_h", 0)).alias("h")).collect()
    share = np.bincount(y) / 600
    for r in first:
        n = (y == r["_y"]).sum()
        assert [r["g0"], r["g1"], r["g2"]] == pytest.approx([n * (share[k] - (k == r["_y"])) for k in range(3)])
        assert r["h"] == pytest.approx(n * share[0] * (1 - share[0]) * 1.5)


def test_gaps_constants_and_empty_tables(spark):
    x = np.array([[1.0, 5.0, np.nan], [2.0, 5.0, 1.0], [3.0, 5.0, np.nan], [4.0, 5.0, 2.0]] * 20)
    y = np.isnan(x[:, 2]).astype(float)
    rows = table(spark, x, y)
    fitted = models.HistogramBoosting(rounds=5, rate=0.5, leastHessian=0.0).fit(rows)
    assert fitted.boosted.edges[1] == [] and (column(fitted.transform(rows), "prediction") == y).all()
    same = models.HistogramBoosting(kind="regression", rounds=5).fit(table(spark, x, np.full(80, 7.0)))
    assert same.boosted.rounds == [] and set(column(same.transform(rows), "prediction")) == {7.0}
    empty = boosting.fit_boosting(rows.limit(0), "x", "label", boosting.SQUARED)
    assert empty.start == [0.0] and empty.rounds == []


def test_features_in_several_chunks_and_sampled_rounds(spark, monkeypatch):
    random = np.random.default_rng(6)
    x = random.integers(0, 5, (300, 7)).astype(float)
    y = x[:, 6] * 3 + x[:, 0]
    growth = boosting.Growth(rounds=3, depth=3, rate=0.5)
    whole = boosting.fit_boosting(table(spark, x, y), "x", "label", boosting.SQUARED, growth=growth)
    monkeypatch.setattr(boosting, "FEATURES_AT_ONCE", 2)
    monkeypatch.setattr(boosting, "CHECKPOINT_ROUNDS", 1)
    parts = boosting.fit_boosting(table(spark, x, y, parts=5), "x", "label", boosting.SQUARED, growth=growth)
    assert [t.feature for g in whole.rounds for t in g] == [t.feature for g in parts.rounds for t in g]
    half = models.HistogramBoosting(kind="regression", rounds=8, rate=0.5, sample=0.5).fit(table(spark, x, y))
    assert np.abs(column(half.transform(table(spark, x, y)), "prediction") - y).mean() < 0.8


def test_collected_splits_equal_sums_by_loop():
    random = np.random.default_rng(7)
    cells = [(t, n, f, b) for t in range(2) for n in (0, 3) for f in range(3) for b in sorted(random.choice(9, 5, False).tolist())]
    g, h, n = random.normal(size=len(cells)), random.random(len(cells)) + 0.1, random.integers(1, 9, len(cells))
    columns = dict(zip(("tree", "node", "feature", "bin"), map(list, zip(*cells))))
    found = boosting.splits_of(pa.table({**columns, "g": g, "h": h, "n": n}), boosting.Growth(ridge=0.5, least_rows=3))
    for split in found:
        rows = [i for i, c in enumerate(cells) if c[:3] == (split.tree, split.node, split.feature)]
        gains = {}
        for b in [cells[i][3] for i in rows][1:]:
            left, right = [i for i in rows if cells[i][3] < b], [i for i in rows if cells[i][3] >= b]
            if n[left].sum() >= 3 and n[right].sum() >= 3:
                gains[b] = sum(g[r].sum() ** 2 / (h[r].sum() + 0.5) for r in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + 0.5)
        assert split.bin == max(gains, key=lambda b: (gains[b], -b)) and split.gain == pytest.approx(gains[split.bin])
    assert len(found) == 12 and boosting.splits_of(pa.table({**{k: [] for k in columns}, "g": [], "h": [], "n": []}), boosting.Growth()) == []


# --- forest

def walk(tree, bins, sums):
    feature, bound, left, right = (np.array(tree[c]) for c in ("feature", "bin", "left", "right"))
    at = np.zeros(len(bins), int)
    while (feature[at] >= 0).any():
        low = bins[np.arange(len(bins)), np.maximum(feature[at], 0)] < bound[at]
        at = np.where(feature[at] < 0, at, np.where(low, left[at], right[at]))
    return np.array(tree["value"]).reshape(-1, sums)[at]


def test_subtrees_grow_until_their_leaves_are_pure():
    random = np.random.default_rng(8)
    bins = random.integers(0, 30, (3_000, 5))
    _, first = np.unique(bins, axis=0, return_index=True)
    bins = bins[first]
    y = random.integers(0, 3, len(bins)).astype(float)
    w = random.integers(1, 4, len(bins)).astype(float)
    tree = forest.grow_subtree(bins, y, w, 3, None, 2, np.random.default_rng(1))
    assert (walk(tree, bins, 3)[np.arange(len(bins)), y.astype(int)] == 1).all()
    figures = random.normal(size=len(bins))
    assert walk(forest.grow_subtree(bins, figures, w, 0, None, 5, np.random.default_rng(1)), bins, 1)[:, 0] == pytest.approx(figures)
    stump = forest.grow_subtree(bins, figures, w, 0, 1, 5, np.random.default_rng(1))
    scores = [(f, b, sum((np.average(figures[s], weights=w[s]) - figures[s]) ** 2 @ w[s] for s in (bins[:, f] < b, bins[:, f] >= b)))
              for f in range(5) for b in range(1, 30)]
    assert (stump["feature"][0], stump["bin"][0]) == min(scores, key=lambda s: s[2])[:2] and len(stump["feature"]) == 3


def test_rows_all_alike_stay_together():
    bins, y = np.zeros((6, 2), int), np.array([0, 0, 0, 0, 1, 1.0])
    tree = forest.grow_subtree(bins, y, np.ones(6), 2, None, 1, np.random.default_rng(1))
    assert tree["feature"] == [-1] and tree["value"] == pytest.approx([4 / 6, 2 / 6])
    none = forest.grow_subtree(np.zeros((3, 0), int), np.array([1.0, 2, 3]), np.ones(3), 0, None, 1, np.random.default_rng(1))
    assert none["value"] == [2.0]


@pytest.mark.parametrize("local", [20, 20_000])
def test_forest_without_limit_learns_every_row(spark, local):
    """Upper parts over 20 rows a task and none at all; a third of the rows are copies."""
    random = np.random.default_rng(9)
    x = np.vstack([random.normal(size=(400, 4)), np.tile([9.0, 9, 9, 9], (200, 1))])
    y = np.where(x[:, 0] == 9, 1, (np.sin(7 * x[:, 0]) + x[:, 1] > 0).astype(int))
    rows = table(spark, x, y)
    fitted = models.DeepForest(trees=12, localRows=local).fit(rows)
    scored = fitted.transform(rows)
    share = np.array(column(scored, vector_to_array("probability")).tolist())
    assert share.sum(axis=1) == pytest.approx(1) and (column(scored, "prediction") == y).mean() > 0.98
    assert scored.columns == [*rows.columns, "probability", "prediction"]
    sizes = fitted.forest.subtrees.agg(F.max(F.size("feature"))).first()[0]
    assert (sizes < 60) if local == 20 else (sizes > 60)
    if local == 20:
        copies = [n for nodes in fitted.forest.uppers for n in nodes if n.left is None and n.settled(forest.ForestGrowth(local_rows=20))]
        assert copies and max(len(nodes) for nodes in fitted.forest.uppers) > 20


def test_forest_of_figures_repeats_itself(spark):
    random = np.random.default_rng(10)
    x = random.normal(size=(300, 3))
    y = x[:, 0] * 5 + np.abs(x[:, 1])
    rows = table(spark, x, y)
    make = lambda: models.make_model("RandomForestRegressor", {"n_estimators": 11}).fit(rows)
    assert isinstance(make(), models.DeepForestModel)
    first, again = (column(make().transform(rows), "prediction") for _ in range(2))
    assert first == pytest.approx(again, abs=1e-12) and np.corrcoef(first, y)[0, 1] > 0.98
    shallow = forest.fit_forest(rows, "x", "label", 0, forest.ForestGrowth(trees=3, depth=2, subset="all", local_rows=30))
    found = forest.forest_scores(shallow, rows, "x", "id")
    assert found.select(F.get("scores", 0)).distinct().count() <= 4**3 and found.count() == 300
    assert type(models.make_model("RandomForestClassifier", {"max_depth": 5})).__name__ == "RandomForestClassifier"


# --- margins

def rings(random, n=600):
    radius = np.where(np.arange(n) % 2, 1.0, 3.0) + random.normal(size=n) * 0.15
    angle = random.random(n) * 2 * np.pi
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1), (np.arange(n) % 2).astype(float)


def test_random_features_approach_the_kernel(spark):
    x = np.random.default_rng(11).normal(size=(60, 5))
    mapped = margins.FourierMap(5, 0.3, 2_048)
    near = mapped.matrix(x) @ mapped.matrix(x).T
    gaps = ((x[:, None] - x) ** 2).sum(axis=2)
    assert np.abs(near - np.exp(-0.3 * gaps)).max() < 4 / 2_048**0.5 and np.diag(near) == pytest.approx(1)
    rows = table(spark, x, np.zeros(60))
    found = np.array(column(rows.select("id", mapped.column("features").alias("m")), vector_to_array("m")).tolist())
    assert found == pytest.approx(mapped.matrix(x))


def test_kernel_separates_two_rings(spark):
    x, y = rings(np.random.default_rng(12))
    rows = table(spark, x, y)
    kernel = models.make_model("SVC", {"C": 1.0}).fit(rows).transform(rows)
    assert (column(kernel, "prediction") == y).mean() > 0.98
    linear = models.KernelMargin(kernel="linear").fit(rows).transform(rows)
    assert (column(linear, "prediction") == y).mean() < 0.75
    share = np.array(column(kernel, vector_to_array("probability")).tolist())
    margin = np.array(column(kernel, vector_to_array("rawPrediction")).tolist())[:, 1]
    assert share.sum(axis=1) == pytest.approx(1) and (np.diff(share[margin.argsort(), 1]) >= 0).all()
    assert -np.log(share[np.arange(600), y.astype(int)]).mean() < 0.2


def test_platt_is_at_the_optimum():
    random = np.random.default_rng(13)
    margin = random.normal(size=4_000) * 2
    y = random.random(4_000) < 1 / (1 + np.exp(-(1.7 * margin - 0.6)))
    cells = [(m, int(t), int(not t)) for m, t in zip(margin, y)]
    a, b = margins.platt(cells)
    assert (a, b) == pytest.approx((-1.7, 0.6), abs=0.15)
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    off = target - 1 / (1 + np.exp(a * margin + b))
    assert abs(off.sum()) < 1e-6 and abs((off * margin).sum()) < 1e-6
    assert np.isfinite(margins.platt([(1.0, 50, 0), (-1.0, 0, 50)])).all() and margins.platt([]) == (-1.0, 0.0)


def test_margins_are_counted_in_cells(spark):
    random = np.random.default_rng(14)
    m = random.normal(size=5_000)
    y = (random.random(5_000) < 1 / (1 + np.exp(-2 * m))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"margin": m, "one": y}))
    cells = margins.margin_cells(df, "margin", "one")
    assert len(cells) <= margins.CELLS and sum(c[1] for c in cells) == y.sum() and sum(c[1] + c[2] for c in cells) == 5_000
    exact = margins.platt([(v, int(t), int(1 - t)) for v, t in zip(m, y)])
    assert margins.platt(cells) == pytest.approx(exact, abs=1e-3)
    assert margins.margin_cells(df.limit(0), "margin", "one") == []


# --- approximate neighbours, class shares of neighbours

def test_index_holds_every_row_and_finds_the_nearest(spark):
    random = np.random.default_rng(15)
    points = np.vstack([random.normal(size=(900, 12)) + 3 * random.integers(0, 4, (900, 1)), np.tile(np.ones(12), (300, 1))])
    train = spark.createDataFrame(pd.DataFrame({"id": range(1_200), "v": points.tolist()}), "id long, v array<double>")
    asked = pd.DataFrame({"id": range(5_000, 5_080), "v": (random.normal(size=(80, 12)) + 3 * random.integers(0, 4, (80, 1))).tolist()})
    queries = spark.createDataFrame(asked, "id long, v array<double>")
    index = inverted_cells.build_index(train, "id", "v", block_rows=64)
    assert index.table.count() == 1_200 and index.table.groupBy("_cell", "_block").count().agg(F.max("count")).first()[0] < 200
    exact = {}
    for i, v in zip(asked["id"], asked["v"]):
        gap = np.sqrt(((points - np.array(v)) ** 2).sum(axis=1))
        exact[i] = [(int(j), gap[j]) for j in np.lexsort((np.arange(1_200), gap))[:5]]
    for probes, least in ((8, 0.9), (len(index.centres), 0.99)):
        rows = inverted_cells.approximate_neighbors(index, queries, "id", "v", 5, probes=probes, refine=8).orderBy("id", "place").collect()
        assert len(rows) == 400
        hits = sum(r["neighbor"] in [j for j, _ in exact[r["id"]]] for r in rows)
        assert hits / 400 >= least
        for r in rows:
            assert r["distance"] == pytest.approx(np.linalg.norm(points[r["neighbor"]] - np.array(asked["v"][r["id"] - 5_000])))
    nothing = inverted_cells.build_index(train.limit(0), "id", "v")
    assert inverted_cells.approximate_neighbors(nothing, queries, "id", "v").count() == 0
    assert inverted_cells.approximate_neighbors(index, queries.limit(0), "id", "v").count() == 0


def test_neighbours_give_class_shares_under_two_keys(spark):
    random = np.random.default_rng(16)
    y = random.integers(0, 3, 150)
    x = random.normal(size=(150, 2)) + 4 * y[:, None]
    rows = table(spark, x, y).withColumn("other", F.col("id") % 7)
    fitted = models.make_model("KNeighborsClassifier", {"n_neighbors": 5}, ["id", "other"]).fit(rows.filter("id < 100"))
    scored = fitted.transform(rows.filter("id >= 100"))
    share = np.array(column(scored, vector_to_array("probability")).tolist())
    assert share.shape == (50, 3) and share.sum(axis=1) == pytest.approx(1) and set((share * 5).round(9).ravel()) <= set(range(6))
    assert (column(scored, "prediction") == y[100:]).mean() > 0.9
