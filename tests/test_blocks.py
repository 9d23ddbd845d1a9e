"""Packed rows: sums of blocks against the row by row forms, and forests that stop where nothing is left to tell."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import blocks, boosting, forest


def coded_rows(spark, bins, y):
    frame = pd.DataFrame({"_bins": bins.tolist(), "_y": y.astype(float), "_id": range(len(y))})
    return spark.createDataFrame(frame, "_bins array<int>, _y double, _id long")


@pytest.mark.parametrize("objective, trees", [(boosting.SQUARED, 1), (boosting.LOGISTIC, 1), (boosting.SOFTMAX, 3)])
def test_block_sums_equal_row_sums(spark, monkeypatch, objective, trees):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 64)
    random = np.random.default_rng(1)
    bins, y = random.integers(0, 9, (500, 3)), random.integers(0, max(trees, 2), 500)
    rows = coded_rows(spark, bins, y)
    start = [0.3 * (k + 1) for k in range(trees)]
    told = boosting.gradients(rows.withColumn("_s", F.array(*[F.lit(s) for s in start])), objective)
    by_row = blocks.summed(boosting.histograms(told, ["IF(_bins[1] < 4, 1, NULL)"] * trees), boosting.SUMS)
    root = boosting.Node((0.0, 0.0, 0), feature=1, bin=4, number=0)
    root.left, root.right = (boosting.Node((0.0, 0.0, 0), 1, number=n) for n in (1, 2))
    packed = blocks.pack(rows, 3, "u1").mapInArrow(lambda b: boosting._first_scores(start, b), boosting.SCORED)
    found = boosting.block_histograms(
        boosting.Blocks(packed, "u1", objective), [[root, root.left, root.right]] * trees, [{1}] * trees, 3, 0, 3)
    by = ["tree", "node", "feature", "bin"]
    was, now = (t.to_pandas().sort_values(by).reset_index(drop=True)[[*by, "g", "h", "n"]]
                for t in (by_row, blocks.summed(found, boosting.SUMS)))
    pd.testing.assert_frame_equal(was, now, check_dtype=False)
    assert len(now) == trees * (9 + 4 + 9) and now["n"].sum() == 3 * trees * (bins[:, 1] < 4).sum()


def test_figures_that_are_told_need_no_subtrees(spark):
    """Nodes whose labels are all equal were split on, down to the rows that a task takes."""
    x = np.random.default_rng(2).integers(0, 40, (1_500, 3))
    y = np.where(x[:, 1] > 25, 2000.0, np.where(x[:, 1] > 10, 1500.0, 1000.0))
    frame = pd.DataFrame({"id": range(len(y)), "x": x.astype(float).tolist(), "y": y})
    rows = spark.createDataFrame(frame, "id long, x array<double>, y double")
    grown = forest.fit_forest(rows, "x", "y", 0, forest.ForestGrowth(trees=4, subset="all", local_rows=30))
    assert [len(nodes) for nodes in grown.uppers] == [5] * 4 and grown.subtrees.count() == 0
    scored = forest.forest_scores(grown, rows, "x", "id").orderBy("id").collect()
    assert [r["scores"][0] for r in scored] == pytest.approx(y.tolist())


def test_few_rows_grow_all_trees_in_one_group(spark, monkeypatch):
    rows = spark.range(3000).selectExpr(
        "array(cast(id % 50 as double), cast(id % 7 as double)) AS x", "cast(id % 50 > 20 as double) AS y").persist()
    groups = []
    grow = forest._upper_parts
    monkeypatch.setattr(forest, "_upper_parts", lambda blocks, first, count, *more: (
        groups.append(count), grow(blocks, first, count, *more))[1])
    growth = forest.ForestGrowth(trees=24, local_rows=200)
    shown = lambda found: ([[(n.feature, n.bin, n.sums) for n in tree] for tree in found.uppers],
                           sorted(map(str, found.subtrees.collect())))
    together = shown(forest.fit_forest(rows, "x", "y", 2, growth))
    monkeypatch.setattr(forest, "ROWS_AT_ONCE", 0)
    assert shown(forest.fit_forest(rows, "x", "y", 2, growth)) == together
    assert groups == [24, 10, 10, 4]


def test_packed_values_get_the_bins_that_the_table_form_gives(spark):
    """Packing made no bins itself: they had to be worked out row by row before."""
    edges = [[0.5, 2.0, 7.0], [], [-1.0]]
    given = [[0.5, 1.0, -1.0], [0.4, None, -1.1], [float("nan"), 3.0, float("inf")], [9.0, 0.0, float("-inf")],
             [None, None, None], [2.0, 1.0, 0.0], None, [7.0]]
    rows = spark.createDataFrame([(i, x, float(i)) for i, x in enumerate(given)], "_id long, _x array<double>, _y double")
    was = [r["_bins"] for r in boosting.binned(rows.coalesce(1), "_x", edges).orderBy("_id").collect()]
    found = blocks.pack(rows.coalesce(1), 3, "u1", edges).toArrow().to_batches()
    bins = np.concatenate([bins for batch in found for _, _, bins, _ in blocks.unpack(batch, 3, "u1")], axis=1)
    assert bins.T.tolist() == was and was[0] == [1, 0, 1] and was[2] == [3, 0, 1]


@pytest.mark.parametrize("few", [64, 0])
def test_rows_end_where_walking_each_ends(monkeypatch, few):
    """Few splits deal the rows split by split; the walk of every row stays for many."""
    monkeypatch.setattr(blocks, "FEW_SPLITS", few)
    random = np.random.default_rng(3)
    bins = random.integers(0, 256, (3, 400)).astype("u1")
    tree = tuple(np.array(a) for a in ([1, 0, -1, 2, -1, -1, -1], [100, 256, 0, 7, 0, 0, 0], [1, 3, 2, 5, 4, 5, 6],
                                       [2, 4, 2, 6, 4, 5, 6]))
    for rows in (None, random.choice(400, 90)):
        at = []
        for row in range(400) if rows is None else rows:
            node = 0
            while tree[0][node] >= 0:
                node = (tree[2] if bins[tree[0][node], row] < tree[1][node] else tree[3])[node]
            at.append(node)
        assert blocks.end_nodes(bins, *tree, rows).tolist() == at and set(at) == {2, 5, 6}


def test_files_of_blocks_are_short(spark, monkeypatch):
    """A file had all blocks of a partition, which its reader held at once: a heap of 1,500 MB did not last for
    six times sf0.1."""
    from pyarrow import parquet

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 20)
    monkeypatch.setattr(boosting, "CHECKPOINT_ROUNDS", 1)
    made, write = [], blocks.materialize
    for module in (blocks, boosting):
        monkeypatch.setattr(module, "materialize", lambda *given: made.append(write(*given)) or made[-1])
    rows = spark.range(0, 4000, 1, 2).selectExpr("array(cast(id % 50 as double)) AS x", "cast(id % 50 > 20 as double) AS y")
    boosting.fit_boosting(rows, "x", "y", boosting.LOGISTIC, 2, boosting.Growth(rounds=2))
    files = [parquet.ParquetFile(path.removeprefix("file:")).metadata.num_rows for table in made for path in table.inputFiles()]
    assert len(made) == 3 and sum(files) == 3 * 4000 // 20
    assert max(files) <= 8


def test_many_open_nodes_are_counted_in_several_passes(spark, monkeypatch):
    """The histograms of all open nodes of a level were held by each task at once."""
    random = np.random.default_rng(4)
    x = random.integers(0, 40, (3_000, 3))
    frame = pd.DataFrame({"x": x.astype(float).tolist(), "y": random.integers(0, 2, len(x)).astype(float)})
    rows = spark.createDataFrame(frame, "x array<double>, y double").persist()
    passes, level = [], forest._level
    monkeypatch.setattr(forest, "_level", lambda data, first, uppers, taken, *more: (
        passes.append(sum(map(len, taken.values()))), level(data, first, uppers, taken, *more))[1])
    shown = lambda found: [[(n.feature, n.bin, n.sums, n.value) for n in tree] for tree in found.uppers]
    for classes in (2, 0):
        growth = forest.ForestGrowth(trees=3, local_rows=300)
        monkeypatch.setattr(forest, "HISTOGRAM_CELLS", 1 << 24)
        whole = shown(forest.fit_forest(rows, "x", "y", classes, growth))
        monkeypatch.setattr(forest, "HISTOGRAM_CELLS", 5 * 256 * 4)
        passes.clear()
        assert shown(forest.fit_forest(rows, "x", "y", classes, growth)) == whole
        assert len(passes) > 5 and max(passes) <= 6
