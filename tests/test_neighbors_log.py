"""Nearest rows by products against all differences; the size of a decision log."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from checks import sources
from tablewright.operators import neighbors
from tablewright.sources import readers, writers

SMALLEST = "/root/testdata/sf0.001"


def test_products_find_what_all_differences_find():
    random = np.random.default_rng(1)
    for shift, scale in ((0.0, 1.0), (1e6, 1.0), (0.0, 1e-9)):
        others = random.integers(0, 4, (300, 6)) * scale + shift  # many ties and copies
        rows = np.vstack([others[:40], random.normal(size=(60, 6)) * scale + shift])
        gaps = neighbors._distances(rows, others)
        best = np.argsort(gaps, axis=1, kind="stable")[:, :7]
        found, apart = neighbors._nearest(rows, others, 7)
        assert (found == best).all() and (apart == np.take_along_axis(gaps, best, axis=1)).all()


def test_blocks_grow_with_the_rows(spark):
    """Copies of the training rows grew with the number of queries over the block size given."""
    random = np.random.default_rng(2)
    x = random.normal(size=(900, 4))
    frame = pd.DataFrame({"id": range(900), "v": x.tolist(), "label": range(900)})
    rows = spark.createDataFrame(frame, "id long, v array<double>, label long")
    train, asked = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    found = neighbors.nearest_neighbors(train, asked, "id", "v", "label", 3, pivots=4, block_rows=1)
    got = {(r["id"], r["place"]): r["neighbor"] for r in found.collect()}
    kept = np.flatnonzero(np.arange(900) % 3 > 0)
    for i in range(0, 900, 3):
        order = np.argsort(((x[kept] - x[i]) ** 2).sum(axis=1), kind="stable")[:3]
        assert [got[i, place] for place in (1, 2, 3)] == kept[order].tolist()


def test_logs_are_compressed(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = sources.log_rows(spark, SMALLEST)
    writers.write_log(rows, path)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    plain = rows.select(F.sum(F.length(F.to_json(F.struct("*")))).alias("n")).first()["n"]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert sum(os.path.getsize(f"{path}/{f}") for f in files) < plain / 4
    back = readers.read_log(spark, path)
    assert back.count() == rows.count() and back.filter("spec_model IS NULL").count() == 0
