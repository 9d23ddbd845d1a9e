"""Linear margins fitted in shared passes."""

import numpy as np
import pandas as pd
import pytest

from tablewright.operators import margins


def test_sums_equal_loops_and_slopes():
    random = np.random.default_rng(1)
    x, weights = random.normal(size=(40, 3)), random.normal(size=(2, 4))
    sides, used = random.choice([-1.0, 1.0], (40, 2)), random.integers(0, 2, (40, 2)).astype(float)
    found = margins.hinge_sums(weights, x, sides, used)
    for j in range(2):
        loss = lambda w: sum(u * max(0, 1 - s * (row @ w[:-1] + w[-1])) for row, s, u in zip(x, sides[:, j], used[:, j]))
        slope = [(loss(weights[j] + 1e-7 * e) - loss(weights[j] - 1e-7 * e)) / 2e-7 for e in np.eye(4)]
        assert found[j] == pytest.approx([loss(weights[j]), *slope], abs=1e-5)


def test_least_of_a_bowl_is_found():
    search, centre, scale = margins.minimised(np.zeros(5), 60, close=1e-12), np.arange(5.0), 4.0 ** np.arange(5)
    point = next(search)
    with pytest.raises(StopIteration) as done:
        while True:
            point = search.send(((scale * (point - centre) ** 2).sum(), 2 * scale * (point - centre)))
    assert done.value.value == pytest.approx(centre, abs=1e-4)


def test_learners_leave_their_fold_out(spark):
    random = np.random.default_rng(2)
    x = random.normal(size=(400, 2))
    side = (x[:, 0] + x[:, 1] > 0).astype(int)
    fold = np.arange(400) % 2
    side_seen = np.where(fold == 1, 1 - side, side)  # fold 1 says the contrary
    frame = pd.DataFrame({"_x": x.tolist(), "_class": side_seen, "_fold": fold})
    rows = spark.createDataFrame(frame, "_x array<double>, _class long, _fold int").repartition(3)
    found = margins.fit_margins(rows, None, 2, [(1, 1), (1, 0)], [200, 200], 10.0, 50)
    for weights, sign in zip(found, (1, -1)):
        said = sign * (x @ weights[:-1] + weights[-1]) > 0
        assert (said == (side == 1)).mean() > 0.98


def test_sums_of_mapped_rows_equal_those_of_the_whole_map():
    random = np.random.default_rng(3)
    x, weights = random.normal(size=(1_500, 4)), random.normal(size=(3, 65))
    sides, used = random.choice([-1.0, 1.0], (1_500, 3)), random.integers(0, 2, (1_500, 3)).astype(float)
    map_, found = margins.FourierMap(4, 0.3, 64), np.zeros((3, 66))
    margins.MappedSums(map_, weights).add(found, x, sides, used)
    assert found == pytest.approx(margins.hinge_sums(weights, map_.matrix(x), sides, used), abs=1e-2, rel=1e-4)


def test_passes_read_packed_rows(spark, monkeypatch):
    """Every pass read the rows as lists of figures, which cost it more than the sums."""
    random = np.random.default_rng(4)
    x = random.normal(size=(900, 3))
    frame = pd.DataFrame({"_x": x.tolist(), "_class": (np.abs(x[:, 0]) > 0.7).astype(int), "_fold": np.arange(900) % 2})
    rows = spark.createDataFrame(frame, "_x array<double>, _class long, _fold int").repartition(3)
    packed = []
    pack = margins.packed_rows
    monkeypatch.setattr(margins, "packed_rows", lambda *given: packed.append(pack(*given)) or packed[-1])
    map_ = margins.FourierMap(3, 0.5, 256)
    found = margins.fit_margins(rows, map_, 3, [(1, -1)], [900], 10.0, 60)
    said = map_.matrix(x) @ found[0][:-1] + found[0][-1] > 0
    assert (said == (np.abs(x[:, 0]) > 0.7)).mean() > 0.95
    assert len(packed) == 1 and packed[0].agg({"n": "sum"}).first()[0] == 900 and packed[0].count() <= 4
