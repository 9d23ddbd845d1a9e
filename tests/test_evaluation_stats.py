import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import analysis as A
from tablewright.operators import metrics as M
from tablewright.operators import stats as S


def labelled(spark):
    return spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (2, 1), (2, 3)], "label int, prediction int")


def test_macro_scores_count_every_class_seen(spark):
    row = M.macro_scores(labelled(spark), "label", "prediction").first()
    # class 0: p 1, r 2/3, f 0.8; class 1: p 1/3, r 1, f 0.5; class 2 and 3: 0
    assert row["f1_macro"] == round((0.8 + 0.5) / 4, 4)
    assert row["precision"] == round((1 + 1 / 3) / 4, 4)
    assert row["recall"] == round((2 / 3 + 1) / 4, 4)
    assert row["accuracy"] == 0.5
    assert M.accuracy(labelled(spark), "label", "prediction").first()[0] == 0.5


def pair_count_auc(positive, score):
    pairs = [(a, b) for a, p in zip(score, positive) if p for b, q in zip(score, positive) if not q]
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)


@pytest.mark.parametrize("ranges", [1, 6])
def test_auc_equals_pair_counting(spark, ranges):
    rng = np.random.default_rng(2)
    score, y = rng.integers(0, 20, 150) / 2.0, rng.integers(0, 2, 150)
    df = spark.createDataFrame([(float(s), int(v)) for s, v in zip(score, y)], "s double, y int")
    found = M.auc_binary(df, "y", "s", ranges=ranges).first()["auc_roc"]
    assert found == round(pair_count_auc(y == 1, score), 4)


def test_auc_is_null_without_both_classes(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert M.auc_binary(df, "y", "s").first()["auc_roc"] is None
    three = spark.createDataFrame([(0, [0.5, 0.2, 0.3]), (1, [0.1, 0.6, 0.3])], "y int, s array<double>")
    assert M.auc_ovr_macro(three, "y", "s").first()["auc_roc"] is None


def test_regression_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    row = M.regression_scores(df, "y", "p").first()
    assert row["rmse"] == round(math.sqrt(2 / 3), 4) and row["mae"] == 0.6667
    assert row["r2"] == round(1 - 2 / (14 / 3), 4)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert M.regression_scores(flat, "y", "p").first()["r2"] == 1.0


def test_metrics_row_nulls_the_other_task(spark):
    row = M.metrics_row(labelled(spark), "classification", "label", "prediction").first()
    assert row["rmse"] is None and row["auc_roc"] is None and row["accuracy"] == 0.5
    row = M.metrics_row(labelled(spark), "regression", "label", "prediction").first()
    assert row["f1_macro"] is None and row["mae"] is not None


# Recorded mean primary metric per dataset and method, with the recorded distances.
MEANS = [
    ("adult_income", 0.7173, 0.7943, 0.7942, 0.7930, -0.0013),
    ("breast_cancer", 0.9714, 0.9529, 0.9714, 0.9469, -0.0245),
    ("covtype", 0.5303, 0.9241, 0.6672, None, None),
    ("diabetes", 0.7374, 0.7372, 0.7374, 0.7271, -0.0103),
    ("heart_disease", 0.8183, 0.8056, 0.8183, 0.7918, -0.0265),
    ("ionosphere", 0.8692, 0.9280, 0.8692, 0.9330, 0.0050),
    ("titanic", 0.7768, 0.8034, 0.7768, 0.8323, 0.0289),
    ("wine_quality", 0.6245, 0.5489, 0.6245, 0.6019, -0.0226),
]


def test_recorded_distances_to_the_best_baseline(spark):
    methods = ["B1_manual", "B2_default", "B3_heuristic", "agent_full"]
    rows = [
        (name, method, value if name != "wine_quality" else None, value if name == "wine_quality" else None)
        for name, *values, _ in MEANS for method, value in zip(methods, values) if value is not None]
    results = spark.createDataFrame(rows, "dataset string, method string, f1_macro double, rmse double")
    scored = A.primary_metric(results, legacy_rmse=["wine_quality"])
    table = A.best_baseline_delta(A.method_pivot(scored, methods))
    found = {r["dataset"]: r["delta_vs_best"] for r in table.collect()}
    assert found == {name: delta for name, *_, delta in MEANS}
    aware = A.best_baseline_delta(A.method_pivot(scored, methods), F.col("dataset") == "wine_quality")
    wine = aware.filter("dataset = 'wine_quality'").first()
    assert wine["best_baseline"] == 0.5489 and wine["delta_vs_best"] == 0.053


def brute_p(differences):
    """Two-sided p over all sign choices, for distinct absolute values."""
    ranks = pd.Series(differences).abs().rank().to_numpy()
    up = ranks[np.array(differences) > 0].sum()
    w = min(up, ranks.sum() - up)
    signs = [sum(r for r, s in zip(ranks, choice) if s) for choice in itertools.product([0, 1], repeat=len(ranks))]
    return w, min(1.0, 2 * sum(s <= w for s in signs) / len(signs))


def test_exact_signed_rank(spark):
    values = [0.9, -0.2, 0.5, 0.3, -0.1, 0.7, 0.0, 1.1, 0.4]
    df = spark.createDataFrame([("b", v) for v in values], "baseline string, difference double")
    row = S.wilcoxon_signed_rank(df).first()
    w, p = brute_p([v for v in values if v])
    assert row["n"] == 8 and row["w"] == w and row["p_value"] == pytest.approx(p, abs=1e-12)


def test_method_of_the_signed_rank_test(spark):
    values = [0.01 * i * (-1 if i % 3 == 0 else 1) for i in range(1, 61)]
    df = spark.createDataFrame([("b", v) for v in values], "baseline string, difference double")
    found = {m: S.wilcoxon_signed_rank(df, method=m).first() for m in ("auto", "exact", "approx")}
    ways = np.array([1.0])
    for rank in range(1, 61):
        ways = np.convolve(ways, np.eye(1, rank + 1, rank)[0] + np.eye(1, rank + 1, 0)[0])
    exact = min(1.0, 2 * ways[: int(found["exact"]["w"]) + 1].sum() / 2.0**60)
    assert found["exact"]["p_value"] == pytest.approx(exact, rel=1e-9)
    assert found["auto"]["p_value"] == found["approx"]["p_value"] == pytest.approx(exact, rel=0.05)
    few = spark.createDataFrame([("b", v) for v in values[:9]], "baseline string, difference double")
    assert S.wilcoxon_signed_rank(few).first()["p_value"] == S.wilcoxon_signed_rank(few, method="exact").first()["p_value"]
    tied = spark.createDataFrame([("b", 0.1), ("b", 0.1), ("b", -0.2)], "baseline string, difference double")
    rows = [S.wilcoxon_signed_rank(tied, method=m).first() for m in ("exact", "approx")]
    assert rows[0]["p_value"] == rows[1]["p_value"]
    with pytest.raises(ValueError):
        S.wilcoxon_signed_rank(df, method="other")


def test_signed_rank_with_ties_is_normal(spark):
    values = [0.1, 0.1, -0.1, 0.2, 0.3, 0.3, -0.4, 0.5]
    df = spark.createDataFrame([("b", v) for v in values], "baseline string, difference double")
    row = S.wilcoxon_signed_rank(df, ranges=3).first()
    ranks = pd.Series(values).abs().rank()
    n, ties = 8, (3**3 - 3) + (2**3 - 2)
    w = min(ranks[[v > 0 for v in values]].sum(), ranks[[v < 0 for v in values]].sum())
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert row["w"] == w and row["z"] == pytest.approx(z)
    assert row["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_recorded_z_and_p(spark):
    """The recorded comparisons: n, W and z give the recorded normal p."""
    for z, p in ((-0.4869, 0.6264), (-0.1868, 0.8519), (-0.1376, 0.8906)):
        row = spark.createDataFrame([(518.0, z, 47.0, 6.0)], "w double, z double, n double, t double")
        assert row.select(S._p_value("w", "z", "n", "t")).first()[0] == pytest.approx(p, abs=1e-4)


def runs(spark):
    rows = []
    for fold, run, agent, base in [(1, 1, 0.9, 0.8), (1, 2, 0.7, 0.7), (2, 1, 0.6, 0.9), (None, 1, 0.5, 0.4)]:
        stamp = f"2026-01-0{run} 00:00:00"
        rows += [("d", "agent_full", fold, agent, stamp, f"a{fold}{run}"),
                 ("d", "B1_manual", fold, base, stamp, f"b{fold}{run}")]
    rows.append(("d", "B1_manual", 2, 0.1, "2026-02-01 00:00:00", "surplus"))
    rows.append(("d", "agent_full", 3, None, "2026-02-01 00:00:00", "unscored"))
    df = spark.createDataFrame(rows, "dataset string, method string, fold int, f1_macro double, t string, run_id string")
    return df.withColumn("timestamp", F.to_timestamp("t")).drop("t")


def test_pairs_follow_the_run_number(spark):
    pairs = S.pair_scores(runs(spark), ["B1_manual"]).collect()
    found = sorted((str(r["fold"]), r["run"], r["agent_score"], r["baseline_score"]) for r in pairs)
    assert found == [("1", 1, 0.9, 0.8), ("1", 2, 0.7, 0.7), ("2", 1, 0.6, 0.9), ("None", 1, 0.5, 0.4)]
    differences = S.paired_differences(S.pair_scores(runs(spark), ["B1_manual"]))
    d = np.array([0.1, 0.0, -0.3, 0.1])
    row = S.cohens_d(differences).first()
    assert row["n_pairs"] == 4 and row["cohens_d"] == round(d.mean() / (d.std() + 1e-10), 3)
    assert S.comparison_table(differences).first()["significance"] == "ns"


def test_significance_labels(spark):
    df = spark.createDataFrame([(0.0005,), (0.005,), (0.02,), (0.05,)], "p double")
    found = [r[0] for r in df.select(S.significance_label(F.col("p"))).collect()]
    assert found == ["*** p<0.001", "** p<0.01", "* p<0.05", "ns"]
