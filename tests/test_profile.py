import pytest

from tablewright.operators import profile as P
from tablewright.plans.jobs import TableTask, profiles_for, stored_profiles
from tablewright.session import fresh_path

NAN = float("nan")


def rows(spark):
    return spark.createDataFrame(
        [(1.0, 1, "x", "p", True), (2.0, None, None, "p", False), (NAN, 3, "y", "q", True),
         (4.0, 4, "x", None, None)],
        "a double, b int, c string, target string, flag boolean")


def one(df):
    return df.first().asDict()


def test_nan_counts_as_missing_by_default(spark):
    found = one(P.profile(rows(spark), "target", "classification", "t"))
    # 3 rows with a target, 4 features, gaps: a (NaN), b, c
    assert found["n_rows"] == 3 and found["n_features"] == 4
    assert found["missing_ratio"] == round(3 / 12, 4)
    assert found["categorical_ratio"] == 0.25
    assert found["class_imbalance"] == 0.3333 and found["n_classes"] == 2
    assert found["feature_variance"] == round((0.5 + 2.0) / 2, 4)


def test_nan_can_count_as_a_value(spark):
    found = one(P.profile(rows(spark), "target", "classification", "t", nan_is_missing=False))
    assert found["missing_ratio"] == round(2 / 12, 4)
    assert found["feature_variance"] != found["feature_variance"]  # one NaN makes it NaN


def test_null_targets_can_stay(spark):
    found = one(P.profile(rows(spark), "target", "classification", "t", drop_null_targets=False))
    assert found["n_rows"] == 4 and found["n_classes"] == 3


def test_regression_has_no_class_figures(spark):
    found = one(P.profile(rows(spark), "a", "regression", "t"))
    assert found["class_imbalance"] is None and found["n_classes"] is None


def test_single_class_and_single_row(spark):
    df = spark.createDataFrame([(1.0, "p")], "a double, target string")
    found = one(P.profile(df, "target", "classification", "t"))
    assert found["class_imbalance"] == 1.0 and found["n_classes"] == 1
    assert found["feature_variance"] == 0.0  # no defined variance


def test_empty_table(spark):
    found = one(P.profile(rows(spark).filter("b > 100"), "target", "classification", "t"))
    assert found["n_rows"] == 0 and found["missing_ratio"] == 0.0
    assert found["class_imbalance"] is None and found["n_classes"] == 0


def test_nested_columns_and_unknown_targets_are_refused(spark):
    df = spark.createDataFrame([([1], "p")], "a array<int>, target string")
    with pytest.raises(TypeError):
        P.profile(df, "target", "classification", "t")
    with pytest.raises(ValueError):
        P.profile(rows(spark), "nothing", "classification", "t")


def test_more_columns_than_one_pass_holds(spark):
    wide = spark.range(10).selectExpr(
        "cast(id % 2 as string) AS target", *[f"cast(id * {i} as double) AS c{i}" for i in range(230)])
    found = one(P.profile(wide, "target", "classification", "wide"))
    base = 55 / 6  # sample variance of 0..9
    assert found["n_features"] == 230
    assert found["feature_variance"] == pytest.approx(sum(i * i * base for i in range(230)) / 230, abs=1e-3)
    assert P.null_counts(wide, wide.columns).count() == 231


def test_unchanged_by_order_partitioning_and_doubling(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    fields = ["missing_ratio", "categorical_ratio", "class_imbalance", "n_classes", "n_features"]
    base, moved, doubled = (
        one(P.profile(df, "o_orderstatus", "classification", "o"))
        for df in (orders, orders.repartition(7, "o_custkey"), orders.unionByName(orders)))
    assert all(base[f] == moved[f] == doubled[f] for f in fields)
    assert doubled["n_rows"] == 2 * base["n_rows"]
    assert moved["feature_variance"] == pytest.approx(base["feature_variance"], rel=1e-12)


def test_store_computes_only_what_is_missing(spark):
    path = fresh_path(spark, "profiles")
    df = spark.createDataFrame([(1.0, "p"), (2.0, "q")], "a double, target string")
    first = TableTask("first", df, "target", "classification", ("a",))
    second = TableTask("second", df, "target", "classification", ("a",))
    with pytest.raises(FileNotFoundError):
        profiles_for(spark, [first], path, require=True)
    profiles_for(spark, [first], path)
    before = stored_profiles(spark, path).first()["timestamp"]
    both = profiles_for(spark, [first, second], path)
    assert both.count() == 2
    assert both.filter("dataset_name = 'first'").first()["timestamp"] == before
