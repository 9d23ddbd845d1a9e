import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import neighbors, prep
from tablewright.plans import models
from tablewright.plans.pipelines import build_fixed, build_pipeline, resolved_steps, stage_count
from tablewright.session import fresh_path


def numbers(spark):
    return spark.createDataFrame(
        [(0, 1.0, 5.0, None), (1, 2.0, 5.0, 4.0), (2, None, 5.0, 4.0), (3, 4.0, 5.0, 2.0), (4, 3.0, 5.0, 2.0)],
        "id int, a double, b double, c double")


def test_median_interpolates_and_drops_empty_columns(spark):
    df = numbers(spark).withColumn("empty", F.lit(None).cast("double"))
    out = prep.MedianImputer(excludeCols=["id"]).fit(df).transform(df).orderBy("id").toPandas()
    assert list(out.columns) == ["id", "a", "b", "c"]
    assert out["a"].tolist() == [1.0, 2.0, 2.5, 4.0, 3.0] and out["c"][0] == 3.0


def test_mode_takes_the_smallest_on_ties(spark):
    df = numbers(spark)
    out = prep.ModeImputer(inputCols=["c"]).fit(df).transform(df).orderBy("id").toPandas()
    assert out["c"][0] == 2.0


def test_population_scaling_and_constant_columns(spark):
    df = numbers(spark).na.fill(0.0)
    out = prep.PopulationScaler(inputCols=["a", "b"]).fit(df).transform(df).toPandas()
    assert out["a"].std(ddof=0) == pytest.approx(1.0) and (out["b"] == 0.0).all()
    ranged = prep.RangeScaler(inputCols=["a", "b"]).fit(df).transform(df).toPandas()
    assert ranged["a"].min() == 0.0 and ranged["a"].max() == 1.0 and (ranged["b"] == 0.0).all()


def test_variance_filter_refuses_to_drop_everything(spark):
    df = numbers(spark)
    kept = prep.VarianceFilter(inputCols=["a", "b"]).fit(df).transform(df)
    assert kept.columns == ["id", "a", "c"]
    with pytest.raises(ValueError):
        prep.VarianceFilter(inputCols=["b"]).fit(df)


def test_codes_of_unseen_and_missing_categories(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "x string")
    model = prep.CategoryEncoder().fit(train)
    test = spark.createDataFrame([("a",), ("b",), (None,), ("zzz",)], "x string")
    assert [r["x"] for r in model.transform(test).collect()] == [0.0, 1.0, 2.0, -1.0]


def test_codes_of_a_hot_category_among_very_many(spark):
    """A third of the rows share a value, the others hold one each; no code table is broadcast by size."""
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("x"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = prep.CategoryEncoder(inputCols=["x"]).fit(rows)
        coded = model.transform(rows).toPandas().set_index("id")["x"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [r["value"] for r in model.codes.filter("frequent").collect()] == ["hot"]
    texts = {i: "hot" if i % 3 == 0 else str(i) for i in range(6000)}
    place = {text: k for k, text in enumerate(sorted(set(texts.values())))}
    assert coded.to_dict() == {i: float(place[text]) for i, text in texts.items()}


def test_one_hot_gives_unseen_codes_no_slot(spark):
    train = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double")
    model = prep.OneHotStep(inputCols=["x"]).fit(train)
    test = spark.createDataFrame([(1.0,), (-1.0,)], "x double")
    found = model.transform(test).select(vector_to_array("x_onehot").alias("v")).collect()
    assert [r["v"] for r in found] == [[0.0, 1.0, 0.0], [0.0, 0.0, 0.0]]


def test_components_explain_the_wanted_share(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 2)) * [5.0, 2.0]
    noise = rng.normal(size=(400, 3)) * 0.05
    frame = pd.DataFrame(np.hstack([base, base.sum(axis=1, keepdims=True), noise]) + 10, columns=list("abcdef"))
    model = prep.PcaStep().fit(spark.createDataFrame(frame))
    values = np.linalg.eigvalsh(np.cov(frame.T))[::-1]
    shares = values / values.sum()
    assert model.k == int((shares.cumsum() <= 0.95).sum()) + 1
    assert model.explained == pytest.approx(shares.tolist(), abs=1e-9)
    out = model.transform(spark.createDataFrame(frame)).toPandas()
    assert out.mean().abs().max() < 1e-9
    assert out["pc_1"].var() == pytest.approx(values[0])


def test_fitted_steps_can_be_saved(spark):
    df = numbers(spark)
    model = prep.MedianImputer(inputCols=["a"]).fit(df)
    path = fresh_path(spark, "model")
    model.save(path)
    assert prep.FillModel.load(path).transform(df).filter("a is null").count() == 0


def test_ridge_agrees_with_the_closed_solution(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [1.0, 4.0, 0.2]
    y = x @ [2.0, -1.0, 3.0] + 7 + rng.normal(size=300)
    frame = pd.DataFrame(x, columns=list("abc")).assign(label=y)
    rows = prep.Assemble(excludeCols=["label"]).transform(spark.createDataFrame(frame))
    fitted = models.Ridge(strength=10.0).fit(rows)
    centred = x - x.mean(axis=0)
    expected = np.linalg.solve(centred.T @ centred + 10.0 * np.eye(3), centred.T @ (y - y.mean()))
    assert fitted.coefficients.toArray() == pytest.approx(expected, abs=1e-8)


def test_logistic_penalty_is_stated_against_the_summed_loss(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0).astype(float)
    frame = pd.DataFrame(x, columns=list("ab")).assign(label=y)
    rows = prep.Assemble(excludeCols=["label"]).transform(spark.createDataFrame(frame))
    fitted = models.PenalisedLogistic(strength=0.5).fit(rows)
    weights, bias = fitted.coefficients.toArray(), fitted.intercept
    residual = 1 / (1 + np.exp(-(x @ weights + bias))) - y
    # At the optimum the gradient of |w|^2 / 2 + C * loss is zero.
    assert np.abs(weights + 0.5 * x.T @ residual).max() < 1e-2
    assert abs(residual.sum()) < 1e-2


def brute_force(train, queries, k):
    found = {}
    for _, q in queries.iterrows():
        gap = np.sqrt(((np.array(train["v"].tolist()) - np.array(q["v"])) ** 2).sum(axis=1))
        order = np.lexsort((train["id"].to_numpy(), gap))[:k]
        found[q["id"]] = train["id"].to_numpy()[order].tolist()
    return found


@pytest.mark.parametrize("block", [16, 4096])
def test_neighbours_equal_brute_force_with_a_hot_cell(spark, block):
    """A third of the training rows are copies of one vector."""
    rng = np.random.default_rng(11)
    points = np.vstack([rng.normal(size=(200, 4)) + 6 * rng.integers(0, 3, (200, 1)), np.tile([1.0, 1, 1, 1], (100, 1))])
    train = pd.DataFrame({"id": range(300), "v": points.tolist(), "y": rng.integers(0, 3, 300)})
    asked = pd.DataFrame({"id": range(1000, 1060), "v": (rng.normal(size=(60, 4)) * 4).tolist(), "y": 0})
    schema = "id bigint, v array<double>, y int"
    found = neighbors.nearest_neighbors(
        spark.createDataFrame(train, schema), spark.createDataFrame(asked, schema), "id", "v", "y", 5,
        pivots=8, block_rows=block).orderBy("id", "place").toPandas()
    assert found.groupby("id")["neighbor"].apply(list).to_dict() == brute_force(train, asked, 5)


def test_fewer_rows_than_neighbours(spark):
    schema = "id bigint, v array<double>, y int"
    train = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 0)], schema)
    asked = spark.createDataFrame([(9, [0.2], 0)], schema)
    assert neighbors.nearest_neighbors(train, asked, "id", "v", "y", 5).count() == 2
    assert neighbors.knn_classify(train, asked, "id", "v", "y", 5).first()["prediction"] == 0


def flowers(spark):
    rng = np.random.default_rng(21)
    y = rng.integers(0, 3, 240)
    frame = pd.DataFrame({
        "id": range(240), "label": y.astype(float), "a": y * 2 + rng.normal(size=240) * 0.4,
        "b": rng.normal(size=240), "kind": np.where(y == 1, "u", "v")})
    frame.loc[frame["id"] % 17 == 0, "b"] = np.nan
    return spark.createDataFrame(frame)


@pytest.mark.parametrize("name,parameters", [
    ("LogisticRegression", {"C": 1.0}), ("RandomForestClassifier", {"n_estimators": 10, "max_depth": 4}),
    ("GradientBoostingClassifier", {"n_estimators": 3}), ("SVC", {"C": 1.0}),
    ("KNeighborsClassifier", {"n_neighbors": 3}), ("NoSuchModel", {})])
def test_three_class_pipelines_beat_the_majority(spark, name, parameters):
    spec = {"preprocessing": ["standard_scaler"], "model": name, "hyperparameters": parameters}
    rows = flowers(spark)
    train, test = rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0")
    fitted = build_pipeline(spec, ["id"], ["kind"], "id").fit(train)
    assert isinstance(fitted, PipelineModel)
    scored = fitted.transform(test)
    assert scored.filter("label = prediction").count() / test.count() > 0.75


def test_every_step_together(spark):
    spec = {"preprocessing": ["one_hot_encoder", "min_max_scaler", "variance_threshold", "pca", "label_encoder"],
            "model": "LogisticRegression", "hyperparameters": {"num_leaves": 3}}
    assert resolved_steps(spec) == ["imputer", "one_hot_encoder", "min_max_scaler", "variance_threshold", "pca"]
    assert stage_count(spec) == 6 and stage_count(spec, True) == 3
    rows = flowers(spark)
    scored = build_pipeline(spec, ["id"], ["kind"]).fit(rows).transform(rows)
    assert scored.filter("prediction is null").count() == 0
    fixed = build_fixed(spec, ["id"], ["kind"]).fit(rows).transform(rows)
    assert fixed.filter("label = prediction").count() > 180


def test_unused_parameters_are_ignored():
    forest = models.make_model("RandomForestRegressor", {"learning_rate": 0.1, "n_estimators": 7})
    assert forest.getNumTrees() == 7 and forest.getFeatureSubsetStrategy() == "all"
    boosted = models.make_model("SVR", {"C": 3.0})
    assert type(boosted).__name__ == "GBTRegressor"


def test_vector_columns_pass_through_assembly(spark):
    df = spark.createDataFrame([(1.0, [2.0, 3.0])], "a double, v array<double>")
    out = prep.Assemble().transform(df.select("a", array_to_vector("v").alias("v")))
    assert out.select(vector_to_array("features").alias("f")).first()["f"] == [1.0, 2.0, 3.0]
