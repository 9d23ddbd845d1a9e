import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators.analysis import primary_metric
from tablewright.plans import jobs
from tablewright.plans.report import analysis_report, save_report
from tablewright.schemas import RESULT
from tablewright.session import fresh_path
from tablewright.sources import readers, synthetic, writers

LIGHT = {
    "RandomForestClassifier": {"n_estimators": 5, "max_depth": 3},
    "RandomForestRegressor": {"n_estimators": 5, "max_depth": 3},
    "GradientBoostingClassifier": {"n_estimators": 2},
    "GradientBoostingRegressor": {"n_estimators": 2},
}


def write_lines(spark, lines):
    path = fresh_path(spark, "lines")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def test_headerless_file_with_blank_lines(spark):
    path = write_lines(spark, ["1,0.5,g", "", "0,0.25,b", "1,0.75, g "])
    for fixed in (2, None):
        df = readers.read_headerless(spark, path, fixed)
        assert df.columns == ["f1", "f2", "label"]
        assert sorted(tuple(r) for r in df.collect()) == [(0, 0.25, 0), (1, 0.5, 1), (1, 0.75, 1)]


def test_csv_nan_and_na(spark):
    path = write_lines(spark, ["a,b", "1.5,1", "NaN,NA", ",3"])
    df = readers.read_table(spark, path)
    assert dict(df.dtypes) == {"a": "double", "b": "string"}


def test_absent_columns_get_the_default(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert readers.select_or_default(df, ["b", "z"]).first().asDict() == {"b": "x", "z": ""}


def test_log_skips_broken_lines(spark):
    path = write_lines(spark, [
        '{"run_id": "1", "dataset": "d", "profile": {"n_rows": 5}, "spec": {"model": "Ridge"}}',
        "", '{"run_id": "2", "data', "not json"])
    rows = readers.read_log(spark, path).collect()
    assert len(rows) == 1 and rows[0]["profile_n_rows"] == 5 and rows[0]["spec_model"] == "Ridge"


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_appended_rows_keep_the_layout(spark, fmt):
    path = fresh_path(spark, "results")
    for part in ([("a", 0.5)], [("b", None)]):
        writers.append_results(spark.createDataFrame(part, "run_id string, f1_macro double"), path, fmt=fmt)
    back = writers.read_results(spark, path, fmt=fmt)
    assert back.columns == RESULT.names
    assert sorted((r["run_id"], r["f1_macro"], r["rmse"]) for r in back.collect()) == [
        ("a", 0.5, None), ("b", None, None)]


def test_replaced_rows(spark):
    old = spark.createDataFrame([("d", "m", 1), ("d", "n", 2), ("e", "m", 3)], "dataset string, method string, v int")
    new = spark.createDataFrame([("d", "m", 9)], "dataset string, method string, v int")
    path = fresh_path(spark, "replaced")
    writers.replace_rows(old, new, ["dataset", "method"], path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2, 3, 9]


def test_generated_table_does_not_depend_on_partitions(spark):
    few, many = (synthetic.synthetic_table(spark, 3000, partitions=p) for p in (2, 9))
    assert few.exceptAll(many).count() == 0
    assert len(few.columns) == 21
    figures = few.agg(
        F.avg("num_0"), F.stddev("num_0"), F.count("num_3") / 3000, F.avg("target"), F.count_distinct("cat_2")).first()
    assert abs(figures[0]) < 0.06 and abs(figures[1] - 1) < 0.05
    assert abs(figures[2] - 0.97) < 0.015 and abs(figures[3] - 0.5) < 0.05 and figures[4] == 5
    coin = synthetic.synthetic_table(spark, 3000, n_categorical=5, missing=0.05, learnable=False)
    assert [c for c in coin.columns if c.startswith("cat_")] == [f"cat_{i}" for i in range(5)]


def task(spark, kind="classification", strategy=jobs.SINGLE_SPLIT):
    rng = np.random.default_rng(4)
    a = rng.normal(size=200)
    y = np.where(a + rng.normal(size=200) * 0.3 > 0, "yes", "no") if kind == "classification" else a * 3 + 1
    frame = pd.DataFrame({"id": range(200), "a": a, "c": rng.choice(["u", "v"], 200), "y": y})
    return jobs.TableTask(kind, spark.createDataFrame(frame), "y", kind, ("id",), strategy)


def test_a_run_codes_its_rows_once_and_lets_go_of_them(spark, monkeypatch):
    given = task(spark)
    rows, categories, n_labels = jobs.prepare(given)
    marked, _ = jobs.with_folds(rows, given)
    seen = []
    build = jobs.build_pipeline

    def building(*args):
        pipeline = build(*args)
        seen.extend(type(stage).__name__ for stage in pipeline.getStages())
        return pipeline

    monkeypatch.setattr(jobs, "build_pipeline", building)
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    spec = {"preprocessing": ["imputer"], "model": "LogisticRegression", "hyperparameters": {}}
    row = jobs.run_one(given, "m", spec, marked.filter("fold <> 0"), marked.filter("fold = 0"), categories, n_labels)
    assert categories == ["c"] and row["f1_macro"] > 0.8 and "error" not in row
    assert "CategoryEncoder" not in seen and spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_experiments_then_ablation_then_report(spark):
    results, profiles = fresh_path(spark, "results"), fresh_path(spark, "profiles")
    tasks = [task(spark), task(spark, "regression")]
    done = jobs.run_experiments(spark, tasks, results, profiles, overrides=LIGHT).collect()
    assert len(done) == 8 and all(r["n_pipeline_stages"] for r in done)
    by = {(r["dataset"], r["method"]): r for r in done}
    assert by["classification", "B1_manual"]["f1_macro"] > 0.8
    assert by["classification", "B1_manual"]["auc_roc"] > 0.9
    assert by["regression", "B1_manual"]["r2"] > 0.99 and by["regression", "B1_manual"]["f1_macro"] is None
    jobs.run_ablation(spark, tasks, results, profiles, LIGHT, fixed_preprocessing=True)
    rows = writers.read_results(spark, results).withColumn("task_type", F.col("dataset"))
    assert rows.count() == 12
    tables = analysis_report(primary_metric(rows), F.col("task_type") == "regression")
    paths = save_report(tables, fresh_path(spark, "report"))
    assert readers.read_table(spark, paths["main_results"]).count() == 2
    assert set(readers.read_table(spark, paths["ablation"]).columns) >= {"delta_A1", "delta_A2"}


def test_five_folds_give_five_rows(spark):
    folded = task(spark, strategy=jobs.CROSS_VALIDATION)
    done = jobs.run_experiments(
        spark, [folded], fresh_path(spark, "results"), fresh_path(spark, "profiles"), {"B1_manual": "manual"})
    assert sorted(r["fold"] for r in done.collect()) == [1, 2, 3, 4, 5]


def test_large_table_samples_boosting_only(spark):
    done = jobs.run_large_table(
        spark, task(spark), fresh_path(spark, "results"), fresh_path(spark, "profiles"),
        {"B1_manual": "manual", "boosted": "task_default"}, sample_rows=50, overrides=LIGHT)
    assert done.filter("accuracy is null").count() == 0 and done.count() == 2


def test_a_failed_run_leaves_a_row(spark):
    broken = task(spark)
    rows, categories, n = jobs.prepare(broken)
    spec = {"preprocessing": ["variance_threshold"], "model": "Ridge", "hyperparameters": {}}
    constant = rows.withColumn("a", F.lit(1.0)).drop("c")
    row = jobs.run_one(broken, "m", spec, constant, constant, [], n)
    assert row["method"] == "m" and "f1_macro" not in row and row["timestamp"] is not None
    assert row["error"]


def test_specs_and_replies_are_decisions_with_a_log(spark):
    results, profiles, log = (fresh_path(spark, n) for n in ("results", "profiles", "log"))
    made = task(spark)
    replies = spark.createDataFrame([
        ("classification", "agent_full", 'So: {"preprocessing": ["imputer"], "model": "LogisticRegression", "hyperparameters": {"C": 7}}'),
        ("classification", "agent_model_only", "I cannot say"), ("unknown table", "agent_full", "{}")],
        "dataset string, condition string, raw_response string")
    specs = spark.createDataFrame(
        [("classification", "mine", (["imputer", "nonsense"], "KNeighborsClassifier", {"n_neighbors": 99.0}, "")),
         ("classification", "broken", (["variance_threshold", "pca"], "LogisticRegression", {}, "x"))],
        "dataset string, method string, spec struct<preprocessing: array<string>, model: string, "
        "hyperparameters: map<string,double>, reasoning: string>")
    run = lambda **more: jobs.run_experiments(
        spark, [made], results, profiles, {"B1_manual": "manual"}, LIGHT, replies, specs, log, **more)
    done = {r["method"]: r for r in run(threads=3).collect()}
    assert set(done) == {"B1_manual", "agent_full", "agent_model_only", "mine", "broken"}
    assert all(done[m]["f1_macro"] > 0.6 for m in done if done[m]["n_pipeline_stages"])
    logged = {r["condition"]: r for r in readers.read_log(spark, log).collect()}
    assert {m: r["run_id"] for m, r in logged.items()} == {m: r["run_id"] for m, r in done.items()}
    assert logged["agent_full"]["spec_hyperparameters"] == {"C": 7.0} and "classification" in logged["agent_full"]["prompt"]
    assert logged["agent_model_only"]["spec_model"] == "GradientBoostingClassifier" and logged["B1_manual"]["prompt"] is None
    assert logged["mine"]["spec_preprocessing"] == ["imputer"] and logged["mine"]["spec_hyperparameters"]["n_neighbors"] == 15
    failed = {r["method"] for r in jobs.read_failures(spark, results).collect()}
    assert failed == {m for m in done if not done[m]["n_pipeline_stages"]}
    again = run(resume=True)
    assert again.count() == len(done) + len(failed)  # only failed runs are tried again


def test_runs_side_by_side_give_the_same_rows(spark):
    folded = task(spark, strategy=jobs.CROSS_VALIDATION)
    shown = []
    for threads in (1, 4):
        done = jobs.run_experiments(
            spark, [folded], fresh_path(spark, "results"), fresh_path(spark, "profiles"),
            {"B1_manual": "manual", "light": "rules_runner"}, threads=threads)
        shown.append(sorted((r["method"], r["fold"], round(r["f1_macro"], 6)) for r in done.collect()))
    assert shown[0] == shown[1] and len(shown[0]) == 10


def test_scaling_rows(spark):
    runs = jobs.profile_scaling(spark, [1000, 2000], lambda n: synthetic.synthetic_table(spark, n)).collect()
    assert [(r["dataset"], r["n_rows"]) for r in runs] == [("synthetic_1K", 1000), ("synthetic_2K", 2000)]
    assert all(r["size_mb"] > 0 and r["spark_profiling_time_s"] > 0 for r in runs)


def test_a_single_split_marks_its_rows_once(spark, tmp_path, monkeypatch):
    """Codes, training and test rows each read, spread and marked the table again."""
    table = spark.range(400).selectExpr("id", "cast(id % 9 as double) AS x", "concat('t', id % 3) AS t",
                                        "cast(id % 9 > 4 as string) AS told")
    task = jobs.TableTask("few", table, "told", "classification", ("id",))
    levels, mark = [], jobs.code_categories
    monkeypatch.setattr(jobs, "code_categories", lambda train, test, names: (
        levels.append("InMemoryTableScan" in train._jdf.queryExecution().executedPlan().toString()),
        mark(train, test, names))[1])
    methods = {"B3_heuristic": "rules_runner"}
    found = jobs.run_experiments(spark, [task], str(tmp_path / "r"), str(tmp_path / "p"), methods)
    assert levels == [True] and found.count() == 1 and found.filter("accuracy is null").count() == 0


def test_the_large_table_fits_the_rounds_of_its_specifications(spark, folder, monkeypatch):
    """The query overrode the 100 rounds of every booster's specification by 20."""
    import checks.jobs as registered

    fitted = {}
    monkeypatch.setattr(jobs, "run_one", lambda task, method, spec, *rest, **more: fitted.update({method: spec}) or {
        "run_id": "", "dataset": task.name, "method": method, "fold": None})
    registered.run_large_table(spark, folder)
    assert set(fitted) == set(jobs.METHODS)
    rounds = {m: s["hyperparameters"]["n_estimators"] for m, s in fitted.items() if s["model"] != "LogisticRegression"}
    assert len(rounds) == 3 and set(rounds.values()) == {100}, fitted
