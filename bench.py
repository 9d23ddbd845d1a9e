"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import checks  # noqa: E402
from checks.models import line_task  # noqa: E402
from tablewright.operators.profile import profile  # noqa: E402
from tablewright.plans import jobs  # noqa: E402
from tablewright.session import build_session, fresh_path  # noqa: E402
from tablewright.sources.synthetic import synthetic_table  # noqa: E402

HEADLINE = [
    "profile", "profile_many", "profile_by_group", "describe_columns", "class_counts",
    "stratified_split", "stratified_kfold", "random_split", "sample_n", "distributed_rank",
    "impute_median", "impute_mode", "standard_scaler", "ordinal_encode", "one_hot", "pca",
    "f1_macro", "auc_binary_distinct", "auc_ovr_macro", "metrics_row", "evaluate_by_group",
    "method_summary", "method_pivot", "pair_scores", "comparison_table",
    "clamp_hyperparameters", "choose_rules_full", "render_prompt", "parse_spec", "validate_spec",
    "knn_classifier",
]
SYNTHETIC_ROWS = 1_000_000  # the largest generated table with a recorded baseline


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def model_times(spark, folder: str) -> dict[str, float]:
    """Fit seconds on the line items: the models with a recorded baseline."""
    task = line_task(spark, folder)
    rows, categories, n_labels = jobs.prepare(task)
    marked, _ = jobs.with_folds(rows, task)
    marked = marked.persist()
    train, test = jobs.code_categories(
        marked.filter("fold <> 0"), marked.filter("fold = 0"), categories)
    train, test = train.persist(), test.persist()
    train.count(), test.count()
    steps = ["imputer", "standard_scaler"]
    specs = {
        "fit_logistic": ("LogisticRegression", {"C": 1.0, "max_iter": 1000}, train),
        "fit_forest_100_trees_depth_6": ("RandomForestClassifier", {"n_estimators": 100, "max_depth": 6}, train),
        "fit_boosting_100_rounds": ("GradientBoostingClassifier", {"n_estimators": 100}, train),
    }
    times = {}
    for name, (model, parameters, fit_rows) in specs.items():
        spec = {"preprocessing": steps, "model": model, "hyperparameters": parameters}
        row = jobs.run_one(task, name, spec, fit_rows, test, categories, n_labels, coded=True)
        times[name] = row["train_time_s"]
    marked.unpersist()
    return times


def csv_profile_time(spark) -> float:
    """Profile of a generated 1M-row CSV with 20 features, schema given, action only."""
    table = synthetic_table(spark, SYNTHETIC_ROWS)
    path = fresh_path(spark, "bench-csv")
    table.write.csv(path, header=True)
    stored = spark.read.csv(path, header=True, schema=table.schema)
    return timed(lambda: profile(stored, "target", "classification", "synthetic_1000K").collect())


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cores}]", spark_sql_shuffle_partitions=cores, spark_driver_memory="12g",
        spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries = checks.queries()
    queries["profile"](spark, folder).collect()  # session warm-up, not counted
    times = {}
    for name in HEADLINE:
        times[name] = timed(
            lambda: queries[name](spark, folder).write.format("noop").mode("overwrite").save())
        print(name, times[name], file=sys.stderr, flush=True)
    times["profile_synthetic_1m_csv"] = csv_profile_time(spark)
    times.update(model_times(spark, folder))
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
