"""Summaries of result tables and decision logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Methods compared, the ablation verdict's limit, the model diversity limit.
AGENT = "agent_full"
BASELINES = ["B1_manual", "B2_default", "B3_heuristic"]
ABLATION_METHODS = ["agent_full", "agent_no_profile", "agent_model_only"]
MIN_PROFILE_GAIN = 0.005
MIN_MODEL_FAMILIES = 3
TEST_DATASET = "test"


def primary_metric(
    results: DataFrame, task_type: str | None = "task_type", legacy_rmse: list[str] | None = None
) -> DataFrame:
    """Add ``primary``: RMSE for regression, macro F1 otherwise.

    ``legacy_rmse`` lists the datasets scored by RMSE when there is no task type column.
    """
    by_error = F.col("dataset").isin(legacy_rmse) if legacy_rmse is not None else (
        F.col(task_type) == "regression"
    )
    return results.withColumn("primary", F.when(by_error, F.col("rmse")).otherwise(F.col("f1_macro")))


def filter_methods(
    results: DataFrame,
    methods: list[str] | None = None,
    datasets: list[str] | None = None,
    score: str | None = None,
) -> DataFrame:
    """Rows of the given methods and datasets, without the test dataset or null scores."""
    kept = results.filter(F.col("dataset") != TEST_DATASET)
    if methods is not None:
        kept = kept.filter(F.col("method").isin(methods))
    if datasets is not None:
        kept = kept.filter(F.col("dataset").isin(datasets))
    return kept.filter(F.col(score).isNotNull()) if score else kept


def list_methods(results: DataFrame) -> DataFrame:
    return results.select("dataset", "method").distinct().orderBy("dataset", "method")


def method_summary(results: DataFrame) -> DataFrame:
    """Mean, sample deviation and count of the primary metric per dataset and method."""
    return results.groupBy("dataset", "method").agg(
        F.round(F.avg("primary"), 4).alias("mean"),
        F.round(F.stddev_samp("primary"), 4).alias("std"),
        F.count("primary").alias("n_folds"),
    )


def method_pivot(results: DataFrame, methods: list[str]) -> DataFrame:
    """One row per dataset, one column of mean primary metric per listed method."""
    return (
        results.groupBy("dataset")
        .pivot("method", methods)
        .agg(F.round(F.avg("primary"), 4))
    )


def best_baseline_delta(
    pivot: DataFrame,
    lower_is_better: Column | None = None,
    baselines: list[str] | None = None,
    agent: str = AGENT,
) -> DataFrame:
    """Add the best baseline and the agent's distance to it.

    The best is the largest mean, or the smallest where ``lower_is_better`` holds.
    """
    names = baselines or [name for name in pivot.columns if name.startswith("B")]
    columns = [F.col(name) for name in names]
    many = len(columns) > 1
    high = F.greatest(*columns) if many else columns[0]
    low = F.least(*columns) if many else columns[0]
    best = high if lower_is_better is None else F.when(lower_is_better, low).otherwise(high)
    return pivot.withColumn("best_baseline", best).withColumn(
        "delta_vs_best", F.round(F.col(agent) - F.col("best_baseline"), 4)
    )


def ablation_table(results: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Mean per condition and what the full condition gains over the reduced ones."""
    full, no_profile, model_only = methods or ABLATION_METHODS
    names = [full, no_profile, model_only]
    return (
        method_pivot(results.filter(F.col("method").isin(names)), names)
        .withColumn("delta_A1", F.round(F.col(full) - F.col(no_profile), 4))
        .withColumn("delta_A2", F.round(F.col(full) - F.col(model_only), 4))
    )


def ablation_verdict(table: DataFrame) -> DataFrame:
    mean = F.avg("delta_A1")
    return table.agg(
        F.round(mean, 4).alias("mean_delta_A1"),
        F.when(mean > MIN_PROFILE_GAIN, "CONFIRMED").otherwise("WEAK or REJECTED").alias("verdict"),
    )


def first_per_dataset(
    rows: DataFrame, order: list[str], key: str = "dataset"
) -> DataFrame:
    """Earliest row per dataset.

    An aggregate with partial results on the map side, so a dataset that holds most of
    the rows costs no more than the others.
    """
    whole = F.struct(*[F.col(name) for name in rows.columns])
    by = F.struct(*[F.col(name) for name in order])
    return rows.groupBy(key).agg(F.min_by(whole, by).alias("_row")).select("_row.*")


def decision_table(log: DataFrame, order: list[str]) -> DataFrame:
    """First full-profile decision per dataset, from a flattened log."""
    full = log.filter((F.col("condition") == "full_profile") & (F.col("dataset") != TEST_DATASET))
    return first_per_dataset(full, order).select(
        "dataset",
        "profile_categorical_ratio",
        "profile_class_imbalance",
        "profile_n_features",
        "spec_model",
        "spec_preprocessing",
        "spec_reasoning",
    )


def model_diversity(log: DataFrame) -> DataFrame:
    """How many model families were chosen over how many datasets."""
    full = log.filter(F.col("condition") == "full_profile")
    models = F.count_distinct("spec_model")
    return full.agg(
        models.alias("n_models"),
        F.count_distinct("dataset").alias("n_datasets"),
        F.when(models >= MIN_MODEL_FAMILIES, "STRONG").otherwise("WEAK").alias("support"),
    )


def join_profile_decision(profiles: DataFrame, decisions: DataFrame) -> DataFrame:
    """Profile figures beside the chosen model; joined on the dataset name."""
    chosen = decisions.select("dataset", F.col("spec_model").alias("model"))
    return chosen.join(profiles, F.col("dataset") == F.col("dataset_name")).select(
        "dataset",
        "model",
        "n_rows",
        F.coalesce("categorical_ratio", F.lit(0.0)).alias("categorical_ratio"),
        F.coalesce("class_imbalance", F.lit(0.5)).alias("class_imbalance"),
        "n_features",
    )


def experiment_grid(datasets: DataFrame, methods: list[str], folds: int = 5) -> DataFrame:
    """One row per dataset, method and fold; a single split has one row without fold.

    Methods and folds are short literal lists, so the grid is an explode, not a join.
    """
    numbers = F.when(
        F.col("strategy") == "cv5", F.sequence(F.lit(1), F.lit(folds))
    ).otherwise(F.array(F.lit(None).cast("int")))
    named = datasets.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    return named.withColumn("fold", F.explode(numbers))


def throughput(runs: DataFrame, size: str = "size_mb", seconds: str = "seconds") -> DataFrame:
    return runs.withColumn("mb_per_s", F.try_divide(F.col(size), F.col(seconds)))


def first_time_per_size(runs: DataFrame, order: list[str], seconds: str = "seconds") -> DataFrame:
    """First recorded time per row count."""
    by = F.struct(*[F.col(name) for name in order])
    return runs.groupBy("n_rows").agg(F.min_by(seconds, by).alias(seconds))


def log_linear_fit(runs: DataFrame, rows: str = "n_rows", seconds: str = "seconds",
                   natural: bool = False) -> DataFrame:
    """Least squares line of seconds over log10(rows), or over log(1 + rows)."""
    x = F.log1p(F.col(rows)) if natural else F.log10(F.col(rows))
    y = F.col(seconds).cast("double")
    return runs.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
