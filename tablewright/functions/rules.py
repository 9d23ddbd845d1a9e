"""Choice rules: a profile row in, a pipeline specification out, as one CASE each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.specs import fallback_model, number_map, spec_struct, text_array

# Thresholds of the rule sets.
MANY_CATEGORIES_LIBRARY = 0.30
MANY_FEATURES_LIBRARY = 20
SEVERE_IMBALANCE_LIBRARY = 0.10
FEW_ROWS = 2000
MANY_CATEGORIES = 0.40
IMBALANCE_RUNNER = 0.20
FEW_FEATURES = 20
MANY_ROWS = 20000
SEVERE_IMBALANCE = 0.15
WIDE_TABLE = 25
MANY_GAPS = 0.05
BALANCED = 0.5

SCALED = ["imputer", "standard_scaler"]


def _spec(steps: list[str], model: str, reason: str, **parameters: float) -> Column:
    return spec_struct(
        text_array(steps), F.lit(model), number_map(parameters) if parameters else
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")),
        F.lit(reason),
    )


def _is_class() -> Column:
    return F.col("task_type") == "classification"


def _by_task(classification: Column, regression: Column) -> Column:
    return F.when(_is_class(), classification).otherwise(regression)


def _imbalance() -> Column:
    # Only an absent share reads as balanced; a share that rounds to 0 stays 0.
    return F.coalesce(F.col("class_imbalance"), F.lit(BALANCED))


def choose_manual() -> Column:
    """Median, scaling and a linear model, whatever the profile says."""
    reason = "fixed linear pipeline"
    return _by_task(
        _spec(SCALED, "LogisticRegression", reason, C=1, max_iter=1000),
        _spec(SCALED, "Ridge", reason, alpha=1),
    )


def choose_default() -> Column:
    """Median and a forest of 100 trees, whatever the profile says."""
    reason = "fixed forest pipeline"
    return _by_task(
        _spec(["imputer"], "RandomForestClassifier", reason, n_estimators=100),
        _spec(["imputer"], "RandomForestRegressor", reason, n_estimators=100),
    )


def choose_rules_library() -> Column:
    classification = (
        F.when(
            F.col("categorical_ratio") > MANY_CATEGORIES_LIBRARY,
            _spec(["impute_mode"], "RandomForestClassifier", "many categories", n_estimators=200),
        )
        .when(
            F.col("n_features") > MANY_FEATURES_LIBRARY,
            _spec([*SCALED, "pca"], "LogisticRegression", "many features", C=1, max_iter=1000),
        )
        .when(
            _imbalance() < SEVERE_IMBALANCE_LIBRARY,
            _spec(SCALED, "GradientBoostingClassifier", "rare class", n_estimators=100),
        )
        .otherwise(_spec(SCALED, "LogisticRegression", "general case", C=1, max_iter=1000))
    )
    return _by_task(classification, _spec(SCALED, "Ridge", "regression", alpha=1))


def choose_rules_runner() -> Column:
    few = F.col("n_rows") < FEW_ROWS
    classification = (
        F.when(few, _spec(SCALED, "LogisticRegression", "few rows", max_iter=1000))
        .when(
            (F.col("categorical_ratio") > MANY_CATEGORIES) | (_imbalance() < IMBALANCE_RUNNER),
            _spec(SCALED, "GradientBoostingClassifier", "categories or rare class", n_estimators=100),
        )
        .otherwise(_spec(SCALED, "RandomForestClassifier", "general case", n_estimators=100))
    )
    regression = F.when(few, _spec(SCALED, "Ridge", "few rows")).otherwise(
        _spec(SCALED, "GradientBoostingRegressor", "many rows", n_estimators=100)
    )
    return _by_task(classification, regression)


def _model_spec(classifier: str, regressor: str, reason: str) -> Column:
    return _by_task(
        _spec(SCALED, classifier, reason, n_estimators=100),
        _spec(SCALED, regressor, reason, n_estimators=100),
    )


def _small_table(reason: str) -> Column:
    return _by_task(
        _spec(SCALED, "LogisticRegression", reason),
        _spec(SCALED, "GradientBoostingRegressor", reason, n_estimators=100),
    )


def choose_rules_full() -> Column:
    """The six numbered rules of the full prompt, first match wins."""
    return (
        F.when(
            (F.col("n_rows") < FEW_ROWS) & (F.col("n_features") < FEW_FEATURES),
            _small_table("rule 1"),
        )
        .when(
            F.col("categorical_ratio") > MANY_CATEGORIES,
            _model_spec("LGBMClassifier", "LGBMRegressor", "rule 2"),
        )
        .when(
            F.col("n_rows") > MANY_ROWS, _model_spec("XGBClassifier", "XGBRegressor", "rule 3")
        )
        .when(
            _is_class() & (_imbalance() < SEVERE_IMBALANCE),
            _spec(SCALED, "GradientBoostingClassifier", "rule 4", n_estimators=100, subsample=0.8),
        )
        .when(
            (F.col("n_features") > WIDE_TABLE) & (F.col("missing_ratio") > MANY_GAPS),
            _model_spec("RandomForestClassifier", "RandomForestRegressor", "rule 5"),
        )
        .otherwise(
            spec_struct(
                text_array(SCALED),
                fallback_model(F.col("task_type")),
                number_map({"n_estimators": 100}),
                F.lit("rule 6"),
            )
        )
    )


def choose_rules_model_only() -> Column:
    """The four rules of the model-only prompt; preprocessing stays fixed."""
    return (
        F.when(F.col("n_rows") < FEW_ROWS, _small_table("rule 1"))
        .when(
            F.col("categorical_ratio") > MANY_CATEGORIES,
            _model_spec("LGBMClassifier", "LGBMRegressor", "rule 2"),
        )
        .when(
            F.col("n_rows") > MANY_ROWS, _model_spec("XGBClassifier", "XGBRegressor", "rule 3")
        )
        .otherwise(
            _model_spec("GradientBoostingClassifier", "GradientBoostingRegressor", "rule 4")
        )
    )


def choose_task_default() -> Column:
    """What is chosen when only the task type is known."""
    return _model_spec("GradientBoostingClassifier", "GradientBoostingRegressor", "task type only")


CHOICES = {
    "manual": choose_manual,
    "default": choose_default,
    "rules_library": choose_rules_library,
    "rules_runner": choose_rules_runner,
    "rules_full": choose_rules_full,
    "rules_model_only": choose_rules_model_only,
    "task_default": choose_task_default,
}


def choose(profiles: DataFrame, rule: str, output: str = "spec") -> DataFrame:
    """Add the specification that the named rule set picks for each profile."""
    return profiles.withColumn(output, CHOICES[rule]())
