"""Pipeline specifications as columns: allow-lists, clamps, defaults, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, ranges and defaults a specification may use.
ALLOWED_STEPS = [
    "imputer",
    "standard_scaler",
    "min_max_scaler",
    "one_hot_encoder",
    "pca",
    "variance_threshold",
]
CLASSIFICATION_MODELS = [
    "LogisticRegression",
    "RandomForestClassifier",
    "GradientBoostingClassifier",
    "SVC",
    "KNeighborsClassifier",
    "XGBClassifier",
    "LGBMClassifier",
]
REGRESSION_MODELS = [
    "Ridge",
    "RandomForestRegressor",
    "GradientBoostingRegressor",
    "SVR",
    "XGBRegressor",
    "LGBMRegressor",
]
ALLOWED_MODELS = CLASSIFICATION_MODELS + REGRESSION_MODELS
CLAMPS = {
    "n_estimators": (50, 500),
    "max_depth": (3, 20),
    "C": (0.001, 100),
    "alpha": (0.01, 100),
    "n_neighbors": (3, 15),
    "learning_rate": (0.01, 0.3),
    "max_iter": (100, 2000),
    "num_leaves": (20, 200),
    "subsample": (0.5, 1.0),
}
INTEGER_PARAMETERS = ["n_estimators", "max_depth", "n_neighbors", "max_iter", "num_leaves"]
MODEL_PARAMETERS = {
    "LogisticRegression": ["C", "max_iter"],
    "RandomForestClassifier": ["n_estimators", "max_depth"],
    "RandomForestRegressor": ["n_estimators", "max_depth"],
    "GradientBoostingClassifier": ["n_estimators", "max_depth", "learning_rate", "subsample"],
    "GradientBoostingRegressor": ["n_estimators", "max_depth", "learning_rate"],
    "XGBClassifier": ["n_estimators", "max_depth", "learning_rate"],
    "XGBRegressor": ["n_estimators", "max_depth", "learning_rate"],
    "LGBMClassifier": ["n_estimators", "max_depth", "learning_rate", "num_leaves"],
    "LGBMRegressor": ["n_estimators", "max_depth", "learning_rate", "num_leaves"],
    "Ridge": ["alpha"],
    "SVC": ["C"],
    "SVR": ["C"],
    "KNeighborsClassifier": ["n_neighbors"],
}
FALLBACK_STEPS = ["imputer", "standard_scaler"]
FALLBACK_CLASSIFIER = "GradientBoostingClassifier"
FALLBACK_REGRESSOR = "GradientBoostingRegressor"
FALLBACK_PARAMETERS = {"n_estimators": 100.0}
FALLBACK_REASONING = "Fallback."
NO_REASONING = "Gerekce belirtilmedi."


def text_array(values: list[str]) -> Column:
    return F.array(*[F.lit(value) for value in values]).cast("array<string>")


def number_map(values: dict[str, float]) -> Column:
    """Literal map of parameter values."""
    pairs = [part for name, value in values.items() for part in (F.lit(name), F.lit(float(value)))]
    return F.create_map(*pairs).cast("map<string,double>")


def filter_steps(steps: Column) -> Column:
    """The allowed step names, in their given order; no list gives an empty one."""
    kept = F.filter(steps, lambda step: step.isin(ALLOWED_STEPS))
    return F.coalesce(kept, text_array([]))


def ensure_imputer(steps: Column) -> Column:
    """Put an imputer first unless the steps hold one."""
    return F.when(F.array_contains(steps, "imputer"), steps).otherwise(
        F.array_prepend(steps, F.lit("imputer"))
    )


def clamp_hyperparameters(parameters: Column) -> Column:
    """Move every known parameter into its range; integer ones are rounded down."""
    lows = number_map({name: low for name, (low, _) in CLAMPS.items()})
    highs = number_map({name: high for name, (_, high) in CLAMPS.items()})

    def clamp(name: Column, value: Column) -> Column:
        # An unknown name finds no bound, and greatest and least skip nulls.
        bounded = F.greatest(F.element_at(lows, name), F.least(F.element_at(highs, name), value))
        whole = F.when(name.isin(INTEGER_PARAMETERS), F.floor(bounded).cast("double"))
        return F.coalesce(whole, bounded)

    return F.transform_values(parameters, clamp)


def filter_hyperparameters(parameters: Column, model: Column) -> Column:
    """Keep the parameters the model takes; an unknown model takes none."""
    pairs = [
        part
        for name, allowed in MODEL_PARAMETERS.items()
        for part in (F.lit(name), text_array(allowed))
    ]
    allowed = F.element_at(F.create_map(*pairs), model)
    return F.map_filter(
        parameters, lambda name, value: F.coalesce(F.array_contains(allowed, name), F.lit(False))
    )


def spec_struct(steps: Column, model: Column, parameters: Column, reasoning: Column) -> Column:
    return F.struct(
        steps.alias("preprocessing"),
        model.alias("model"),
        parameters.alias("hyperparameters"),
        reasoning.alias("reasoning"),
    )


def fallback_model(task_type: Column) -> Column:
    return F.when(task_type == "classification", FALLBACK_CLASSIFIER).otherwise(FALLBACK_REGRESSOR)


def fallback_spec(spec: Column, task_type: Column) -> Column:
    """The default specification where there is none; default model and reasoning
    where those are unusable."""
    default = spec_struct(
        text_array(FALLBACK_STEPS),
        fallback_model(task_type),
        number_map(FALLBACK_PARAMETERS),
        F.lit(FALLBACK_REASONING),
    )
    model = F.when(spec["model"].isin(ALLOWED_MODELS), spec["model"]).otherwise(fallback_model(task_type))
    reasoning = F.when(F.length(spec["reasoning"]) > 0, spec["reasoning"]).otherwise(NO_REASONING)
    patched = spec_struct(spec["preprocessing"], model, spec["hyperparameters"], reasoning)
    return F.when(spec.isNull(), default).otherwise(patched)


def validate_spec(spec: Column, task_type: Column) -> Column:
    """A specification with only allowed content, whatever ``spec`` held."""
    known = fallback_spec(spec, task_type)
    parameters = F.coalesce(known["hyperparameters"], number_map({}))
    present = F.map_filter(parameters, lambda name, value: value.isNotNull())
    return spec_struct(
        filter_steps(known["preprocessing"]),
        known["model"],
        clamp_hyperparameters(present),
        known["reasoning"],
    )
