"""From a specification to a pyspark.ml Pipeline."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml import Estimator, Pipeline

from tablewright.operators.prep import (
    Assemble,
    CategoryEncoder,
    MedianImputer,
    ModeImputer,
    OneHotStep,
    PcaStep,
    PopulationScaler,
    RangeScaler,
    VarianceFilter,
)
from tablewright.plans.models import make_model

StepFactory = Callable[[list[str], list[str]], Estimator]

# Step name -> factory over (columns that are not features, category columns).
STEPS: dict[str, StepFactory] = {
    "imputer": lambda exclude, categories: MedianImputer(excludeCols=exclude),
    "impute_mode": lambda exclude, categories: ModeImputer(excludeCols=exclude),
    "standard_scaler": lambda exclude, categories: PopulationScaler(excludeCols=exclude),
    "min_max_scaler": lambda exclude, categories: RangeScaler(excludeCols=exclude),
    "one_hot_encoder": lambda exclude, categories: OneHotStep(inputCols=categories),
    "pca": lambda exclude, categories: PcaStep(excludeCols=exclude),
    "variance_threshold": lambda exclude, categories: VarianceFilter(excludeCols=exclude),
}
FIXED_STEPS = ["imputer", "standard_scaler"]


def resolved_steps(spec: Mapping) -> list[str]:
    """Known steps in order, an imputer first where the specification has none."""
    steps = [name for name in spec.get("preprocessing") or [] if name in STEPS]
    if not any(name in ("imputer", "impute_mode") for name in steps):
        steps.insert(0, "imputer")
    return steps


def build_pipeline(
    spec: Mapping,
    exclude: list[str],
    categories: list[str] | None = None,
    key: str | list[str] | None = None,
    fixed_preprocessing: bool = False,
    coded: bool = False,
) -> Pipeline:
    """Category coding, the steps, vector assembly and the model as one Pipeline.

    ``exclude`` names the columns that are not features: label, keys, split marks.
    ``categories`` are the text features; with ``coded`` they hold codes already.
    """
    categories = list(categories or [])
    excluded = sorted({*exclude, "label"})
    steps = FIXED_STEPS if fixed_preprocessing else resolved_steps(spec)
    stages: list = []
    if categories and not coded:
        stages.append(CategoryEncoder(inputCols=categories))
    stages += [STEPS[name](excluded, categories) for name in steps]
    stages.append(Assemble(excludeCols=excluded))
    stages.append(
        make_model(spec.get("model") or "", dict(spec.get("hyperparameters") or {}), key)
    )
    return Pipeline(stages=stages)


def build_fixed(spec: Mapping, exclude: list[str], categories: list[str] | None = None,
                key: str | list[str] | None = None) -> Pipeline:
    """Median, scaling and the specification's model."""
    return build_pipeline(spec, exclude, categories, key, fixed_preprocessing=True)


def stage_count(spec: Mapping, fixed_preprocessing: bool = False) -> int:
    """Preparation steps plus the model."""
    return len(FIXED_STEPS if fixed_preprocessing else resolved_steps(spec)) + 1
