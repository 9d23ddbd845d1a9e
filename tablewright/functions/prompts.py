"""Prompt texts rendered from profile columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three prompt texts. A field in braces takes a profile column,
# ``:%`` shows a share as a percentage with two places.
FULL_PROFILE = """You are an expert machine learning engineer designing pipelines for tabular datasets.

Dataset profile:
- Name: {dataset_name}
- Task: {task_type}
- Rows: {n_rows}
- Features: {n_features}
- Missing ratio: {missing_ratio:%}
- Categorical ratio: {categorical_ratio:%}
- Class imbalance (minority fraction): {class_imbalance}
- Mean feature variance: {feature_variance}
- Classes: {n_classes}

STRICT MODEL SELECTION RULES — you MUST follow these:
1. n_rows < 2000 AND n_features < 20  →  use LogisticRegression or GradientBoostingClassifier/GradientBoostingRegressor
2. categorical_ratio > 0.40            →  use LGBMClassifier or LGBMRegressor
3. n_rows > 20000                      →  use XGBClassifier or XGBRegressor
4. class_imbalance < 0.15 (severe)     →  use GradientBoostingClassifier with subsample
5. n_features > 25 AND missing_ratio > 0.05 →  use RandomForestClassifier or RandomForestRegressor
6. Otherwise                           →  choose the most appropriate model

ALLOWED MODELS:
Classification: LogisticRegression, RandomForestClassifier, GradientBoostingClassifier, XGBClassifier, LGBMClassifier
Regression:     Ridge, RandomForestRegressor, GradientBoostingRegressor, XGBRegressor, LGBMRegressor

ALLOWED PREPROCESSING steps (use only these exact strings):
imputer, standard_scaler, min_max_scaler, one_hot_encoder, pca, variance_threshold

IMPORTANT: Do NOT include label_encoder in preprocessing list.

Return ONLY a valid JSON object with no extra text:
{
  "preprocessing": ["imputer", "standard_scaler"],
  "model": "ModelName",
  "hyperparameters": {"param": value},
  "reasoning": "Explain which rule you applied and why this model fits this dataset."
}"""

NO_PROFILE = """You are an expert ML engineer.
Task type: {task_type}

Choose a preprocessing pipeline and model. You must NOT always pick RandomForest.
Consider LogisticRegression for simple tasks, GradientBoosting for medium complexity, XGB/LGBM for large data.

ALLOWED MODELS:
Classification: LogisticRegression, RandomForestClassifier, GradientBoostingClassifier, XGBClassifier, LGBMClassifier
Regression:     Ridge, RandomForestRegressor, GradientBoostingRegressor, XGBRegressor, LGBMRegressor

ALLOWED PREPROCESSING: imputer, standard_scaler, min_max_scaler, one_hot_encoder, pca, variance_threshold

Return ONLY valid JSON:
{
  "preprocessing": ["imputer", "standard_scaler"],
  "model": "ModelName",
  "hyperparameters": {},
  "reasoning": "Brief justification."
}"""

MODEL_ONLY = """You are an expert ML engineer.

Dataset profile:
- Task: {task_type}
- Rows: {n_rows}
- Features: {n_features}
- Categorical ratio: {categorical_ratio:%}
- Class imbalance: {class_imbalance}

Choose ONLY the model (preprocessing will be fixed). Do NOT always pick RandomForest.
Apply the selection rules:
- n_rows < 2000 → LogisticRegression or GradientBoosting
- categorical > 0.40 → LGBM
- n_rows > 20000 → XGB
- Otherwise → best fit

ALLOWED MODELS:
Classification: LogisticRegression, RandomForestClassifier, GradientBoostingClassifier, XGBClassifier, LGBMClassifier
Regression:     Ridge, RandomForestRegressor, GradientBoostingRegressor, XGBRegressor, LGBMRegressor

Return ONLY valid JSON:
{
  "preprocessing": [],
  "model": "ModelName",
  "hyperparameters": {},
  "reasoning": "Which rule applied and why."
}"""

TEMPLATES = {"full_profile": FULL_PROFILE, "no_profile": NO_PROFILE, "model_only": MODEL_ONLY}

_FIELD = re.compile(r"\{([a-z_]+)(:%)?\}")
_DECIMALS = {"class_imbalance", "feature_variance"}


def decimal_text(value: Column) -> Column:
    """Up to four places, without trailing zeros but with at least one place."""
    fixed = F.format_string("%.4f", value.cast("double"))
    return F.regexp_replace(fixed, r"(\.\d+?)0+$", "$1")


def _field(name: str, percent: str | None) -> Column:
    column = F.col(name)
    if name == "class_imbalance":
        column = F.coalesce(column, F.lit(0.5))
    if percent:
        return F.format_string("%.2f%%", column.cast("double") * 100)
    if name in _DECIMALS:
        return decimal_text(column)
    return F.coalesce(column.cast("string"), F.lit("None"))


def render_prompt(condition: str = "full_profile") -> Column:
    """Prompt text for each row of a profiles table."""
    if condition not in TEMPLATES:
        raise ValueError(f"unknown condition {condition!r}")
    template = TEMPLATES[condition]
    parts, position = [], 0
    for match in _FIELD.finditer(template):
        parts += [F.lit(template[position : match.start()]), _field(match[1], match[2])]
        position = match.end()
    return F.concat(*parts, F.lit(template[position:]))
