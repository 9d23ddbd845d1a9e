import json

import pytest
from pyspark.sql import functions as F

from tablewright.functions import rules, specs
from tablewright.functions.prompts import render_prompt
from tablewright.functions.replies import parse_spec
from tablewright.schemas import PROFILE, SPEC

FIELDS = ["dataset_name", "task_type", "n_rows", "n_features", "missing_ratio", "categorical_ratio",
          "class_imbalance", "feature_variance", "n_classes"]


def profiles(spark, *rows):
    full = [(*row, None, None) for row in rows]
    return spark.createDataFrame(full, PROFILE)


def picks(spark, rule, *rows):
    chosen = rules.choose(profiles(spark, *rows), rule).select("dataset_name", "spec.model").collect()
    return {r["dataset_name"]: r["model"] for r in chosen}


def row(name, n_rows=5000, n_features=10, missing=0.0, categories=0.0, imbalance=0.4, task="classification"):
    classes = None if task == "regression" else 2
    return (name, task, n_rows, n_features, missing, categories,
            None if task == "regression" else imbalance, 1.0, classes)


def test_library_rules_in_order(spark):
    found = picks(
        spark, "rules_library", row("cat", categories=0.31, n_features=30), row("edge", categories=0.30),
        row("wide", n_features=21), row("rare", imbalance=0.09), row("zero", imbalance=0.0),
        row("plain"), row("reg", task="regression", categories=0.9))
    assert found == {"cat": "RandomForestClassifier", "edge": "LogisticRegression", "wide": "LogisticRegression",
                     "rare": "GradientBoostingClassifier", "zero": "GradientBoostingClassifier",
                     "plain": "LogisticRegression", "reg": "Ridge"}


def test_runner_rules_at_their_limits(spark):
    found = picks(
        spark, "rules_runner", row("few", n_rows=1999), row("enough", n_rows=2000), row("cat", categories=0.41),
        row("rare", imbalance=0.19), row("edge", imbalance=0.20, categories=0.40),
        row("small", n_rows=506, task="regression"), row("large", n_rows=2000, task="regression"))
    assert found == {"few": "LogisticRegression", "enough": "RandomForestClassifier",
                     "cat": "GradientBoostingClassifier", "rare": "GradientBoostingClassifier",
                     "edge": "RandomForestClassifier", "small": "Ridge", "large": "GradientBoostingRegressor"}


def test_full_rules_reach_every_branch(spark):
    found = picks(
        spark, "rules_full", row("one", n_rows=1999, n_features=19), row("two", categories=0.41),
        row("three", n_rows=20001), row("four", n_rows=20000, imbalance=0.14),
        row("five", n_features=26, missing=0.06), row("six"), row("regsix", task="regression"),
        row("regfive", task="regression", n_features=26, missing=0.06))
    assert found == {
        "one": "LogisticRegression", "two": "LGBMClassifier", "three": "XGBClassifier",
        "four": "GradientBoostingClassifier", "five": "RandomForestClassifier",
        "six": "GradientBoostingClassifier", "regsix": "GradientBoostingRegressor",
        "regfive": "RandomForestRegressor"}


def test_missing_imbalance_reads_as_balanced(spark):
    assert picks(spark, "rules_runner", row("x", imbalance=None)) == {"x": "RandomForestClassifier"}


def test_prompt_formats(spark):
    table = profiles(spark, ("titanic", "classification", 891, 7, 0.0287, 0.2857, None, 80127.5, 2))
    text = table.select(render_prompt()).first()[0]
    assert "- Missing ratio: 2.87%\n- Categorical ratio: 28.57%\n" in text
    assert "(minority fraction): 0.5\n- Mean feature variance: 80127.5\n- Classes: 2\n" in text
    assert '{"param": value}' in text
    short = table.select(render_prompt("no_profile")).first()[0]
    assert short.startswith("You are an expert ML engineer.\nTask type: classification\n")
    with pytest.raises(ValueError):
        render_prompt("other")


GOOD = {"preprocessing": ["imputer", "pca"], "model": "Ridge", "hyperparameters": {"alpha": 2}, "reasoning": "r"}


def parsed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    return [r["spec"] for r in parse_spec(df, "raw").orderBy("i").collect()]


def test_reply_stages(spark):
    text = json.dumps(GOOD)
    found = parsed(
        spark, text, f"  {text}\n", f"Sure:\n```json\n{text}\n```", f"```{text}```", f"I say {text} now",
        "no object", "", None, "[1, 2]", "7", '{"model": "Ridge"', "```json\n{broken}\n``` then " + text)
    for spec in found[:5]:
        assert spec["model"] == "Ridge" and spec["preprocessing"] == ["imputer", "pca"]
        assert spec["hyperparameters"] == {"alpha": 2.0}
    assert found[5:11] == [None] * 6


def test_reply_field_types(spark):
    odd = {"preprocessing": ["pca", 7, None, True], "model": 5,
           "hyperparameters": {"C": True, "alpha": "2", "max_depth": 4.5, "n_estimators": 10}, "reasoning": None}
    spec, other = parsed(spark, json.dumps(odd), '{"preprocessing": "pca", "hyperparameters": [1]}')
    assert spec["preprocessing"] == ["pca"] and spec["model"] is None
    assert spec["hyperparameters"] == {"max_depth": 4.5, "n_estimators": 10.0}
    assert other["preprocessing"] is None and other["hyperparameters"] is None


def test_validation(spark):
    given = [
        (0, "classification", None),
        (1, "regression", (["label_encoder", "pca"], "Perceptron", {"max_depth": 99.7, "C": 0.0, "odd": 5.0}, "")),
        (2, "classification", (None, "SVC", None, "why")),
    ]
    df = spark.createDataFrame(given, f"i int, task string, spec {SPEC.simpleString()}")
    out = df.withColumn("ok", specs.validate_spec(F.col("spec"), F.col("task"))).orderBy("i").collect()
    first, second, third = (r["ok"].asDict() for r in out)
    assert first == {"preprocessing": ["imputer", "standard_scaler"], "model": "GradientBoostingClassifier",
                     "hyperparameters": {"n_estimators": 100.0}, "reasoning": specs.FALLBACK_REASONING}
    assert second == {"preprocessing": ["pca"], "model": "GradientBoostingRegressor",
                      "hyperparameters": {"max_depth": 20.0, "C": 0.001, "odd": 5.0},
                      "reasoning": specs.NO_REASONING}
    assert third == {"preprocessing": [], "model": "SVC", "hyperparameters": {}, "reasoning": "why"}


def test_long_and_repeated_replies(spark):
    """A reply with very many braces, an open tail, and a key that occurs twice."""
    from tablewright.functions.replies import parse_spec

    rows = [
        ("many", "x " + "{}" * 100_000), ("open", "{" * 5_000 + '"model": 1'),
        ("nested", 'so: {"model": "Ridge", "hyperparameters": {"alpha": 2}} done'),
        ("twice", '{"model": "A", "model": "Ridge"}'),
    ]
    found = parse_spec(spark.createDataFrame(rows, "id string, raw string"), "raw").collect()
    specs = {r["id"]: r["spec"] for r in found}
    assert specs["nested"]["hyperparameters"] == {"alpha": 2.0}
    assert specs["twice"]["model"] == "Ridge" and specs["open"] is None
