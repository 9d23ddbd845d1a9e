"""Metrics of rule-made predictions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.frames import PREDICTIONS_SQL, predictions, table
from tablewright.operators import metrics as M

RANGES = {"ranges": 16}


def _two(metric):
    return lambda spark, folder: metric(predictions(spark, folder), "label", "prediction")


def _price(metric):
    return lambda spark, folder: metric(predictions(spark, folder), "price", "price_hat")


# Scores with many ties: the value rounded, clicks being the positive class.
SCORED = {
    "event_id": "event_id",
    "half": "concat('h', event_id % 2)",
    "label": "case when event_type = 'click' then 1 else 0 end",
    "prediction": "case when value > 25 then 1 else 0 end",
    "score": "floor(value)",
    "kind": "case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'view' then 3 else 4 end",
}
SCORED_SQL = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in SCORED.items()) + ", value FROM events"


def _scored(spark, folder):
    return table(spark, folder, "events").selectExpr(*[f"{sql} AS {name}" for name, sql in SCORED.items()], "value")


CLASS_SCORES = ["value", "floor(value) * 2", "100 - value", "event_id % 17 + floor(value)", "floor(value / 10)"]


def auc_binary(spark, folder):
    return M.auc_binary(_scored(spark, folder), "label", "score", **RANGES)


def auc_binary_distinct(spark, folder):
    """Nearly as many distinct scores as rows."""
    return M.auc_binary(
        table(spark, folder, "orders").selectExpr("o_totalprice AS s", "cast(o_orderstatus = 'F' as int) AS y"),
        "y", "s", **RANGES)


def auc_ovr_macro(spark, folder):
    rows = _scored(spark, folder).select(
        F.col("kind").alias("label"), F.array(*[F.expr(s).cast("double") for s in CLASS_SCORES]).alias("scores"))
    return M.auc_ovr_macro(rows, "label", "scores", **RANGES)


def metrics_row(spark, folder):
    """The classification and the regression form of the record."""
    rows = _scored(spark, folder).select(
        "label", "prediction", F.array(-F.col("score"), F.col("score")).cast("array<double>").alias("scores"))
    first = M.metrics_row(rows, "classification", "label", "prediction", "scores", 2, **RANGES)
    second = M.metrics_row(predictions(spark, folder), "regression", "price", "price_hat")
    return first.unionByName(second)


def evaluate_by_group(spark, folder):
    rows = _scored(spark, folder).select(
        F.col("half").alias("method"), (F.col("event_id") % 5 + 1).alias("fold"), "label", "prediction",
        F.array(-F.col("score"), F.col("score")).cast("array<double>").alias("scores"))
    scored = M.evaluate_by_group(
        rows, "classification", "label", "prediction", ["method", "fold"], "scores", 2, **RANGES)
    return scored.select("method", "fold", *M.CLASSIFICATION_FIELDS)


QUERIES = {
    "confusion_counts": lambda spark, folder: M.confusion_counts(
        predictions(spark, folder), "label", "prediction", ["priority"]),
    "accuracy": _two(M.accuracy),
    "precision_macro": _two(M.precision_macro),
    "recall_macro": _two(M.recall_macro),
    "f1_macro": _two(M.f1_macro),
    "auc_binary": auc_binary,
    "auc_binary_distinct": auc_binary_distinct,
    "auc_ovr_macro": auc_ovr_macro,
    "rmse": _price(M.rmse),
    "mae": _price(M.mae),
    "r2": _price(M.r2),
    "metrics_row": metrics_row,
    "evaluate_by_group": evaluate_by_group,
}


def classes_sql(source: str, keys: str = "") -> str:
    by = f"{keys}, " if keys else ""
    return f"""SELECT {by}k AS class, sum(a) AS actual, sum(p) AS predicted, sum(h) AS hits FROM (
 SELECT {by}label AS k, 1 AS a, 0 AS p, case when label = prediction then 1 else 0 end AS h FROM ({source}) s
 UNION ALL SELECT {by}prediction, 0, 1, 0 FROM ({source}) s) u GROUP BY ALL"""


def macro_sql(source: str, keys: str = "") -> str:
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {by}round(avg(case when actual + predicted > 0 then 2 * hits / (actual + predicted)::double
 else 0 end), 4) AS f1_macro, round(sum(hits) / sum(actual)::double, 4) AS accuracy,
 round(avg(case when predicted > 0 then hits / predicted::double else 0 end), 4) AS precision,
 round(avg(case when actual > 0 then hits / actual::double else 0 end), 4) AS recall
 FROM ({classes_sql(source, keys)}) c {group}"""


def auc_sql(source: str, positive: str, score: str, keys: str = "") -> str:
    """Unrounded area under ROC from average ranks."""
    by = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {by}sum(pos * (below + neg / 2::double)) / (sum(pos)::double * sum(neg)) AS auc FROM (
 SELECT *, sum(neg) OVER ({part} ORDER BY s) - neg AS below FROM (SELECT {by}{score} AS s,
 count(*) FILTER (WHERE {positive}) AS pos, count(*) FILTER (WHERE NOT ({positive})) AS neg
 FROM ({source}) q GROUP BY ALL) t) w {group}"""


_ERRORS = f"""SELECT round(sqrt(avg((price - price_hat) ** 2)), 4) AS rmse,
 round(avg(abs(price - price_hat)), 4) AS mae,
 round(1 - sum((price - price_hat) ** 2) / (var_pop(price) * count(*)), 4) AS r2 FROM ({PREDICTIONS_SQL}) p"""
_GROUPED = f"SELECT half AS method, event_id % 5 + 1 AS fold, label, prediction, score FROM ({SCORED_SQL}) z"

SQL = {
    "confusion_counts": f"""SELECT priority, label, prediction, count(*) AS n FROM ({PREDICTIONS_SQL}) p
 GROUP BY 1, 2, 3""",
    "accuracy": f"SELECT round(avg(cast(label = prediction as int)), 4) AS accuracy FROM ({PREDICTIONS_SQL}) p",
    "precision_macro": f"SELECT precision AS precision_macro FROM ({macro_sql(PREDICTIONS_SQL)}) m",
    "recall_macro": f"SELECT recall AS recall_macro FROM ({macro_sql(PREDICTIONS_SQL)}) m",
    "f1_macro": f"SELECT f1_macro FROM ({macro_sql(PREDICTIONS_SQL)}) m",
    "auc_binary": f"SELECT round(auc, 4) AS auc_roc FROM ({auc_sql(SCORED_SQL, 'label = 1', 'score')}) a",
    "auc_binary_distinct": f"""SELECT round(auc, 4) AS auc_roc FROM
 ({auc_sql('SELECT o_totalprice, o_orderstatus FROM orders', "o_orderstatus = 'F'", 'o_totalprice')}) a""",
    "auc_ovr_macro": "SELECT round(avg(auc), 4) AS auc_roc FROM (" + " UNION ALL ".join(
        auc_sql(SCORED_SQL, f"kind = {i}", score) for i, score in enumerate(CLASS_SCORES)) + ") a",
    "rmse": f"SELECT rmse FROM ({_ERRORS}) e",
    "mae": f"SELECT mae FROM ({_ERRORS}) e",
    "r2": f"SELECT r2 FROM ({_ERRORS}) e",
    "metrics_row": f"""SELECT f1_macro, accuracy, precision, recall, round(auc, 4) AS auc_roc, null::double AS rmse,
 null::double AS mae, null::double AS r2 FROM ({macro_sql(SCORED_SQL)}) m, ({auc_sql(SCORED_SQL, 'label = 1', 'score')}) a
 UNION ALL SELECT null, null, null, null, null, rmse, mae, r2 FROM ({_ERRORS}) e""",
    "evaluate_by_group": f"""SELECT method, fold, f1_macro, accuracy, precision, recall, round(auc, 4) AS auc_roc
 FROM ({macro_sql(_GROUPED, 'method, fold')}) m JOIN ({auc_sql(_GROUPED, 'label = 1', 'score', 'method, fold')}) a
 USING (method, fold)""",
}
