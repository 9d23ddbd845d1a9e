"""Scores of predictions, overall or per key, each from one grouped aggregate."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.ranking import running_totals

CLASSIFICATION_FIELDS = ["f1_macro", "accuracy", "precision", "recall", "auc_roc"]
REGRESSION_FIELDS = ["rmse", "mae", "r2"]


def confusion_counts(
    df: DataFrame, label: str, prediction: str, keys: list[str] | None = None
) -> DataFrame:
    return df.groupBy(
        *(keys or []), F.col(label).alias("label"), F.col(prediction).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def class_scores(
    df: DataFrame, label: str, prediction: str, keys: list[str] | None = None
) -> DataFrame:
    """Support, precision, recall and F1 of every class seen as label or prediction."""
    keys = keys or []
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("actual"),
                 F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )
    per_class = (
        confusion_counts(df, label, prediction, keys)
        .select(*keys, F.inline(sides))
        .groupBy(*keys, "class")
        .agg(*[F.sum(name).alias(name) for name in ("actual", "predicted", "hits")])
    )

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    return per_class.select(
        *keys,
        "class",
        "actual",
        "predicted",
        "hits",
        share(F.col("hits"), F.col("predicted")).alias("precision"),
        share(F.col("hits"), F.col("actual")).alias("recall"),
        share(2 * F.col("hits"), F.col("actual") + F.col("predicted")).alias("f1"),
    )


def macro_scores(
    df: DataFrame, label: str, prediction: str, keys: list[str] | None = None
) -> DataFrame:
    """Accuracy and unweighted class means of precision, recall and F1, 4 places."""
    return class_scores(df, label, prediction, keys).groupBy(*(keys or [])).agg(
        F.round(F.avg("f1"), 4).alias("f1_macro"),
        F.round(F.sum("hits") / F.sum("actual"), 4).alias("accuracy"),
        F.round(F.avg("precision"), 4).alias("precision"),
        F.round(F.avg("recall"), 4).alias("recall"),
    )


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Share of correct predictions; needs no confusion table."""
    correct = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.round(F.avg(correct), 4).alias("accuracy"))


def precision_macro(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return macro_scores(df, label, prediction).select(F.col("precision").alias("precision_macro"))


def recall_macro(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return macro_scores(df, label, prediction).select(F.col("recall").alias("recall_macro"))


def f1_macro(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return macro_scores(df, label, prediction).select("f1_macro")


def _auc(df: DataFrame, positive: Column, score: str, keys: list[str], **options) -> DataFrame:
    """Area under ROC per key, unrounded; null when one side is empty.

    Rows are counted per distinct score first, so ties, however many, are one row.
    """
    counts = df.groupBy(*keys, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    ordered = running_totals(counts, ["_score"], ["neg"], keys, **options)
    won = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    return ordered.groupBy(*keys).agg(
        F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    )


def auc_binary(
    df: DataFrame,
    label: str,
    score: str,
    positive=1,
    keys: list[str] | None = None,
    **options,
) -> DataFrame:
    """Exact area under the ROC curve, ties counting half."""
    keys = keys or []
    result = _auc(df, F.col(label) == F.lit(positive), score, keys, **options)
    return result.select(*keys, F.round("auc", 4).alias("auc_roc"))


def auc_ovr_macro(
    df: DataFrame, label: str, scores: str, keys: list[str] | None = None, **options
) -> DataFrame:
    """Mean of the one-versus-rest areas; null when a class has no positive or no other row.

    ``label`` numbers the classes from 0 and ``scores`` holds one score per class.
    """
    keys = keys or []
    long = df.select(*keys, F.col(label).alias("_label"), F.posexplode(scores).alias("_class", "_s"))
    per_class = _auc(long, F.col("_label") == F.col("_class"), "_s", [*keys, "_class"], **options)
    whole = F.count("auc") == F.count(F.lit(1))
    return per_class.groupBy(*keys).agg(
        F.when(whole, F.round(F.avg("auc"), 4)).alias("auc_roc")
    )


def regression_scores(
    df: DataFrame, label: str, prediction: str, keys: list[str] | None = None
) -> DataFrame:
    """RMSE, MAE and the coefficient of determination, 4 places."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    squared = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * F.count(y)
    r2 = F.when(spread > 0, 1 - squared / spread).otherwise(F.when(squared == 0, 1.0).otherwise(0.0))
    return df.groupBy(*(keys or [])).agg(
        F.round(F.sqrt(F.avg((y - p) * (y - p))), 4).alias("rmse"),
        F.round(F.avg(F.abs(y - p)), 4).alias("mae"),
        F.round(r2, 4).alias("r2"),
    )


def rmse(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return regression_scores(df, label, prediction).select("rmse")


def mae(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return regression_scores(df, label, prediction).select("mae")


def r2(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return regression_scores(df, label, prediction).select("r2")


def score_array(df: DataFrame) -> Column | None:
    """Class scores a fitted model left behind: probabilities, else raw scores."""
    for name in ("probability", "rawPrediction"):
        if name in df.columns:
            return vector_to_array(F.col(name))
    return None


def _join_on_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        value = right.columns[0]
        return left.withColumn(value, right.scalar())
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, same, "left").drop(*[f"_r_{k}" for k in keys])


def metrics_row(
    df: DataFrame,
    task_type: str,
    label: str,
    prediction: str,
    scores: str | None = None,
    n_scores: int | None = None,
    keys: list[str] | None = None,
    **options,
) -> DataFrame:
    """All eight metric fields per key; those of the other task type are null.

    ``scores`` names an array column with one score per class. With two scores the area
    of the second is used, otherwise the one-versus-rest mean.
    """
    keys = keys or []
    if task_type == "regression":
        row = regression_scores(df, label, prediction, keys)
        blanks = CLASSIFICATION_FIELDS
    else:
        row = macro_scores(df, label, prediction, keys)
        blanks = REGRESSION_FIELDS
        if scores is None:
            blanks = ["auc_roc", *blanks]
        else:
            if n_scores == 2:
                second = df.select(*keys, label, F.element_at(scores, 2).alias("_second"))
                area = auc_binary(second, label, "_second", 1, keys, **options)
            else:
                area = auc_ovr_macro(df, label, scores, keys, **options)
            row = _join_on_keys(row, area, keys)
    for name in blanks:
        row = row.withColumn(name, F.lit(None).cast("double"))
    return row.select(*keys, *CLASSIFICATION_FIELDS, *REGRESSION_FIELDS)


def evaluate_by_group(
    df: DataFrame,
    task_type: str,
    label: str,
    prediction: str,
    keys: list[str],
    scores: str | None = None,
    n_scores: int | None = None,
    **options,
) -> DataFrame:
    """Metric rows for every (dataset, method, fold) held in one predictions table."""
    return metrics_row(df, task_type, label, prediction, scores, n_scores, keys, **options)
