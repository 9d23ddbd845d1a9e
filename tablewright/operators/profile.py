"""The statistical profile of a labelled table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.kinds import (
    CATEGORICAL,
    NUMERIC,
    add_all,
    chunked,
    column_kinds,
    columns_of_kind,
    feature_columns,
    present_value,
    quoted,
)
from tablewright.schemas import PROFILE, conform

CLASSIFICATION, REGRESSION = "classification", "regression"

# Aggregates per plan: beyond this one generated aggregation method grows too large.
COLUMNS_PER_PASS = 100


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a target. The null test is stated so that it reaches the file scan."""
    kept = df.filter(quoted(target).isNotNull())
    if isinstance(df.schema[target].dataType, (T.FloatType, T.DoubleType)):
        kept = kept.filter(~F.isnan(quoted(target)))
    return kept


def split_features_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    features = feature_columns(df, target)
    return df.select(*[quoted(name) for name in features]), df.select(quoted(target))


def columns_by_type(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: its kind and how many values are present."""
    kinds = column_kinds(df, columns)
    return _unpivot(
        df,
        list(kinds),
        lambda name: {
            "kind": F.lit(kinds[name]),
            "n_values": F.count(quoted(name)),
        },
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def null_counts(df: DataFrame, columns: list[str], nan_is_missing: bool = True) -> DataFrame:
    """Missing cells per column in one pass, in long form."""
    return _unpivot(
        df,
        columns,
        lambda name: {
            "n_missing": F.count(F.lit(1)) - F.count(present_value(df, name, nan_is_missing))
        },
    )


def describe_columns(
    df: DataFrame, columns: list[str] | None = None, nan_is_missing: bool = True
) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum per numeric column."""
    names = columns_of_kind(df, df.columns if columns is None else columns, NUMERIC)

    def summary(name: str) -> dict[str, Column]:
        value = present_value(df, name, nan_is_missing).cast("double")
        return {
            "n": F.count(value),
            "mean": F.avg(value),
            "stddev": F.stddev_samp(value),
            "min": F.min(value),
            "max": F.max(value),
        }

    return _unpivot(df, names, summary)


def _unpivot(df: DataFrame, names: list[str], aggregates) -> DataFrame:
    """Aggregate every column at once, then turn the wide row into one row per column."""
    parts = []
    for chunk in chunked(names, COLUMNS_PER_PASS):
        records = [
            F.struct(
                F.lit(name).alias("column"),
                *[value.alias(label) for label, value in aggregates(name).items()],
            )
            for name in chunk
        ]
        parts.append(df.agg(F.array(*records).alias("records")).select(F.inline("records")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per target value, rarest first."""
    counts = df.groupBy(quoted(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("n", "class")


def _class_summary(df: DataFrame, target: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    counts = df.groupBy(*keys, quoted(target).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.round(F.min("_n") / F.sum("_n"), 4).alias("class_imbalance"),
        F.count(F.lit(1)).alias("n_classes"),
    )


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """Share of the rarest class."""
    return _class_summary(df, target).select("class_imbalance")


def n_classes(df: DataFrame, target: str, approximate: bool = False) -> DataFrame:
    if approximate:
        return df.agg(F.approx_count_distinct(quoted(target)).alias("n_classes"))
    return _class_summary(df, target).select("n_classes")


def _missing_ratio(df: DataFrame, features: list[str], nan_is_missing: bool) -> Column:
    # One summed counter per row instead of one aggregate per column.
    gaps = [present_value(df, name, nan_is_missing).isNull().cast("long") for name in features]
    if not features:
        return F.lit(0.0)
    cells = F.count(F.lit(1)) * F.lit(len(features))
    return F.coalesce(F.round(F.try_divide(F.sum(add_all(gaps)), cells), 4), F.lit(0.0))


def missing_ratio(df: DataFrame, features: list[str], nan_is_missing: bool = True) -> DataFrame:
    """Missing cells over all feature cells; 0.0 for an empty table."""
    return df.agg(_missing_ratio(df, features, nan_is_missing).alias("missing_ratio"))


def categorical_share(df: DataFrame, features: list[str]) -> float:
    """Text columns over all feature columns, from the schema alone."""
    if not features:
        return 0.0
    return round(len(columns_of_kind(df, features, CATEGORICAL)) / len(features), 4)


def _variances(df: DataFrame, names: list[str], nan_is_missing: bool) -> Column:
    return F.array(
        *[F.var_samp(present_value(df, name, nan_is_missing).cast("double")) for name in names]
    )


def _mean_present(values: Column) -> Column:
    kept = F.filter(values, lambda v: v.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + v)
    return F.coalesce(F.round(F.try_divide(total, F.size(kept)), 4), F.lit(0.0))


def feature_variance(df: DataFrame, features: list[str], nan_is_missing: bool = True) -> DataFrame:
    """Mean of the numeric columns' sample variances; undefined ones are left out."""
    numeric = columns_of_kind(df, features, NUMERIC)
    row = df.agg(F.lit(1).alias("_one"))
    for i, chunk in enumerate(chunked(numeric, COLUMNS_PER_PASS)):
        part = df.agg(_variances(df, chunk, nan_is_missing).alias("v"))
        row = part.select(F.col("v").alias("_v0")) if i == 0 else row.withColumn(f"_v{i}", part.scalar())
    lists = [F.col(name) for name in row.columns if name.startswith("_v")]
    values = F.concat(*lists) if lists else F.array().cast("array<double>")
    return row.select(_mean_present(values).alias("feature_variance"))


def profile(
    df: DataFrame,
    target: str,
    task_type: str,
    name: str,
    nan_is_missing: bool = True,
    drop_null_targets: bool = True,
) -> DataFrame:
    """The whole profile as one row.

    Two scans: one aggregate over all features, and one that reads only the target
    column for the class figures. Both results are single rows, so they meet through
    a scalar subquery and nothing else moves.
    """
    if task_type not in (CLASSIFICATION, REGRESSION):
        raise ValueError(f"unknown task type {task_type!r}")
    features = feature_columns(df, target)
    column_kinds(df, features)
    base = drop_null_target(df, target) if drop_null_targets else df
    numeric = columns_of_kind(df, features, NUMERIC)
    chunks = chunked(numeric, COLUMNS_PER_PASS) or [[]]

    row = base.agg(
        F.count(F.lit(1)).alias("n_rows"),
        _missing_ratio(base, features, nan_is_missing).alias("missing_ratio"),
        _variances(base, chunks[0], nan_is_missing).cast("array<double>").alias("_v"),
    )
    for chunk in chunks[1:]:
        more = base.agg(_variances(base, chunk, nan_is_missing).alias("v"))
        row = row.withColumn("_v", F.concat("_v", more.scalar()))
    row = row.select(
        F.lit(name).alias("dataset_name"),
        F.lit(task_type).alias("task_type"),
        "n_rows",
        F.lit(len(features)).alias("n_features"),
        "missing_ratio",
        F.lit(categorical_share(df, features)).alias("categorical_ratio"),
        _mean_present(F.col("_v")).alias("feature_variance"),
        F.current_timestamp().alias("timestamp"),
        F.lit(df.sparkSession.version).alias("spark_version"),
    )
    if task_type == CLASSIFICATION:
        summary = _class_summary(base, target)
        both = summary.select(F.struct("class_imbalance", "n_classes").alias("s")).scalar()
        row = row.withColumn("_classes", both).select(
            "*",
            F.col("_classes.class_imbalance").alias("class_imbalance"),
            F.col("_classes.n_classes").alias("n_classes"),
        )
    return conform(row, PROFILE)


def profile_many(tables: list[tuple[str, DataFrame, str, str]], **options) -> DataFrame:
    """Profiles of several (name, table, target, task type) entries as one table."""
    parts = [profile(df, target, task, name, **options) for name, df, target, task in tables]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def profile_by_group(
    df: DataFrame,
    keys: list[str],
    target: str,
    task_type: str,
    nan_is_missing: bool = True,
    drop_null_targets: bool = True,
) -> DataFrame:
    """One profile per value of the keys, named by the key values joined with ``/``."""
    features = [name for name in feature_columns(df, target) if name not in keys]
    base = drop_null_target(df, target) if drop_null_targets else df
    numeric = columns_of_kind(df, features, NUMERIC)
    grouped = base.groupBy(*[quoted(key) for key in keys]).agg(
        F.count(F.lit(1)).alias("n_rows"),
        _missing_ratio(base, features, nan_is_missing).alias("missing_ratio"),
        _variances(base, numeric, nan_is_missing).cast("array<double>").alias("_v"),
    )
    if task_type == CLASSIFICATION:
        other = _class_summary(base, target, keys)
        renamed = other.select(*[F.col(key).alias(f"_k_{key}") for key in keys],
                               "class_imbalance", "n_classes")
        same = [F.col(key).eqNullSafe(F.col(f"_k_{key}")) for key in keys]
        grouped = grouped.join(renamed, same, "left")
    label = F.concat_ws("/", *[F.coalesce(F.col(key).cast("string"), F.lit("null")) for key in keys])
    row = grouped.select(
        "*",
        label.alias("dataset_name"),
        F.lit(task_type).alias("task_type"),
        F.lit(len(features)).alias("n_features"),
        F.lit(categorical_share(df, features)).alias("categorical_ratio"),
        _mean_present(F.col("_v")).alias("feature_variance"),
        F.current_timestamp().alias("timestamp"),
        F.lit(df.sparkSession.version).alias("spark_version"),
    )
    return conform(row, PROFILE)
