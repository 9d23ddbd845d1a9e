"""Profiles that grow with their table: a summary per part is stored, and summaries are merged.

A part is any piece of a table that arrives at once (a day, a file, a shard). Its summary holds
moments and sketches of every column and the counts of the target's values. A new part is read
once, alone; the profile of the whole comes from the summaries, never from the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.kinds import (
    CATEGORICAL,
    NUMERIC,
    chunked,
    column_kinds,
    feature_columns,
    present_value,
    quoted,
)
from tablewright.operators.profile import CLASSIFICATION, REGRESSION, drop_null_target
from tablewright.schemas import PROFILE, conform

# Aggregates with sketches are wide: fewer columns go into one than in a plain profile.
COLUMNS_PER_PASS = 40
TARGET = "target"

COLUMN_SUMMARY = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("task_type", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_present", T.LongType()),
        T.StructField("n_numbers", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("spread", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("values", T.BinaryType()),
        T.StructField("quantiles", T.BinaryType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("part", T.StringType()),
    ]
)

CLASS_SUMMARY = T.StructType(
    [
        T.StructField("class", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("part", T.StringType()),
    ]
)


def _column_record(df: DataFrame, name: str, kind: str, task_type: str, nan_is_missing: bool) -> Column:
    value = present_value(df, name, nan_is_missing)
    fields = {
        "column": F.lit(name),
        "kind": F.lit(kind),
        "task_type": F.lit(task_type),
        "n_rows": F.count(F.lit(1)),
        "n_present": F.count(value),
        "values": F.hll_sketch_agg(value.cast("string")),
    }
    if kind == NUMERIC:
        number = value.cast("double")
        fields |= {
            "n_numbers": F.count(number),
            "mean": F.avg(number),
            "spread": F.var_pop(number) * F.count(number),
            "min": F.min(number),
            "max": F.max(number),
            "quantiles": F.kll_sketch_agg_double(number),
        }
    return F.struct(
        *[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in COLUMN_SUMMARY.fields[:-2]])


def summarize_columns(
    df: DataFrame, target: str, task_type: str, name: str, part: Column, nan_is_missing: bool = True,
    skip: tuple[str, ...] = (),
) -> DataFrame:
    """One row per part and column, the target as a column of kind ``target``.

    ``part`` names the part a row belongs to, so many parts are summed up in one pass. Rows
    without a target are left out, as in ``profile``; columns in ``skip`` are no features.
    """
    if task_type not in (CLASSIFICATION, REGRESSION):
        raise ValueError(f"unknown task type {task_type!r}")
    base = drop_null_target(df, target)
    kinds = {c: k for c, k in column_kinds(df, feature_columns(df, target)).items() if c not in skip}
    kinds[target] = TARGET
    parts = []
    for chunk in chunked(list(kinds), COLUMNS_PER_PASS):
        records = F.array(*[_column_record(base, c, kinds[c], task_type, nan_is_missing) for c in chunk])
        grouped = base.groupBy(part.cast("string").alias("_part")).agg(records.alias("_records"))
        parts.append(grouped.select(F.inline("_records"), F.lit(name).alias("dataset_name"), F.col("_part").alias("part")))
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result


def summarize_classes(df: DataFrame, target: str, name: str, part: Column) -> DataFrame:
    """Rows per part and target value."""
    counts = drop_null_target(df, target).groupBy(
        part.cast("string").alias("part"), quoted(target).cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.select("class", "n", F.lit(name).alias("dataset_name"), "part")


def store_summaries(
    df: DataFrame, path: str, target: str, task_type: str, name: str, part: Column, **options
) -> None:
    """Add the summaries of the parts in ``df`` to the store at ``path``.

    A part lies in a folder of its own, which is overwritten when the part is stored again, so a
    rerun after a failure counts nothing twice. Parts that ``df`` does not hold stay as they are.
    """
    tables = {"columns": summarize_columns(df, target, task_type, name, part, **options)}
    if task_type == CLASSIFICATION:
        tables["classes"] = summarize_classes(df, target, name, part)
    for folder, table in tables.items():
        (table.repartition("dataset_name", "part").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic")
         .partitionBy("dataset_name", "part").parquet(f"{path}/{folder}"))


def read_summaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Column summaries and class counts of all parts stored at ``path``."""
    columns = spark.read.schema(COLUMN_SUMMARY).parquet(f"{path}/columns")
    try:
        classes = spark.read.schema(CLASS_SUMMARY).parquet(f"{path}/classes")
    except Exception as error:  # a store of regression tables has no class counts
        if "PATH_NOT_FOUND" not in str(error):
            raise
        classes = spark.createDataFrame([], CLASS_SUMMARY)
    return columns, classes


def merge_columns(columns: DataFrame) -> DataFrame:
    """One row per dataset and column: the moments, extremes and sketches of all its parts.

    Squared deviations are moved to the common mean before they are added, which stays exact
    where a difference of sums of squares would cancel. ``n_distinct`` comes from merged
    HyperLogLog sketches and ``median`` from merged quantile sketches; all else is exact.
    """
    keys = ["dataset_name", "column"]
    means = columns.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("mean") * F.col("n_numbers")), F.sum("n_numbers")).alias("centre"))
    moved = columns.join(means, keys)
    away = F.col("mean") - F.col("centre")
    merged = moved.groupBy(*keys).agg(
        F.max("kind").alias("kind"),
        F.max("task_type").alias("task_type"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_present").alias("n_present"),
        F.coalesce(F.sum("n_numbers"), F.lit(0)).alias("n"),
        F.first("centre", ignorenulls=True).alias("mean"),
        F.sum(F.col("spread") + F.col("n_numbers") * away * away).alias("_spread"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("n_distinct"),
        F.kll_merge_agg_double("quantiles").alias("_quantiles"),
    )
    return merged.select(
        *keys, "kind", "task_type", "n_rows", "n_present", "n", "mean",
        F.when(F.col("n") > 1, F.col("_spread") / (F.col("n") - 1)).alias("variance"),
        "min", "max", "n_distinct",
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_quantiles", F.lit(0.5))).alias("median"),
    )


def merge_profiles(columns: DataFrame, classes: DataFrame) -> DataFrame:
    """Profiles of all stored datasets, equal to ``profile`` of their whole tables.

    A column that a part lacks counts as missing in all rows of that part. A column whose kind
    changes between parts takes the one that comes last in the alphabet, numeric before other.
    """
    merged = merge_columns(columns)
    feature = F.col("kind") != TARGET
    numeric = feature & (F.col("kind") == NUMERIC)
    per_set = merged.groupBy("dataset_name").agg(
        F.max("task_type").alias("task_type"),
        F.max(F.when(~feature, F.col("n_rows"))).alias("n_rows"),
        F.count_if(feature).cast("int").alias("n_features"),
        F.sum(F.when(feature, F.col("n_present")).otherwise(0)).alias("_present"),
        F.count_if(feature & (F.col("kind") == CATEGORICAL)).alias("_texts"),
        F.coalesce(F.round(F.avg(F.when(numeric, F.col("variance"))), 4), F.lit(0.0)).alias("feature_variance"),
    )
    totals = classes.groupBy("dataset_name", "class").agg(F.sum("n").alias("n"))
    shares = totals.groupBy("dataset_name").agg(
        F.round(F.min("n") / F.sum("n"), 4).alias("class_imbalance"), F.count(F.lit(1)).alias("n_classes"))
    cells = F.col("n_rows") * F.col("n_features")
    rows = per_set.join(shares, "dataset_name", "left").select(
        "*",
        F.coalesce(F.round(F.try_divide(cells - F.col("_present"), cells), 4), F.lit(0.0)).alias("missing_ratio"),
        F.coalesce(F.round(F.try_divide("_texts", "n_features"), 4), F.lit(0.0)).alias("categorical_ratio"),
        F.current_timestamp().alias("timestamp"),
        F.lit(columns.sparkSession.version).alias("spark_version"),
    )
    return conform(rows, PROFILE)
