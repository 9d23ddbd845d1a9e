"""Fixed record layouts shared by sources, operators and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE = T.StructType(
    [
        T.StructField("dataset_name", T.StringType()),
        T.StructField("task_type", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_features", T.IntegerType()),
        T.StructField("missing_ratio", T.DoubleType()),
        T.StructField("categorical_ratio", T.DoubleType()),
        T.StructField("class_imbalance", T.DoubleType()),
        T.StructField("feature_variance", T.DoubleType()),
        T.StructField("n_classes", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("spark_version", T.StringType()),
    ]
)

RESULT = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("f1_macro", T.DoubleType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("auc_roc", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("train_time_s", T.DoubleType()),
        T.StructField("n_pipeline_stages", T.IntegerType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

FAILURE = T.StructType(
    [
        *RESULT.fields[:4],
        T.StructField("error", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

SCALING = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("size_mb", T.DoubleType()),
        T.StructField("spark_profiling_time_s", T.DoubleType()),
        T.StructField("method", T.StringType()),
        T.StructField("f1_macro", T.DoubleType()),
        T.StructField("train_time_s", T.DoubleType()),
    ]
)

SPEC = T.StructType(
    [
        T.StructField("preprocessing", T.ArrayType(T.StringType())),
        T.StructField("model", T.StringType()),
        T.StructField("hyperparameters", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("reasoning", T.StringType()),
    ]
)

LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("profile", PROFILE),
        T.StructField("prompt", T.StringType()),
        T.StructField("raw_response", T.StringType()),
        T.StructField("spec", SPEC),
        T.StructField("timestamp", T.TimestampType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: cast present fields, null the absent ones."""
    present = set(df.columns)

    def pick(field: T.StructField) -> Column:
        source = F.col(field.name) if field.name in present else F.lit(None)
        return source.cast(field.dataType).alias(field.name)

    return df.select(*[pick(field) for field in schema.fields])
