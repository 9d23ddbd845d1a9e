"""Table and log readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.schemas import LOG


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet by suffix, otherwise CSV with a header.

    With a ``schema`` the CSV inference pass over the data is skipped.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if schema:
        return spark.read.csv(path, header=True, schema=schema)
    return spark.read.csv(path, header=True, inferSchema=True)


def read_headerless(
    spark: SparkSession,
    path: str,
    n_features: int | None = None,
    positive: str = "g",
) -> DataFrame:
    """CSV without a header: columns ``f1..fn`` and a 0/1 ``label``.

    The last field is 1 where it reads ``positive``. Blank lines are skipped.
    Giving ``n_features`` fixes the layout and saves the inference pass.
    """
    if n_features is not None:
        fields = [T.StructField(f"f{i}", T.DoubleType()) for i in range(1, n_features + 1)]
        layout = T.StructType([*fields, T.StructField("label", T.StringType())])
        raw = spark.read.csv(path, header=False, schema=layout)
    else:
        raw = spark.read.csv(path, header=False, inferSchema=True)
        names = [f"f{i}" for i in range(1, len(raw.columns))] + ["label"]
        raw = raw.toDF(*names)
    flag = F.when(F.trim(F.col("label").cast("string")) == positive, 1).otherwise(0)
    return raw.withColumn("label", flag)


def select_or_default(df: DataFrame, names: list[str], default: str = "") -> DataFrame:
    """The named columns in order; a name the table lacks becomes ``default``."""
    present = set(df.columns)
    return df.select(
        *[F.col(name) if name in present else F.lit(default).alias(name) for name in names]
    )


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Lift struct fields to top-level columns named ``parent_child``."""
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StructType):
            columns += [
                F.col(f"{field.name}.{child}").alias(f"{field.name}{separator}{child}")
                for child in field.dataType.names
            ]
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def read_log(spark: SparkSession, path: str, schema: T.StructType = LOG) -> DataFrame:
    """Decision log: JSON lines, blank and malformed lines skipped, fields flattened."""
    raw = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    return flatten(raw)
