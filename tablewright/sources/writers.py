"""Result, log and table sinks. All of them append or write to a new path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.schemas import LOG, RESULT, conform

LOG_FILE_ROWS = 1_000_000  # a compressed file is read by one task


def append_results(
    df: DataFrame, path: str, schema: T.StructType = RESULT, fmt: str = "parquet"
) -> None:
    """Append rows in the fixed layout; fields ``df`` lacks are written as null."""
    rows = conform(df, schema)
    if fmt == "csv":
        rows.write.mode("append").csv(path, header=True)
    else:
        rows.write.mode("append").format(fmt).save(path)


def read_results(
    spark: SparkSession, path: str, schema: T.StructType = RESULT, fmt: str = "parquet"
) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)


def without_keys(existing: DataFrame, replaced: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``existing`` whose key is not among the keys of ``replaced``."""
    return existing.join(replaced.select(*keys).distinct(), keys, "left_anti")


def replace_rows(existing: DataFrame, new_rows: DataFrame, keys: list[str], path: str) -> None:
    """Swap all rows that share a key with ``new_rows``; the outcome goes to a new path."""
    kept = without_keys(existing, new_rows, keys)
    kept.unionByName(conform(new_rows, existing.schema)).write.parquet(path)


def write_log(df: DataFrame, path: str, schema: T.StructType = LOG) -> None:
    """Append one nested JSON record per decision, to compressed files of bounded length."""
    rows = conform(df, schema).write.mode("append").option("maxRecordsPerFile", LOG_FILE_ROWS)
    rows.json(path, compression="gzip")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def store_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("append").json(path)


def unstored(requested: DataFrame, stored: DataFrame, name: str = "dataset_name") -> DataFrame:
    """Requested dataset names that have no stored profile yet."""
    return requested.join(stored.select(name).distinct(), name, "left_anti").select(
        F.col(name)
    )
