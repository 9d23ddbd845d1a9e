"""What role a column's type gives it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, CATEGORICAL, OTHER = "numeric", "categorical", "other"


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, T.StringType):
        return CATEGORICAL
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        raise TypeError(f"nested column type {data_type.simpleString()} is not a table value")
    return OTHER


def column_kinds(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, str]:
    """Kind of each column, read from the schema without running a job."""
    wanted = list(df.columns if columns is None else columns)
    return {name: kind_of(df.schema[name].dataType) for name in wanted}


def feature_columns(df: DataFrame, target: str) -> list[str]:
    """Every column but the target, in table order."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not in the table")
    return [name for name in df.columns if name != target]


def columns_of_kind(df: DataFrame, columns: Iterable[str], kind: str) -> list[str]:
    return [name for name, found in column_kinds(df, columns).items() if found == kind]


def quoted(name: str) -> Column:
    """Column reference that is safe for names holding dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def moments_as_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Dates as days and timestamps as seconds since 1970, so that they serve as features."""
    changed = {}
    for name in columns:
        kind = df.schema[name].dataType
        if isinstance(kind, T.DateType):
            changed[name] = F.unix_date(quoted(name)).cast("double")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            changed[name] = F.unix_micros(quoted(name).cast("timestamp")) / 1_000_000
    return df.withColumns(changed) if changed else df


def present_value(df: DataFrame, name: str, nan_is_missing: bool = True) -> Column:
    """The column with NaN turned into null where NaN counts as missing."""
    column = quoted(name)
    data_type = df.schema[name].dataType
    if nan_is_missing and isinstance(data_type, (T.FloatType, T.DoubleType)):
        # One reference to the column, so that chained steps stay one flat expression.
        return F.nanvl(column, F.lit(None).cast(data_type))
    return column


def chunked(names: list[str], size: int) -> list[list[str]]:
    return [names[start : start + size] for start in range(0, len(names), size)]


def add_all(terms: list[Column]) -> Column:
    """Sum of the terms as a balanced tree, so wide tables stay shallow."""
    if not terms:
        return F.lit(0)
    while len(terms) > 1:
        paired = [a + b for a, b in zip(terms[::2], terms[1::2])]
        terms = paired + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]
