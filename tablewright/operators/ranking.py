"""Ranks and running totals that no single task has to compute alone.

A window without partition keys moves every row to one task. Here the ordering column
is cut into value ranges, ranges are totalled, the short table of totals is summed up,
and only the rows of one range are ordered together. A range is a function of the row's
value, so a rerun task puts every row where the lost one did.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.session import materialize

TEXTS_PER_RANGE = 200  # texts drawn for each range whose bounds are sought


def _text_range(df: DataFrame, value: str, ranges: int) -> Column:
    """The range of a text: how many bounds it reaches.

    Bounds are whole texts, so neither a long beginning that most share nor a few texts without it
    upset them. They are quantiles of about ``TEXTS_PER_RANGE`` rows a range, drawn by a hash of the
    row; the driver receives the bounds alone. They decide how even ranges are, never the order.
    """
    drawing = F.pmod(F.xxhash64(*df.columns), F.lit(1_000_000)).alias("drawing")
    known = df.select(F.col(value).alias("text"), drawing).filter("text is not null")
    share = min(1.0, TEXTS_PER_RANGE * ranges / max(1, known.count()))
    drawn = known.filter(F.col("drawing") < ceil(share * 1_000_000))
    tiles = drawn.select("text", F.ntile(ranges).over(Window.orderBy("text")).alias("tile"))
    bounds = sorted({row["low"] for row in tiles.groupBy("tile").agg(F.min("text").alias("low")).filter("tile > 1").collect()},
                    key=lambda text: text.encode())
    if not bounds:
        return F.lit(0.0)
    table = F.array(*[F.lit(bound) for bound in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    reached = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(bounds)) & (F.get(table, at + step - 1) <= F.col(value)), at + step).otherwise(at))
    return reached.cast("double")


def _place(df: DataFrame, value: str) -> Column:
    """A number that never falls when the value rises; null for null.

    Ranges are cut on it, so it may be equal for different values: those of one range are
    ordered by the value itself.
    """
    kind, column = df.schema[value].dataType, F.col(value)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    return column.cast("double")


def with_range(df: DataFrame, value: str, ranges: int, output: str = "_range") -> DataFrame:
    """Add the number of the value range each row falls in: null lowest, NaN highest.

    One path for every size: with one range the others are simply fewer.
    """
    if isinstance(df.schema[value].dataType, T.StringType):
        number = _text_range(df, value, ranges) if ranges > 1 else F.lit(0.0)
        return df.withColumn(output, F.when(F.col(value).isNull(), F.lit(-1.0)).otherwise(number))
    placed = df.withColumn("_place", _place(df, value))
    bounds: list[float] = []
    if ranges > 1:
        probabilities = [i / ranges for i in range(1, ranges)]
        known = placed.select("_place").filter("_place is not null and not isnan(_place)")
        found = known.approxQuantile("_place", probabilities, 1 / (4 * ranges))
        bounds = sorted({bound for bound in found if abs(bound) != float("inf")})
    # A bound that no finite value reaches keeps the number of splits legal.
    splits = [float("-inf"), *(bounds or [float("1.7976931348623157e308")]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_place", outputCol=output, handleInvalid="keep")
    numbered = cut.transform(placed)
    return numbered.withColumn(
        output, F.when(F.col("_place").isNull(), F.lit(-1.0)).otherwise(F.col(output))).drop("_place")


def running_totals(
    df: DataFrame,
    order: list[str],
    weights: list[str],
    groups: list[str] | None = None,
    rows_per_range: int = 500_000,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``<weight>_before``: the weight total of all rows ordered before this one.

    ``df`` holds one row per (groups, order); pre-aggregate before calling. Ranges cut
    the first ordering column, which may be a number, text, date or timestamp; null comes
    first and NaN last. Their number follows the rows.
    """
    groups = groups or []
    table = materialize(df, "ordered")
    if ranges is None:
        ranges = max(1, ceil(table.count() / rows_per_range))
    split = with_range(table, order[0], ranges)
    # The cell as one struct: null groups compare equal, and the window and the join
    # below share one shuffle because both hash the same column. No field is a floating
    # number, which either would normalise in its own way and shuffle again.
    split = split.withColumn("_range", F.col("_range").cast("int"))
    split = split.withColumn("_cell", F.struct(*groups, "_range"))
    inside = Window.partitionBy("_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = split.withColumns(
        {f"{w}_before": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights}
    )
    # At most `ranges` rows per group reach this window.
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = split.groupBy(*groups, "_range").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    offsets = totals.select(
        F.struct(*groups, "_range").alias("_cell"),
        *[F.coalesce(F.sum(f"_t_{w}").over(earlier), F.lit(0)).alias(f"_o_{w}") for w in weights],
    )
    return (
        ranked.join(offsets, "_cell")
        .withColumns({f"{w}_before": F.col(f"{w}_before") + F.col(f"_o_{w}") for w in weights})
        .select(*table.columns, *[f"{w}_before" for w in weights])
    )


def value_ranks(
    df: DataFrame, value: str, groups: list[str] | None = None, **options
) -> DataFrame:
    """One row per (groups, value): how often it occurs and its average rank."""
    groups = groups or []
    counts = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, [value], ["n"], groups, **options).withColumn(
        "average_rank", F.col("n_before") + (F.col("n") + 1) / 2
    )


def _exact_key(df: DataFrame, value: str) -> Column:
    """The value in a form that hashes and compares without floating point rules."""
    if isinstance(df.schema[value].dataType, (T.FloatType, T.DoubleType)):
        return (F.col(value) + F.lit(0.0)).cast("string")  # adding 0 makes -0 a plain 0
    return F.col(value)


def distributed_rank(
    df: DataFrame,
    value: str,
    tie: Column,
    groups: list[str] | None = None,
    output: str = "rank",
    tie_digits: int = 3,
    **options,
) -> DataFrame:
    """Ordinal rank 1..n of every row by ``value``, ties by ``md5(tie)``.

    A value shared by very many rows is split by the leading digits of the digest, so
    the rows ordered together stay few however uneven the values are.
    """
    groups = groups or []
    keyed = df.withColumn("_digest", F.md5(tie.cast("string"))).withColumn(
        "_part", F.substring("_digest", 1, tie_digits)
    )
    cell = [*groups, value, "_part"]
    counts = keyed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    totals = running_totals(counts, [value, "_part"], ["n"], groups, **options)
    key = F.struct(*groups, _exact_key(df, value).alias("_value"), "_part")
    offsets = totals.select(key.alias("_cell"), "n_before")
    inside = Window.partitionBy("_cell").orderBy("_digest")
    # One shuffle of the rows serves both the window and the join: the cast gives both
    # sides the same field nullability, without which the join would shuffle again.
    typed = key.cast(offsets.schema["_cell"].dataType)
    numbered = keyed.withColumn("_cell", typed).withColumn(
        "_place", F.row_number().over(inside)
    )
    return numbered.join(offsets, "_cell").withColumn(
        output, F.col("n_before") + F.col("_place")
    ).select(*df.columns, output)
