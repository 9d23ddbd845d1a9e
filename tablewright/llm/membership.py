"""Thin out a large table before it is shuffled to a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.session import materialize

BITS = 23  # 131,072 words of 64 bits: the broadcast is 2 MB, however many keys there are


def mark_possible(rows: DataFrame, column: str, keys: DataFrame, key: str, mark: str) -> DataFrame:
    """``rows`` with ``mark``: false only where ``column`` does not occur in ``keys[key]``.

    One bit per hash value of the keys, packed into a table of a fixed number of words that
    every executor can hold. The more keys, the more other rows are marked. Null never is.
    """
    def place(name: str):
        return F.shiftrightunsigned(F.xxhash64(F.col(name).cast("string")), 64 - BITS)

    words = _words(keys.filter(F.col(key).isNotNull()), place(key))
    marked = rows.withColumn("_place", F.when(F.col(column).isNotNull(), place(column)))
    found = marked.join(F.broadcast(words), F.shiftrightunsigned("_place", 6) == F.col("_word"), "left")
    bit = F.expr("shiftrightunsigned(_bits, cast(_place & 63 as int)) & 1")
    return found.select(*rows.columns, F.coalesce(bit == 1, F.lit(False)).alias(mark))


def _words(keys: DataFrame, place: Column) -> DataFrame:
    marks = keys.select(
        F.shiftrightunsigned(place, 6).alias("_word"), place.bitwiseAND(F.lit(63)).cast("int").alias("_at"))
    return materialize(marks.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _at))").alias("_bits")), "filter")


def possibly_in(rows: DataFrame, column: str, keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """Rows whose ``column`` may occur in ``keys[key]``: all that do, and some that do not.

    One bit per hash value of the keys, packed into a table of a fixed number of words that
    every executor can hold. The more keys, the more other rows pass; the join that follows
    decides; ``bits`` makes a larger table, of 2 ** ``bits`` bits. Null never passes.
    """
    def place(name: str):
        return F.shiftrightunsigned(F.xxhash64(F.col(name).cast("string")), 64 - bits)

    words = _words(keys.filter(F.col(key).isNotNull()), place(key))
    marked = rows.filter(F.col(column).isNotNull()).withColumn("_place", place(column))
    found = marked.join(F.broadcast(words), F.shiftrightunsigned("_place", 6) == F.col("_word"))
    bit = F.expr("shiftrightunsigned(_bits, cast(_place & 63 as int)) & 1")
    return found.filter(bit == 1).select(rows.columns)
