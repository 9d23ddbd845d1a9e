"""Exact quantiles of many columns without holding a column in one task."""

from __future__ import annotations

from functools import reduce
from math import ceil, floor, isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.kinds import chunked, present_value

ACCURACY = 10_000
CELLS = 4_096  # equal cells of a bracket that are counted to narrow it
MAX_BRACKET_ROWS = 1_000_000
MAX_ROUNDS = 6


class _Bracket:
    """Value interval known to hold the wanted order statistics of one column."""

    def __init__(self, low: float, high: float, below: int, inside: int, first: int, last: int):
        self.low, self.high = low, high
        self.below, self.inside = below, inside
        self.first, self.last = first, last  # wanted ranks, 1-based
        self.uneven = not isfinite(high - low)  # equal cells do not narrow it

    def covers(self, below: int, inside: int) -> bool:
        return below < self.first and self.last <= below + inside


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probability: float = 0.5,
    nan_is_missing: bool = True,
    max_bracket_rows: int = MAX_BRACKET_ROWS,
) -> dict[str, float | None]:
    """Interpolated quantile of each column; null where a column has no value.

    Counts of equal cells narrow each column to a bracket around the wanted rank, or a sketch where most rows
    lie in a few cells; a counting pass proves the bracket holds it, and only bracket rows, counted per value,
    are ordered. The driver sees a count per cell and a few numbers per column and pass.
    """
    result: dict[str, float | None] = {}
    for chunk in chunked(columns, 50):
        result.update(_chunk_quantiles(df, chunk, probability, nan_is_missing, max_bracket_rows))
    return result


def _chunk_quantiles(df, columns, probability, nan_is_missing, max_rows):
    value = {c: present_value(df, c, nan_is_missing).cast("double") for c in columns}
    first = df.agg(
        *[
            F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).alias(f"s{i}")
            for i, v in enumerate(value.values())
        ]
    ).first()
    brackets: dict[str, _Bracket] = {}
    for i, c in enumerate(columns):
        stats = first[f"s{i}"]
        if stats["n"]:
            position = probability * (stats["n"] - 1)
            brackets[c] = _Bracket(
                stats["low"], stats["high"], 0, stats["n"], floor(position) + 1, ceil(position) + 1
            )
    for _ in range(MAX_ROUNDS):
        wide = [c for c, b in brackets.items() if b.inside > max_rows and b.low < b.high]
        if not wide or not _narrow(df, value, brackets, wide):
            break
    found = _order_statistics(df, value, brackets)
    result: dict[str, float | None] = {c: None for c in columns}
    for c, b in brackets.items():
        low, high = found[c]
        count = first[f"s{columns.index(c)}"]["n"]
        position = probability * (count - 1)
        result[c] = low + (high - low) * (position - floor(position))
    return result


def _inside(v: Column, b: _Bracket) -> Column:
    return v.between(F.lit(b.low), F.lit(b.high))


def _cells(df, value, brackets, columns) -> dict[str, tuple[float, float]]:
    """Bounds of the cells of each bracket that hold the wanted ranks."""
    parts = []
    for i, c in enumerate(columns):
        b = brackets[c]
        cell = F.least(F.floor((value[c] - F.lit(b.low)) / F.lit(b.high - b.low) * CELLS), F.lit(CELLS - 1))
        parts.append(F.struct(F.lit(i).alias("i"), F.when(_inside(value[c], b), cell.cast("int")).alias("cell")))
    counted = df.select(F.inline(F.array(*parts))).filter("cell IS NOT NULL").groupBy("i", "cell").count()
    counts: list[dict[int, int]] = [{} for _ in columns]
    for row in counted.collect():  # a row per column and cell
        counts[row["i"]][row["cell"]] = row["count"]
    found = {}
    for c, own in zip(columns, counts):
        b, upto, held = brackets[c], brackets[c].below, []
        for cell in sorted(own):
            if upto < b.last and upto + own[cell] >= b.first:
                held.append(cell)
            upto += own[cell]
        step = (b.high - b.low) / CELLS
        if held and step > 0:
            # A little wider than the cells, whose bounds are rounded.
            found[c] = max(b.low, b.low + (held[0] - 0.01) * step), min(b.high, b.low + (held[-1] + 1.01) * step)
    return found


def _sketched(df, value, brackets, columns) -> dict[str, tuple[float, float]]:
    margin = 3 / ACCURACY
    probes = []
    for i, c in enumerate(columns):
        b = brackets[c]
        low = max(0.0, (b.first - b.below) / b.inside - margin)
        high = min(1.0, (b.last - b.below) / b.inside + margin)
        probes.append(
            F.percentile_approx(F.when(_inside(value[c], b), value[c]), [low, high], ACCURACY).alias(f"q{i}")
        )
    guesses = df.agg(*probes).first()
    return {c: tuple(guesses[f"q{i}"]) for i, c in enumerate(columns)}


def _narrow(df, value, brackets, columns) -> bool:
    """Shrink the brackets of ``columns``; false when nothing more can move them."""
    even = [c for c in columns if not brackets[c].uneven]
    uneven = [c for c in columns if brackets[c].uneven]
    guesses = _cells(df, value, brackets, even) if even else {}
    if uneven:
        guesses.update(_sketched(df, value, brackets, uneven))
    moved = False
    tallies = []
    for i, (c, (low, high)) in enumerate(guesses.items()):
        within = value[c].between(F.lit(low), F.lit(high))
        inside = F.when(within, value[c])
        tallies += [
            F.count_if(value[c] < F.lit(low)).alias(f"b{i}"), F.count_if(within).alias(f"i{i}"),
            F.min(inside).alias(f"l{i}"), F.max(inside).alias(f"h{i}")]
    counted = df.agg(*tallies).first() if tallies else None
    for c in even:
        brackets[c].uneven = True  # until its cells have narrowed it well
    for i, c in enumerate(guesses):
        b = brackets[c]
        below, inside = counted[f"b{i}"], counted[f"i{i}"]
        if b.covers(below, inside) and inside < b.inside:
            b.uneven = b.uneven and inside > b.inside // 8
            # The values found inside are narrower than the guess; a value alone is the answer.
            b.low, b.high, b.below, b.inside = counted[f"l{i}"], counted[f"h{i}"], below, inside
            moved = True
    return moved or bool(even)


def _order_statistics(df, value, brackets) -> dict[str, tuple[float, float]]:
    found = {c: (b.low, b.high) for c, b in brackets.items() if b.low == b.high}
    open_columns = [c for c in brackets if c not in found]
    if not open_columns:
        return found
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.when(_inside(value[c], brackets[c]), value[c]).alias("v"))
            for i, c in enumerate(open_columns)
        ]
    )
    near = reduce(Column.__or__, [F.coalesce(_inside(value[c], brackets[c]), F.lit(False)) for c in open_columns])
    counts = (
        df.filter(near)
        .select(F.inline(cells))
        .filter(F.col("v").isNotNull())
        .groupBy("i", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("v"))
    wanted_first = F.element_at(F.array(*[F.lit(brackets[c].first - brackets[c].below) for c in open_columns]), F.col("i") + 1)
    wanted_last = F.element_at(F.array(*[F.lit(brackets[c].last - brackets[c].below) for c in open_columns]), F.col("i") + 1)
    rows = (
        counts.withColumn("upto", upto)
        .groupBy("i")
        .agg(
            F.min(F.when(F.col("upto") >= wanted_first, F.col("v"))).alias("low"),
            F.min(F.when(F.col("upto") >= wanted_last, F.col("v"))).alias("high"),
        )
        .collect()
    )
    for row in rows:
        found[open_columns[row["i"]]] = (row["low"], row["high"])
    return found
