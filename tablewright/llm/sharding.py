"""Shards of near-equal bytes: the minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.columns import inner_names, make_room
from tablewright.session import materialize

FIRST_DIGITS = 3  # hex digits of the cells that are totalled first
MORE_DIGITS = 2  # and by how many a cell is refined
SLOT_DIGITS = 3


@dataclass
class Run:
    """Consecutive groups: those whose digest starts with ``prefix``; ``single`` if one group."""

    prefix: str
    size: int
    single: bool


def _running(sizes: list[int]) -> list[int]:
    totals = [0]
    for size in sizes:
        totals.append(totals[-1] + size)
    return totals


def _fits(totals: list[int], at: int, capacity: int, shards: int) -> bool:
    """Whether ``shards`` of ``capacity``, filled greedily, hold all groups from ``at`` on."""
    for _ in range(shards):
        at = bisect_right(totals, totals[at] + capacity) - 1
    return at == len(totals) - 1


def smallest_capacity(sizes: list[int], shards: int, low: int) -> int:
    """Binary search of the smallest capacity, at least ``low``, that holds everything."""
    totals = _running(sizes)
    high = max(low, totals[-1])
    while low < high:
        middle = (low + high) // 2
        if _fits(totals, 0, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low


def cut_ends(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Ends of the shards as running totals, none larger than ``capacity``.

    Each shard ends as near to an even share of the rest as the capacity allows, as long
    as the shards after it can hold what remains.
    """
    totals = _running(sizes)
    ends, at = [], 0
    for left in range(shards, 1, -1):
        far = bisect_right(totals, totals[at] + capacity) - 1
        aim = totals[at] + (totals[-1] - totals[at]) / left
        near = bisect_right(totals, aim) - 1
        if near + 1 < len(totals) and totals[near + 1] - aim < aim - totals[near]:
            near += 1
        low, high = min(max(near, at), far), far
        while low < high:
            middle = (low + high) // 2
            if _fits(totals, middle, capacity, left - 1):
                high = middle
            else:
                low = middle + 1
        at = low
        ends.append(totals[at])
    return [*ends, totals[-1]]


def _lowest_ends(runs: list[Run], capacity: int, shards: int) -> list[int]:
    """Positions that greedy filling with ``capacity`` reaches at least, runs kept whole."""
    totals = _running([run.size for run in runs])
    ends, at = [], 0
    for _ in range(shards):
        at = bisect_right(totals, totals[at] + capacity) - 1
        ends.append(totals[at])
    return ends


def _open_runs(runs: list[Run], low: int, high: int, shards: int) -> list[int]:
    """Runs of several groups in which some cut may fall for a capacity of ``low`` to ``high``."""
    ends = _lowest_ends(runs, low, shards)
    total = sum(run.size for run in runs)
    even = [(k + 1) * total // shards - high // shards for k in range(shards)]
    spans = [(min(ends[k], even[k]), min((k + 1) * high, total)) for k in range(shards - 1)]
    found, at = [], 0
    for i, run in enumerate(runs):
        if not run.single and any(start < at + run.size and at < end for start, end in spans):
            found.append(i)
        at += run.size
    return found


def _totals(groups: DataFrame, digits: int, within: list[str] | None) -> list[Run]:
    rows = groups
    if within is not None:
        rows = rows.filter(F.substring("_digest", 1, len(within[0])).isin(within))
    cells = rows.groupBy(F.substring("_digest", 1, digits).alias("prefix")).agg(
        F.sum("_bytes").alias("size"), F.count(F.lit(1)).alias("n"), F.min("_digest").alias("first"))
    return [
        Run(r["first"] if r["n"] == 1 else r["prefix"], r["size"], r["n"] == 1)
        for r in sorted(cells.collect(), key=lambda r: r["prefix"])]


def cut_points(groups: DataFrame, shards: int) -> list[str]:
    """Digest of the first group of each shard but the first.

    ``groups`` holds ``_digest`` (hex, in whose order the groups stand) and ``_bytes``.
    The order is seen through cells of equal leading digits. Whole cells bound the
    smallest feasible capacity from above; the mean and the largest group bound it from
    below. Only cells in which a cut can fall between these bounds are refined, until
    every such cell is one group, and then the search is exact. The driver holds the
    totals of 4,096 cells and of the refined ones, a number that does not grow with the rows.
    """
    stats = groups.agg(F.sum("_bytes"), F.max("_bytes")).first()
    if stats[0] is None or shards < 2:
        return []
    low = max(-(-stats[0] // shards), stats[1])
    digits = FIRST_DIGITS
    runs = _totals(groups, digits, None)
    while True:
        high = smallest_capacity([r.size for r in runs], shards, low)
        wanted = _open_runs(runs, low, high, shards)
        if high == low or not wanted:
            break
        level = min(len(runs[i].prefix) for i in wanted)
        within = [runs[i].prefix for i in wanted if len(runs[i].prefix) == level]
        finer: dict[str, list[Run]] = {prefix: [] for prefix in within}
        for run in _totals(groups, level + MORE_DIGITS, within):
            finer[run.prefix[:level]].append(run)
        runs = [new for run in runs
                for new in (finer[run.prefix] if not run.single and run.prefix in finer else [run])]
    ends = cut_ends([r.size for r in runs], high, shards)
    cuts, at = [], 0
    for run in runs:
        while len(cuts) < shards - 1 and ends[len(cuts)] <= at:
            cuts.append(run.prefix)
        at += run.size
    return cuts


def large_groups(groups: DataFrame, shards: int) -> list[str]:
    """Digests of the groups that fill a shard alone: none smaller than an even share of the rest."""
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    alone: list[str] = []
    for row in groups.orderBy(F.desc("_bytes"), "_digest").limit(shards - 1).collect():
        if row["_bytes"] * (shards - len(alone)) <= total or len(alone) == shards - 1:
            break
        alone.append(row["_digest"])
        total -= row["_bytes"]
    return alone


@inner_names("_digest", "_bytes", "_crc", "_shard", "_cell", "_n", "_offset")
def shard_documents(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Add ``size, text_crc32, law, shard, slot, grown_shard`` under the law ``bytes``.

    A group is all rows of equal text (null counts as a text of its own, apart from the empty one)
    and stays whole. Groups stand in the order of their text's digest; they are cut into
    ``shards`` runs so that the largest run is as small as it can be. ``slot``
    numbers the rows of a shard without gaps: rows fall into cells by a hash, running
    totals of the cells give offsets, and only a cell's rows are sorted. Rows equal in
    id and text may swap slots with each other. A group larger than an even share of what is left
    has a shard of its own, and the others share the rest. ``grown_shard`` is null (no key
    law). An empty table gives no rows. Extra columns are kept, but for those with the
    names of the results, which are replaced.
    """
    docs = make_room(docs, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    text = F.col(text_col)
    data = F.coalesce(text, F.lit("")).cast("binary")
    rows = docs.withColumns({
        "_digest": F.when(text.isNull(), F.md5(F.lit("null").cast("binary"))).otherwise(
            F.md5(F.concat(F.lit("text:").cast("binary"), data))),
        "_bytes": (F.octet_length(data) + 1).cast("long"), "_crc": F.crc32(data)})
    groups = rows.groupBy("_digest").agg(F.sum("_bytes").alias("_bytes"))
    groups = materialize(groups, "groups")
    alone = large_groups(groups, shards)
    cuts = cut_points(groups.filter(~F.col("_digest").isin(alone)), shards - len(alone))
    shard = sum((F.when(F.col("_digest") >= cut, 1).otherwise(0) for cut in cuts), F.lit(len(alone)))
    for place, digest in enumerate(alone):
        shard = F.when(F.col("_digest") == digest, place).otherwise(shard)
    cell = F.concat(
        F.lpad(shard.cast("string"), 6, "0"),
        F.substring(F.md5(F.concat_ws(":", F.col("_digest"), F.col(id_col).cast("string"))), 1, SLOT_DIGITS))
    placed = rows.withColumns({"_shard": shard.cast("int"), "_cell": cell})
    counts = materialize(placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")), "cells")
    earlier = Window.partitionBy(F.substring("_cell", 1, 6)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        counts.select("_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")), "offsets")
    inside = Window.partitionBy("_cell").orderBy("_digest", id_col)
    return placed.join(offsets, "_cell").select(
        *docs.columns, F.col("_bytes").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("_shard").alias("shard"),
        (F.col("_offset") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
