"""Mix sources to target weights: hash order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.columns import inner_names, make_room
from tablewright.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
WEIGHTS = (5, 2, 1)  # by the order of the sources, repeating
SHARE = 1.5  # of all words
MOST = 2  # times a source's size, and a document's
RESULTS = ("size", "source_size", "target", "taken")
CELL_DIGITS = 4  # hex digits that name a range of the random order within each source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """Add ``target`` to rows of ``source, source_size``, one per source.

    Sources in code point order, null last, weigh 5, 2, 1, repeating. A source gets
    ``level * weight``, but at most twice its size; the level that spends the whole budget
    is found in closed form. In the order of size by weight, the sources that reach their
    bound come first, and the level follows from what is left when they are paid. Same
    result as handing out the excess again and again.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    index = F.pmod(F.row_number().over(place) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (index + 1).cast("int"))
    bound = F.col("source_size") * float(MOST)
    filling = Window.orderBy(F.col("_bound") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = F.col("_left") / F.col("_open")
    rows = sources.withColumns({"_weight": weight, "_bound": bound})
    rows = rows.withColumns({
        "_left": F.sum("source_size").over(whole) * SHARE - F.coalesce(F.sum("_bound").over(before), F.lit(0.0)),
        "_open": F.sum("_weight").over(onward),
    })
    # The first source that stays below its bound sets the level for all after it: from
    # there on the quotient only falls, so it is the largest.
    rows = rows.withColumn("_level", F.max(
        F.when(level * F.col("_weight") <= F.col("_bound"), level)).over(whole))
    target = F.when(F.col("_level").isNull(), F.col("_bound")).otherwise(
        F.least(F.col("_bound"), F.col("_level") * F.col("_weight")))
    return rows.select("source", "source_size", target.alias("target"))


@inner_names("_size", "_key", "_cell", "_tie", "_offset", "_source_size", "_target", "_before")
def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: int = 11, prefix: str = "",
) -> DataFrame:
    """Add ``size, source_size, target, taken`` (each after ``prefix``): the words of each
    document and source, the words the source should give, and those of this document that
    the mix takes.

    Each source is put in the random order of a seeded hash of the id (ties by the text's hash).
    The order is cut into cells, every cell is totalled, and running totals of the cells of a source
    give each cell its offset; only the rows of one cell are sorted together. A
    source gives all its documents as often as its target holds its size, then the
    remainder in that order, the last document cut at the exact word. A source or text that is
    null, empty or repeated is as any other; equal rows stand next to each other in the order.
    A source without words has target 0. Extra columns are kept, but for those with the names
    of the results, which are replaced.
    """
    docs = make_room(docs, *[prefix + name for name in RESULTS])
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    cell = F.struct(F.col(source_col).alias("source"), F.substring(key, 1, CELL_DIGITS).alias("cell"))
    rows = docs.withColumns({
        "_size": word_count(F.col(text_col)), "_key": key, "_cell": cell,
        "_tie": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    cells = materialize(rows.groupBy("_cell").agg(F.sum("_size").alias("words")), "cells")
    sources = cells.groupBy(F.col("_cell.source").alias("source")).agg(F.sum("words").alias("source_size"))
    sources = materialize(source_targets(sources), "targets")
    cells = cells.select("_cell", F.col("_cell.source").alias("source"), F.col("_cell.cell").alias("cell"), "words")
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("_offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    offsets = offsets.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    offsets = materialize(offsets.select(
        "_cell", "_offset", F.col("source_size").alias("_source_size"), F.col("target").alias("_target")),
        "offsets")
    # Both sides hash the same struct (the cast gives equal nullability), so one shuffle
    # serves the join and the window.
    typed = F.col("_cell").cast(offsets.schema["_cell"].dataType)
    inside = Window.partitionBy("_cell").orderBy("_key", "_tie", id_col).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_cell", typed).join(offsets, "_cell")
    before = F.col("_offset") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    budget = F.round("_target").cast("long")
    epochs = F.when(F.col("_source_size") > 0, F.floor(budget / F.greatest("_source_size", F.lit(1)))).otherwise(0)
    rest = budget - epochs * F.col("_source_size")
    part = F.greatest(F.lit(0), F.least("_size", rest - F.col("_before")))
    return placed.withColumn("_before", before).select(
        *docs.columns, F.col("_size").alias(f"{prefix}size"),
        F.col("_source_size").alias(f"{prefix}source_size"), F.col("_target").alias(f"{prefix}target"),
        (epochs * F.col("_size") + part).cast("long").alias(f"{prefix}taken"))


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its ``count``-th word, white space kept."""
    return F.array_join(F.slice(F.split(text, WORD_END), F.lit(1), count.cast("int")), "")


@inner_names("_cut", "_cut_text")
def mixed_rows(
    mixed: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", prefix: str = ""
) -> DataFrame:
    """The mix itself: a whole row for every full take of a document, then one cut to the rest.

    Input is the result of ``mix_sources`` with the same ``prefix``; its four columns are
    dropped. Documents of which no word is taken are left out, so documents without words are too.
    """
    names = [c for c in mixed.columns if c not in [prefix + name for name in RESULTS]]
    taken, size = F.col(f"{prefix}taken"), F.col(f"{prefix}size")
    full = F.floor(taken / F.greatest(size, F.lit(1))).cast("int")
    rest = taken - full * size
    takes = F.concat(
        F.array_repeat(F.lit(0).cast("long"), full),
        F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    rows = mixed.filter(taken > 0).select(*names, F.explode(takes).alias("_cut"))
    cut = F.when(F.col("_cut") > 0, first_words(F.col(text_col), F.col("_cut"))).otherwise(F.col(text_col))
    rows = rows.withColumn("_cut_text", cut)
    changed = {text_col: F.col("_cut_text")}
    if length_col in names:
        length = F.when(F.col("_cut") > 0, F.length("_cut_text")).otherwise(F.col(length_col))
        changed[length_col] = length.cast(mixed.schema[length_col].dataType)
    return rows.withColumns(changed).select(names)
