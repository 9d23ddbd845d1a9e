"""How filters act on each other: what every order of them removes, by intervals of ranked orders."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tablewright.session import materialize

BLANK = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 50  # fewer fail filter A
DISTINCT_PERCENT = 65  # a smaller share of distinct words fails filter B
CAPITAL_PERCENT = 5  # a larger share of A-Z among the code points fails filter C
SYMBOLS = r"[#$%&*|]"  # any of them fails filter D
FILTERS = "ABCDE"  # E: the text of a smaller id again
COUNTS = ("n", "good", "toxic")


def lehmer_rank(prefix: tuple[int, ...], size: int) -> int:
    """Place, among all orders of ``size`` filters in lexicographic order, of the first order
    that begins with ``prefix``: its Lehmer code read in the factorial number system."""
    rank = 0
    for place, item in enumerate(prefix):
        smaller = item - sum(earlier < item for earlier in prefix[:place])
        rank += smaller * factorial(size - 1 - place)
    return rank


def removal_edges(size: int) -> Iterator[tuple[int, int, int, int]]:
    """Rows ``(mask, step, rank, change)``: the ends of the intervals of orders in which a
    document that fails the filters of ``mask`` is removed at ``step``.

    All orders that share a prefix are neighbours in lexicographic order. A document goes at
    step k in the orders whose first k-1 filters pass it and whose k-th does not, so every
    such prefix adds +1 where its interval starts and -1 where it ends. Touching ends
    cancel; an end after the last order is left out.
    """
    for mask in range(1, 1 << size):
        passing = [f for f in range(size) if not mask >> f & 1]
        failing = [f for f in range(size) if mask >> f & 1]
        for step in range(1, len(passing) + 2):
            width = factorial(size - step)
            change: dict[int, int] = {}
            for before in permutations(passing, step - 1):
                for last in failing:
                    start = lehmer_rank((*before, last), size)
                    change[start] = change.get(start, 0) + 1
                    change[start + width] = change.get(start + width, 0) - 1
            for rank, value in sorted(change.items()):
                if value and rank < factorial(size):
                    yield mask, step, rank, value


def document_failures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """``doc_id, part, mask``, one row per row of ``docs``: bit i is set if filter i of ``ABCDE`` fails.

    A: under 50 words; B: distinct words under 65 % of the words; C: more than 5 % of the code
    points are A-Z; D: a character of ``#$%&*|``; E: a row of a smaller id has the same
    text. Null texts count as empty, a null part as the empty string. Rows of equal id do not fail E
    by each other; a row without an id neither fails E nor makes others fail. Texts are
    compared by SHA-256. The first id of a text is found by an aggregate with map-side
    combination and handed back by text and id together, so a text that a third of all rows
    share is no hot key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = F.split(text, BLANK)
    blank_first = F.element_at("_pieces", 1) == ""
    blank_last = (F.size("_pieces") > 1) & (F.element_at("_pieces", -1) == "")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text.alias("_text"), pieces.alias("_pieces"))
    n_words = F.size("_pieces") - blank_first.cast("int") - blank_last.cast("int")
    n_distinct = F.size(F.array_distinct("_pieces")) - (blank_first | blank_last).cast("int")
    capitals = F.length(F.regexp_replace("_text", "[^A-Z]+", ""))
    fails = [
        n_words < LEAST_WORDS,
        n_distinct.cast("long") * 100 < n_words.cast("long") * DISTINCT_PERCENT,
        capitals.cast("long") * 100 > F.length("_text").cast("long") * CAPITAL_PERCENT,
        F.col("_text").rlike(SYMBOLS),
    ]
    narrow = rows.select(
        "doc_id", "part", _mask(fails).alias("mask"), F.unhex(F.sha2("_text", 256)).alias("_key"))
    narrow = materialize(narrow, "filters")
    first = narrow.groupBy("_key").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    found = narrow.join(first, ["_key", "doc_id"], "left")
    again = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    return found.select("doc_id", "part", (F.col("mask") + again.cast("int") * 16).alias("mask"))


def _mask(fails: list[Column]) -> Column:
    bits = [fail.cast("int") * (1 << i) for i, fail in enumerate(fails)]
    return sum(bits[1:], bits[0])


def with_labels(failures: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add ``good`` and ``toxic``: whether any label row of the id says quality 1 or toxic 1."""
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"),
        F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    return failures.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])


def audit_filters(failures: DataFrame, names: str = FILTERS) -> DataFrame:
    """What each filter removes at each step of every order of the filters.

    ``failures`` has ``part, mask, good, toxic`` (see ``document_failures``, ``with_labels``), one row per
    document; ``names`` has a letter per bit of the mask. One row per part, order and step comes back:
    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``,
    cells without any document included; an empty table gives no rows.

    The documents are first counted by part and mask, which is all that the rest sees. Each mask
    meets the ends of its intervals (``removal_edges``, a fixed table for a number
    of filters), the changes are added per part, step and rank, and running sums over the
    ranks of a part and step give the removals.
    """
    size = len(names)
    spark = failures.sparkSession
    counts = failures.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts, "masks")
    schema = StructType([StructField(name, IntegerType(), False) for name in ("mask", "step", "rank")]
                        + [StructField("change", LongType(), False)])
    edges = spark.createDataFrame(list(removal_edges(size)), schema)  # 1,100 rows for five filters
    changes = counts.join(F.broadcast(edges), "mask").select(
        "part", "step", "rank", *[(F.col(name) * F.col("change")).alias(name) for name in COUNTS])

    def of_filter(condition) -> Column:
        return F.array(*[F.sum(F.when(condition(i), F.col("n")).otherwise(0)) for i in range(size)])

    parts = counts.groupBy("part").agg(
        F.sum("n").alias("_all"),
        of_filter(lambda i: F.col("mask").bitwiseAND(1 << i) != 0).alias("_fails"),
        of_filter(lambda i: F.col("mask") == (1 << i)).alias("_only"))
    cells = (
        parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
        .select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(factorial(size) - 1))).alias("rank")))
    changes = changes.unionByName(cells.select("*", *[F.lit(0).cast("long").alias(name) for name in COUNTS]))
    changes = changes.groupBy("part", "step", "rank").agg(*[F.sum(name).alias(name) for name in COUNTS])

    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    gone = changes.select("part", "step", "rank", *[F.sum(name).over(along).alias(name) for name in COUNTS])
    orders = ["".join(order) for order in permutations(names)]
    gone = gone.withColumn("filter_order", F.element_at(F.lit(orders), F.col("rank") + 1))
    gone = gone.withColumn("_filter", F.instr(F.lit(names), F.substr("filter_order", F.col("step"), F.lit(1))))
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    of_one = Window.partitionBy("part", "_filter")
    gone = gone.withColumns({
        "_gone": F.sum("n").over(so_far), "shapley": F.sum("n").over(of_one)}).join(parts, "part")
    return gone.select(
        "part", "filter_order", "step", (F.col("_all") - F.col("_gone")).alias("kept"), F.col("n").alias("removed"),
        (F.element_at("_fails", F.col("_filter")) - F.col("n")).alias("redundant"),
        F.element_at("_only", F.col("_filter")).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
