"""Fingerprints of whole documents by winnowing, and each document against its edited text."""

from __future__ import annotations

from math import ceil

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 4  # pieces
WINDOW = 16  # grams: any shared passage of 19 pieces shares a fingerprint, in long texts
WINDOWS_PER_TEXT = 16  # a text of fewer than 16 times as many grams has narrower windows
PRIME = (1 << 31) - 1
BASE = 1_000_003
# Scripts written without blanks, whose characters are pieces of their own: Thai, Lao, Burmese, Khmer,
# Chinese, Japanese and Yi.
UNSPACED = (r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{A4CF}\x{F900}-\x{FAFF}"
            r"\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}")
PIECE = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]{{1,6}}"
LOW = (1 << 31) - 1
ROWS_PER_CELL = 5_000
MOST_CELLS = 10_000  # how finely the order of ids is cut; larger cells are sorted with spill


def winnow(rows: DataFrame, text_col: str, output: str) -> DataFrame:
    """Add ``output``: the fingerprint of a text as an array of long.

    A text is cut into pieces: words, of which long ones give a piece for every six characters,
    and single characters of scripts without blanks. Each k-gram of pieces has the polynomial
    hash of their hashes. Of every window of consecutive grams the least hash is kept, the
    rightmost if it occurs twice, with its place: an element is
    hash * 2^31 + (2^31 - 1 - place), so its order is just that. A text of fewer pieces than a
    gram is one gram; one without pieces has no fingerprint.

    Windows are ``WINDOW`` grams wide, in texts of fewer than ``WINDOW * WINDOWS_PER_TEXT`` grams
    1, 2, 4 or 8: the largest of these that fits into the text ``WINDOWS_PER_TEXT`` times, or 1. The least gram
    of a window is also the least of any narrower window that holds it, so texts of different
    length still share the fingerprints that the wider windows promise.
    """
    powers = [pow(BASE, GRAM - 1 - j, PRIME) for j in range(GRAM)]
    words, hashes, grams, codes, size = (f"_{output}_{part}" for part in ("w", "h", "g", "c", "n"))
    count = F.size(hashes)

    def gram(i: Column) -> Column:
        terms = [F.get(F.col(hashes), i + j) * F.lit(powers[j]) for j in range(GRAM)]
        return F.pmod(sum(terms[1:], terms[0]), F.lit(PRIME))

    none = F.array().cast("array<bigint>")
    hashed = (
        rows.withColumn(words, F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(PIECE), F.lit(0)))
        .withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << 28) - 1))))
        .withColumn(grams, F.when(count >= GRAM, F.transform(F.sequence(F.lit(0), count - GRAM), gram))
                    .when(count > 0, F.array(F.pmod(F.xxhash64(F.col(hashes)), F.lit(PRIME)))).otherwise(none))
        .withColumn(codes, F.transform(grams, lambda g, i: g * F.lit(1 << 31) + (F.lit(LOW) - i)))
        .withColumn(size, F.size(codes)))
    # The least of each window by doubling: a window of 2 w is two of w side by side.
    least, step = F.col(codes), 1
    while step < WINDOW:
        moved = F.slice(least, F.lit(step + 1), F.greatest(F.col(size) - step, F.lit(0)))
        hashed = hashed.withColumn(
            codes, F.when(F.col(size) >= 2 * step * WINDOWS_PER_TEXT, F.zip_with(least, moved, lambda a, b: F.least(a, b))).otherwise(least))
        step *= 2
    width = F.lit(1)
    for w in (2**i for i in range(1, WINDOW.bit_length())):
        width = F.when(F.col(size) >= w * WINDOWS_PER_TEXT, w).otherwise(width)
    return hashed.withColumn(
        output, F.array_distinct(F.slice(F.col(codes), F.lit(1), F.greatest(F.col(size) - width + 1, F.lit(0))))).drop(
        words, hashes, grams, codes, size)


def fingerprint_hashes(codes: Column) -> Column:
    return F.array_distinct(F.transform(codes, lambda c: F.shiftright(c, 31)))


def fingerprint_text(codes: Column) -> Column:
    """``hash@place`` of every kept gram, in order, joined by spaces."""
    return F.array_join(F.transform(codes, lambda c: F.concat(
        F.lower(F.hex(F.shiftright(c, 31))), F.lit("@"),
        (F.lit(LOW) - c.bitwiseAND(F.lit(LOW))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Add ``next_<column>``: the value in the next row by descending id, after the last the first.

    The ids are cut into cells at quantiles, null below all. The row that follows a
    cell's last one is handed to it as an extra row at its end, so that each cell is a
    window of its own and rows are shuffled once. Rows of equal id follow each other by
    the hash of ``columns``.
    """
    cells = min(MOST_CELLS, ceil(docs.count() / ROWS_PER_CELL))
    bounds: list[float] = []
    if cells > 1:
        bounds = sorted(set(docs.select(F.col(id_col).cast("double").alias("x")).approxQuantile(
            "x", [i / cells for i in range(1, cells)], 1 / (4 * cells))))
    number = F.coalesce(F.col(id_col).cast("double"), F.lit(float("-inf")))
    rows = docs.withColumns({"_number": number, "_cell": F.lit(0)})
    if bounds:
        cutter = Bucketizer(
            splits=[float("-inf"), *bounds, float("inf")], inputCol="_number", outputCol="_cell")
        rows = cutter.transform(rows.drop("_cell"))
    rows = rows.withColumn("_cell", F.when(F.col(id_col).isNull(), -1).otherwise(
        F.col("_cell").cast("int"))).drop("_number")
    # At most one row per cell from here: the cell's first id, and the cell it follows.
    heads = rows.groupBy("_cell").agg(F.max(id_col).alias("_head"))
    order = Window.orderBy("_cell")
    above = F.coalesce(F.lead("_cell").over(order), F.min("_cell").over(Window.partitionBy()))
    heads = heads.select("_head", above.alias("_above"))
    extra = rows.join(F.broadcast(heads), F.col(id_col).eqNullSafe(F.col("_head"))).withColumn("_cell", F.col("_above"))
    both = rows.withColumn("_extra", F.lit(False)).unionByName(
        extra.drop("_head", "_above").withColumn("_extra", F.lit(True)))
    tie = F.xxhash64(*columns)
    along = Window.partitionBy("_cell").orderBy("_extra", F.col(id_col).desc_nulls_last(), tie)
    following = {f"next_{c}": F.lead(c).over(along) for c in columns}
    return both.withColumns(following).filter(~F.col("_extra")).drop("_cell", "_extra")


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprint every document and its edited text, and compare it with both neighbours.

    The edited text replaces the last half of the code points by as many of the first ones of the next
    document (all of them if it has fewer). Returns ``<id>, n_chars, edited_text, fingerprint,
    edited_fingerprint, next_fingerprint`` (arrays, see ``winnow``), ``near_edited, near_next``.
    Null counts as empty; an empty text has an empty fingerprint, whose likeness is 1 to another empty one and
    0 to the rest. A single document is its own neighbour. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = with_next(winnow(rows, "_text", "fingerprint"), id_col, ["_text", "fingerprint"])
    half = F.floor(F.length("_text") / 2).cast("int")
    edited = F.concat(
        F.substr("_text", F.lit(1), F.length("_text") - half), F.substr("next__text", F.lit(1), half))
    rows = rows.withColumns({"n_chars": F.length("_text").cast("long"), "edited_text": edited})
    rows = winnow(rows, "edited_text", "edited_fingerprint")
    rows = rows.withColumn("_own", fingerprint_hashes(F.col("fingerprint")))
    return rows.select(
        id_col, "n_chars", "edited_text", "fingerprint", "edited_fingerprint",
        F.col("next_fingerprint"),
        likeness(F.col("_own"), fingerprint_hashes(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(F.col("_own"), fingerprint_hashes(F.col("next_fingerprint"))).alias("near_next"))
