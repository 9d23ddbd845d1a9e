"""Training passages that repeat benchmark items: n-gram seeds, then local alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.membership import possibly_in
from tablewright.llm.wordhash import MARKS, hashed_words, shingle_hashes
from tablewright.session import materialize

SEED_WORDS = 3
FILTER_BITS = 22  # the filter is 512 KB, however large the benchmark
STRETCH = 4  # places of an item of which the rarest gram is a seed, whatever its frequency
RARE_FOLD, RARE_LEAST = 4, 16
MATCH, MISMATCH, GAP = 2, 1, 1
_U = np.uint64


def _grams(batches, size: int):
    for batch in batches:
        for start, words, cuts in hashed_words(batch.column(1), MARKS):
            grams = shingle_hashes(words, size).view(np.int64)
            counts = np.maximum(np.diff(cuts) - size + 1, 0)
            rows = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            lengths = np.diff(cuts)[rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows + start)), pa.array(place),
                 pa.array(grams[cuts[:-1][rows] + place]), pa.array(lengths)],
                ["item_id", "place", "gram", "words"])


def _seen(batches, size: int, known: np.ndarray):
    """Grams of whole texts that pass the filter of benchmark grams."""
    for batch in batches:
        for start, words, cuts in hashed_words(batch.column(1), MARKS):
            grams = shingle_hashes(words, size)
            bits = grams >> _U(64 - FILTER_BITS)
            hit = (known[bits >> _U(6)] >> (bits & _U(63))) & _U(1)
            at = np.flatnonzero(hit)
            rows = np.searchsorted(cuts, at, "right") - 1
            inside = at + size <= cuts[rows + 1]  # a gram never spans two texts
            at, rows = at[inside], rows[inside]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows + start)), pa.array(at - cuts[rows]),
                 pa.array(grams[at].view(np.int64))], ["doc_id", "at", "gram"])


def gram_filter(grams: DataFrame) -> np.ndarray:
    """One bit for each value of the leading bits of a gram: 65,536 words at most."""
    bit = F.shiftrightunsigned("gram", 64 - FILTER_BITS)
    places = grams.select(
        F.shiftrightunsigned(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("place"))
    words = places.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, place))").alias("bits"))
    known = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for row in words.collect():
        known[row["word"]] = row["bits"] & ((1 << 64) - 1)
    return known


def align(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman score of each pair, and where its best alignment ends on either side.

    All pairs advance together, one word of ``left`` at a time. A gap along ``right`` is a
    running maximum, since its price is even.
    """
    rows = len(left)
    tall, wide = max(map(len, left)), max(map(len, right))
    a, b = np.zeros((rows, tall), _U), np.zeros((rows, wide), _U)
    for i in range(rows):
        a[i, : len(left[i])], b[i, : len(right[i])] = left[i], right[i]
    in_a = np.arange(tall) < np.array([len(x) for x in left])[:, None]
    in_b = np.arange(wide) < np.array([len(x) for x in right])[:, None]
    slope = np.arange(wide + 1, dtype=np.int32) * GAP
    score = np.zeros((rows, wide + 1), np.int32)
    best, end_a, end_b = (np.zeros(rows, np.int64) for _ in range(3))
    for i in range(tall):
        same = (b == a[:, i : i + 1]) & in_b & in_a[:, i : i + 1]
        new = np.zeros_like(score)
        np.maximum(score[:, :-1] + np.where(same, MATCH, -MISMATCH), 0, out=new[:, 1:])
        np.maximum(new, score - GAP, out=new)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        score = np.where(in_a[:, i : i + 1], new, score)
        top = score.argmax(axis=1)
        value = score[np.arange(rows), top]
        better = value > best
        best[better], end_a[better], end_b[better] = value[better], i + 1, top[better]
    return best, end_a, end_b


def _score(batches, least: float):
    for batch in batches:
        texts = [w[c[i] : c[i + 1]] for _, w, c in hashed_words(batch.column(4), MARKS) for i in range(len(c) - 1)]
        items = [w[c[i] : c[i + 1]] for _, w, c in hashed_words(batch.column(5), MARKS) for i in range(len(c) - 1)]
        low = batch.column(2).to_numpy()
        high = batch.column(3).to_numpy()
        spans = [texts[i][max(0, low[i]) : high[i]] for i in range(len(texts))]
        order = sorted((i for i in range(len(items)) if len(items[i]) and len(spans[i])), key=lambda i: len(spans[i]))
        keep, scores, begins, ends = [], [], [], []
        at = 0
        while at < len(order):
            width = len(spans[order[min(at + 255, len(order) - 1)]])
            pick = order[at : at + max(1, min(256, (1 << 21) // max(1, width)))]
            at += len(pick)
            best, stop_item, stop_span = align([items[i] for i in pick], [spans[i] for i in pick])
            share = best / (MATCH * np.array([len(items[i]) for i in pick]))
            good = np.flatnonzero(share >= least)
            if not len(good):
                continue
            _, _, back = align(
                [items[pick[g]][: stop_item[g]][::-1] for g in good],
                [spans[pick[g]][: stop_span[g]][::-1] for g in good])
            for g, reach in zip(good, back):
                i, stop = pick[g], int(stop_span[g])
                keep.append(i)
                scores.append(float(share[g]))
                begins.append(int(max(0, low[i])) + stop - int(reach))
                ends.append(int(max(0, low[i])) + stop)
        chosen = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(scores, pa.float64()),
             pa.array(begins, pa.int64()), pa.array(ends, pa.int64())],
            ["doc_id", "item_id", "score", "start_word", "end_word"])


def rare_seeds(grams: DataFrame, seen: DataFrame) -> DataFrame:
    """``gram, item_id, place, words, rare``: the grams by which documents and items meet.

    Of every stretch of ``STRETCH`` places the gram that fewest documents hold is a seed, so
    each part of an item has one; grams that no document holds are passed over. A gram is rare
    if it is held by at most ``RARE_FOLD`` times as many documents as the item's median gram
    (at least ``RARE_LEAST``), and all rare grams are seeds. The median rises with the copies of
    an item, so the grams of an often copied item stay rare, while "one of the" is not, beside
    words that nobody else wrote.
    """
    held = seen.select("gram", "doc_id").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    counted = grams.join(held, "gram", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    usual = counted.groupBy("item_id").agg(F.percentile("held", F.lit(0.5)).alias("usual"))
    bound = F.greatest(F.lit(RARE_LEAST), RARE_FOLD * F.col("usual"))
    stretch = Window.partitionBy("item_id", F.floor(F.col("place") / STRETCH)).orderBy("held", "place")
    ranked = counted.filter("held > 0").withColumn("rank", F.row_number().over(stretch)).join(usual, "item_id")
    return ranked.withColumn("rare", F.col("held") <= bound).filter("rare or rank = 1").select(
        "gram", "item_id", "place", "words", "rare")


def find_windows(seen: DataFrame, seeds: DataFrame) -> DataFrame:
    """``doc_id, item_id, low, high``: stretches of documents, in words, to align with an item.

    Hits are gathered by diagonal in strips as wide as the item; strips whose hits lie within
    the slack of an alignment are merged. A window needs one rare seed, or at least three
    seeds, and one for every 16 words of the item.
    """
    width = F.greatest(F.col("words"), F.lit(16))
    shift = F.col("at") - F.col("place")
    pad = F.ceil(F.col("words") / 4) + 8
    strips = seen.join(seeds, "gram").groupBy("doc_id", "item_id", F.floor(shift / width).alias("strip")).agg(
        F.min(shift).alias("low"), F.max(shift).alias("high"), F.max("words").alias("words"),
        F.count(F.lit(1)).alias("hits"), F.count_if("rare").alias("rare"))
    along = Window.partitionBy("doc_id", "item_id").orderBy("strip")
    apart = F.col("low") - F.lag("high").over(along) > pad
    marked = strips.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int"))
    islands = marked.withColumn("island", F.sum("apart").over(along)).groupBy("doc_id", "item_id", "island").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("words").alias("words"),
        F.sum("hits").alias("hits"), F.sum("rare").alias("rare"))
    needed = F.greatest(F.lit(3), F.ceil(F.col("words") / 16))
    return islands.filter((F.col("rare") > 0) | (F.col("hits") >= needed)).select(
        "doc_id", "item_id", (F.col("low") - pad).alias("low"), (F.col("high") + F.col("words") + pad).alias("high"))


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", least: float = 0.5,
) -> DataFrame:
    """Passages that repeat a benchmark item: ``doc_id, item_id, score, start_word, end_word``.

    Words are runs of letters and digits, lower case. Three-word grams of whole texts are held
    against the items' grams; the rare ones are seeds (``rare_seeds``). Seeds that lie on nearby
    diagonals give a window (``find_windows``), whose words are aligned with the item's (2 a
    match, -1 a mismatch or gap). ``score`` is the best local score over that of a whole copy;
    pairs of at least ``least`` are returned, one row per document and item, its best passage as
    a span of word numbers (end exclusive).

    A passage that keeps a rare gram of its item is always aligned. Missed are passages that keep
    no three words in a row, or only one or two grams that are common elsewhere.

    Null or empty texts, null ids and items of fewer than three words match nothing. Rows that
    repeat an id are reported together under it. Other columns are ignored. Very long texts are
    read once, whole, and only their windows are aligned.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_col).alias("text")).filter("doc_id is not null")
    tests = items.select(F.col(item_col).cast("long").alias("item_id"), F.lower(item_text_col).alias("item"))
    tests = tests.filter("item is not null and item_id is not null").dropDuplicates()
    grams = materialize(tests.mapInArrow(
        lambda batches: _grams(batches, SEED_WORDS), "item_id long, place long, gram long, words long"), "grams")
    known = gram_filter(grams)
    seen = source.mapInArrow(
        lambda batches: _seen(batches, SEED_WORDS, known), "doc_id long, at long, gram long")
    seen = materialize(seen.join(grams.select("gram").distinct(), "gram", "left_semi"), "seen")

    windows = materialize(find_windows(seen, rare_seeds(grams, seen)), "windows")
    rows = windows.join(possibly_in(source, "doc_id", windows, "doc_id"), "doc_id")
    rows = rows.join(tests, "item_id").select("doc_id", "item_id", "low", "high", "text", "item")
    scored = rows.mapInArrow(
        lambda batches: _score(batches, least),
        "doc_id long, item_id long, score double, start_word long, end_word long")
    best = scored.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("score", F.negate("start_word").alias("minus"), "end_word")).alias("top"))
    return best.select("doc_id", "item_id", "top.score", F.negate("top.minus").alias("start_word"), "top.end_word")
