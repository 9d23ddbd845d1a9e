"""Near-duplicate documents by HyperMinHash sketches, confirmed on the full shingle sets."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import components
from tablewright.llm.membership import possibly_in
from tablewright.llm.wordhash import mix, shingle_sets
from tablewright.session import materialize

REGISTERS = 256
MANTISSA_BITS = 18
BAND_ROWS = 6
LOW_BITS = 4  # bits of each mantissa that the estimate compares
WORDS = REGISTERS // 64
_BOUNDS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(56)
_U = np.uint64

SKETCH_SCHEMA = (
    "_id long, n_shingles long, set_a long, set_b long, bands array<long>, marks array<int>, "
    + ", ".join(f"p{i} long" for i in range((LOW_BITS + 1) * WORDS))
)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set: 0 when the bucket is empty, else 1 plus the count of
    leading zeros of the bucket's least hash followed by the bits after its leading one.

    The first 8 bits of a hash name the bucket; the sets are sorted, so the least hash of
    a bucket is the first at or above the bucket's lower bound.
    """
    out = np.zeros((len(sets), REGISTERS), np.uint32)
    for row, hashes in enumerate(sets):
        if not len(hashes):
            continue
        at = np.searchsorted(hashes, _BOUNDS)
        filled = np.flatnonzero(np.diff(at, append=len(hashes)))
        value = (hashes[at[filled]] & _U((1 << 56) - 1)) >> _U(5)  # 51 bits, exact as a float
        length = np.frexp(value.astype(np.float64))[1]
        zeros = np.minimum(51 - length, 63).astype(np.uint64)
        shift = np.maximum(length - 1, 0).astype(np.uint64)
        rest = value - np.where(length > 0, _U(1) << shift, _U(0))
        aligned = (rest << (_U(51) - shift)) >> _U(51 - MANTISSA_BITS)
        out[row, filled] = ((zeros << _U(MANTISSA_BITS)) | aligned) + _U(1)
    return out


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``BAND_ROWS`` registers, and whether any of them is filled."""
    count = regs.shape[1] // BAND_ROWS
    parts = regs[:, : count * BAND_ROWS].reshape(len(regs), count, BAND_ROWS).astype(_U)
    keys = np.arange(1, count + 1, dtype=_U)[None, :] << _U(40)
    for i in range(BAND_ROWS):
        keys = mix(keys + parts[:, :, i])
    return keys.view(np.int64), (parts > 0).any(axis=2)


def packed(regs: np.ndarray) -> np.ndarray:
    """Per row: which registers are filled, then each low mantissa bit, 64 to a word."""
    planes = [regs > 0] + [((regs - (regs > 0)) >> i & 1).astype(bool) for i in range(LOW_BITS)]
    return np.concatenate(
        [np.packbits(plane, axis=1, bitorder="little").view(np.int64) for plane in planes], axis=1)


def _sketch(batches, size: int, least: float):
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        ids = rows.column(0).combine_chunks()
        texts = rows.column(1).combine_chunks()
        part: list[np.ndarray] = []
        start = 0
        for hashes in shingle_sets(texts, size):
            part.append(hashes)
            if len(part) == 512:
                yield _sketch_rows(ids.slice(start, len(part)), part, least)
                start, part = start + len(part), []
        if part:
            yield _sketch_rows(ids.slice(start, len(part)), part, least)


def _sketch_rows(ids: pa.Array, sets: list[np.ndarray], least: float) -> pa.RecordBatch:
    regs = registers(sets)
    keys, filled = band_keys(regs)
    counts = np.array([len(s) for s in sets], np.int64)
    filled &= (counts >= least)[:, None]  # smaller sets link with equal ones only
    starts = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1])
    bands = pa.ListArray.from_arrays(starts, pa.array(np.where(filled, keys, 0).ravel()))
    a = np.array([s.sum(dtype=_U) if len(s) else 0 for s in sets], _U).view(np.int64)
    b = np.array([mix(s + _U(7)).sum(dtype=_U) if len(s) else 0 for s in sets], _U).view(np.int64)
    marks = (keys.view(_U) >> _U(33)).astype(np.int32).ravel()
    marks = pa.ListArray.from_arrays(starts, pa.array(marks, mask=~filled.ravel()))
    columns = [ids, pa.array(counts), pa.array(a), pa.array(b), bands, marks]
    columns += [pa.array(column) for column in packed(regs).T.copy()]
    names = ["_id", "n_shingles", "set_a", "set_b", "bands", "marks"]
    names += [f"p{i}" for i in range((LOW_BITS + 1) * WORDS)]
    return pa.RecordBatch.from_arrays(columns, names)


def _confirm(batches, size: int, percent: int):
    """Keep the pairs whose full shingle sets are alike enough."""
    for batch in batches:
        left = shingle_sets(batch.column(2), size)
        right = shingle_sets(batch.column(3), size)
        keep = []
        for x, y in zip(left, right):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _limit(percent: int) -> Column:
    """How many registers of a sketch may differ from those of a set that is alike enough.

    The estimate is 1 - differing / filled / (1 - collisions): equal low bits of different
    registers (one in sixteen for four bits) are taken out. Filled registers are a draw without
    replacement from the union, so small sets are estimated almost exactly. Solved for the
    differing ones with four standard deviations of slack, and with the largest union that a set of
    this size allows, it is a number of each sketch, and the join only counts bits.
    """
    least, equal = percent / 100, 0.5**LOW_BITS
    own = sum((F.bit_count(F.col(f"p{i}")) for i in range(WORDS)), F.lit(0))
    union = F.col("n_shingles") * 2 / (1 + least)
    filled = F.least(F.lit(float(REGISTERS)), own + union - F.col("n_shingles"))
    unseen = F.greatest(1 - own / union, F.lit(0.0))
    spread = filled * (least * (1 - least) * unseen + (1 - least) * equal * (1 - equal))
    return F.ceil((1 - least) * (1 - equal) * filled + 4 * F.sqrt(spread) + 1).cast("int")


def _alike(percent: int) -> Column:
    """Whether two sketches may belong to sets that are alike enough."""
    def differ(i: int) -> Column:
        parts = [F.col(f"x.p{i + k * WORDS}").bitwiseXOR(F.col(f"y.p{i + k * WORDS}"))
                 for k in range(LOW_BITS + 1)]
        joined = parts[0]
        for part in parts[1:]:
            joined = joined.bitwiseOR(part)
        return F.bit_count(joined)

    different = sum((differ(i) for i in range(1, WORDS)), differ(0))
    sizes = (F.least("x.n_shingles", "y.n_shingles") * 100
             >= F.greatest("x.n_shingles", "y.n_shingles") * percent)
    return sizes & (different <= F.greatest("x.limit", "y.limit"))


def _first_shared(place: str) -> Column:
    """Whether two sketches share no band before this one, so that a pair is made once."""
    before = [F.slice(f"{side}.marks", F.lit(1), F.col(place)) for side in ("x", "y")]
    return ~F.coalesce(F.arrays_overlap(*before), F.lit(False))  # null: an empty band


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    rows = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    check = partial(_confirm, size=size, percent=percent)
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long").distinct()


def _pairs(left: DataFrame, right: DataFrame, on: list, test: Column) -> DataFrame:
    """Ordered pairs of ``left`` and ``right`` (columns ``_id``, ``sign``) that pass the test."""
    x = left.withColumnsRenamed({"_id": "a", "sign": "x"})
    y = right.withColumnsRenamed({"_id": "b", "sign": "y"})
    found = x.join(y, on).filter(test)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """Group documents whose sets of ``size``-word shingles have a Jaccard of ``percent`` %.

    Returns one row per input row: ``<id_col>, n_shingles, component_id, kept``. The
    component is the smallest id reachable over links; ``kept`` marks that document.

    Each set is split over 256 buckets; a bucket stores the leading zeros of its least
    hash and 18 mantissa bits. Runs of six registers form 42 bands: a pair at 0.80 misses
    them all three times in a million, at 0.85 twice in 10^9. Equal sets are one class
    from the start. Within a band the classes first meet the most central of them only;
    those that are then still in different components meet inside the band, where the
    corrected estimate decides in the join itself. Only pairs that pass it are written, and
    confirmed on full sets.

    Nulls and texts without words have an empty set, no links, and themselves as
    component. A null id has no links, a null component, and is kept. Rows that repeat an
    id are judged one by one. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    least = percent / max(1, 100 - percent) - 1e-9
    sketch = partial(_sketch, size=size, least=least)
    sketches = materialize(source.mapInArrow(sketch, SKETCH_SCHEMA), "sketches")
    key = ["n_shingles", "set_a", "set_b"]
    filled = sketches.filter("n_shingles > 0 and _id is not null")
    classes = materialize(filled.groupBy(*key).agg(F.min("_id").alias("rep")), "classes")

    reps = filled.join(classes.withColumnRenamed("rep", "_id"), [*key, "_id"], "left_semi")
    reps = reps.dropDuplicates([*key, "_id"])
    sign = F.struct("n_shingles", "marks", _limit(percent).alias("limit"),
                    *[c for c in sketches.columns if c[0] == "p"]).alias("sign")
    # Dealt out once: the counts and the join read the same shuffle.
    banded = reps.select("_id", F.posexplode("bands").alias("place", "band")).filter("band <> 0").repartition("band")
    shared = banded.groupBy("band").agg(F.count("_id").alias("members"), F.max("place").alias("_")).filter("members > 1")
    shared = shared.drop("_")
    members = materialize(banded.join(shared, "band"), "bands")
    central = members.groupBy("_id").agg(F.sum("members").alias("weight"))
    central = materialize(central, "central")
    signs = materialize(reps.select("_id", sign).join(central, "_id", "left_semi"), "signs")
    texts = possibly_in(source, "_id", central, "_id").join(central, "_id").select("_id", "_text")
    texts = materialize(texts.dropDuplicates(), "texts")

    weighted = members.join(central, "_id")
    hubs = weighted.groupBy("band").agg(
        F.max(F.struct("weight", F.negate("_id").alias("minus"))).alias("top"))
    hubs = hubs.select("band", F.negate("top.minus").alias("hub"))
    to_hub = members.join(hubs, "band").filter("_id <> hub").select("_id", "hub").distinct()
    near = to_hub.join(signs, "_id")
    first = _pairs(near, signs, [F.col("hub") == F.col("b")], _alike(percent))
    first = materialize(first, "candidates")
    links = materialize(_confirmed(first, texts, size, percent), "confirmed")

    found = materialize(components(links), "components").toDF("_id", "component")
    placed = members.join(found, "_id", "left").select(
        "band", "place", "_id", F.coalesce("component", "_id").alias("component"))
    placed = materialize(placed.distinct(), "placed")
    split = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    split = split.filter("low <> high").select("band")
    open_rows = materialize(placed.join(split, "band").join(signs, "_id"), "open")
    left, right = open_rows.withColumnRenamed("component", "cx"), open_rows.withColumnRenamed("component", "cy")
    apart = [F.col("left.band") == F.col("right.band"), F.col("cx") != F.col("cy"), F.col("a") < F.col("b")]
    once = _alike(percent) & _first_shared("left.place")
    second = _pairs(left.alias("left"), right.alias("right"), apart, once)
    second = materialize(second.join(first, ["a", "b"], "left_anti"), "candidates")
    more = materialize(_confirmed(second, texts, size, percent), "confirmed")
    if not more.isEmpty():
        found = components(links.unionByName(more)).toDF("_id", "component")

    rooted = classes.join(found.withColumnRenamed("_id", "rep"), "rep", "left").select(
        *key, F.coalesce("component", "rep").alias("root"))
    plain = sketches.select("_id", *key)
    whole = plain.filter("n_shingles > 0 and _id is not null").join(rooted, key)
    rest = plain.filter("n_shingles = 0 or _id is null").withColumn("root", F.col("_id"))
    return whole.unionByName(rest).select(
        F.col("_id").alias(id_col), "n_shingles", F.col("root").alias("component_id"),
        F.coalesce(F.col("_id") == F.col("root"), F.lit(True)).alias("kept"))
