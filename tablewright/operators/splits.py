"""Reproducible splits, folds and samples.

Rows are ordered by ``md5(seed:key)``; a split is a set of cut points in that order.
The cut points come from a histogram of leading digest digits plus the few rows around
each cut, and are then compared with every row in a projection. The table itself is
never sorted or shuffled, and a row's side depends on its key alone. Rows that share a
key always land on the same side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.kinds import add_all, quoted
from tablewright.session import materialize

SEED = 42
TEST_SHARE = 0.20
FOLDS = 5
BUCKET_DIGITS = 4  # 65,536 histogram cells per group


def row_digest(keys: list[str], seed: int = SEED) -> Column:
    """Position of a row in the seeded shuffle order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[quoted(key).cast("string") for key in keys]))


def digest_cuts(
    df: DataFrame,
    keys: list[str],
    ranks: Column,
    groups: list[str] | None = None,
    seed: int = SEED,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Digest of the row at each wanted rank, per group.

    ``ranks`` is an array over the group size ``n``. Gives one row per group with the
    group columns and ``cuts``, an array in the order of ``ranks`` (null for rank 0).
    """
    groups = groups or []
    keyed = df.select(
        *[quoted(group).alias(f"_g{i}") for i, group in enumerate(groups)],
        row_digest(keys, seed).alias("_digest"),
    ).withColumn("_bucket", F.substring("_digest", 1, digits))
    names = [f"_g{i}" for i in range(len(groups))]

    histogram = keyed.groupBy(*names, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_group = Window.partitionBy(*names)
    located = (
        histogram.withColumn("_upto", F.sum("_n").over(by_group.orderBy("_bucket")))
        .withColumn("n", F.sum("_n").over(by_group))
        .select(*names, "_bucket", "_n", "_upto", F.posexplode(ranks).alias("_cut", "_rank"))
        .filter((F.col("_upto") - F.col("_n") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")))
        .select(
            *[F.col(name).alias(f"_l{name}") for name in names],
            F.col("_bucket").alias("_lbucket"),
            "_cut",
            (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rest"),
        )
    )
    # One row per group and cut; the reader of this table decides on broadcasting by size.
    located = materialize(located, "cuts")
    same = [F.col(name).eqNullSafe(F.col(f"_l{name}")) for name in names]
    near = (
        keyed.join(located, [*same, F.col("_bucket") == F.col("_lbucket")])
        .groupBy(*names, "_cut", "_rest", "_digest")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    in_cut = Window.partitionBy(*names, "_cut").orderBy("_digest")
    cuts = (
        near.withColumn("_upto", F.sum("_n").over(in_cut))
        .filter(F.col("_upto") >= F.col("_rest"))
        .groupBy(*names, "_cut")
        .agg(F.min("_digest").alias("_digest"))
    )
    # As many map entries per group as there are wanted ranks.
    per_group = cuts.groupBy(*names).agg(
        F.map_from_entries(F.collect_list(F.struct("_cut", "_digest"))).alias("cuts")
    )
    return materialize(
        per_group.select(*[F.col(f"_g{i}").alias(g) for i, g in enumerate(groups)], "cuts"), "cuts"
    )


def _with_cuts(df: DataFrame, cuts: DataFrame, groups: list[str]) -> DataFrame:
    if not groups:
        return df.withColumn("_cuts", cuts.scalar())
    renamed = cuts.select(*[quoted(g).alias(f"_c{i}") for i, g in enumerate(groups)],
                          F.col("cuts").alias("_cuts"))
    same = [quoted(g).eqNullSafe(F.col(f"_c{i}")) for i, g in enumerate(groups)]
    return df.join(renamed, same, "left").drop(*[f"_c{i}" for i in range(len(groups))])


def _split(df, keys, groups, seed, test_share, output) -> DataFrame:
    test_rows = F.round(F.col("n") * F.lit(test_share)).cast("long")
    cuts = digest_cuts(df, keys, F.array(test_rows), groups, seed)
    side = F.when(row_digest(keys, seed) <= F.element_at("_cuts", 0), "test").otherwise("train")
    return _with_cuts(df, cuts, groups).withColumn(output, side).drop("_cuts")


def stratified_split(
    df: DataFrame,
    keys: list[str],
    label: str,
    seed: int = SEED,
    test_share: float = TEST_SHARE,
    output: str = "split",
) -> DataFrame:
    """Mark ``round(share * n)`` rows of every class as test, the rest as train."""
    return _split(df, keys, [label], seed, test_share, output)


def random_split(
    df: DataFrame,
    keys: list[str],
    seed: int = SEED,
    test_share: float = TEST_SHARE,
    output: str = "split",
) -> DataFrame:
    """Mark ``round(share * n)`` rows as test."""
    return _split(df, keys, [], seed, test_share, output)


def approximate_split(
    df: DataFrame,
    keys: list[str],
    seed: int = SEED,
    test_share: float = TEST_SHARE,
    output: str = "split",
) -> DataFrame:
    """Like ``random_split`` with a size that is right only on average; no extra pass."""
    if not 0 <= test_share <= 1:
        raise ValueError(f"test_share must lie between 0 and 1, not {test_share}")
    place = F.conv(F.substring(row_digest(keys, seed), 1, 8), 16, 10).cast("long")
    side = F.when(place < int(test_share * 16**8), "test").otherwise("train")
    return df.withColumn(output, side)


def _folds(df, keys, groups, seed, k, output) -> DataFrame:
    size, extra = F.floor(F.col("n") / k), F.col("n") % k
    ends = F.array(*[(j * size + F.least(F.lit(j), extra)).cast("long") for j in range(1, k)])
    cuts = digest_cuts(df, keys, ends, groups, seed)
    marked = _with_cuts(df, cuts, groups).withColumn("_digest", row_digest(keys, seed))
    passed = [
        F.when(F.col("_digest") > F.element_at("_cuts", j), 1).otherwise(0) for j in range(k - 1)
    ]
    return marked.withColumn(output, F.lit(1) + add_all(passed)).drop("_cuts", "_digest")


def stratified_kfold(
    df: DataFrame, keys: list[str], label: str, k: int = FOLDS, seed: int = SEED, output: str = "fold"
) -> DataFrame:
    """Number every row 1..k; fold sizes within a class differ by one row at most."""
    return _folds(df, keys, [label], seed, k, output)


def kfold(
    df: DataFrame, keys: list[str], k: int = FOLDS, seed: int = SEED, output: str = "fold"
) -> DataFrame:
    """Number every row 1..k; fold sizes differ by one row at most."""
    return _folds(df, keys, [], seed, k, output)


def sample_n(df: DataFrame, keys: list[str], n: int, seed: int = SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement (the keys being unique)."""
    wanted = F.least(F.col("n"), F.lit(n)).cast("long")
    cuts = digest_cuts(df, keys, F.array(wanted), None, seed)
    return (
        df.withColumn("_cuts", cuts.scalar())
        .filter(row_digest(keys, seed) <= F.element_at("_cuts", 0))
        .drop("_cuts")
    )
