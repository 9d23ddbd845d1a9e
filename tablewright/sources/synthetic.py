"""Generated tables and injected gaps.

Every drawn value is a function of (seed, stream, row id) alone, so a task that is
rerun on another executor, or a table with another partitioning, yields the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ["A", "B", "C", "D", "E"]


def uniform(key: Column, seed: int, stream: str) -> Column:
    """Uniform draw in [0, 1) with 53 random bits."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), key), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def normal(key: Column, seed: int, stream: str) -> Column:
    """Standard normal draw (Box-Muller)."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(key, seed, stream + "/r")))
    return radius * F.cos(2.0 * math.pi * uniform(key, seed, stream + "/a"))


def inject_missing(df: DataFrame, columns: list[str], where: Column | dict[str, Column]) -> DataFrame:
    """Null the given columns where the predicate holds (one for all, or one each)."""
    masks = where if isinstance(where, dict) else {name: where for name in columns}
    return df.withColumns({name: F.when(~masks[name], F.col(name)) for name in columns})


def inject_missing_share(
    df: DataFrame, columns: list[str], key: Column, share: float, seed: int = 42
) -> DataFrame:
    """Null about ``share`` of the cells of each column, drawn per cell."""
    return inject_missing(
        df, columns, {name: uniform(key, seed, "gap/" + name) < share for name in columns}
    )


def synthetic_table(
    spark: SparkSession,
    n: int,
    n_features: int = 20,
    n_categorical: int = 4,
    missing: float = 0.03,
    learnable: bool = True,
    seed: int = 42,
    partitions: int | None = None,
) -> DataFrame:
    """``num_i`` standard normal, ``cat_i`` from A..E, binary ``target``.

    A learnable target is 1 where a noisy mix of ``num_0`` and ``num_1`` lies above
    its mean; otherwise the target is a fair coin.
    """
    key = F.col("id")
    numeric = [f"num_{i}" for i in range(n_features - n_categorical)]
    base = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    base = base.select("id", *[normal(key, seed, name).alias(name) for name in numeric])
    letters = F.array(*[F.lit(letter) for letter in CATEGORIES])
    categorical = {
        f"cat_{i}": F.element_at(
            letters, (uniform(key, seed, f"cat_{i}") * len(CATEGORIES)).cast("int") + 1
        )
        for i in range(n_categorical)
    }
    table = base.withColumns(categorical)
    if learnable:
        score = 0.5 * F.col("num_0") + 0.3 * F.col("num_1") + 0.5 * normal(key, seed, "noise")
        mean = base.agg(F.avg(score)).scalar()
        table = table.withColumn("target", (score > mean).cast("int"))
    else:
        table = table.withColumn("target", (uniform(key, seed, "target") < 0.5).cast("int"))
    return inject_missing_share(table, numeric, key, missing, seed).drop("id")
