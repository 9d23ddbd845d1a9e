"""Paired comparison of methods."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.analysis import AGENT, BASELINES
from tablewright.operators.ranking import distributed_rank, running_totals
from tablewright.session import materialize

EXACT_UP_TO = 50  # under method "auto" larger or tied samples use the normal approximation
EPSILON = 1e-10


def pair_scores(
    results: DataFrame,
    baselines: list[str] | None = None,
    agent: str = AGENT,
    score: str = "f1_macro",
    order: str = "timestamp",
    tie: str = "run_id",
    **options,
) -> DataFrame:
    """Agent and baseline score of the same dataset, fold and run number.

    Runs are numbered by time within (dataset, method, fold), so the first run of the
    one meets the first run of the other and surplus runs stay out. Numbering is by
    ranges of time, and the join keys are unique on either side: no group is collected.
    """
    baselines = baselines or BASELINES
    kept = results.filter(F.col("method").isin([agent, *baselines]) & F.col(score).isNotNull())
    moment = F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    runs = distributed_rank(
        kept.select("dataset", "method", "fold", F.col(score).alias("score"),
                    F.coalesce(moment, F.lit(0.0)).alias("_time"), F.col(tie).alias("_tie")),
        "_time", F.col("_tie"), ["dataset", "method", "fold"], "run", **options,
    )
    own = runs.filter(F.col("method") == agent).select(
        F.col("dataset").alias("_d"), F.col("fold").alias("_f"), F.col("run").alias("_r"),
        F.col("score").alias("agent_score"),
    )
    other = runs.filter(F.col("method") != agent).select(
        "dataset", "fold", "run", F.col("method").alias("baseline"),
        F.col("score").alias("baseline_score"),
    )
    same = (
        (F.col("dataset") == F.col("_d"))
        & F.col("fold").eqNullSafe(F.col("_f"))
        & (F.col("run") == F.col("_r"))
    )
    return other.join(own, same).select(
        "dataset", "fold", "run", "baseline", "agent_score", "baseline_score"
    )


def paired_differences(pairs: DataFrame) -> DataFrame:
    """Add agent minus baseline, 6 places so that equal differences are equal."""
    return pairs.withColumn(
        "difference", F.round(F.col("agent_score") - F.col("baseline_score"), 6)
    )


def signed_ranks(differences: DataFrame, key: str = "baseline", **options) -> DataFrame:
    """Per comparison: rank sums, W, sample size, tie term and normal score z.

    Differences are counted per absolute value before ranking.
    """
    size = F.abs(F.col("difference"))
    counts = (
        differences.filter(F.col("difference") != 0)
        .groupBy(key, size.alias("_size"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("difference") > 0).alias("up"),
            F.count_if(F.col("difference") < 0).alias("down"),
        )
    )
    ranked = running_totals(counts, ["_size"], ["n"], [key], **options)
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    sums = ranked.groupBy(key).agg(
        F.sum(rank * F.col("up")).alias("w_plus"),
        F.sum(rank * F.col("down")).alias("w_minus"),
        F.sum("n").alias("n"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("tie_term"),
    )
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    return sums.withColumn("w", F.least("w_plus", "w_minus")).withColumn(
        "z", F.when(variance > 0, (F.col("w") - n * (n + 1) / 4) / F.sqrt(variance))
    )


def _exact_p(w: float, n: int) -> float:
    """Two-sided probability of a rank sum this small among the 2^n sign choices."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        ways[rank:] = ways[rank:] + ways[:-rank]
    return min(1.0, 2.0 * ways[: int(w) + 1].sum() / 2.0**n)


def _barred(method: str) -> Column:
    """0 where the exact distribution applies: it knows no ties."""
    if method not in ("auto", "exact", "approx"):
        raise ValueError(f"unknown method {method!r}: auto, exact or approx")
    ties, large = F.col("tie_term"), (F.col("n") > EXACT_UP_TO).cast("double")
    return {"auto": ties + large, "exact": ties, "approx": F.lit(1.0)}[method]


@F.pandas_udf(T.DoubleType())
def _p_value(w: pd.Series, z: pd.Series, n: pd.Series, barred: pd.Series) -> pd.Series:
    # Exact where nothing bars it, as ties do. A handful of aggregated rows, one per comparison; SQL has no error function.
    return pd.Series(
        [
            _exact_p(a, int(count)) if bar == 0 else math.erfc(abs(score) / math.sqrt(2.0))
            for a, score, count, bar in zip(w, z, n, barred)
        ]
    )


def wilcoxon_signed_rank(differences: DataFrame, key: str = "baseline", method: str = "auto", **options) -> DataFrame:
    """Two-sided signed rank test per comparison; needs two non-zero differences.

    ``method`` is ``exact`` (all sign choices, whose work grows with the cube of the sample), ``approx`` (tie-corrected
    normal approximation) or ``auto``: exact for up to 50 differences. Samples with ties are approximated.
    """
    barred = _barred(method)
    ranks = signed_ranks(differences, key, **options).filter(F.col("n") >= 2)
    return ranks.withColumn("p_value", _p_value("w", "z", F.col("n").cast("double"), barred))


def cohens_d(differences: DataFrame, key: str = "baseline") -> DataFrame:
    """Mean over population deviation of all differences, zeros included."""
    d = F.avg("difference") / (F.stddev_pop("difference") + F.lit(EPSILON))
    return differences.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.round(d, 3).alias("cohens_d")
    )


def significance_label(p: Column) -> Column:
    # The levels and how they are written.
    return (
        F.when(p < 0.001, "*** p<0.001")
        .when(p < 0.01, "** p<0.01")
        .when(p < 0.05, "* p<0.05")
        .otherwise("ns")
    )


def comparison_table(differences: DataFrame, agent: str = AGENT, **options) -> DataFrame:
    """One row per baseline: W, p, its label, effect size and sample size.

    The pairing is computed once and written; ranks and effect sizes read it.
    """
    differences = materialize(differences, "differences")
    tests = wilcoxon_signed_rank(differences, **options)
    effects = cohens_d(differences).withColumnRenamed("baseline", "_b").drop("n_pairs")
    return tests.join(effects, F.col("baseline") == F.col("_b")).select(
        F.concat(F.lit(f"{agent} vs "), F.col("baseline")).alias("comparison"),
        F.col("w").alias("W"),
        F.round("p_value", 4).alias("p_value"),
        significance_label(F.col("p_value")).alias("significance"),
        "cohens_d",
        F.col("n").alias("n"),
    )
