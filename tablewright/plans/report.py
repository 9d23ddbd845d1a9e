"""The four result tables of an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators import analysis, stats
from tablewright.sources.writers import write_csv

MAIN_METHODS = [*analysis.BASELINES, analysis.AGENT]


def analysis_report(
    results: DataFrame,
    lower_is_better: Column | None = None,
    log: DataFrame | None = None,
    **options,
) -> dict[str, DataFrame]:
    """Main results, paired tests, ablation, and decisions where a log is given.

    ``results`` carries ``primary``; ``lower_is_better`` marks its rows whose primary
    metric is an error. Paired tests use macro F1, hence classification rows.
    """
    pivot = analysis.method_pivot(results, MAIN_METHODS)
    by_error = None
    if lower_is_better is not None:
        marks = results.groupBy("dataset").agg(F.bool_or(lower_is_better).alias("_by_error"))
        pivot = pivot.join(marks, "dataset")
        by_error = F.col("_by_error")
    main = analysis.best_baseline_delta(pivot, by_error, analysis.BASELINES)
    tables = {
        "main_results": main.drop("_by_error"),
        "paired_tests": stats.comparison_table(
            stats.paired_differences(stats.pair_scores(results, **options)), **options
        ),
        "ablation": analysis.ablation_table(results),
    }
    if log is not None:
        decisions = analysis.decision_table(log, ["timestamp", "run_id"])
        tables["agent_decisions"] = decisions.withColumn(
            "spec_preprocessing", F.concat_ws(",", "spec_preprocessing")
        )
    return tables


def save_report(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write every table as CSV with a header; gives their paths."""
    paths = {name: f"{folder}/{name}" for name in tables}
    for name, table in tables.items():
        write_csv(table, paths[name])
    return paths
