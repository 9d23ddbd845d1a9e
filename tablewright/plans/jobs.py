"""Experiment jobs: profile, choose, split, fit, score, append."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import partial

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.kinds import CATEGORICAL, columns_of_kind, moments_as_numbers
from tablewright.operators.metrics import metrics_row, score_array
from tablewright.operators.prep import CategoryEncoder, encode_target
from tablewright.operators.profile import CLASSIFICATION, drop_null_target, profile
from tablewright.operators.splits import (
    FOLDS,
    SEED,
    kfold,
    random_split,
    sample_n,
    stratified_kfold,
    stratified_split,
)
from tablewright.plans.decisions import decide, specs_of, unfinished
from tablewright.plans.pipelines import build_pipeline, stage_count
from tablewright.schemas import FAILURE, PROFILE, RESULT, SCALING, conform
from tablewright.session import fresh_path, materialize, spread
from tablewright.sources.writers import append_results, read_results, store_profiles, unstored

logger = logging.getLogger(__name__)

# Method names and the rule set each one stands for.
METHODS = {
    "B1_manual": "manual",
    "B2_default": "default",
    "B3_heuristic": "rules_runner",
    "agent_full": "rules_full",
}
ABLATIONS = {"agent_no_profile": "task_default", "agent_model_only": "rules_model_only"}
SINGLE_SPLIT, CROSS_VALIDATION = "single_split", "cv5"
SAMPLE_ROWS = 50_000
BOOSTING = ("GradientBoostingClassifier",)
ERROR_CHARS = 2_000  # kept of the cause of a failed run


@dataclass(frozen=True)
class TableTask:
    """A table, its label and how it is evaluated. ``keys`` identify the rows."""

    name: str
    table: DataFrame
    target: str
    task_type: str
    keys: tuple[str, ...]
    strategy: str = SINGLE_SPLIT


# --- profiles -----------------------------------------------------------------------


def stored_profiles(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(PROFILE).json(path)
    except Exception as error:  # the store does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], PROFILE)


def profiles_for(
    spark: SparkSession, tasks: list[TableTask], path: str, require: bool = False
) -> DataFrame:
    """Profiles of all tasks, computing and storing only those not stored yet.

    With ``require`` a missing profile is an error instead of work.
    """
    names = [task.name for task in tasks]
    requested = spark.createDataFrame([(name,) for name in names], "dataset_name string")
    todo = {row[0] for row in unstored(requested, stored_profiles(spark, path)).collect()}
    if todo and require:
        raise FileNotFoundError(f"no stored profile for {sorted(todo)}")
    missing = [task for task in tasks if task.name in todo]
    if missing:
        fresh = [profile(t.table, t.target, t.task_type, t.name) for t in missing]
        table = fresh[0]
        for part in fresh[1:]:
            table = table.unionByName(part)
        store_profiles(table, path)
    return stored_profiles(spark, path).filter(F.col("dataset_name").isin(names))


# --- one run ------------------------------------------------------------------------


def prepare(task: TableTask) -> tuple[DataFrame, list[str], int | None]:
    """The task's rows with a numeric ``label``; its text features; its class count."""
    rows = drop_null_target(spread(task.table, list(task.keys)), task.target)
    features = [c for c in rows.columns if c != task.target and c not in task.keys]
    rows = moments_as_numbers(rows, features)
    labelled, codes = encode_target(rows, task.target, task.task_type)
    categories = [
        name
        for name in columns_of_kind(task.table, task.table.columns, CATEGORICAL)
        if name != task.target and name not in task.keys
    ]
    return labelled.drop(task.target), categories, codes.count() if codes is not None else None


def with_folds(rows: DataFrame, task: TableTask) -> tuple[DataFrame, list[int | None]]:
    """Mark each row with the fold that tests it; a single split has the one fold 0."""
    keys = list(task.keys)
    stratify = task.task_type == CLASSIFICATION
    if task.strategy == CROSS_VALIDATION:
        marked = stratified_kfold(rows, keys, "label") if stratify else kfold(rows, keys)
        return marked, list(range(1, FOLDS + 1))
    marked = stratified_split(rows, keys, "label") if stratify else random_split(rows, keys)
    in_test = F.when(F.col("split") == "test", 0).otherwise(-1)
    return marked.withColumn("fold", in_test).drop("split"), [None]


def run_one(
    task: TableTask,
    method: str,
    spec: dict,
    train: DataFrame,
    test: DataFrame,
    categories: list[str],
    n_labels: int | None,
    fold: int | None = None,
    fixed_preprocessing: bool = False,
    coded: bool = False,
) -> dict:
    """Fit, time and score one pipeline. A failure leaves a row of nulls and its cause, ``error``.

    ``coded`` says that the rows went through ``code_categories`` already.
    """
    row: dict = {"run_id": str(uuid.uuid4()), "dataset": task.name, "method": method, "fold": fold}
    held = None
    try:
        exclude = [*task.keys, "fold"]
        pipeline: Pipeline = build_pipeline(
            spec, exclude, categories, list(task.keys), fixed_preprocessing, True
        )
        started = time.perf_counter()
        if categories and not coded:
            # Every pass of every stage would look the codes up again.
            train, test = code_categories(train, test, categories)
            train = held = train.persist(StorageLevel.MEMORY_AND_DISK)
        fitted = pipeline.fit(train)
        row["train_time_s"] = round(time.perf_counter() - started, 4)
        scored = fitted.transform(test)
        scores = score_array(scored)
        kept = [F.col("label"), F.col("prediction")]
        if scores is not None:
            kept.append(scores.alias("scores"))
        # Several aggregates read the predictions; the model runs over the rows once.
        predicted = materialize(scored.select(*kept), "predicted")
        row.update(
            metrics_row(
                predicted,
                task.task_type,
                "label",
                "prediction",
                "scores" if scores is not None and task.task_type == CLASSIFICATION else None,
                n_labels,
            )
            .first()
            .asDict()
        )
        row["n_pipeline_stages"] = stage_count(spec, fixed_preprocessing)
    except Exception as failure:
        logger.exception("run failed: %s %s fold %s", task.name, method, fold)
        row["error"] = f"{type(failure).__name__}: {failure}"[:ERROR_CHARS]
    finally:
        if held is not None:
            held.unpersist()
    row["timestamp"] = datetime.now(timezone.utc)
    return row


def code_categories(
    train: DataFrame, test: DataFrame, categories: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Category codes learnt on the training rows, once for all methods of a fold."""
    if not categories:
        return train, test
    encoder = CategoryEncoder(inputCols=categories).fit(train)
    return encoder.transform(train), encoder.transform(test)


@contextmanager
def _kept(*frames: DataFrame):
    """The frames held in memory, spilling to disk, while the block runs.

    A lost executor only costs recomputation: every frame is a function of its source.
    """
    held = [frame.persist(StorageLevel.MEMORY_AND_DISK) for frame in frames]
    for frame in held:
        frame.count()  # the clock of the first method must not pay for reading and coding
    try:
        yield held
    finally:
        for frame in held:
            frame.unpersist()


def _record(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Append results, and the causes of failed runs beside them."""
    plain = [tuple(row.get(name) for name in RESULT.names) for row in rows]
    append_results(spark.createDataFrame(plain, RESULT), path)
    failed = [tuple(row.get(name) for name in FAILURE.names) for row in rows if row.get("error")]
    if failed:
        spark.createDataFrame(failed, FAILURE).write.mode("append").json(failures_path(path))


def failures_path(results_path: str) -> str:
    return f"{results_path.rstrip('/')}-failures"


def read_failures(spark: SparkSession, results_path: str) -> DataFrame:
    """Why runs failed: ``run_id, dataset, method, fold, error, timestamp``; empty if none did."""
    try:
        return spark.read.schema(FAILURE).json(failures_path(results_path))
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], FAILURE)


def _stored_results(spark: SparkSession, path: str) -> DataFrame:
    try:
        return read_results(spark, path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], RESULT)


def _side_by_side(spark: SparkSession, runs: list[Callable[[], dict]], threads: int) -> list[dict]:
    """Results of the runs, in their order, at most ``threads`` at a time.

    Each thread submits its jobs to a pool of its own; with ``spark.scheduler.mode`` FAIR the pools share
    the cluster, else they follow each other where one leaves cores idle.
    """
    if threads <= 1 or len(runs) <= 1:
        return [run() for run in runs]

    def pooled(number: int, run: Callable[[], dict]) -> dict:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"grid-{number % threads}")
        return run()

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(inheritable_thread_target(spark)(pooled), range(len(runs)), runs))


def _run_grid(
    spark: SparkSession,
    tasks: list[TableTask],
    decisions: DataFrame,
    path: str,
    overrides: dict[str, dict] | None = None,
    fixed_methods: tuple[str, ...] = (),
    threads: int = 1,
    resume: bool = False,
) -> None:
    for task in tasks:
        specs = specs_of(decisions, task.name, overrides)
        planned = [(method, fold) for _, method, _ in specs
                   for fold in (range(1, FOLDS + 1) if task.strategy == CROSS_VALIDATION else [None])]
        todo = unfinished(spark, _stored_results(spark, path), task.name, planned) if resume else set(planned)
        if not todo:
            continue
        rows, categories, n_labels = prepare(task)
        marked, folds = with_folds(rows, task)
        # Codes, training and test rows are all made of it.
        marked = marked.persist(StorageLevel.MEMORY_AND_DISK)
        for fold in folds:
            left = [spec for spec in specs if (spec[1], fold) in todo]
            if not left:
                continue
            held = F.col("fold") == (0 if fold is None else fold)
            with _kept(*code_categories(marked.filter(~held), marked.filter(held), categories)) as (train, test):
                if len(folds) == 1:
                    marked.unpersist()  # training and test rows hold it all by now
                runs = [
                    partial(run_one, task, method, spec, train, test, categories, n_labels, fold,
                            method in fixed_methods, coded=True)
                    for _, method, spec in left
                ]
                done = _side_by_side(spark, runs, threads)
            for row, (run_id, _, _) in zip(done, left):
                row["run_id"] = run_id if fold is None else f"{run_id}:{fold}"
            # Appended fold by fold, so an interrupted job keeps what it has done.
            _record(spark, done, path)
        marked.unpersist()


def run_experiments(
    spark: SparkSession,
    tasks: list[TableTask],
    results_path: str,
    profiles_path: str,
    methods: dict[str, str] | None = None,
    overrides: dict[str, dict] | None = None,
    replies: DataFrame | None = None,
    specs: DataFrame | None = None,
    log_path: str | None = None,
    threads: int = 1,
    resume: bool = False,
) -> DataFrame:
    """Every table by every decision and fold; one appended row per run.

    Decisions come from rule sets (``methods``; all of them if nothing else is given), from reply texts
    (``dataset, condition, raw_response``) and from specifications (``dataset, method, spec``); ``log_path``
    keeps them, and a result carries the identifier of its decision. ``overrides`` maps a model name to
    hyperparameters that replace the chosen ones. ``threads`` runs of a fold go side by side. With ``resume``
    only what has no result yet is fitted.
    """
    profiles = profiles_for(spark, tasks, profiles_path)
    if methods is None and replies is None and specs is None:
        methods = METHODS
    decisions = decide(profiles, methods, replies, specs, log_path)
    _run_grid(spark, tasks, decisions, results_path, overrides, threads=threads, resume=resume)
    return read_results(spark, results_path)


def run_ablation(
    spark: SparkSession,
    tasks: list[TableTask],
    results_path: str,
    profiles_path: str,
    overrides: dict[str, dict] | None = None,
    fixed_preprocessing: bool = False,
    log_path: str | None = None,
) -> DataFrame:
    """The two reduced conditions, on stored profiles only.

    ``fixed_preprocessing`` holds the preparation of the model-only condition fixed.
    """
    profiles = profiles_for(spark, tasks, profiles_path, require=True)
    decisions = decide(profiles, ABLATIONS, log_path=log_path)
    _run_grid(
        spark, tasks, decisions, results_path, overrides,
        ("agent_model_only",) if fixed_preprocessing else (),
    )
    return read_results(spark, results_path)


def run_large_table(
    spark: SparkSession,
    task: TableTask,
    results_path: str,
    profiles_path: str,
    methods: dict[str, str] | None = None,
    sample_rows: int | None = None,
    sampled_models: tuple[str, ...] = BOOSTING,
    overrides: dict[str, dict] | None = None,
    log_path: str | None = None,
) -> DataFrame:
    """One large table: profile, then each method once, on all training rows.

    The boosted trees are distributed. ``sample_rows`` (``SAMPLE_ROWS`` in the published
    experiments) may bound the rows that the classifiers of ``sampled_models`` are fitted on.
    """
    profiles = profiles_for(spark, [task], profiles_path)
    specs = specs_of(decide(profiles, methods or METHODS, log_path=log_path), task.name, overrides)
    rows, categories, n_labels = prepare(task)
    marked = with_folds(rows, task)[0].persist(StorageLevel.MEMORY_AND_DISK)
    coded = code_categories(marked.filter("fold <> 0"), marked.filter("fold = 0"), categories)
    with _kept(*coded) as (train, test):
        marked.unpersist()  # training and test rows hold it all by now
        for run_id, method, spec in specs:
            sampled = sample_rows is not None and spec["model"] in sampled_models
            fit_rows = sample_n(train, list(task.keys), sample_rows, SEED) if sampled else train
            done = run_one(task, method, spec, fit_rows, test, categories, n_labels, coded=True)
            _record(spark, [{**done, "run_id": run_id}], results_path)
    return read_results(spark, results_path)


def folder_megabytes(spark: SparkSession, path: str) -> float:
    """Size of a written table, from the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getContentSummary(target).getLength() / 2**20


def profile_scaling(
    spark: SparkSession,
    sizes: list[int],
    make_table: Callable[[int], DataFrame],
    target: str = "target",
    measure: Callable[[DataFrame, DataFrame], dict] | None = None,
    method: str = "profile",
    name: Callable[[int], str] = lambda size: f"synthetic_{size // 1000}K",
) -> DataFrame:
    """Write a table of each size as CSV and time its profile alone.

    The clock covers reading and profiling, not session start. ``measure`` may fit a
    model on the same table and return ``method``, ``f1_macro`` and ``train_time_s``.
    """
    rows = []
    for size in sizes:
        table = make_table(size)
        path = fresh_path(spark, f"scaling-{size}")
        table.write.csv(path, header=True)
        stored = spark.read.csv(path, header=True, schema=table.schema)
        started = time.perf_counter()
        result = profile(stored, target, CLASSIFICATION, name(size)).collect()
        seconds = round(time.perf_counter() - started, 3)
        row = {
            "dataset": result[0]["dataset_name"],
            "n_rows": result[0]["n_rows"],
            "size_mb": round(folder_megabytes(spark, path), 2),
            "spark_profiling_time_s": seconds,
            "method": method,
        }
        if measure:
            row.update(measure(stored, spark.createDataFrame(result, PROFILE)))
        rows.append(tuple(row.get(name) for name in SCALING.names))
    return conform(spark.createDataFrame(rows, SCALING), SCALING)
