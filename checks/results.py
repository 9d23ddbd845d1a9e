"""Result tables: summaries, pivots, pairs, paired statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.frames import LINE_KEY, PRIMARY_SQL, PROFILE_COLUMNS, RESULTS_SQL
from checks.frames import results as derived_results
from checks.frames import table
from checks.sources import flat_log
from tablewright.operators import analysis as A
from tablewright.operators import stats as S

MAIN = ["B1_manual", "B2_default", "B3_heuristic", "agent_full"]
RANGES = {"ranges": 16}


def _scored(spark, folder):
    return A.primary_metric(derived_results(spark, folder))


def primary_metric(spark, folder):
    return _scored(spark, folder).select("run_id", "dataset", "primary")


def filter_methods(spark, folder):
    rows = derived_results(spark, folder)
    return A.filter_methods(rows, A.ABLATION_METHODS, score="f1_macro").select("run_id", "method", "f1_macro")


def list_methods(spark, folder):
    return A.list_methods(derived_results(spark, folder))


def method_summary(spark, folder):
    return A.method_summary(_scored(spark, folder))


def method_pivot(spark, folder):
    return A.method_pivot(_scored(spark, folder), MAIN)


def best_baseline_delta(spark, folder):
    """Direction-aware: for regression datasets the smallest error is the best."""
    scored = _scored(spark, folder)
    tasks = scored.groupBy("dataset").agg(F.first("task_type").alias("task_type"))
    pivot = A.method_pivot(scored, MAIN).join(tasks, "dataset")
    return A.best_baseline_delta(pivot, F.col("task_type") == "regression")


def ablation_table(spark, folder):
    return A.ablation_table(_scored(spark, folder))


def ablation_verdict(spark, folder):
    return A.ablation_verdict(A.ablation_table(_scored(spark, folder)))


def first_per_dataset(spark, folder):
    rows = derived_results(spark, folder).select("dataset", "timestamp", "run_id", "method")
    return A.first_per_dataset(rows, ["timestamp", "run_id"]).select("dataset", "run_id", "method")


def decision_table(spark, folder):
    table_ = A.decision_table(flat_log(spark, folder), ["timestamp", "run_id"])
    return table_.withColumn("spec_preprocessing", F.concat_ws(",", "spec_preprocessing"))


def model_diversity(spark, folder):
    return A.model_diversity(flat_log(spark, folder))


def join_profile_decision(spark, folder):
    """Decisions of the log beside the profile of the same supplier's lines."""
    decisions = A.decision_table(flat_log(spark, folder), ["timestamp", "run_id"])
    per_supplier = table(spark, folder, "lineitem").groupBy(
        F.expr("concat('ds_', l_suppkey)").alias("dataset_name")
    ).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg("l_discount"), 4).alias("categorical_ratio"),
        F.max(F.expr("case when l_suppkey % 4 = 0 then null else l_tax end")).alias("class_imbalance"),
        F.max(F.expr("cast(l_quantity as int)")).alias("n_features"),
    )
    return A.join_profile_decision(per_supplier, decisions)


def experiment_grid(spark, folder):
    datasets = table(spark, folder, "supplier").selectExpr(
        "concat('ds_', s_suppkey) AS dataset",
        "case when s_suppkey % 3 = 0 then 'single_split' else 'cv5' end AS strategy",
    )
    return A.experiment_grid(datasets, MAIN)


# Timed runs: one per order line, rows and seconds from its figures.
RUNS = {
    "run_id": LINE_KEY,
    "n_rows": "cast(l_suppkey * 1000 + 1000 as bigint)",
    "size_mb": "l_extendedprice / 100",
    "seconds": "l_quantity",
    "method": "concat('m', l_linenumber)",
}
RUNS_SQL = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in RUNS.items()) + " FROM lineitem"


def _runs(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(*[f"{sql} AS {name}" for name, sql in RUNS.items()])


def throughput(spark, folder):
    return A.throughput(_runs(spark, folder)).select("run_id", "mb_per_s")


def first_time_per_size(spark, folder):
    return A.first_time_per_size(_runs(spark, folder), ["method", "run_id"])


def log_linear_fit(spark, folder):
    runs = _runs(spark, folder)
    ten, natural = A.log_linear_fit(runs), A.log_linear_fit(runs, natural=True)
    both = ten.select(F.lit("log10").alias("axis"), "*").unionByName(
        natural.select(F.lit("log1p").alias("axis"), "*"))
    return both.select("axis", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


def pair_scores(spark, folder):
    return S.pair_scores(derived_results(spark, folder), **RANGES)


def _differences(spark, folder):
    return S.paired_differences(S.pair_scores(derived_results(spark, folder), **RANGES))


def paired_differences(spark, folder):
    return _differences(spark, folder).select("dataset", "fold", "run", "baseline", "difference")


def wilcoxon_signed_rank(spark, folder):
    tested = S.wilcoxon_signed_rank(_differences(spark, folder), **RANGES)
    return tested.select(
        "baseline", "w_plus", "w_minus", "w", "n", F.round("z", 6).alias("z"),
        F.round("p_value", 6).alias("p_value"),
    )


def cohens_d(spark, folder):
    return S.cohens_d(_differences(spark, folder))


def significance_label(spark, folder):
    """Labels for the discount of every line read as a p-value."""
    return table(spark, folder, "lineitem").select(
        F.expr(LINE_KEY).alias("run_id"),
        S.significance_label(F.col("l_discount") * F.col("l_tax")).alias("significance"),
    )


def comparison_table(spark, folder):
    return S.comparison_table(_differences(spark, folder), **RANGES)


QUERIES = {
    "primary_metric": primary_metric,
    "filter_methods": filter_methods,
    "list_methods": list_methods,
    "method_summary": method_summary,
    "method_pivot": method_pivot,
    "best_baseline_delta": best_baseline_delta,
    "ablation_table": ablation_table,
    "ablation_verdict": ablation_verdict,
    "first_per_dataset": first_per_dataset,
    "decision_table": decision_table,
    "model_diversity": model_diversity,
    "join_profile_decision": join_profile_decision,
    "experiment_grid": experiment_grid,
    "throughput": throughput,
    "first_time_per_size": first_time_per_size,
    "log_linear_fit": log_linear_fit,
    "pair_scores": pair_scores,
    "paired_differences": paired_differences,
    "wilcoxon_signed_rank": wilcoxon_signed_rank,
    "cohens_d": cohens_d,
    "significance_label": significance_label,
    "comparison_table": comparison_table,
}


def _means(methods: list[str], rows: str = f"({PRIMARY_SQL})") -> str:
    columns = ", ".join(
        f"round(avg(\"primary\") FILTER (WHERE method = '{m}'), 4) AS \"{m}\"" for m in methods)
    return f"SELECT dataset, {columns} FROM {rows} p GROUP BY dataset"


_ABLATED = f"""SELECT *, round(agent_full - agent_no_profile, 4) AS "delta_A1",
 round(agent_full - agent_model_only, 4) AS "delta_A2"
 FROM ({_means(A.ABLATION_METHODS, f"(SELECT * FROM ({PRIMARY_SQL}) q WHERE method LIKE 'agent%')")}) m"""

_LOG_SQL = f"""SELECT concat('ds_', l_suppkey) AS dataset, {LINE_KEY} AS run_id, l_shipdate AS "timestamp",
 case l_linenumber % 3 when 0 then 'no_profile' when 1 then 'full_profile' else 'model_only' end AS condition,
 {PROFILE_COLUMNS['categorical_ratio']} AS profile_categorical_ratio,
 {PROFILE_COLUMNS['class_imbalance']} AS profile_class_imbalance,
 {PROFILE_COLUMNS['n_features']} AS profile_n_features,
 case l_partkey % 4 when 0 then 'LogisticRegression' when 1 then 'XGBClassifier'
 when 2 then 'LGBMClassifier' else 'Ridge' end AS spec_model, 'imputer,pca' AS spec_preprocessing,
 concat('because of ', {LINE_KEY}) AS spec_reasoning FROM lineitem"""
_DECISIONS_SQL = f"""SELECT dataset, profile_categorical_ratio, profile_class_imbalance, profile_n_features,
 spec_model, spec_preprocessing, spec_reasoning FROM (SELECT *, row_number() OVER (PARTITION BY dataset
 ORDER BY "timestamp", run_id) AS rn FROM ({_LOG_SQL}) l WHERE condition = 'full_profile') x WHERE rn = 1"""

_PAIRS_SQL = f"""SELECT b.dataset, b.fold, b.run, b.method AS baseline, a.f1_macro AS agent_score,
 b.f1_macro AS baseline_score FROM (SELECT * FROM _ranked WHERE method = 'agent_full') a
 JOIN (SELECT * FROM _ranked WHERE method LIKE 'B%') b
 ON a.dataset = b.dataset AND a.fold = b.fold AND a.run = b.run"""
_RANKED = f"""WITH _ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset, method, fold
 ORDER BY "timestamp", md5(run_id)) AS run FROM ({RESULTS_SQL}) r
 WHERE f1_macro IS NOT NULL AND (method = 'agent_full' OR method LIKE 'B%'))"""
_DIFFERENCES = f"""{_RANKED}, _pairs AS ({_PAIRS_SQL}),
 _diff AS (SELECT *, round(agent_score - baseline_score, 6) AS difference FROM _pairs)"""
_SIGNED = f"""{_DIFFERENCES}, _sized AS (SELECT baseline, difference, abs(difference) AS size FROM _diff
 WHERE difference <> 0), _tied AS (SELECT baseline, size, count(*) AS n,
 count(*) FILTER (WHERE difference > 0) AS up, count(*) FILTER (WHERE difference < 0) AS down
 FROM _sized GROUP BY 1, 2), _avg AS (SELECT *, sum(n) OVER (PARTITION BY baseline ORDER BY size) - n
 + (n + 1) / 2::double AS rank FROM _tied), _sums AS (SELECT baseline, sum(rank * up) AS w_plus,
 sum(rank * down) AS w_minus, cast(sum(n) as bigint) AS n, sum(n::double ** 3 - n) AS tie_term
 FROM _avg GROUP BY 1), _z AS (SELECT *, least(w_plus, w_minus) AS w, (least(w_plus, w_minus)
 - n::double * (n + 1) / 4) / sqrt(n::double * (n + 1) * (2 * n + 1) / 24 - tie_term / 48) AS z FROM _sums),
 _p AS (SELECT _z.*, greatest(0, 1 - 2 * area) AS p FROM _z JOIN (SELECT baseline, sum(case when i = 0 or i = 4000 then 1
 when i % 2 = 1 then 4 else 2 end * exp(-((abs(z) * i / 4000) ** 2) / 2) / sqrt(2 * pi())) * abs(any_value(z))
 / 4000 / 3 AS area FROM _z, generate_series(0, 4000) g(i) GROUP BY baseline) s USING (baseline))"""
_EFFECTS = """SELECT baseline, count(*) AS n_pairs,
 round(avg(difference) / (stddev_pop(difference) + 1e-10), 3) AS cohens_d FROM _diff GROUP BY 1"""
_LABEL = """case when {p} < 0.001 then '*** p<0.001' when {p} < 0.01 then '** p<0.01'
 when {p} < 0.05 then '* p<0.05' else 'ns' end"""

SQL = {
    "primary_metric": f'SELECT run_id, dataset, "primary" FROM ({PRIMARY_SQL}) p',
    "filter_methods": f"""SELECT run_id, method, f1_macro FROM ({RESULTS_SQL}) r WHERE f1_macro IS NOT NULL
 AND method IN ('agent_full', 'agent_no_profile', 'agent_model_only')""",
    "list_methods": f"SELECT DISTINCT dataset, method FROM ({RESULTS_SQL}) r",
    "method_summary": f"""SELECT dataset, method, round(avg("primary"), 4) AS mean,
 round(stddev_samp("primary"), 4) AS std, count("primary") AS n_folds FROM ({PRIMARY_SQL}) p GROUP BY 1, 2""",
    "method_pivot": _means(MAIN),
    "best_baseline_delta": f"""SELECT m.*, t.task_type,
 case when task_type = 'regression' then least("B1_manual", "B2_default", "B3_heuristic")
 else greatest("B1_manual", "B2_default", "B3_heuristic") end AS best_baseline,
 round(agent_full - case when task_type = 'regression' then least("B1_manual", "B2_default", "B3_heuristic")
 else greatest("B1_manual", "B2_default", "B3_heuristic") end, 4) AS delta_vs_best
 FROM ({_means(MAIN)}) m JOIN (SELECT DISTINCT dataset, task_type FROM ({PRIMARY_SQL}) p) t USING (dataset)""",
    "ablation_table": _ABLATED,
    "ablation_verdict": f"""SELECT round(avg("delta_A1"), 4) AS "mean_delta_A1", case when avg("delta_A1") > 0.005
 then 'CONFIRMED' else 'WEAK or REJECTED' end AS verdict FROM ({_ABLATED}) a""",
    "first_per_dataset": f"""SELECT dataset, run_id, method FROM (SELECT *, row_number() OVER
 (PARTITION BY dataset ORDER BY "timestamp", run_id) AS rn FROM ({RESULTS_SQL}) r) x WHERE rn = 1""",
    "decision_table": _DECISIONS_SQL,
    "model_diversity": f"""SELECT count(DISTINCT spec_model) AS n_models, count(DISTINCT dataset) AS n_datasets,
 case when count(DISTINCT spec_model) >= 3 then 'STRONG' else 'WEAK' end AS support
 FROM ({_LOG_SQL}) l WHERE condition = 'full_profile'""",
    "join_profile_decision": f"""SELECT d.dataset, d.spec_model AS model, p.n_rows, p.categorical_ratio,
 coalesce(p.class_imbalance, 0.5) AS class_imbalance, p.n_features FROM ({_DECISIONS_SQL}) d JOIN (SELECT
 concat('ds_', l_suppkey) AS dataset, count(*) AS n_rows, round(avg(l_discount), 4) AS categorical_ratio,
 max(case when l_suppkey % 4 = 0 then null else l_tax end) AS class_imbalance,
 max(cast(l_quantity as int)) AS n_features FROM lineitem GROUP BY 1) p ON d.dataset = p.dataset""",
    "experiment_grid": """SELECT concat('ds_', s_suppkey) AS dataset,
 case when s_suppkey % 3 = 0 then 'single_split' else 'cv5' end AS strategy, method, fold
 FROM supplier, (VALUES ('B1_manual'), ('B2_default'), ('B3_heuristic'), ('agent_full')) m(method),
 (VALUES (1), (2), (3), (4), (5), (null)) f(fold) WHERE (s_suppkey % 3 = 0) = (fold IS NULL)""",
    "throughput": f"SELECT run_id, size_mb / seconds AS mb_per_s FROM ({RUNS_SQL}) r",
    "first_time_per_size": f"""SELECT n_rows, seconds FROM (SELECT *, row_number() OVER (PARTITION BY n_rows
 ORDER BY method, run_id) AS rn FROM ({RUNS_SQL}) r) x WHERE rn = 1""",
    "log_linear_fit": f"""SELECT 'log10' AS axis, round(regr_slope(seconds, log10(n_rows)), 6) AS slope,
 round(regr_intercept(seconds, log10(n_rows)), 6) AS intercept FROM ({RUNS_SQL}) r UNION ALL
 SELECT 'log1p', round(regr_slope(seconds, ln(1 + n_rows)), 6),
 round(regr_intercept(seconds, ln(1 + n_rows)), 6) FROM ({RUNS_SQL}) r""",
    "pair_scores": f"{_RANKED} {_PAIRS_SQL}",
    "paired_differences": f"{_DIFFERENCES} SELECT dataset, fold, run, baseline, difference FROM _diff",
    "wilcoxon_signed_rank": f"""{_SIGNED} SELECT baseline, w_plus, w_minus, w, n, round(z, 6) AS z,
 round(p, 6) AS p_value FROM _p""",
    "cohens_d": f"{_DIFFERENCES} {_EFFECTS}",
    "significance_label": f"""SELECT {LINE_KEY} AS run_id, {_LABEL.format(p='l_discount * l_tax')} AS significance
 FROM lineitem""",
    "comparison_table": f"""{_SIGNED} SELECT concat('agent_full vs ', baseline) AS comparison, w AS "W",
 round(p, 4) AS p_value, {_LABEL.format(p='p')} AS significance, e.cohens_d, n
 FROM _p JOIN ({_EFFECTS}) e USING (baseline)""",
}
