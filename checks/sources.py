"""Readers and sinks: written to the shared folder, read back, compared."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.frames import LINE_KEY, PROFILE_COLUMNS, RESULTS_SQL, results, table
from tablewright.functions.specs import number_map, text_array
from tablewright.plans.jobs import TableTask, profiles_for
from tablewright.schemas import LOG, PROFILE, RESULT
from tablewright.session import fresh_path
from tablewright.sources import readers, synthetic, versions, writers


def read_table(spark, folder):
    """Parquet in, CSV out with a header, CSV back in with inferred types."""
    path = fresh_path(spark, "customer-csv")
    writers.write_csv(table(spark, folder, "customer"), path)
    return readers.read_table(spark, path)


def read_headerless(spark, folder):
    path = fresh_path(spark, "headerless")
    flag = F.when(F.col("event_type") == "click", " g").otherwise("b")
    table(spark, folder, "events").select("event_id", "user_id", "value", flag).write.csv(path)
    return readers.read_headerless(spark, path, 3)


def select_or_default(spark, folder):
    names = ["c_custkey", "c_mktsegment", "c_phone", "c_acctbal", "c_comment"]
    return readers.select_or_default(table(spark, folder, "customer"), names)


def _tasks(spark, folder):
    def task(name, target, kind, key):
        return TableTask(name, table(spark, folder, name), target, kind, (key,))

    return [
        task("orders", "o_orderstatus", "classification", "o_orderkey"),
        task("part", "p_retailprice", "regression", "p_partkey"),
        task("customer", "c_mktsegment", "classification", "c_custkey"),
    ]


PROFILE_FIELDS = [f for f in PROFILE.names if f not in ("timestamp", "spark_version", "feature_variance")]


def profile_store(spark, folder):
    """Profile one table, then ask for three: only the other two are computed."""
    path = fresh_path(spark, "profiles")
    tasks = _tasks(spark, folder)
    profiles_for(spark, tasks[:1], path)
    stored = profiles_for(spark, tasks, path)
    return stored.select(*PROFILE_FIELDS, F.round("feature_variance", 2).alias("feature_variance"))


def append_results(spark, folder):
    """Append classification rows, then regression rows, that each lack some fields."""
    path = fresh_path(spark, "results")
    rows = results(spark, folder)
    writers.append_results(rows.filter("task_type = 'classification'").drop("rmse"), path)
    writers.append_results(rows.filter("task_type = 'regression'").drop("f1_macro"), path)
    back = writers.read_results(spark, path, RESULT)
    return back.select("run_id", "dataset", "method", "fold", "f1_macro", "rmse", "accuracy")


def _agent_rows(spark, folder):
    return table(spark, folder, "supplier").filter("s_acctbal > 0").selectExpr(
        "concat('new-', s_suppkey) AS run_id", "concat('ds_', s_suppkey) AS dataset",
        "'agent_full' AS method", "cast(null as int) AS fold", "s_acctbal / 10000 AS f1_macro",
    )


def replace_rows(spark, folder):
    """New agent rows, one per supplier in credit, take the place of the old ones."""
    path = fresh_path(spark, "replaced")
    old = results(spark, folder).select("run_id", "dataset", "method", "fold", "f1_macro")
    writers.replace_rows(old, _agent_rows(spark, folder), ["dataset", "method"], path)
    return spark.read.parquet(path)


def replace_in_place(spark, folder):
    """The same swap in a versioned table, then one interrupted run that must not show."""
    path = fresh_path(spark, "versioned")
    keys = ["dataset", "method"]
    old = results(spark, folder).select("run_id", "dataset", "method", "fold", "f1_macro")
    versions.create_versioned(old, path, keys)
    versions.replace_in_place(spark, path, _agent_rows(spark, folder), keys)
    old.write.parquet(f"{path}/rows/generation=2/bucket=0")  # written, but never committed
    return versions.read_versioned(spark, path)


def replace_in_place_before(spark, folder):
    """The generation before a swap stays readable."""
    path = fresh_path(spark, "versioned")
    keys = ["dataset", "method"]
    old = results(spark, folder).select("run_id", "dataset", "method", "fold", "f1_macro")
    versions.create_versioned(old, path, keys)
    versions.replace_in_place(spark, path, _agent_rows(spark, folder), keys)
    return versions.read_versioned(spark, path, 0)


def anti_replace(spark, folder):
    old = results(spark, folder).select("run_id", "dataset", "method")
    gone = table(spark, folder, "supplier").filter("s_acctbal > 0").selectExpr(
        "concat('ds_', s_suppkey) AS dataset", "'agent_full' AS method"
    )
    return writers.without_keys(old, gone, ["dataset", "method"])


def log_rows(spark, folder):
    """One decision per line item: profile struct, specification struct, condition."""
    lines = table(spark, folder, "lineitem")
    model = F.expr(
        "case l_partkey % 4 when 0 then 'LogisticRegression' when 1 then 'XGBClassifier'"
        " when 2 then 'LGBMClassifier' else 'Ridge' end"
    )
    condition = F.expr(
        "case l_linenumber % 3 when 0 then 'no_profile' when 1 then 'full_profile' else 'model_only' end"
    )
    base = lines.select(
        F.expr(LINE_KEY).alias("line"),
        F.expr("concat('ds_', l_suppkey)").alias("dataset"),
        condition.alias("condition"),
        model.alias("model"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        *[F.expr(sql).alias(f"p_{name}") for name, sql in PROFILE_COLUMNS.items()],
    )
    profile = F.struct(
        *[
            F.col(f"p_{name}").alias(name) if name in PROFILE_COLUMNS else F.lit(None).alias(name)
            for name in PROFILE.names
        ]
    )
    spec = F.struct(
        text_array(["imputer", "pca"]).alias("preprocessing"),
        F.col("model"),
        number_map({"n_estimators": 100}).alias("hyperparameters"),
        F.concat(F.lit("because of "), "line").alias("reasoning"),
    )
    return base.select(
        F.col("line").alias("run_id"), "dataset", "condition", profile.alias("profile"),
        spec.alias("spec"), "timestamp",
    )


def flat_log(spark, folder):
    path = fresh_path(spark, "log")
    writers.write_log(log_rows(spark, folder), path)
    return readers.read_log(spark, path, LOG)


def read_log(spark, folder):
    """JSON lines with blank and broken lines among them."""
    path = fresh_path(spark, "broken-log")
    whole = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("run_id"),
            F.col("event_type").alias("dataset"),
            F.lit("full_profile").alias("condition"),
            F.struct(F.col("user_id").alias("n_rows"), F.col("value").alias("missing_ratio")).alias("profile"),
            F.struct(F.lit("Ridge").alias("model"), text_array(["imputer"]).alias("preprocessing")).alias("spec"),
        )
    )
    line = (
        F.when(F.col("event_id") % 7 == 0, F.substring(whole, 1, 40))
        .when(F.col("event_id") % 11 == 0, F.lit(""))
        .otherwise(whole)
    )
    table(spark, folder, "events").select(line.alias("value")).write.text(path)
    return readers.read_log(spark, path).select(
        "run_id", "dataset", "condition", "profile_n_rows", "profile_missing_ratio", "spec_model",
        F.concat_ws(",", "spec_preprocessing").alias("steps"),
    )


def write_log(spark, folder):
    return flat_log(spark, folder).groupBy("dataset", "condition", "spec_model").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("profile_n_rows").alias("largest"),
        F.max("spec_reasoning").alias("last_reason"),
    )


def synthetic_table(spark, folder):
    """As many generated rows as there are line items, summed up per target value."""
    rows = synthetic.synthetic_table(spark, table(spark, folder, "lineitem").count())
    numeric = [name for name in rows.columns if name.startswith("num_")]
    return rows.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(name).alias(f"{name}_mean") for name in numeric],
        *[(F.count(name) / F.count(F.lit(1))).alias(f"{name}_present") for name in numeric],
        F.count_distinct("cat_0").alias("n_categories"),
    )


def inject_missing(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value", "event_type")
    return synthetic.inject_missing(
        events, ["value", "event_type"],
        {"value": F.col("event_id") % 33 == 0, "event_type": F.col("event_id") % 20 == 3},
    )


def final_tables(spark, folder):
    """A summary saved as CSV with a header and read back."""
    path = fresh_path(spark, "final")
    summary = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity")
    )
    writers.write_csv(summary, path)
    schema = T.StructType.fromDDL("l_returnflag string, l_linestatus string, n bigint, quantity bigint")
    return readers.read_table(spark, path, schema)


QUERIES = {
    "read_table": read_table,
    "read_headerless": read_headerless,
    "select_or_default": select_or_default,
    "profile_store": profile_store,
    "append_results": append_results,
    "replace_rows": replace_rows,
    "replace_in_place": replace_in_place,
    "replace_in_place_before": replace_in_place_before,
    "anti_replace": anti_replace,
    "read_log": read_log,
    "write_log": write_log,
    "synthetic_table": synthetic_table,
    "inject_missing": inject_missing,
    "final_tables": final_tables,
}


def profile_sql(name: str, source: str, target: str, task: str, numeric: list[str], text: int,
                features: list[str], places: int = 4) -> str:
    """The profile of a table without text-typed exceptions, spelled out."""
    gaps = " + ".join(f"count(*) - count({c})" for c in features)
    variances = ", ".join(f"var_samp({c})" for c in numeric)
    classes = f"(SELECT {target} AS c, count(*) AS n FROM {source} WHERE {target} IS NOT NULL GROUP BY 1)"
    is_class = task == "classification"
    imbalance = f"(SELECT round(min(n) / sum(n)::double, 4) FROM {classes})" if is_class else "null::double"
    n_classes = f"(SELECT count(*) FROM {classes})" if is_class else "null::bigint"
    return f"""SELECT '{name}' AS dataset_name, '{task}' AS task_type, count(*) AS n_rows,
 {len(features)}::int AS n_features,
 round(({gaps}) / (count(*) * {len(features)})::double, 4) AS missing_ratio,
 {round(text / len(features), 4)}::double AS categorical_ratio,
 {imbalance} AS class_imbalance, {n_classes} AS n_classes,
 round(list_avg([{variances}]), {places}) AS feature_variance
 FROM {source} WHERE {target} IS NOT NULL"""


ORDERS_PROFILE = profile_sql(
    "orders", "orders", "o_orderstatus", "classification", ["o_orderkey", "o_custkey", "o_totalprice"], 1,
    ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"], 2)
PART_PROFILE = profile_sql(
    "part", "part", "p_retailprice", "regression", ["p_partkey", "p_size"], 3,
    ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], 2)
CUSTOMER_PROFILE = profile_sql(
    "customer", "customer", "c_mktsegment", "classification", ["c_custkey", "c_nationkey", "c_acctbal"], 1,
    ["c_custkey", "c_name", "c_nationkey", "c_acctbal"], 2)

_CREDIT = "SELECT concat('ds_', s_suppkey) FROM supplier WHERE s_acctbal > 0"
_KEPT = f"SELECT * FROM ({RESULTS_SQL}) r WHERE NOT (method = 'agent_full' AND dataset IN ({_CREDIT}))"

_REPLACED = f"""SELECT run_id, dataset, method, fold, f1_macro FROM ({_KEPT}) k UNION ALL
 SELECT concat('new-', s_suppkey), concat('ds_', s_suppkey), 'agent_full', null, s_acctbal / 10000
 FROM supplier WHERE s_acctbal > 0"""

SQL = {
    "read_table": "SELECT * FROM customer",
    "read_headerless": """SELECT cast(event_id as double) AS f1, cast(user_id as double) AS f2,
 value AS f3, case when event_type = 'click' then 1 else 0 end AS label FROM events""",
    "select_or_default": """SELECT c_custkey, c_mktsegment, '' AS c_phone, c_acctbal,
 '' AS c_comment FROM customer""",
    "profile_store": f"{ORDERS_PROFILE} UNION ALL {PART_PROFILE} UNION ALL {CUSTOMER_PROFILE}",
    "append_results": f"""SELECT run_id, dataset, method, fold, f1_macro, rmse,
 null::double AS accuracy FROM ({RESULTS_SQL}) r""",
    "replace_rows": _REPLACED,
    "replace_in_place": _REPLACED,
    "replace_in_place_before": f"SELECT run_id, dataset, method, fold, f1_macro FROM ({RESULTS_SQL}) r",
    "anti_replace": f"SELECT run_id, dataset, method FROM ({_KEPT}) k",
    "read_log": """SELECT cast(event_id as varchar) AS run_id, event_type AS dataset,
 'full_profile' AS condition, user_id AS profile_n_rows, value AS profile_missing_ratio,
 'Ridge' AS spec_model, 'imputer' AS steps FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0""",
    "write_log": f"""SELECT dataset, condition, spec_model, count(*) AS n, max(n_rows) AS largest,
 max(concat('because of ', line)) AS last_reason FROM (SELECT concat('ds_', l_suppkey) AS dataset,
 case l_linenumber % 3 when 0 then 'no_profile' when 1 then 'full_profile' else 'model_only' end AS condition,
 case l_partkey % 4 when 0 then 'LogisticRegression' when 1 then 'XGBClassifier'
 when 2 then 'LGBMClassifier' else 'Ridge' end AS spec_model,
 {PROFILE_COLUMNS['n_rows']} AS n_rows, {LINE_KEY} AS line FROM lineitem) l GROUP BY 1, 2, 3""",
    "inject_missing": """SELECT event_id, case when event_id % 33 = 0 then null else value end AS value,
 case when event_id % 20 = 3 then null else event_type end AS event_type FROM events""",
    "final_tables": """SELECT l_returnflag, l_linestatus, count(*) AS n,
 cast(sum(cast(l_quantity as bigint)) as bigint) AS quantity FROM lineitem GROUP BY 1, 2""",
}
