"""Tables derived from the given ones, as DataFrames and as the equal SQL.

Result rows, specifications, profiles and log entries are made from every row of
``lineitem``, replies from every row of ``events``: their number grows with the data and
every branch of the rules is met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.readers import read_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def expressions(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS {name}" for name, sql in pairs.items()])


# One row number per duplicate-free line; l_extendedprice tells equal key parts apart.
LINE_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date))"
TASK = "case when l_suppkey % 4 = 0 then 'regression' else 'classification' end"

METHOD = """case l_linenumber when 1 then 'B1_manual' when 2 then 'B2_default'
 when 3 then 'B3_heuristic' when 5 then 'agent_no_profile' when 6 then 'agent_model_only'
 else 'agent_full' end"""

RESULT_COLUMNS = {
    "run_id": LINE_KEY,
    "dataset": "concat('ds_', l_suppkey)",
    "task_type": TASK,
    "method": METHOD,
    "fold": "cast(cast(l_quantity as int) % 5 + 1 as int)",
    "f1_macro": "case when l_suppkey % 4 = 0 then null else (l_extendedprice % 1000) / 1000 end",
    "rmse": "case when l_suppkey % 4 = 0 then (l_extendedprice % 100) / 10 else null end",
    "timestamp": "l_shipdate",
}

PROFILE_COLUMNS = {
    "dataset_name": LINE_KEY,
    "task_type": TASK,
    "n_rows": "cast(floor(l_extendedprice / 3) as bigint)",
    "n_features": "cast(l_quantity as int)",
    "missing_ratio": "l_tax",
    "categorical_ratio": "l_discount * 5",
    "class_imbalance": "case when l_suppkey % 4 = 0 then null else (l_partkey % 60) / cast(100 as double) end",
    "feature_variance": "l_extendedprice * 1.5",
    "n_classes": "case when l_suppkey % 4 = 0 then null else cast(l_linenumber + 1 as bigint) end",
}

# Step names with gaps, unknown names, and now and then none at all.
STEP_PARTS = [
    "case when l_linenumber % 2 = 0 then 'standard_scaler' end",
    "case when l_quantity > 25 then 'label_encoder' end",
    "case when l_discount > 0.05 then 'imputer' end",
    "case when l_tax > 0.04 then 'pca' end",
    "case when l_partkey % 3 = 0 then 'one_hot_encoder' end",
    "case when l_partkey % 5 = 0 then 'polynomials' end",
]
MODEL = """case l_linenumber when 1 then 'LogisticRegression' when 2 then 'RandomForestClassifier'
 when 3 then 'Ridge' when 4 then 'KNeighborsClassifier' when 5 then 'NotAModel'
 when 6 then null else 'XGBClassifier' end"""
PARAMETERS = {
    "n_estimators": "l_quantity * 20.5",
    "max_depth": "l_linenumber * 4.25",
    "C": "l_extendedprice / 500",
    "alpha": "l_tax * 10",
    "n_neighbors": "l_quantity",
    "learning_rate": "l_discount * 5",
    "max_iter": "l_extendedprice / 20",
    "num_leaves": "l_quantity * 10",
    "subsample": "l_discount * 12",
    "gamma": "l_tax",
}

_columns = ", ".join(f"{sql} AS {name}" for name, sql in RESULT_COLUMNS.items())
RESULTS_SQL = f"SELECT {_columns} FROM lineitem"
PRIMARY_SQL = f"""SELECT *, case when task_type = 'regression' then rmse else f1_macro end AS "primary"
 FROM ({RESULTS_SQL}) _r"""
_columns = ", ".join(f"{sql} AS {name}" for name, sql in PROFILE_COLUMNS.items())
PROFILES_SQL = f"SELECT {_columns} FROM lineitem"
STEPS_SQL = f"list_filter([{', '.join(STEP_PARTS)}], lambda x: x is not null)"


def results(spark: SparkSession, folder: str) -> DataFrame:
    return expressions(table(spark, folder, "lineitem"), RESULT_COLUMNS)


def derived_profiles(spark: SparkSession, folder: str) -> DataFrame:
    typed = {**PROFILE_COLUMNS}
    return expressions(table(spark, folder, "lineitem"), typed)


def with_steps(df: DataFrame) -> DataFrame:
    parts = F.array(*[F.expr(part) for part in STEP_PARTS])
    return df.withColumn("steps", F.filter(parts, lambda step: step.isNotNull()))


def with_parameters(df: DataFrame) -> DataFrame:
    pairs = [p for name, sql in PARAMETERS.items() for p in (F.lit(name), F.expr(sql).cast("double"))]
    return df.withColumn("parameters", F.create_map(*pairs))


# Replies: bare object, fenced object, object in prose, broken text, list, blank.
REPLY_OBJECT = """concat('{"preprocessing": ["imputer", "', event_type, '", "pca", 7], "model": "',
 case user_id % 4 when 0 then 'LogisticRegression' when 1 then 'SVC' when 2 then 'Perceptron'
 else 'LGBMClassifier' end, '", "hyperparameters": {"n_estimators": ', event_id % 900,
 ', "max_depth": ', cast(event_id % 40 as varchar(10)), '.5, "max_iter": true, "gamma": "auto"}',
 case when user_id % 3 = 0 then '' else concat(', "reasoning": "user ', user_id, '"') end, '}')"""
REPLY = f"""case event_id % 6 when 0 then {REPLY_OBJECT}
 when 1 then concat('Here it is:\\n```json\\n', {REPLY_OBJECT}, '\\n```\\nDone {{see above}}.')
 when 2 then concat('I choose ', {REPLY_OBJECT}, ' because it fits.')
 when 3 then concat('{{"model": "', event_type, '", ')
 when 4 then '[1, 2]' else '  ' end"""
REPLY_TASK = "case when user_id % 5 = 0 then 'regression' else 'classification' end"


def replies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id", f"{REPLY} AS raw", f"{REPLY_TASK} AS task_type"
    )


_newline = "' || chr(10) || '"
REPLIES_SQL = f"""SELECT event_id, {REPLY.replace(chr(92) + 'n', _newline)} AS raw,
 {REPLY_TASK} AS task_type FROM events"""

# Predictions: the label, or the next class for a quarter of the keys.
CLASSES = {"F": 0, "O": 1, "P": 2}
PREDICTION_COLUMNS = {
    "o_orderkey": "o_orderkey",
    "priority": "o_orderpriority",
    "label": "case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end",
    "prediction": """case when substring(md5(cast(o_orderkey as varchar(20))), 1, 1) < '4' then
 (case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end + 1) % 3
 else case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end end""",
    "price": "o_totalprice",
    "price_hat": "o_totalprice * 0.75 + (o_custkey % 1000) * 16",
}
_columns = ", ".join(f"{sql} AS {name}" for name, sql in PREDICTION_COLUMNS.items())
PREDICTIONS_SQL = f"SELECT {_columns} FROM orders"


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return expressions(table(spark, folder, "orders"), PREDICTION_COLUMNS)
