"""Specifications: allow-lists, rules, prompts, replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.frames import (
    LINE_KEY,
    MODEL,
    PARAMETERS,
    PROFILES_SQL,
    REPLIES_SQL,
    STEPS_SQL,
    TASK,
    derived_profiles,
    replies,
    table,
    with_parameters,
    with_steps,
)
from tablewright.functions import rules, specs
from tablewright.functions.prompts import TEMPLATES, render_prompt
from tablewright.functions.replies import parse_spec, with_reply_object
from tablewright.operators.profile import profile_by_group


def _lines(spark, folder):
    return table(spark, folder, "lineitem").withColumn("run_id", F.expr(LINE_KEY))


def _values(parameters, names=PARAMETERS):
    """Map entries as plain columns, so that both engines show the same thing."""
    return [F.round(F.element_at(parameters, name), 6).alias(name) for name in names]


def clamp_hyperparameters(spark, folder):
    rows = with_parameters(_lines(spark, folder))
    return rows.select("run_id", *_values(specs.clamp_hyperparameters(F.col("parameters"))))


def filter_steps(spark, folder):
    rows = with_steps(_lines(spark, folder))
    return rows.select("run_id", F.array_join(specs.filter_steps(F.col("steps")), ",").alias("steps"))


def filter_hyperparameters(spark, folder):
    rows = with_parameters(_lines(spark, folder))
    kept = specs.filter_hyperparameters(F.col("parameters"), F.expr(MODEL))
    return rows.select("run_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("names"))


def ensure_imputer(spark, folder):
    rows = with_steps(_lines(spark, folder))
    return rows.select("run_id", F.array_join(specs.ensure_imputer(F.col("steps")), ",").alias("steps"))


def fallback_spec(spark, folder):
    """No specification on every third line, no model or an unknown one on others."""
    rows = with_parameters(with_steps(_lines(spark, folder)))
    given = specs.spec_struct(
        F.col("steps"), F.expr(MODEL), F.col("parameters"),
        F.expr("case when l_linenumber > 4 then '' else 'given' end"),
    )
    spec = specs.fallback_spec(F.when(F.col("l_partkey") % 3 != 0, given), F.expr(TASK))
    shown = rows.withColumn("spec", spec)
    return shown.select(
        "run_id", F.array_join("spec.preprocessing", ",").alias("steps"), F.col("spec.model").alias("model"),
        F.element_at("spec.hyperparameters", "n_estimators").alias("n_estimators"),
        F.col("spec.reasoning").alias("reasoning"),
    )


def _shown(profiles, rule):
    spec = rules.choose(profiles, rule)
    return spec.select(
        "dataset_name", F.array_join("spec.preprocessing", ",").alias("steps"), F.col("spec.model").alias("model"),
        F.element_at("spec.hyperparameters", "n_estimators").alias("n_estimators"),
        F.col("spec.reasoning").alias("reasoning"),
    )


def _choice(rule):
    return lambda spark, folder: _shown(derived_profiles(spark, folder), rule)


def choose_for_groups(spark, folder):
    """From table to choice: each user's events are profiled, the runner rules applied."""
    profiles = profile_by_group(table(spark, folder, "events"), ["user_id"], "event_type", "classification")
    return _shown(profiles, "rules_runner").select("dataset_name", "steps", "model")


def _prompt(condition):
    def query(spark, folder):
        return derived_profiles(spark, folder).select("dataset_name", render_prompt(condition).alias("prompt"))

    return query


def parse_spec_query(spark, folder):
    rows = parse_spec(with_reply_object(replies(spark, folder), "raw"), "raw", parsed="found")
    return rows.select(
        "event_id", F.col("found").isNotNull().alias("found"),
        F.array_join("spec.preprocessing", ",").alias("steps"), F.col("spec.model").alias("model"),
        F.element_at("spec.hyperparameters", "n_estimators").alias("n_estimators"),
        F.element_at("spec.hyperparameters", "max_depth").alias("max_depth"),
        F.size("spec.hyperparameters").alias("n_parameters"), F.col("spec.reasoning").alias("reasoning"),
    )


def validate_spec(spark, folder):
    parsed = parse_spec(replies(spark, folder), "raw", "parsed")
    rows = parsed.withColumn("spec", specs.validate_spec(F.col("parsed"), F.col("task_type")))
    return rows.select(
        "event_id", F.array_join("spec.preprocessing", ",").alias("steps"), F.col("spec.model").alias("model"),
        F.element_at("spec.hyperparameters", "n_estimators").alias("n_estimators"),
        F.element_at("spec.hyperparameters", "max_depth").alias("max_depth"),
        F.col("spec.reasoning").alias("reasoning"),
    )


QUERIES = {
    "clamp_hyperparameters": clamp_hyperparameters,
    "filter_steps": filter_steps,
    "filter_hyperparameters": filter_hyperparameters,
    "ensure_imputer": ensure_imputer,
    "fallback_spec": fallback_spec,
    "choose_manual": _choice("manual"),
    "choose_default": _choice("default"),
    "choose_rules_library": _choice("rules_library"),
    "choose_rules_runner": _choice("rules_runner"),
    "choose_rules_full": _choice("rules_full"),
    "choose_rules_model_only": _choice("rules_model_only"),
    "choose_for_groups": choose_for_groups,
    "render_prompt": _prompt("full_profile"),
    "render_prompt_no_profile": _prompt("no_profile"),
    "render_prompt_model_only": _prompt("model_only"),
    "parse_spec": parse_spec_query,
    "validate_spec": validate_spec,
}


def _in(names: list[str]) -> str:
    return ", ".join(f"'{name}'" for name in names)


def _clamped(name: str, sql: str) -> str:
    if name not in specs.CLAMPS:
        return f"round({sql}, 6) AS {name}"
    low, high = specs.CLAMPS[name]
    bounded = f"greatest({low}::double, least({high}::double, ({sql})::double))"
    if name in specs.INTEGER_PARAMETERS:
        bounded = f"floor({bounded})"
    return f'round({bounded}, 6) AS "{name}"'


_NAMES_OF = " ".join(
    f"when '{model}' then '{','.join(sorted(names))}'" for model, names in specs.MODEL_PARAMETERS.items())
_ALLOWED = f"list_filter({STEPS_SQL}, lambda x: x IN ({_in(specs.ALLOWED_STEPS)}))"
_FALLBACK = "case when {task} = 'classification' then 'GradientBoostingClassifier' else 'GradientBoostingRegressor' end"


def _rule_sql(classification: list[tuple[str, str, str, str, str]], regression) -> str:
    """Rules as (condition, steps, model, n_estimators, reasoning); the last has no condition."""
    columns = []
    for i, name in enumerate(["steps", "model", "n_estimators", "reasoning"], 1):
        sides = []
        for side in (classification, regression):
            whens = " ".join(f"when {r[0]} then {r[i]}" for r in side[:-1])
            sides.append(f"case {whens} else {side[-1][i]} end" if whens else side[-1][i])
        columns.append(f"case when task_type = 'classification' then {sides[0]} else {sides[1]} end AS {name}")
    return f"SELECT dataset_name, {', '.join(columns)} FROM ({PROFILES_SQL}) p"


_S = "'imputer,standard_scaler'"
_IMB = "coalesce(class_imbalance, 0.5)"


def _pair(condition, classifier, regressor, reason, trees="100::double"):
    return ((condition, _S, f"'{classifier}'", trees, f"'{reason}'"), (condition, _S, f"'{regressor}'", trees, f"'{reason}'"))


_SMALL = "n_rows < 2000"
_FULL_1 = f"{_SMALL} AND n_features < 20"
_LGBM = _pair("categorical_ratio > 0.40", "LGBMClassifier", "LGBMRegressor", "rule 2")
_XGB = _pair("n_rows > 20000", "XGBClassifier", "XGBRegressor", "rule 3")
_FOREST = _pair("n_features > 25 AND missing_ratio > 0.05", "RandomForestClassifier", "RandomForestRegressor", "rule 5")
_LOGISTIC = (_S, "'LogisticRegression'", "null::double")


def _prompt_sql(condition: str) -> str:
    text = TEMPLATES[condition].replace("'", "''")
    trimmed = "regexp_replace(printf('%.4f', {}), '(\\.\\d+?)0+$', '\\1')"
    fields = {
        "{dataset_name}": "dataset_name",
        "{task_type}": "task_type",
        "{n_rows}": "cast(n_rows as varchar)",
        "{n_features}": "cast(n_features as varchar)",
        "{missing_ratio:%}": "printf('%.2f%%', missing_ratio * 100)",
        "{categorical_ratio:%}": "printf('%.2f%%', categorical_ratio * 100)",
        "{class_imbalance}": trimmed.format("coalesce(class_imbalance, 0.5)::double"),
        "{feature_variance}": trimmed.format("feature_variance"),
        "{n_classes}": "coalesce(cast(n_classes as varchar), 'None')",
    }
    sql = f"'{text}'"
    for mark, value in fields.items():
        sql = f"replace({sql}, '{mark}', {value})"
    return f"SELECT dataset_name, {sql} AS prompt FROM ({PROFILES_SQL}) p"


_FOUND_SQL = f"""SELECT event_id, task_type, case when json_valid(o) and json_type(o) = 'OBJECT' then o end AS obj FROM
 (SELECT event_id, task_type, case when json_valid(trim(raw)) then raw
 when json_valid(fenced) then fenced when json_valid(braced) then braced end AS o FROM (SELECT event_id, task_type,
 raw, regexp_extract(raw, '(?s)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1) AS fenced,
 regexp_extract(raw, '(?s)\\{{[^{{}}]*(?:\\{{[^{{}}]*\\}}[^{{}}]*)*\\}}') AS braced FROM ({REPLIES_SQL}) r) a) b"""
_PARSED_SQL = f"""SELECT event_id, task_type, obj IS NOT NULL AS found,
 case when obj is not null then concat('imputer,', obj->'preprocessing'->>1, ',pca') end AS steps,
 obj->>'model' AS model, cast(obj->'hyperparameters'->>'n_estimators' as double) AS n_estimators,
 cast(obj->'hyperparameters'->>'max_depth' as double) AS max_depth,
 obj->>'reasoning' AS reasoning FROM ({_FOUND_SQL}) f"""

SQL = {
    "clamp_hyperparameters": f"""SELECT {LINE_KEY} AS run_id, {', '.join(_clamped(n, s) for n, s in PARAMETERS.items())}
 FROM lineitem""",
    "filter_steps": f"SELECT {LINE_KEY} AS run_id, array_to_string({_ALLOWED}, ',') AS steps FROM lineitem",
    "filter_hyperparameters": f"""SELECT {LINE_KEY} AS run_id, case {MODEL} {_NAMES_OF} else '' end AS names
 FROM lineitem""",
    "ensure_imputer": f"""SELECT {LINE_KEY} AS run_id, array_to_string(case when list_contains({STEPS_SQL}, 'imputer')
 then {STEPS_SQL} else list_prepend('imputer', {STEPS_SQL}) end, ',') AS steps FROM lineitem""",
    "fallback_spec": f"""SELECT {LINE_KEY} AS run_id,
 case when l_partkey % 3 = 0 then 'imputer,standard_scaler' else array_to_string({STEPS_SQL}, ',') end AS steps,
 case when l_partkey % 3 = 0 or {MODEL} is null or {MODEL} = 'NotAModel' then {_FALLBACK.format(task=TASK)}
 else {MODEL} end AS model, case when l_partkey % 3 = 0 then 100::double else l_quantity * 20.5 end AS n_estimators,
 case when l_partkey % 3 = 0 then 'Fallback.' when l_linenumber > 4 then 'Gerekce belirtilmedi.'
 else 'given' end AS reasoning FROM lineitem""",
    "choose_manual": _rule_sql(
        [("", *_LOGISTIC, "'fixed linear pipeline'")], [("", _S, "'Ridge'", "null::double", "'fixed linear pipeline'")]),
    "choose_default": _rule_sql(
        [("", "'imputer'", "'RandomForestClassifier'", "100::double", "'fixed forest pipeline'")],
        [("", "'imputer'", "'RandomForestRegressor'", "100::double", "'fixed forest pipeline'")]),
    "choose_rules_library": _rule_sql(
        [
            ("categorical_ratio > 0.30", "'impute_mode'", "'RandomForestClassifier'", "200::double", "'many categories'"),
            ("n_features > 20", "'imputer,standard_scaler,pca'", "'LogisticRegression'", "null::double", "'many features'"),
            (f"{_IMB} < 0.10", _S, "'GradientBoostingClassifier'", "100::double", "'rare class'"),
            ("", *_LOGISTIC, "'general case'"),
        ],
        [("", _S, "'Ridge'", "null::double", "'regression'")]),
    "choose_rules_runner": _rule_sql(
        [
            (_SMALL, *_LOGISTIC, "'few rows'"),
            (f"categorical_ratio > 0.40 OR {_IMB} < 0.20", _S, "'GradientBoostingClassifier'", "100::double",
             "'categories or rare class'"),
            ("", _S, "'RandomForestClassifier'", "100::double", "'general case'"),
        ],
        [
            (_SMALL, _S, "'Ridge'", "null::double", "'few rows'"),
            ("", _S, "'GradientBoostingRegressor'", "100::double", "'many rows'"),
        ]),
    "choose_rules_full": _rule_sql(
        [
            (_FULL_1, *_LOGISTIC, "'rule 1'"), _LGBM[0], _XGB[0],
            (f"{_IMB} < 0.15", _S, "'GradientBoostingClassifier'", "100::double", "'rule 4'"), _FOREST[0],
            ("", _S, "'GradientBoostingClassifier'", "100::double", "'rule 6'"),
        ],
        [
            (_FULL_1, _S, "'GradientBoostingRegressor'", "100::double", "'rule 1'"), _LGBM[1], _XGB[1], _FOREST[1],
            ("", _S, "'GradientBoostingRegressor'", "100::double", "'rule 6'"),
        ]),
    "choose_rules_model_only": _rule_sql(
        [(_SMALL, *_LOGISTIC, "'rule 1'"), _LGBM[0], _XGB[0],
         ("", _S, "'GradientBoostingClassifier'", "100::double", "'rule 4'")],
        [(_SMALL, _S, "'GradientBoostingRegressor'", "100::double", "'rule 1'"), _LGBM[1], _XGB[1],
         ("", _S, "'GradientBoostingRegressor'", "100::double", "'rule 4'")]),
    "choose_for_groups": f"""SELECT cast(user_id as varchar) AS dataset_name, {_S} AS steps,
 case when sum(n) < 2000 then 'LogisticRegression' when 0.4 > 0.4 or round(min(n) / sum(n)::double, 4) < 0.2
 then 'GradientBoostingClassifier' else 'RandomForestClassifier' end AS model
 FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) c GROUP BY 1""",
    "render_prompt": _prompt_sql("full_profile"),
    "render_prompt_no_profile": _prompt_sql("no_profile"),
    "render_prompt_model_only": _prompt_sql("model_only"),
    "parse_spec": f"""SELECT event_id, found, steps, model, n_estimators, max_depth,
 case when found then 2::int end AS n_parameters, reasoning FROM ({_PARSED_SQL}) p""",
    "validate_spec": f"""SELECT event_id, case when found then 'imputer,pca' else 'imputer,standard_scaler' end AS steps,
 case when model in ('LogisticRegression', 'SVC', 'LGBMClassifier') then model
 else {_FALLBACK.format(task='task_type')} end AS model,
 case when found then greatest(50, least(500, n_estimators)) else 100 end AS n_estimators,
 case when found then floor(greatest(3, least(20, max_depth))) end AS max_depth,
 case when not found then 'Fallback.' else coalesce(reasoning, 'Gerekce belirtilmedi.') end AS reasoning
 FROM ({_PARSED_SQL}) p""",
}
