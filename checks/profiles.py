"""Profile aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.frames import table
from checks.sources import CUSTOMER_PROFILE, ORDERS_PROFILE, PART_PROFILE, PROFILE_FIELDS, _tasks
from tablewright.operators import profile as P
from tablewright.operators import summaries
from tablewright.session import fresh_path
from tablewright.sources.synthetic import inject_missing

# Orders and events with gaps: the given tables have none.
GAPPY_ORDERS_SQL = """(SELECT o_orderkey, o_custkey,
 case when o_orderkey % 50 = 0 then null else o_orderstatus end AS o_orderstatus,
 case when o_orderkey % 33 = 0 then null else o_totalprice end AS o_totalprice, o_orderdate,
 case when o_orderkey % 20 = 0 then null else o_orderpriority end AS o_orderpriority FROM orders)"""
GAPPY_EVENTS_SQL = """(SELECT event_id, ts, user_id, event_type,
 case when event_id % 33 = 0 then null else value end AS value,
 case when event_id % 20 = 0 then null else props end AS props FROM events)"""


def gappy_orders(spark, folder):
    key = F.col("o_orderkey")
    masks = {"o_orderstatus": key % 50 == 0, "o_totalprice": key % 33 == 0, "o_orderpriority": key % 20 == 0}
    return inject_missing(table(spark, folder, "orders"), list(masks), masks)


def gappy_events(spark, folder):
    masks = {"value": F.col("event_id") % 33 == 0, "props": F.col("event_id") % 20 == 0}
    return inject_missing(table(spark, folder, "events"), list(masks), masks)


TARGET = "o_orderstatus"


def drop_null_target(spark, folder):
    kept = P.drop_null_target(gappy_orders(spark, folder), TARGET)
    return kept.select("o_orderkey", TARGET, "o_totalprice")


def split_features_target(spark, folder):
    features, _ = P.split_features_target(table(spark, folder, "part"), "p_retailprice")
    return features


def columns_by_type(spark, folder):
    parts = [
        P.columns_by_type(gappy_orders(spark, folder)),
        P.columns_by_type(table(spark, folder, "lineitem")),
        P.columns_by_type(gappy_events(spark, folder)),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def row_count(spark, folder):
    return P.row_count(P.drop_null_target(gappy_orders(spark, folder), TARGET))


def _features(df):
    return [name for name in df.columns if name != TARGET]


def null_counts(spark, folder):
    df = P.drop_null_target(gappy_orders(spark, folder), TARGET)
    return P.null_counts(df, _features(df))


def missing_ratio(spark, folder):
    df = P.drop_null_target(gappy_orders(spark, folder), TARGET)
    return P.missing_ratio(df, _features(df))


def categorical_ratio(spark, folder):
    """Share of text columns beside the cells it speaks for."""
    parts = []
    for name, target in [("part", "p_retailprice"), ("customer", "c_acctbal"), ("orders", TARGET)]:
        df = table(spark, folder, name)
        features = [c for c in df.columns if c != target]
        parts.append(
            df.agg(
                F.lit(name).alias("dataset"),
                F.lit(P.categorical_share(df, features)).alias("categorical_ratio"),
                (F.count(F.lit(1)) * len(features)).alias("n_cells"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def class_counts(spark, folder):
    return P.class_counts(P.drop_null_target(gappy_orders(spark, folder), TARGET), TARGET)


def class_imbalance(spark, folder):
    return P.class_imbalance(table(spark, folder, "labels"), "toxic")


def n_classes(spark, folder):
    return P.n_classes(table(spark, folder, "part"), "p_brand")


def feature_variance(spark, folder):
    df = gappy_events(spark, folder)
    return P.feature_variance(df, [c for c in df.columns if c != "event_type"]).select(
        F.round("feature_variance", 2).alias("feature_variance")
    )


def describe_columns(spark, folder):
    described = P.describe_columns(
        table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    )
    return described.select(
        "column", "n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "min", "max"
    )


def _rounded(df):
    return df.select(*PROFILE_FIELDS, F.round("feature_variance", 2).alias("feature_variance"))


def profile(spark, folder):
    return _rounded(P.profile(gappy_orders(spark, folder), TARGET, "classification", "orders"))


def profile_many(spark, folder):
    entries = [(t.name, t.table, t.target, t.task_type) for t in _tasks(spark, folder)]
    return _rounded(P.profile_many(entries))


def profile_by_group(spark, folder):
    return _rounded(P.profile_by_group(gappy_events(spark, folder), ["user_id"], "event_type", "classification"))


def _stored_years(spark, folder, df, moment, target, name, skip=()):
    """Summaries by year: the years before 1996 first, the others later, one year twice."""
    path = fresh_path(spark, "summaries")
    year = F.year(moment)
    for part in (year < 1996, year >= 1996, year == 1995):
        summaries.store_summaries(df.filter(part), path, target, "classification", name, year, skip=skip)
    return summaries.read_summaries(spark, path)


def profile_parts(spark, folder):
    """The profile of a table that arrived year by year, from its stored summaries alone."""
    stored = _stored_years(spark, folder, gappy_orders(spark, folder), "o_orderdate", TARGET, "orders")
    return _rounded(summaries.merge_profiles(*stored))


def profile_parts_columns(spark, folder):
    """Merged moments, extremes and gaps of every line item column."""
    columns, _ = _stored_years(spark, folder, table(spark, folder, "lineitem"), "l_shipdate", "l_returnflag",
                               "lineitem", skip=("l_shipdate", "l_orderkey"))
    merged = summaries.merge_columns(columns)
    return merged.select(
        "column", "n_rows", "n_present", "n", F.round("mean", 4).alias("mean"),
        F.round(F.sqrt("variance"), 4).alias("stddev"), "min", "max")


QUERIES = {
    "profile_parts": profile_parts,
    "profile_parts_columns": profile_parts_columns,
    "drop_null_target": drop_null_target,
    "split_features_target": split_features_target,
    "columns_by_type": columns_by_type,
    "row_count": row_count,
    "null_counts": null_counts,
    "missing_ratio": missing_ratio,
    "categorical_ratio": categorical_ratio,
    "class_counts": class_counts,
    "class_imbalance": class_imbalance,
    "n_classes": n_classes,
    "feature_variance": feature_variance,
    "describe_columns": describe_columns,
    "profile": profile,
    "profile_many": profile_many,
    "profile_by_group": profile_by_group,
}

_KEPT = f"{GAPPY_ORDERS_SQL} o WHERE o_orderstatus IS NOT NULL"
_ORDER_FEATURES = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _kinds(source: str, names: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS kind, count({c}) AS n_values FROM {source} t" for c, k in names.items()
    )


def _describe(name: str) -> str:
    return f"""SELECT '{name}' AS "column", count({name}) AS n, round(avg({name}), 4) AS mean,
 round(stddev_samp({name}), 4) AS stddev, min({name}) AS "min", max({name}) AS "max" FROM lineitem"""


_LINE_NUMBERS = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_TEXTS = ["l_linestatus", "l_returnflag"]

SQL = {
    "profile_parts": ORDERS_PROFILE.replace("FROM orders", f"FROM {GAPPY_ORDERS_SQL} o"),
    "profile_parts_columns": " UNION ALL ".join(
        [f"""SELECT '{c}' AS "column", count(*) AS n_rows, count({c}) AS n_present, count({c}) AS n,
 round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev, min({c})::double AS "min", max({c})::double AS "max"
 FROM lineitem""" for c in _LINE_NUMBERS]
        + [f"""SELECT '{c}', count(*), count({c}), 0::bigint, null::double, null::double, null::double, null::double
 FROM lineitem""" for c in _LINE_TEXTS]),
    "drop_null_target": f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM {_KEPT}",
    "split_features_target": "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part",
    "columns_by_type": " UNION ALL ".join(
        [
            _kinds(GAPPY_ORDERS_SQL, {
                "o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical",
                "o_totalprice": "numeric", "o_orderdate": "other", "o_orderpriority": "categorical"}),
            _kinds("lineitem", {
                "l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric",
                "l_linenumber": "numeric", "l_quantity": "numeric", "l_extendedprice": "numeric",
                "l_discount": "numeric", "l_tax": "numeric", "l_returnflag": "categorical",
                "l_linestatus": "categorical", "l_shipdate": "other"}),
            _kinds(GAPPY_EVENTS_SQL, {
                "event_id": "numeric", "ts": "other", "user_id": "numeric", "event_type": "categorical",
                "value": "numeric", "props": "categorical"}),
        ]
    ),
    "row_count": f"SELECT count(*) AS n_rows FROM {_KEPT}",
    "null_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing FROM {_KEPT}" for c in _ORDER_FEATURES
    ),
    "missing_ratio": f"""SELECT round(({' + '.join(f'count(*) - count({c})' for c in _ORDER_FEATURES)})
 / (count(*) * 5)::double, 4) AS missing_ratio FROM {_KEPT}""",
    "categorical_ratio": """SELECT 'part' AS dataset, 0.6::double AS categorical_ratio, count(*) * 5 AS n_cells FROM part
 UNION ALL SELECT 'customer', 0.5::double, count(*) * 4 FROM customer
 UNION ALL SELECT 'orders', 0.2::double, count(*) * 5 FROM orders""",
    "class_counts": f"SELECT o_orderstatus AS class, count(*) AS n FROM {_KEPT} GROUP BY 1",
    "class_imbalance": """SELECT round(min(n) / sum(n)::double, 4) AS class_imbalance
 FROM (SELECT count(*) AS n FROM labels GROUP BY toxic) c""",
    "n_classes": "SELECT count(DISTINCT p_brand) AS n_classes FROM part",
    "feature_variance": f"""SELECT round((var_samp(event_id) + var_samp(user_id) + var_samp(value)) / 3, 2)
 AS feature_variance FROM {GAPPY_EVENTS_SQL} e""",
    "describe_columns": " UNION ALL ".join(
        _describe(c) for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "profile": ORDERS_PROFILE.replace("FROM orders", f"FROM {GAPPY_ORDERS_SQL} o"),
    "profile_many": f"{ORDERS_PROFILE} UNION ALL {PART_PROFILE} UNION ALL {CUSTOMER_PROFILE}",
    "profile_by_group": f"""SELECT cast(g.user_id as varchar) AS dataset_name, 'classification' AS task_type,
 g.n_rows, 4::int AS n_features, g.missing_ratio, 0.25::double AS categorical_ratio, c.class_imbalance,
 c.n_classes, g.feature_variance FROM (SELECT user_id, count(*) AS n_rows,
 round((4 * count(*) - count(event_id) - count(ts) - count(value) - count(props)) / (4 * count(*))::double, 4)
 AS missing_ratio, round(round(case when var_samp(value) is null then var_samp(event_id)
 else (var_samp(event_id) + var_samp(value)) / 2 end, 4), 2) AS feature_variance
 FROM {GAPPY_EVENTS_SQL} e GROUP BY user_id) g JOIN (SELECT user_id, round(min(n) / sum(n)::double, 4)
 AS class_imbalance, count(*) AS n_classes FROM (SELECT user_id, event_type, count(*) AS n FROM events
 GROUP BY 1, 2) k GROUP BY 1) c ON g.user_id = c.user_id""",
}
