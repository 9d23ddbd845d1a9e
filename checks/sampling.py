"""Splits, folds, samples, ranks and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.frames import LINE_KEY, table
from tablewright.operators import profile as P
from tablewright.operators import ranking as R
from tablewright.operators import splits as S

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def stratified_split(spark, folder):
    return S.stratified_split(table(spark, folder, "orders"), ["o_orderkey"], "o_orderstatus").select(
        "o_orderkey", "o_orderstatus", "split"
    )


def random_split(spark, folder):
    return S.random_split(table(spark, folder, "events"), ["event_id"]).select("event_id", "split")


def approximate_split(spark, folder):
    return S.approximate_split(table(spark, folder, "lineitem"), LINE_KEYS).select(*LINE_KEYS, "split")


def stratified_kfold(spark, folder):
    return S.stratified_kfold(table(spark, folder, "orders"), ["o_orderkey"], "o_orderstatus").select(
        "o_orderkey", "o_orderstatus", "fold"
    )


def kfold(spark, folder):
    return S.kfold(table(spark, folder, "events"), ["event_id"]).select("event_id", "fold")


def sample_n(spark, folder):
    return S.sample_n(table(spark, folder, "lineitem"), LINE_KEYS, 50_000).select(
        *LINE_KEYS, "l_quantity", "l_linestatus"
    )


def sort_rows(spark, folder):
    """Class counts in report order: rarest first."""
    return P.class_counts(table(spark, folder, "part"), "p_brand")


def distributed_rank(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.expr(LINE_KEY).alias("line"), "l_returnflag", "l_quantity")
    return R.distributed_rank(lines, "l_quantity", F.col("line"), ["l_returnflag"], ranges=16)


def average_rank(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice")
    return R.value_ranks(lines, "l_extendedprice", ["l_returnflag"], ranges=16).select(
        "l_returnflag", "l_extendedprice", "n", "average_rank"
    )


QUERIES = {
    "stratified_split": stratified_split,
    "random_split": random_split,
    "approximate_split": approximate_split,
    "stratified_kfold": stratified_kfold,
    "kfold": kfold,
    "sample_n": sample_n,
    "sort_rows": sort_rows,
    "distributed_rank": distributed_rank,
    "average_rank": average_rank,
}

_LINE_DIGEST = "md5(concat_ws(':', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey))"


def split_sql(source: str, key: str, columns: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {columns}, case when rn <= round(0.2::double * n) then 'test' else 'train' end AS split
 FROM (SELECT *, row_number() OVER ({part} ORDER BY md5('42:' || {key})) AS rn,
 count(*) OVER ({part}) AS n FROM {source}) s"""


SQL = {
    "stratified_split": split_sql("orders", "o_orderkey", "o_orderkey, o_orderstatus", "o_orderstatus"),
    "random_split": split_sql("events", "event_id", "event_id"),
    "approximate_split": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 case when substr({_LINE_DIGEST}, 1, 8) < '33333333' then 'test' else 'train' end AS split FROM lineitem""",
    "stratified_kfold": """SELECT o_orderkey, o_orderstatus, cast(ntile(5) OVER (PARTITION BY o_orderstatus
 ORDER BY md5('42:' || o_orderkey)) as int) AS fold FROM orders""",
    "kfold": """SELECT event_id, cast(ntile(5) OVER (ORDER BY md5('42:' || event_id)) as int) AS fold FROM events""",
    "sample_n": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus FROM lineitem
 ORDER BY {_LINE_DIGEST} LIMIT 50000""",
    "sort_rows": "SELECT p_brand AS class, count(*) AS n FROM part GROUP BY 1",
    "distributed_rank": f"""SELECT {LINE_KEY} AS line, l_returnflag, l_quantity, row_number() OVER
 (PARTITION BY l_returnflag ORDER BY l_quantity, md5({LINE_KEY})) AS rank FROM lineitem""",
    "average_rank": """SELECT l_returnflag, l_extendedprice, n, sum(n) OVER (PARTITION BY l_returnflag
 ORDER BY l_extendedprice) - n + (n + 1) / 2::double AS average_rank FROM (SELECT l_returnflag,
 l_extendedprice, count(*) AS n FROM lineitem GROUP BY 1, 2) c""",
}
