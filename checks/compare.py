"""Run registered queries beside their SQL and compare the rows.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks import oracle_sql, queries
from tablewright.session import build_session

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
 pages benchmark labels conversations""".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return repr(float(value) + 0.0)
    return str(value)


def normal_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, connection, folder: str, name: str) -> tuple[int, str | None]:
    """Row count, and what differs from the SQL (None when nothing does)."""
    df = queries()[name](spark, folder)
    found = df.collect()
    sql = oracle_sql().get(name)
    if sql is None:
        return len(found), None
    expected = connection.execute(sql)
    columns = [item[0] for item in expected.description]
    wanted = expected.fetchall()
    if sorted(columns) != sorted(df.columns):
        return len(found), f"columns {sorted(df.columns)} but SQL {sorted(columns)}"
    left, right = normal_rows(df.columns, found), normal_rows(columns, wanted)
    if len(left) != len(right):
        return len(left), f"{len(left)} rows but SQL {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return len(left), f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:] or list(queries())
    spark = build_session(
        "compare", "local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for name in names:
        started = time.time()
        try:
            count, problem = difference(spark, connection, folder, name)
        except Exception as error:
            count, problem = -1, f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "sql" if name in oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {name:28} {kind:4} {count:7} rows "
              f"{time.time() - started:6.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
