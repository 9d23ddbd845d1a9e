"""Spark session defaults and the shared folder every job writes through."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def build_session(app: str = "tablewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested with.

    Shuffle parallelism is left to adaptive execution unless the caller sets it;
    on a cluster pass ``spark_sql_shuffle_partitions`` a few times the core count.
    Keyword names use ``_`` where the Spark key uses ``.``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("_", "."): str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session may run without it; it then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tablewright-")
        context.setCheckpointDir(_local_roots[app])
    return _local_roots[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has written to yet."""
    return f"{shared_root(spark)}/tablewright/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage durably, and gives the optimizer a measured size: a small
    table is broadcast under ``spark.sql.autoBroadcastJoinThreshold`` while a
    large one is shuffled, so no join needs an unchecked broadcast hint. Rows of a megabyte and more
    need ``file_rows``, the most rows of a file: the reader holds up to 4,096 rows of a file at once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While the block runs, a query's shuffle files go when it ends, not when the driver's collector finds them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash the rows of a table with too few partitions over all cores.

    Model fits pass over their rows many times; one small file would keep them on one
    core. A table that already has a partition per core is left alone. Call it on a
    table as read: counting the partitions of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
