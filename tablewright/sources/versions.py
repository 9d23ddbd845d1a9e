"""Rows replaced in place: only the buckets that hold changed keys are written again.

A table lies in a folder as ``rows/generation=G/bucket=B``, and ``manifests/G`` names the
generation that is live for each bucket. A replacement writes the touched buckets under a new
generation and then the manifest, whose ``_SUCCESS`` file commits it. Until that file is there
readers see the manifest before, so an interrupted run leaves the old rows in place.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.schemas import conform
from tablewright.session import materialize
from tablewright.sources.writers import without_keys

BUCKETS = 64
MANIFEST = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("live", T.LongType()),
        T.StructField("buckets", T.IntegerType()),
        T.StructField("layout", T.StringType()),
    ]
)
PLACE = [T.StructField("generation", T.LongType()), T.StructField("bucket", T.IntegerType())]


def _folder(spark: SparkSession, path: str):
    """The folder of manifests, as Hadoop's file system sees it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def generations(spark: SparkSession, path: str) -> list[int]:
    """Committed generations, oldest first."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    done = [n for n in names if n.isdigit() and files.exists(folder.suffix(f"/{n}/_SUCCESS"))]
    return sorted(int(name) for name in done)


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*[F.col(key).cast("string") for key in keys]), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str, generation: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{generation}")


def _started(spark: SparkSession, path: str) -> int:
    """Highest generation that any run has begun to write, committed or not."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return -1
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return max((int(n.split("=")[1]) for n in names if n.startswith("generation=")), default=-1)


def _write(rows: DataFrame, path: str, generation: int, keys: list[str], buckets: int) -> None:
    placed = rows.withColumn("bucket", _bucket(keys, buckets))
    placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows/generation={generation}")


def create_versioned(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Write ``rows`` as the first generation of a table that ``replace_in_place`` can change.

    ``bucket``, ``generation`` and ``live`` are no names for its columns. A key that holds a
    large share of the rows makes its bucket as large: choose keys that tell rows apart.
    """
    spark = rows.sparkSession
    if generations(spark, path):
        raise ValueError(f"{path} already holds a table")
    generation = _started(spark, path) + 1
    _write(rows, path, generation, keys, buckets)
    manifest = spark.range(buckets, numPartitions=1).select(
        F.col("id").cast("int").alias("bucket"), F.lit(generation).cast("long").alias("live"),
        F.lit(buckets).alias("buckets"), F.lit(rows.schema.json()).alias("layout"))
    manifest.write.parquet(f"{path}/manifests/{generation}")


def read_versioned(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The rows of a committed generation, the last one if none is given."""
    return _rows(spark, path, generation).drop("bucket", "generation")


def _rows(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    known = generations(spark, path)
    if not known:
        raise FileNotFoundError(f"no committed table at {path}")
    chosen = known[-1] if generation is None else generation
    if chosen not in known:
        raise FileNotFoundError(f"generation {chosen} was never committed")
    manifest = _manifest(spark, path, chosen)
    layout = T.StructType.fromJson(json.loads(manifest.select("layout").first()[0]))
    schema = T.StructType([*layout.fields, *PLACE])
    folders = _live(spark, path, chosen)
    if not folders:
        return spark.createDataFrame([], schema)
    held = manifest.groupBy("live").agg(F.collect_list("bucket").alias("held")).collect()
    # Folders are told apart by literals, at most one per bucket, so dead ones are never listed as input.
    wanted = F.lit(False)
    for row in held:
        wanted = wanted | ((F.col("generation") == row["live"]) & F.col("bucket").isin(row["held"]))
    stored = spark.read.schema(schema).option("basePath", f"{path}/rows")
    return stored.parquet(*[f"{path}/rows/generation={g}" for g in folders]).filter(wanted)


def _live(spark: SparkSession, path: str, generation: int) -> list[int]:
    """Generations that still hold live buckets; at most one per bucket."""
    held = _manifest(spark, path, generation).select("live").distinct().collect()
    folder, files = _folder(spark, path)
    names = sorted(row[0] for row in held)
    exists = [g for g in names if files.exists(folder.getParent().suffix(f"/rows/generation={g}"))]
    return exists


def replace_in_place(spark: SparkSession, path: str, new_rows: DataFrame, keys: list[str]) -> int:
    """Swap all rows that share a key with ``new_rows``; returns the generation that holds them.

    ``keys`` are the ones the table was created with. Only buckets of new keys are read and
    written; the manifest carries the others over. Null keys match nothing and are added, as in
    ``replace_rows``. Two runs at once on one table are not supported: the later one to commit
    fails, since its generation exists.
    """
    last = generations(spark, path)[-1]
    manifest = _manifest(spark, path, last)
    buckets = manifest.agg(F.max("buckets")).first()[0]
    generation = _started(spark, path) + 1
    existing = _rows(spark, path, last)
    columns = existing.drop("bucket", "generation").schema
    fresh = materialize(conform(new_rows, columns), "replacement")
    touched = [row[0] for row in fresh.select(_bucket(keys, buckets).alias("b")).distinct().collect()]
    kept = existing.filter(F.col("bucket").isin(touched)).drop("bucket", "generation")
    _write(without_keys(kept, fresh, keys).select(*columns.names).unionByName(fresh), path, generation, keys, buckets)
    live = F.when(F.col("bucket").isin(touched), F.lit(generation)).otherwise(F.col("live")).cast("long")
    manifest.select("bucket", live.alias("live"), "buckets", "layout").coalesce(1).write.parquet(f"{path}/manifests/{generation}")
    return generation


def drop_unreachable(spark: SparkSession, path: str) -> list[int]:
    """Delete generations that no committed manifest names, as interrupted runs leave them."""
    known = generations(spark, path)
    named = {g for generation in known for g in _live(spark, path, generation)}
    folder, files = _folder(spark, path)
    gone = []
    for g in range(_started(spark, path) + 1):
        left = folder.getParent().suffix(f"/rows/generation={g}")
        if g not in named and files.exists(left):
            files.delete(left, True)
            gone.append(g)
    return gone
