"""Corpus pipeline: each stage reads what its predecessor kept.

All stages keep extra columns, whatever their names, but for those that the last one adds
(``size, text_crc32, law, shard, slot, grown_shard``), which it replaces. Null and empty texts and texts without a
letter go with the first stage; texts are read whole, however long; rows that repeat an id stay or go together;
rows without an id are never copies or leaks of others. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.columns import free_prefix
from tablewright.llm.decontaminate import find_leaks
from tablewright.llm.language import UNDETERMINED, identify_language, train_language_model
from tablewright.llm.mixing import mix_sources, mixed_rows
from tablewright.llm.near_dedup import near_duplicates
from tablewright.llm.sharding import shard_documents
from tablewright.session import materialize

LEAST_SCORE = 0.3  # mean probability below which a language counts as unknown


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language the model cannot tell at all, go."""
    own = free_prefix(docs.columns)
    found = identify_language(docs, train_language_model(docs), prefix=own)
    known = found.filter((F.col(f"{own}lang_pred") != UNDETERMINED) & (F.col(f"{own}score") >= LEAST_SCORE))
    return known.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.80 of five-word shingles) stays."""
    found = near_duplicates(docs, percent=80)
    copies = materialize(found.filter("not kept").select("doc_id").distinct(), "copies")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that repeats a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = materialize(find_leaks(docs, items).select("doc_id").distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a source cut to its budget."""
    own = free_prefix(docs.columns) + "mix_"
    return mixed_rows(mix_sources(docs, prefix=own), prefix=own)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in 16 shards of near-equal bytes, every document with its place."""
    return shard_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

ORACLE_SQL = None  # trained models and sketches: tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; between stages the rows are written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
