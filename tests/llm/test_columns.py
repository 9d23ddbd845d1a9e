"""Columns of the caller that are named like an operator's own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tablewright.llm.columns import free_prefix, inner_names
from tablewright.llm.language import identify_language
from tablewright.llm.line_dedup import dedup_lines
from tablewright.llm.mixing import mix_sources, mixed_rows
from tablewright.llm.secrets import find_secrets, labelled_samples
from tablewright.llm.sharding import shard_documents

INNER = (
    "_text _assign _access _hex _known _rest _token _size _key _cell _tie _offset _source_size _target _before "
    "_cut _cut_text _digest _bytes _crc _shard _n _found _drop_id _lang_pred _score _mix_size _mix_taken").split()


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(i, f"some plain words in text number {i} password=secret{i}" if i % 4 else None, "en", f"s{i % 2}", *["keep"] * len(INNER))
            for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in INNER))


@pytest.mark.parametrize("operator", [
    lambda docs: find_secrets(docs, None), lambda docs: find_secrets(docs, [0.0] * 128 * 128), shard_documents, mix_sources, dedup_lines,
    lambda docs: mixed_rows(mix_sources(docs)), lambda docs: identify_language(docs, None),
    lambda docs: pipeline.keep_known_languages(docs.sparkSession, docs, ""),
    lambda docs: pipeline.mix(docs.sparkSession, docs, "")])
def test_callers_columns_come_back_unchanged(crowded, operator):
    found = operator(crowded)
    assert found.columns[: len(crowded.columns)] == crowded.columns
    rows = found.collect()
    assert all(row[name] == "keep" for row in rows for name in INNER)
    plain = operator(crowded.drop(*INNER))
    extra = [c for c in plain.columns]
    assert sorted(map(str, found.select(extra).collect())) == sorted(map(str, plain.collect()))


def test_texts_and_ids_may_have_such_a_name(crowded):
    renamed = crowded.select(F.col("doc_id").alias("_cell"), F.col("text").alias("_text"), "source")
    plain = {r["doc_id"]: (r["size"], r["taken"]) for r in mix_sources(crowded.drop(*INNER)).collect()}
    found = mix_sources(renamed, id_col="_cell", text_col="_text")
    assert {r["_cell"]: (r["size"], r["taken"]) for r in found.collect()} == plain
    wanted = find_secrets(crowded.drop(*INNER), None).select("secret_spans").collect()
    assert sorted(map(str, find_secrets(renamed, None, text_col="_text").select("secret_spans").collect())) == sorted(map(str, wanted))
    samples = labelled_samples(renamed, "_cell", "_text", 100, 1)
    assert samples.filter("random").count() == 9


def test_a_result_takes_the_place_of_an_inner_name(spark):
    @inner_names("_x")
    def double(docs, value_col="v"):
        return docs.withColumn("_x", F.col(value_col) * 2)

    table = spark.createDataFrame([(1, "old")], "v long, _x string")
    assert [tuple(r) for r in double(table).collect()] == [(1, 2)]
    assert free_prefix(["a", "_b", "__c"]) == "___" and free_prefix(["a"]) == "_"
