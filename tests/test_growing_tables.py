"""Stored summaries, rows replaced in place, and components of wide tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import prep
from tablewright.operators import profile as P
from tablewright.operators import range_finder as R
from tablewright.operators import summaries as S
from tablewright.session import fresh_path
from tablewright.sources import versions

NAN = float("nan")
EXACT = ["n_rows", "n_features", "missing_ratio", "categorical_ratio", "class_imbalance", "n_classes"]


def rows(spark, n=3000):
    return spark.range(n).selectExpr(
        "id % 7 AS part", "cast(1e9 + id % 101 as double) AS far", "case when id % 9 = 0 then double('NaN') else id / 3 end AS gaps",
        "case when id % 4 = 0 then null else concat('t', id % 50) end AS word",
        "case when id % 11 = 0 then null when id % 5 = 0 then 'a' else 'b' end AS target")


def test_merged_profile_equals_the_profile_of_the_whole(spark):
    df, path = rows(spark), fresh_path(spark, "summaries")
    for chosen in (F.col("part") < 3, F.col("part") >= 3, F.col("part") == 2):
        S.store_summaries(df.filter(chosen), path, "target", "classification", "t", F.col("part"), skip=("part",))
    merged = S.merge_profiles(*S.read_summaries(spark, path)).first().asDict()
    whole = P.profile(df.drop("part"), "target", "classification", "t").first().asDict()
    assert {f: merged[f] for f in EXACT} == {f: whole[f] for f in EXACT}
    assert merged["feature_variance"] == pytest.approx(whole["feature_variance"], rel=1e-9)


def test_merged_columns_and_sketches(spark):
    df, path = rows(spark, 20000), fresh_path(spark, "summaries")
    S.store_summaries(df, path, "target", "classification", "t", F.col("part"), skip=("part",))
    found = {r["column"]: r for r in S.merge_columns(S.read_summaries(spark, path)[0]).collect()}
    kept = df.filter("target is not null").toPandas()
    # far from zero: a difference of sums of squares would lose the variance
    assert found["far"]["variance"] == pytest.approx(kept["far"].var(), rel=1e-9)
    assert found["gaps"]["n"] == kept["gaps"].notna().sum()
    assert found["gaps"]["median"] == pytest.approx(kept["gaps"].median(), rel=0.05)
    assert found["gaps"]["n_distinct"] == pytest.approx(kept["gaps"].nunique(), rel=0.05)
    assert found["word"]["n_distinct"] == pytest.approx(kept["word"].nunique(), rel=0.05)
    assert found["word"]["mean"] is None and found["word"]["variance"] is None


def test_a_part_is_read_alone(spark):
    path = fresh_path(spark, "summaries")
    first = rows(spark).filter("part = 1")
    S.store_summaries(first, path, "target", "classification", "t", F.col("part"), skip=("part",))
    before = {r["part"]: r["n"] for r in S.read_summaries(spark, path)[1].groupBy("part").agg(F.sum("n").alias("n")).collect()}
    S.store_summaries(rows(spark).filter("part = 2"), path, "target", "classification", "t", F.col("part"), skip=("part",))
    after = {r["part"]: r["n"] for r in S.read_summaries(spark, path)[1].groupBy("part").agg(F.sum("n").alias("n")).collect()}
    assert after["1"] == before["1"] and set(after) == {"1", "2"}


def test_parts_without_a_column_single_rows_and_null_parts(spark):
    path = fresh_path(spark, "summaries")
    S.store_summaries(spark.createDataFrame([("1", 2.0, "p")], "part string, a double, y string"),
                      path, "y", "classification", "t", F.col("part"), skip=("part",))
    S.store_summaries(spark.createDataFrame([(None, 4.0, "x", "q"), (None, None, None, "q")], "part string, a double, b string, y string"),
                      path, "y", "classification", "t", F.col("part"), skip=("part",))
    found = S.merge_profiles(*S.read_summaries(spark, path)).first()
    assert found["n_rows"] == 3 and found["n_features"] == 2 and found["n_classes"] == 2
    assert found["missing_ratio"] == round(3 / 6, 4)  # a: one gap, b: one gap and the part without it
    assert found["feature_variance"] == 2.0


def test_regression_and_empty_stores(spark):
    path = fresh_path(spark, "summaries")
    df = rows(spark)
    S.store_summaries(df, path, "gaps", "regression", "t", F.col("part"), skip=("part",))
    found = S.merge_profiles(*S.read_summaries(spark, path)).first()
    assert found["n_classes"] is None and found["n_rows"] == df.filter("not isnan(gaps)").count()
    S.store_summaries(df.filter("false"), path, "gaps", "regression", "t", F.col("part"), skip=("part",))
    assert S.merge_profiles(*S.read_summaries(spark, path)).first()["n_rows"] == found["n_rows"]
    with pytest.raises(ValueError):
        S.summarize_columns(df, "gaps", "clustering", "t", F.col("part"))


def held(spark, path, generation=None):
    return sorted((r["k"], r["v"]) for r in versions.read_versioned(spark, path, generation).collect())


def test_only_touched_buckets_are_written(spark):
    path = fresh_path(spark, "versioned")
    old = spark.range(200).selectExpr("cast(id as string) AS k", "id AS v")
    versions.create_versioned(old, path, ["k"], buckets=16)
    generation = versions.replace_in_place(spark, path, spark.createDataFrame([("7", -1), ("new", -2)], "k string, v long"), ["k"])
    assert generation == 1
    expected = sorted([(str(i), i) for i in range(200) if i != 7] + [("7", -1), ("new", -2)])
    assert held(spark, path) == expected
    assert held(spark, path, 0) == sorted((str(i), i) for i in range(200))
    written = spark.read.parquet(f"{path}/rows/generation=1").select("bucket").distinct().count()
    assert written <= 2


def test_an_interrupted_run_leaves_the_old_rows(spark):
    path = fresh_path(spark, "versioned")
    versions.create_versioned(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long"), path, ["k"])
    spark.createDataFrame([("a", 9, 0)], "k string, v long, bucket int").write.partitionBy("bucket").parquet(
        f"{path}/rows/generation=1")
    assert held(spark, path) == [("a", 1), ("b", 2)]
    assert versions.replace_in_place(spark, path, spark.createDataFrame([("b", 5)], "k string, v long"), ["k"]) == 2
    assert held(spark, path) == [("a", 1), ("b", 5)]
    assert versions.drop_unreachable(spark, path) == [1]
    assert held(spark, path) == [("a", 1), ("b", 5)] and versions.generations(spark, path) == [0, 2]


def test_null_keys_repeated_rows_and_empty_tables(spark):
    path = fresh_path(spark, "versioned")
    schema = "k string, v long"
    versions.create_versioned(spark.createDataFrame([], schema), path, ["k"])
    assert held(spark, path) == []
    versions.replace_in_place(spark, path, spark.createDataFrame([("a", 1), ("a", 1)], schema), ["k"])
    assert held(spark, path) == [("a", 1), ("a", 1)]
    versions.replace_in_place(spark, path, spark.createDataFrame([(None, 3)], schema), ["k"])
    versions.replace_in_place(spark, path, spark.createDataFrame([(None, 4)], schema), ["k"])
    rows_now = versions.read_versioned(spark, path).collect()
    assert sorted(r["v"] for r in rows_now) == [1, 1, 3, 4]
    versions.replace_in_place(spark, path, spark.createDataFrame([], schema), ["k"])
    assert versions.read_versioned(spark, path).count() == 4
    with pytest.raises(ValueError):
        versions.create_versioned(spark.createDataFrame([], schema), path, ["k"])


def cloud(spark, n, width, seed=3):
    generator = np.random.default_rng(seed)
    scales = 1 / (1 + np.arange(width)) ** 1.2
    data = generator.standard_normal((n, width)) * scales @ np.linalg.qr(generator.standard_normal((width, width)))[0] + 5
    return data, spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], "id long, v array<double>").repartition(6)


def test_range_finder_equals_the_exact_components(spark):
    data, df = cloud(spark, 1500, 64)
    found = R.principal_components(df, "v", 12)
    values, vectors = np.linalg.eigh(np.cov(data.T))
    shares = values[::-1] / values.sum()
    assert np.abs(found.shares - shares[:12]).max() < 1e-3
    assert np.abs(np.abs((found.axes[:6] * vectors[:, ::-1].T[:6]).sum(axis=1)) - 1).max() < 1e-3
    assert found.count_for(0.5) == int(np.flatnonzero(np.cumsum(shares) > 0.5)[0]) + 1
    shown = R.project(df, "v", found).agg(F.var_samp("pc_1").alias("a"), F.avg("pc_2").alias("b")).first()
    assert math.isclose(shown["a"], found.variances[0], rel_tol=1e-9) and abs(shown["b"]) < 1e-9


def test_given_vectors_agree_with_the_exact_step(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    wide = df.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    exact = prep.PcaStep(excludeCols=["vec_id"]).fit(wide)
    found = R.principal_components(df, "embedding", 10, passes=20)
    assert np.abs(found.shares - np.array(exact.explained[:10])).max() < 1e-3


def test_pca_step_takes_the_range_finder_for_wide_tables(spark):
    data, df = cloud(spark, 400, 40)
    wide = df.select("id", *[F.col("v")[i].alias(f"c{i}") for i in range(40)])
    exact = prep.PcaStep(excludeCols=["id"], share=0.9).fit(wide)
    model = prep.PcaStep(excludeCols=["id"], share=0.9, exactWidth=10).fit(wide)
    assert isinstance(model, prep.WidePcaModel) and model.k == exact.k
    a, b = (m.transform(wide).orderBy("id").select("id", "pc_1", "pc_2").toPandas() for m in (exact, model))
    for name in ("pc_1", "pc_2"):
        assert np.abs(np.abs(a[name]) - np.abs(b[name])).max() < 1e-3


def test_five_thousand_columns(spark):
    df = spark.range(600).select(
        "id", F.transform(F.sequence(F.lit(1), F.lit(5000)),
                          lambda i: F.sin(F.col("id") * 0.1) * i + F.rand(7) * 0.01).alias("v"))
    found = R.principal_components(df, "v", 3, passes=2)
    assert found.axes.shape == (3, 5000) and found.shares[0] > 0.99


def test_vectors_that_are_null_uneven_or_not_there(spark):
    schema = "id long, v array<double>"
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [3.0, 2.0])], schema)
    found = R.principal_components(df, "v", 5)
    assert found.shares.tolist() == pytest.approx([1.0, 0.0]) and found.total == pytest.approx(2.0)
    assert [r["pc_1"] is None for r in R.project(df, "v", found).orderBy("id").collect()] == [False, True, False]
    assert R.principal_components(df.filter("false"), "v", 5).total == 0.0
    assert R.principal_components(df.filter("id = 1"), "v", 5).shares.tolist() == [0.0, 0.0]
    for bad in ([1.0], [NAN, 1.0], [None, 1.0]):
        with pytest.raises(Exception, match="vector must have|missing or infinite"):
            R.principal_components(df.union(spark.createDataFrame([(4, bad)], schema)), "v", 2)
