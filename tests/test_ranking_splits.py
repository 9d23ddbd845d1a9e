import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import quantiles, ranking, splits


def test_average_ranks_with_many_ranges(spark):
    values = [1.0, 2.0, 2.0, 2.0, 5.0, 7.0, 7.0, 9.0] * 3 + [2.0] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double")
    expected = pd.Series(values).rank().groupby(pd.Series(values)).first().to_dict()
    for ranges in (1, 3, 8):
        found = {r["v"]: r["average_rank"] for r in ranking.value_ranks(df, "v", ranges=ranges).collect()}
        assert found == expected


def test_text_ranges(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), "id").alias("v"), F.lit(1).cast("long").alias("n"))
    rows = ranking.running_totals(df, ["v"], ["n"], ranges=7).collect()
    order = sorted(r["v"] for r in rows)
    assert all(order[r["n_before"]] == r["v"] for r in rows)


def test_one_foreign_text_does_not_crowd_the_others_into_a_range(spark):
    urls = spark.range(20_000).select(F.concat(F.lit("https://example.org/pages/of/a/long/path/"), F.lpad("id", 6, "0")).alias("v"))
    foreign = spark.createDataFrame([("about",), ("\U0001F600 zz",), (None,)], "v string")
    rows = ranking.with_range(urls.unionByName(foreign), "v", 8).toPandas()
    sizes = rows.groupby("_range").size()
    assert sizes[-1.0] == 1 and len(sizes) == 9 and sizes.max() < 3 * 20_000 / 8
    known = rows.dropna(subset=["v"])
    order = known.iloc[np.argsort([v.encode() for v in known["v"]])]
    assert order["_range"].is_monotonic_increasing


def test_a_text_repeated_in_most_rows_keeps_ranges_legal(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    rows = ranking.with_range(df, "v", 6).toPandas()
    assert rows[rows["v"] == "hot"]["_range"].nunique() == 1 and rows["_range"].nunique() > 1
    assert ranking.with_range(df.limit(0), "v", 6).count() == 0


def test_ordinal_rank_of_one_hot_value(spark):
    """Nine of ten rows share one value and one group."""
    df = spark.range(2000).selectExpr(
        "id", "'g' AS g", "case when id % 10 = 0 then cast(id as double) else 5.0 end AS v")
    found = ranking.distributed_rank(df, "v", F.col("id"), ["g"], ranges=5).toPandas()
    assert sorted(found["rank"]) == list(range(1, 2001))
    assert found.sort_values("rank")["v"].is_monotonic_increasing


@pytest.mark.parametrize("limit", [1_000_000, 50])
@pytest.mark.parametrize("probability", [0.0, 0.25, 0.5, 1.0])
def test_exact_quantiles(spark, limit, probability):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"a": rng.normal(size=3000), "b": rng.integers(0, 4, 3000) * 1.0,
                          "c": np.where(rng.random(3000) < 0.4, np.nan, rng.random(3000)),
                          "d": np.full(3000, np.nan)})
    df = spark.createDataFrame(frame)
    found = quantiles.exact_quantiles(df, list("abcd"), probability, max_bracket_rows=limit)
    for name in "abc":
        assert found[name] == pytest.approx(frame[name].quantile(probability), abs=1e-12)
    assert found["d"] is None


def test_cells_narrow_even_columns_and_a_sketch_the_others(spark, monkeypatch):
    df = spark.range(4000).selectExpr(
        "cast(id as double) AS even", "cast(id % 5 as double) AS few",
        "case when id % 100 = 0 then 1e300 * (id - 2000) else id / 1e6 end AS uneven")
    sketched = []
    sketch = quantiles._sketched
    monkeypatch.setattr(quantiles, "_sketched", lambda df, value, brackets, columns: (
        sketched.extend(columns), sketch(df, value, brackets, columns))[1])
    found = quantiles.exact_quantiles(df, df.columns, max_bracket_rows=50)
    frame = df.toPandas()
    for name in df.columns:
        assert found[name] == pytest.approx(np.sort(frame[name])[1999:2001].mean(), rel=1e-12)
    assert set(sketched) == {"uneven"}


def _skewed(spark):
    """One class holds most rows, one has a single row, one label is missing."""
    return spark.range(1003).selectExpr(
        "id", "case when id = 0 then 'rare' when id = 1 then null when id < 100 then 'mid' else 'big' end AS y")


def test_split_sizes_are_exact_per_class(spark):
    marked = splits.stratified_split(_skewed(spark), ["id"], "y")
    found = {(r["y"], r["split"]): r["count"] for r in marked.groupBy("y", "split").count().collect()}
    assert found == {("rare", "train"): 1, (None, "train"): 1, ("mid", "test"): 20, ("mid", "train"): 78,
                     ("big", "test"): 181, ("big", "train"): 722}


def test_folds_are_balanced_and_cover_all_rows(spark):
    marked = splits.stratified_kfold(_skewed(spark), ["id"], "y").toPandas()
    assert len(marked) == 1003 and set(marked["fold"]) == {1, 2, 3, 4, 5}
    for _, part in marked.groupby("y"):
        sizes = part.groupby("fold").size().reindex(range(1, 6), fill_value=0)
        assert sizes.max() - sizes.min() <= 1
    plain = splits.kfold(_skewed(spark), ["id"]).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in plain) == [200, 200, 201, 201, 201]


def test_split_depends_on_key_and_seed_only(spark):
    df = _skewed(spark)
    first = splits.random_split(df, ["id"]).toPandas().set_index("id")["split"].sort_index()
    again = splits.random_split(df.repartition(5), ["id"]).toPandas().set_index("id")["split"].sort_index()
    other = splits.random_split(df, ["id"], seed=7).toPandas().set_index("id")["split"].sort_index()
    assert (first == again).all() and not (first == other).all()
    assert (first == "test").sum() == (other == "test").sum() == 201


def test_copies_of_a_key_stay_together(spark):
    df = spark.range(300).selectExpr("id % 60 AS k")
    sides = splits.random_split(df, ["k"]).groupBy("k").agg(F.count_distinct("split").alias("n"))
    assert sides.filter("n > 1").count() == 0


def test_sample_is_exact_and_whole_when_large_enough(spark):
    df = _skewed(spark)
    assert splits.sample_n(df, ["id"], 250).count() == 250
    assert splits.sample_n(df, ["id"], 5000).count() == 1003
    assert splits.sample_n(df, ["id"], 0).count() == 0


def test_approximate_split_share(spark):
    share = splits.approximate_split(spark.range(20000), ["id"]).filter("split = 'test'").count() / 20000
    assert share == pytest.approx(0.2, abs=0.01)


@pytest.mark.parametrize("kind", ["double", "date", "timestamp", "timestamp_ntz", "decimal(9,2)", "string", "int"])
def test_every_type_ranks_alike_in_one_range_and_in_many(spark, kind):
    """Null first, NaN last, whatever the number of ranges."""
    days = spark.range(60).select(F.pmod(F.col("id") * 7, F.lit(23)).alias("id"))
    if kind in ("date", "timestamp", "timestamp_ntz"):
        value = F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).cast(kind)
    elif kind == "string":
        value = F.concat(F.lit("same prefix é"), F.col("id").cast("string"))
    else:
        value = (F.col("id") - 11).cast(kind)
    value = F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(value)
    if kind == "double":
        value = F.when(F.col("id") == 3, F.lit(float("nan"))).when(F.col("id") == 4, float("inf")).otherwise(value)
    df = days.select(value.alias("v"))
    one = ranking.value_ranks(df, "v").collect()
    many = ranking.value_ranks(df, "v", rows_per_range=2).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))
    order = {repr(r["v"]): r["average_rank"] for r in one}
    if kind == "double":
        assert max(order, key=order.get) == "nan"
    assert min(order, key=order.get) == "None"


def test_approximate_split_at_both_ends(spark):
    df = spark.range(500)
    for share, side in ((0.0, "train"), (1.0, "test")):
        assert splits.approximate_split(df, ["id"], test_share=share).filter(F.col("split") != side).isEmpty()
    with pytest.raises(ValueError):
        splits.approximate_split(df, ["id"], test_share=1.5)
