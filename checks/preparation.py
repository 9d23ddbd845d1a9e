"""Feature preparation: fitted statistics and transformed rows."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.frames import table
from checks.profiles import GAPPY_EVENTS_SQL, GAPPY_ORDERS_SQL, gappy_events, gappy_orders
from tablewright.operators import prep, range_finder
from tablewright.operators.splits import stratified_split
from tablewright.plans.pipelines import build_fixed, build_pipeline

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def impute_median(spark, folder):
    df = gappy_events(spark, folder).select("event_id", "value")
    return prep.MedianImputer(inputCols=["value"]).fit(df).transform(df)


def impute_mode(spark, folder):
    """Numeric gaps through the stage, text gaps through the one-column form."""
    df = gappy_orders(spark, folder).select(
        "o_orderkey", F.floor(F.col("o_totalprice") / 50000).cast("double").alias("price_band"), "o_orderpriority"
    )
    filled = prep.ModeImputer(inputCols=["price_band"]).fit(df).transform(df)
    return prep.fill_text_mode(filled, "o_orderpriority")


def standard_scaler(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *LINE_NUMBERS)
    scaled = prep.PopulationScaler(inputCols=LINE_NUMBERS).fit(df).transform(df)
    return scaled.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in LINE_NUMBERS])


def min_max_scaler(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", *LINE_NUMBERS, F.lit(1.0).alias("constant"))
    names = [*LINE_NUMBERS, "constant"]
    scaled = prep.RangeScaler(inputCols=names).fit(df).transform(df)
    return scaled.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in names])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def one_hot(spark, folder):
    """Codes fitted on the table, then the sparse indicator stage, shown as an array."""
    df = gappy_orders(spark, folder).select("o_orderkey", "o_orderpriority")
    coded = prep.CategoryEncoder(inputCols=["o_orderpriority"]).fit(df).transform(df)
    hot = prep.OneHotStep(inputCols=["o_orderpriority"]).fit(coded).transform(coded)
    slots = vector_to_array("o_orderpriority_onehot")
    return hot.select(
        "o_orderkey", *[slots[i].cast("int").alias(f"slot_{i}") for i in range(6)]
    )


def one_hot_columns(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return prep.one_hot_columns(df, "o_orderpriority", PRIORITIES)


def ordinal_encode(spark, folder):
    """Fitted on the cheaper half of the parts: brand and type of the rest may be new."""
    df = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    train = df.filter("p_retailprice < 1000")
    model = prep.CategoryEncoder(inputCols=["p_name", "p_brand", "p_type"]).fit(train)
    return model.transform(df)


def ordinal_encode_wide(spark, folder):
    """A text column with a value per row, coded range by range."""
    customers = table(spark, folder, "customer")
    return prep.category_codes(customers, "c_name", ranges=8)


def encode_target(spark, folder):
    labelled, _ = prep.encode_target(table(spark, folder, "orders"), "o_orderstatus", "classification")
    return labelled.select("o_orderkey", "o_orderstatus", "label")


def encode_target_regression(spark, folder):
    labelled, _ = prep.encode_target(gappy_orders(spark, folder), "o_totalprice", "regression")
    return labelled.select("o_orderkey", "label")


def cast_features(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *LINE_NUMBERS)
    names = ["l_partkey", *LINE_NUMBERS]
    cells = vector_to_array("features")
    return prep.cast_features(df, names).select(
        "l_orderkey", "l_linenumber", *[cells[i].alias(f"x{i}") for i in range(len(names))]
    )


def variance_threshold(spark, folder):
    """The discount and tax columns vary too little and go."""
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *LINE_NUMBERS)
    return prep.VarianceFilter(inputCols=LINE_NUMBERS).fit(df).transform(df)


def column_variances(spark, folder):
    rows = prep.column_variances(table(spark, folder, "lineitem"), LINE_NUMBERS)
    return rows.select("column", F.round("variance", 4).alias("variance"))


def covariance_matrix(spark, folder):
    rows = prep.covariance_matrix(table(spark, folder, "lineitem"), LINE_NUMBERS)
    return rows.select("a", "b", F.round("covariance", 4).alias("covariance"))


def _embedding_columns(spark, folder):
    df = table(spark, folder, "embeddings")
    return df.select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


def pca(spark, folder):
    """Components, their number, and each one's share beside the spread it shows."""
    df = _embedding_columns(spark, folder)
    model = prep.PcaStep(excludeCols=["vec_id", "label"]).fit(df)
    shown = model.transform(df)
    records = [
        F.struct(
            F.lit(i + 1).alias("component"),
            F.lit(model.k).alias("k"),
            F.lit(model.explained[i]).alias("share"),
            F.avg(f"pc_{i + 1}").alias("mean"),
            F.var_samp(f"pc_{i + 1}").alias("variance"),
        )
        for i in range(model.k)
    ]
    return shown.agg(F.array(*records).alias("r")).select(F.inline("r"))


def pca_wide(spark, folder):
    """The ten leading components by the range finder beside the spread that the rows show."""
    df = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = range_finder.principal_components(df, "embedding", 10, passes=20)
    shown = range_finder.project(df, "embedding", found)
    records = [
        F.struct(
            F.lit(i + 1).alias("component"),
            F.lit(float(found.shares[i])).alias("share"),
            F.lit(float(found.variances[i])).alias("variance"),
            F.avg(f"pc_{i + 1}").alias("mean"),
            F.var_samp(f"pc_{i + 1}").alias("shown"),
        )
        for i in range(10)
    ]
    return shown.agg(F.array(*records).alias("r")).select(F.inline("r"))


def pca_wide_total(spark, folder):
    """Rows, total variance and the mean's length, which SQL can tell too."""
    df = table(spark, folder, "embeddings").select("embedding")
    found = range_finder.principal_components(df, "embedding", 5, passes=1)
    return df.agg(
        F.count("embedding").alias("n_rows"), F.round(F.lit(found.total), 6).alias("total"),
        F.round(F.lit(float((found.mean**2).sum())), 6).alias("mean_length"))


def _order_rows(spark, folder):
    labelled, _ = prep.encode_target(gappy_orders(spark, folder).dropna(subset=["o_orderstatus"]),
                                     "o_orderstatus", "classification")
    rows = labelled.drop("o_orderstatus", "o_orderdate")
    return stratified_split(rows, ["o_orderkey"], "label")


EXCLUDED = ["o_orderkey", "split"]


def _fit_and_show(rows, pipeline):
    fitted = pipeline.fit(rows.filter("split = 'train'"))
    shown = fitted.transform(rows.filter("split = 'test'"))
    return shown.select("o_orderkey", "label", "prediction")


def build_pipeline_query(spark, folder):
    """Every kind of step before a linear model; no imputer named, so one is put first."""
    spec = {
        "preprocessing": ["label_encoder", "one_hot_encoder", "standard_scaler", "variance_threshold", "pca"],
        "model": "LogisticRegression",
        "hyperparameters": {"C": 1.0, "max_iter": 100},
    }
    rows = _order_rows(spark, folder)
    return _fit_and_show(rows, build_pipeline(spec, EXCLUDED, ["o_orderpriority"]))


def build_fixed_query(spark, folder):
    spec = {"preprocessing": ["pca"], "model": "LogisticRegression", "hyperparameters": {}}
    rows = _order_rows(spark, folder)
    return _fit_and_show(rows, build_fixed(spec, EXCLUDED, ["o_orderpriority"]))


QUERIES = {
    "impute_median": impute_median,
    "impute_mode": impute_mode,
    "standard_scaler": standard_scaler,
    "min_max_scaler": min_max_scaler,
    "one_hot": one_hot,
    "one_hot_columns": one_hot_columns,
    "ordinal_encode": ordinal_encode,
    "ordinal_encode_wide": ordinal_encode_wide,
    "encode_target": encode_target,
    "encode_target_regression": encode_target_regression,
    "cast_features": cast_features,
    "variance_threshold": variance_threshold,
    "column_variances": column_variances,
    "covariance_matrix": covariance_matrix,
    "pca": pca,
    "pca_wide": pca_wide,
    "pca_wide_total": pca_wide_total,
    "build_pipeline": build_pipeline_query,
    "build_fixed": build_fixed_query,
}

_ORDER = ", ".join(["l_orderkey", "l_linenumber"])
_STANDARD = ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in LINE_NUMBERS)
_MINMAX = ", ".join(
    f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in LINE_NUMBERS)
_CODE = """coalesce((SELECT cast(c.code as double) FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM
 (SELECT DISTINCT {0} AS v FROM part WHERE p_retailprice < 1000) d) c WHERE c.v = p.{0}), -1) AS {0}"""
_BAND = "cast(floor(o_totalprice / 50000) as double)"

SQL = {
    "impute_median": f"""SELECT event_id, coalesce(value, (SELECT median(value) FROM {GAPPY_EVENTS_SQL} m)) AS value
 FROM {GAPPY_EVENTS_SQL} e""",
    "impute_mode": f"""SELECT o_orderkey, coalesce({_BAND}, (SELECT {_BAND} AS b FROM {GAPPY_ORDERS_SQL} m
 WHERE o_totalprice IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, b LIMIT 1)) AS price_band,
 coalesce(o_orderpriority, (SELECT o_orderpriority FROM {GAPPY_ORDERS_SQL} m WHERE o_orderpriority IS NOT NULL
 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM {GAPPY_ORDERS_SQL} o""",
    "standard_scaler": f"SELECT {_ORDER}, {_STANDARD} FROM lineitem",
    "min_max_scaler": f"SELECT {_ORDER}, {_MINMAX}, 0.0::double AS constant FROM lineitem",
    "one_hot": "SELECT o_orderkey, " + ", ".join(
        f"case when coalesce(o_orderpriority, 'nan') = '{v}' then 1 else 0 end AS slot_{i}"
        for i, v in enumerate([*PRIORITIES, "nan"])) + f" FROM {GAPPY_ORDERS_SQL} o",
    "one_hot_columns": "SELECT o_orderkey, " + ", ".join(
        f"case when o_orderpriority = '{v}' then 1 else 0 end AS \"o_orderpriority={v}\"" for v in PRIORITIES)
    + " FROM orders",
    "ordinal_encode": f"""SELECT p_partkey, {_CODE.format('p_name')}, {_CODE.format('p_brand')},
 {_CODE.format('p_type')}, p_retailprice FROM part p""",
    "ordinal_encode_wide": """SELECT c_name AS value, cast(row_number() OVER (ORDER BY c_name) - 1 as double) AS code
 FROM (SELECT DISTINCT c_name FROM customer) d""",
    "encode_target": """SELECT o_orderkey, o_orderstatus, cast(dense_rank() OVER (ORDER BY o_orderstatus) - 1
 as double) AS label FROM orders""",
    "encode_target_regression": f"""SELECT o_orderkey, coalesce(o_totalprice, (SELECT median(o_totalprice)
 FROM {GAPPY_ORDERS_SQL} m)) AS label FROM {GAPPY_ORDERS_SQL} o""",
    "cast_features": """SELECT l_orderkey, l_linenumber, cast(l_partkey as double) AS x0, l_quantity AS x1,
 l_extendedprice AS x2, l_discount AS x3, l_tax AS x4 FROM lineitem""",
    "variance_threshold": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem",
    "column_variances": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(var_pop({c}), 4) AS variance FROM lineitem" for c in LINE_NUMBERS),
    "pca_wide_total": """SELECT max(n) AS n_rows, round(sum(v), 6) AS total, round(sum(m * m), 6) AS mean_length FROM (
 SELECT count(*) AS n, var_samp(x::double) AS v, avg(x::double) AS m FROM (
 SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) e GROUP BY place) p""",
    "covariance_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) AS covariance FROM lineitem"
        for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i:]),
}
