"""Fitted models on whole tables, scored on the held-out part."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks.frames import table
from tablewright.operators import boosting, neighbors
from tablewright.operators.inverted_cells import approximate_neighbors as approximate
from tablewright.operators.inverted_cells import build_index
from tablewright.operators.prep import Assemble
from tablewright.operators.splits import stratified_split
from tablewright.plans.jobs import TableTask, prepare, run_one, with_folds
from tablewright.plans.models import Ridge

CLASS_METRICS = ("f1_macro", "accuracy", "precision", "recall", "auc_roc")
FIGURE_METRICS = ("r2",)
FIELDS = "dataset string, method string, n_test long, largest_class long, n_pipeline_stages int"
SCALED = ["imputer", "standard_scaler"]


def line_task(spark, folder):
    """Line status from the figures of a line; the key is kept out of the features."""
    lines = table(spark, folder, "lineitem").withColumn(
        "line", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return TableTask("lineitem", lines, "l_linestatus", "classification", ("line",))


def order_task(spark, folder):
    orders = table(spark, folder, "orders")
    return TableTask("orders", orders, "o_orderstatus", "classification", ("o_orderkey",))


def part_task(spark, folder):
    parts = table(spark, folder, "part")
    return TableTask("part", parts.withColumn("row", F.col("p_partkey")), "p_retailprice", "regression", ("row",))


def embedding_task(spark, folder):
    vectors = table(spark, folder, "embeddings")
    cells = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]
    return TableTask("embeddings", vectors.select("vec_id", "label", *cells).withColumnRenamed("label", "class"),
                     "class", "classification", ("vec_id",))


# Targets that the other columns tell: the same expression in both engines. Trees need two
# columns for ODD, linear models one for LARGE; every step lies between two given values.
LARGE = "case when l_quantity > 25 then 'large' else 'small' end"
ODD = "case when (l_quantity > 25) <> (l_discount > 0.05) then 'odd' else 'even' end"
THIRDS = "case when l_quantity > 30 then 'high' when l_tax > 0.04 then 'taxed' else 'other' end"
STEPS = "case when p_size > 25 then 2000 when p_size > 10 then 1500 else 1000 end"
LINE = "3 * p_size + 100"


def told_task(expression):
    """Line items or parts, with a target that ``expression`` derives from their columns."""
    def make(spark, folder):
        if "l_" in expression:
            task = line_task(spark, folder)
            return replace(task, table=task.table.withColumn("told", F.expr(expression)), target="told")
        task = part_task(spark, folder)
        return replace(task, table=task.table.withColumn("told", F.expr(expression).cast("double")), target="told")

    return make


def _scores(make_task, model, digits=2, **parameters):
    """Fit on the training rows with the model's own defaults, score the rest: what was tested, and the
    metrics. The target can be told from the features, so the metrics of a right model are 1."""
    def query(spark, folder):
        task = make_task(spark, folder)
        rows, categories, n_labels = prepare(task)
        marked, _ = with_folds(rows, task)
        marked = marked.persist()
        spec = {"preprocessing": SCALED, "model": model, "hyperparameters": parameters}
        train, test = marked.filter("fold <> 0"), marked.filter("fold = 0")
        row = run_one(task, model, spec, train, test, categories, n_labels)
        sizes = [r["count"] for r in test.groupBy("label").count().collect()] if n_labels else [test.count()]
        marked.unpersist()
        if row.get("n_pipeline_stages") is None:
            raise RuntimeError(f"{model} could not be fitted: {row.get('error')}")
        metrics = CLASS_METRICS if n_labels else FIGURE_METRICS
        shown = (task.name, model, sum(sizes), max(sizes), row["n_pipeline_stages"])
        shown += tuple(round(row[name], digits) for name in metrics)
        return spark.createDataFrame([shown], FIELDS + "".join(f", {name} double" for name in metrics))

    return query


QUANTITIES = ("l_quantity", "l_discount", "l_tax")  # few values each: bins are exact


def _first_round(spark, folder, objective, label):
    """Binned line items with the scores of a model before its first round."""
    lines = table(spark, folder, "lineitem").select(
        F.array(*[F.col(c).cast("double") for c in QUANTITIES]).alias("_x"), F.expr(label).cast("double").alias("_y"))
    edges = boosting.bin_edges(lines, "_x", len(QUANTITIES))
    coded = boosting.binned(lines, "_x", edges)
    classes = int(coded.agg(F.max("_y")).first()[0]) + 1
    start = boosting.starting_scores(coded, objective, classes)
    scored = coded.withColumn("_s", F.array(*[F.lit(s) for s in start]))
    return boosting.gradients(scored, objective), edges


def boosting_splits(spark, folder):
    """The best root split by each of three columns in the first round of a classifier."""
    rows, edges = _first_round(spark, folder, boosting.LOGISTIC, "cast(l_returnflag = 'R' as int)")
    found = boosting.best_splits(rows, ["0"], len(QUANTITIES), boosting.Growth(ridge=1.0, least_rows=20))
    shown = [(QUANTITIES[s.feature], edges[s.feature][s.bin - 1], round(s.gain, 5), s.left[2]) for s in found]
    return spark.createDataFrame(shown, "feature string, bound double, gain double, n_left long")


def softmax_gradients(spark, folder):
    """Gradient and Hessian sums of the first round, per class of line items and tree."""
    rows, _ = _first_round(
        spark, folder, boosting.SOFTMAX, "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end")
    cells = rows.select(F.col("_y").cast("int").alias("class"), F.posexplode("_g").alias("tree", "g"), "_h")
    return cells.groupBy("class", "tree").agg(
        F.round(F.sum("g"), 4).alias("gradient"), F.round(F.sum(F.get("_h", F.col("tree"))), 4).alias("hessian"))


def ridge_one_feature(spark, folder):
    """Ridge of price on one centred figure, whose weight has a closed form."""
    lines = table(spark, folder, "lineitem")
    centred = lines.select(
        (F.col("l_quantity") - lines.agg(F.avg("l_quantity")).scalar()).alias("x"),
        (F.col("l_extendedprice") - lines.agg(F.avg("l_extendedprice")).scalar()).alias("label"),
    )
    rows = Assemble(inputCols=["x"]).transform(centred)
    model = Ridge(strength=1000.0).fit(rows)
    weight = float(model.coefficients[0])
    return lines.agg(F.count(F.lit(1)).alias("n"), F.round(F.lit(weight), 4).alias("weight"))


def _split_vectors(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>"))
    return stratified_split(rows, ["vec_id"], "label")


def knn_classifier(spark, folder):
    marked = _split_vectors(spark, folder)
    train, test = marked.filter("split = 'train'"), marked.filter("split = 'test'")
    found = neighbors.knn_classify(train, test, "vec_id", "embedding", "label", 5, pivots=16, block_rows=64)
    return found


def nearest_neighbors(spark, folder):
    marked = _split_vectors(spark, folder)
    train, test = marked.filter("split = 'train'"), marked.filter("split = 'test'")
    found = neighbors.nearest_neighbors(train, test, "vec_id", "embedding", "label", 3, pivots=16, block_rows=64)
    return found.select("vec_id", "neighbor", "place", F.round("distance", 5).alias("distance"))


def approximate_neighbors(spark, folder):
    """Recall of the index against the exact neighbours, over all test vectors.

    The given vectors are almost equally far from each other, so most cells hold neighbours."""
    marked = _split_vectors(spark, folder)
    train, test = marked.filter("split = 'train'"), marked.filter("split = 'test'")
    index = build_index(train, "vec_id", "embedding")
    found = approximate(index, test, "vec_id", "embedding", 5, probes=max(8, len(index.centres) * 3 // 4), refine=8)
    exact = neighbors.nearest_neighbors(train, test, "vec_id", "embedding", "label", 5, pivots=16, block_rows=64)
    hit = exact.join(found.select("vec_id", "neighbor"), ["vec_id", "neighbor"], "left_semi")
    indexed = index.table.agg(F.count(F.lit(1))).scalar()
    return found.agg(F.countDistinct("vec_id").alias("n_queries"), F.count(F.lit(1)).alias("n_found")).select(
        indexed.alias("n_indexed"), "n_queries", "n_found",
        (hit.agg(F.count(F.lit(1))).scalar() >= 0.9 * F.col("n_found")).alias("recalled"))


QUERIES = {
    "logistic_regression": _scores(told_task(LARGE), "LogisticRegression"),
    "ridge": _scores(told_task(LINE), "Ridge"),
    "ridge_one_feature": ridge_one_feature,
    "random_forest_classifier": _scores(told_task(LARGE), "RandomForestClassifier"),
    "random_forest_regressor": _scores(told_task(STEPS), "RandomForestRegressor"),
    "gbt_classifier": _scores(told_task(ODD), "GradientBoostingClassifier"),
    "gbt_classifier_joint": _scores(told_task(THIRDS), "GradientBoostingClassifier", n_estimators=20),
    "gbt_regressor": _scores(told_task(STEPS), "GradientBoostingRegressor"),
    "xgb_classifier": _scores(told_task(ODD), "XGBClassifier"),
    "xgb_regressor": _scores(told_task(STEPS), "XGBRegressor"),
    "lgbm_classifier": _scores(told_task(ODD), "LGBMClassifier"),
    "lgbm_regressor": _scores(told_task(STEPS), "LGBMRegressor"),
    "linear_svc": _scores(told_task(LARGE), "SVC", digits=1),
    "boosting_splits": boosting_splits,
    "softmax_gradients": softmax_gradients,
    "knn_classifier": knn_classifier,
    "nearest_neighbors": nearest_neighbors,
    "approximate_neighbors": approximate_neighbors,
}

_NEIGHBORS = """SELECT q.vec_id, t.vec_id AS neighbor, t.label, sqrt(list_sum(list_transform(list_zip(q.v, t.v),
 lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM _rows q JOIN _rows t ON NOT t.test WHERE q.test"""
_ROWS = """WITH _rows AS (SELECT vec_id, label, cast(embedding as double[]) AS v, row_number() OVER (PARTITION BY label
 ORDER BY md5('42:' || vec_id)) <= round(0.2::double * count(*) OVER (PARTITION BY label)) AS test FROM embeddings),
 _near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor) AS place FROM ({0}) n)"""
_ROWS = _ROWS.format(_NEIGHBORS)



def _tested(name: str, expression: str, method: str) -> dict[str, str]:
    """Rows of the test side, per class for classifiers, and metrics of 1."""
    lines = "l_" in expression
    dataset = "lineitem" if lines else "part"
    told = f"SELECT {expression} AS told FROM {dataset}" + (" ) s GROUP BY told" if lines else ") s")
    metrics = ", ".join(f"1.0::double AS {m}" for m in (CLASS_METRICS if lines else FIGURE_METRICS))
    return {name: f"""SELECT '{dataset}' AS dataset, '{method}' AS method, cast(sum(n) as bigint) AS n_test,
 max(n) AS largest_class, 3 AS n_pipeline_stages, {metrics}
 FROM (SELECT cast(round(0.2::double * count(*)) as bigint) AS n FROM ({told}) c"""}


SQL = {
    **_tested("logistic_regression", LARGE, "LogisticRegression"),
    **_tested("ridge", LINE, "Ridge"),
    **_tested("random_forest_classifier", LARGE, "RandomForestClassifier"),
    **_tested("random_forest_regressor", STEPS, "RandomForestRegressor"),
    **_tested("gbt_classifier", ODD, "GradientBoostingClassifier"),
    **_tested("gbt_classifier_joint", THIRDS, "GradientBoostingClassifier"),
    **_tested("gbt_regressor", STEPS, "GradientBoostingRegressor"),
    **_tested("xgb_classifier", ODD, "XGBClassifier"),
    **_tested("xgb_regressor", STEPS, "XGBRegressor"),
    **_tested("lgbm_classifier", ODD, "LGBMClassifier"),
    **_tested("lgbm_regressor", STEPS, "LGBMRegressor"),
    **_tested("linear_svc", LARGE, "SVC"),
    "boosting_splits": """WITH r AS (SELECT cast(l_returnflag = 'R' as int) AS y, unnest(['l_quantity', 'l_discount',
 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]::double[]) AS x FROM lineitem),
 p AS (SELECT avg(y) AS p FROM r),
 v AS (SELECT feature, x, count(*) AS n, sum(p - y) AS g, count(*) * any_value(p * (1 - p)) AS h FROM r, p GROUP BY 1, 2),
 s AS (SELECT feature, x AS bound, sum(n) OVER b AS n_left, sum(g) OVER b AS gl, sum(h) OVER b AS hl,
 sum(n) OVER w AS n, sum(g) OVER w AS g, sum(h) OVER w AS h FROM v WINDOW w AS (PARTITION BY feature),
 b AS (PARTITION BY feature ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM s
 WHERE n_left >= 20 AND n - n_left >= 20)
 SELECT feature, bound, round(gain, 5) AS gain, cast(n_left as bigint) AS n_left FROM t
 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, bound) = 1""",
    "softmax_gradients": """WITH r AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class
 FROM lineitem), c AS (SELECT class, count(*) AS n, count(*) / sum(count(*)) OVER ()::double AS p FROM r GROUP BY 1)
 SELECT c.class, t.class AS tree, round(c.n * (t.p - cast(c.class = t.class as int)), 4) AS gradient,
 round(c.n * t.p * (1 - t.p) * 1.5, 4) AS hessian FROM c, c t""",
    "ridge_one_feature": """SELECT count(*) AS n, round(covar_pop(l_quantity, l_extendedprice) * count(*)
 / (var_pop(l_quantity) * count(*) + 1000), 4) AS weight FROM lineitem""",
    "knn_classifier": f"""{_ROWS} SELECT vec_id, label AS prediction FROM (SELECT vec_id, label, row_number() OVER
 (PARTITION BY vec_id ORDER BY count(*) DESC, label) AS rn FROM _near WHERE place <= 5 GROUP BY 1, 2) v WHERE rn = 1""",
    "nearest_neighbors": f"""{_ROWS} SELECT vec_id, neighbor, cast(place as int) AS place, round(distance, 5) AS distance
 FROM _near WHERE place <= 3""",
    "approximate_neighbors": """WITH s AS (SELECT cast(round(0.2::double * count(*)) as bigint) AS n, count(*) AS n_all
 FROM embeddings GROUP BY label) SELECT cast(sum(n_all - n) as bigint) AS n_indexed, cast(sum(n) as bigint) AS n_queries,
 cast(5 * sum(n) as bigint) AS n_found, true AS recalled FROM s""",
}
