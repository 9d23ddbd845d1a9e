"""Model registry: estimators by name, with penalties stated per row as users expect.

The linear models take ``C`` or ``alpha`` as weights against the summed loss; MLlib
averages the loss, so the conversion needs the row count (and for ridge the spread of
the label), which one aggregate over the training rows supplies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.specs import FALLBACK_REGRESSOR, MODEL_PARAMETERS
from tablewright.operators import boosting
from tablewright.operators.forest import LOCAL_ROWS, ForestGrowth, fit_forest, forest_scores
from tablewright.operators.margins import FOURIER, FourierMap, fit_margins, margin_cells, margins_of, platt, share_of, spread_of_features
from tablewright.operators.neighbors import nearest_neighbors, vote
from tablewright.session import materialize

SEED = 42
TREE_MEMORY_MB = 1024


class _Supervised(Estimator, HasLabelCol, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    def _named(self, estimator):
        return estimator.setLabelCol(self.getLabelCol()).setFeaturesCol(self.getFeaturesCol())


class _Penalised(_Supervised):
    strength = Param(Params._dummy(), "strength", "C or alpha", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "iteration limit", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, strength=1.0, maxIter=1000, labelCol="label", featuresCol="features"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(strength=1.0, maxIter=1000, labelCol="label", featuresCol="features")

    def _row_share(self, dataset) -> float:
        return 1.0 / (self.getOrDefault("strength") * dataset.count())


class PenalisedLogistic(_Penalised):
    """Logistic regression with penalty weight 1/C against the summed loss."""

    def _fit(self, dataset):
        return self._named(
            LogisticRegression(
                regParam=self._row_share(dataset),
                standardization=False,
                maxIter=self.getOrDefault("maxIter"),
            )
        ).fit(dataset)


class Ridge(_Penalised):
    """Least squares with ``alpha`` times the squared weights against the summed loss."""

    def _fit(self, dataset):
        label = F.col(self.getLabelCol()).cast("double")
        n, spread = dataset.agg(F.count(label), F.stddev_pop(label)).first()
        return self._named(
            LinearRegression(
                regParam=self.getOrDefault("strength") * (spread or 0.0) / n,
                elasticNetParam=0.0,
                standardization=False,
                solver="auto",
            )
        ).fit(dataset)


def _class_count(dataset, label: str) -> int:
    return int(dataset.agg(F.max(F.col(label))).first()[0]) + 1


class MarginModel(Model):
    """One margin per class against the rest (one in all for two classes), with calibrated shares."""

    def __init__(self, map_=None, weights=None, calibration=(), features=None, size=0):
        super().__init__()
        self.map_, self.weights, self.calibration, self.features = map_, weights, list(calibration), features
        self.size = size

    def _transform(self, dataset):
        found = margins_of(self.weights, self.map_, self.size)(vector_to_array(F.col(self.features)))
        rows = dataset.withColumn("_margins", found)
        margins = [F.get("_margins", k) for k in range(len(self.weights))]
        shares = [share_of(m, *ab) for m, ab in zip(margins, self.calibration)]
        if len(margins) == 1:
            margins, shares = [-margins[0], margins[0]], [1 - shares[0], shares[0]]
        rows = rows.withColumn("_shares", F.array(*shares)).withColumn("_margins", F.array(*margins))
        total = F.aggregate("_shares", F.lit(0.0), lambda a, x: a + x)
        best = F.array_position("_margins", F.array_max("_margins")) - 1
        return rows.withColumns({
            "rawPrediction": array_to_vector(F.col("_margins")),
            "probability": array_to_vector(F.transform("_shares", lambda x: x / F.greatest(total, F.lit(1e-300)))),
            "prediction": best.cast("double"),
        }).drop("_margins", "_shares")


class KernelMargin(_Supervised):
    """Support vector classifier with scores.

    ``kernel`` "rbf" draws random Fourier features of the Gaussian kernel before the linear margin
    (``gamma`` 0 stands for 1 / (features * their variance)); "linear" takes the features as they are. More
    than two classes are fitted one against the rest. The margins of held-out folds, counted in
    cells, calibrate the probabilities.
    """

    strength = Param(Params._dummy(), "strength", "C", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "iteration limit", TypeConverters.toInt)
    kernel = Param(Params._dummy(), "kernel", "rbf or linear", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "random features", TypeConverters.toInt)
    folds = Param(Params._dummy(), "folds", "folds for calibration", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, strength=1.0, maxIter=50, kernel="rbf", gamma=0.0, width=FOURIER, folds=2,
                 labelCol="label", featuresCol="features"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(strength=1.0, maxIter=50, kernel="rbf", gamma=0.0, width=FOURIER, folds=2,
                         labelCol="label", featuresCol="features")

    def _fit(self, dataset):
        get = self.getOrDefault
        features, folds = self.getFeaturesCol(), get("folds")
        n_classes = max(_class_count(dataset, self.getLabelCol()), 2)
        size, spread_ = spread_of_features(dataset, features)
        map_ = None
        if get("kernel") == "rbf":
            gamma = get("gamma") or (1 / (size * spread_) if size * spread_ > 0 else 1.0)
            map_ = FourierMap(size, gamma, get("width"), SEED)
        # Equal rows share a fold, and a fold is the same after a lost task.
        x = vector_to_array(F.col(features))
        fold = F.pmod(F.xxhash64(x.cast("string"), F.lit(SEED)), F.lit(folds))
        rows = materialize(dataset.select(
            x.alias("_x"), F.col(self.getLabelCol()).cast("long").alias("_class"), fold.cast("int").alias("_fold")), "margins")
        counts = {(r["_fold"], r["_class"]): r["count"] for r in rows.groupBy("_fold", "_class").count().collect()}
        told = [1] if n_classes == 2 else list(range(n_classes))
        learners, sizes = [], []
        for k in told:
            for f in range(-1, folds):
                sides = [sum(n for (fold_, c), n in counts.items() if fold_ != f and (c == k) == side) for side in (True, False)]
                if f < 0 or all(sides):  # else too few rows to hold any out
                    learners.append((k, f))
                    sizes.append(sum(sides))
        weights = fit_margins(rows, map_, size, learners, sizes, get("strength"), get("maxIter"))
        margins = rows.withColumn("_margins", margins_of(weights, map_, size)(F.col("_x")))
        margins = materialize(margins.select("_class", "_fold", "_margins"), "held-out")
        calibration = []
        for k in told:
            own = [F.when(F.col("_fold") == f, F.get("_margins", j)) for j, (c, f) in enumerate(learners) if c == k and f >= 0]
            held = margins.select((F.coalesce(*own) if own else F.lit(None).cast("double")).alias("margin"),
                                  (F.col("_class") == k).cast("double").alias("_one")).filter("margin IS NOT NULL")
            calibration.append(platt(margin_cells(held, "margin", "_one")))
        whole = weights[[learners.index((k, -1)) for k in told]]
        return MarginModel(map_, whole, calibration, features, size)


class HistogramModel(Model):
    """Boosted trees on binned features; classifiers add ``rawPrediction`` and ``probability``."""

    def __init__(self, boosted=None, features=None):
        super().__init__()
        self.boosted, self.features = boosted, features

    def first_rounds(self, rounds: int) -> "HistogramModel":
        """The model as it was after so many rounds."""
        kept = replace(self.boosted, rounds=self.boosted.rounds[:rounds])
        return HistogramModel(kept, self.features)

    def _transform(self, dataset):
        rows = boosting.with_scores(dataset, self.features, self.boosted, "_raw")
        if self.boosted.objective == boosting.SQUARED:
            return rows.withColumn("prediction", F.get("_raw", 0)).drop("_raw")
        if self.boosted.objective == boosting.LOGISTIC:
            share = 1 / (1 + F.exp(-F.get("_raw", 0)))
            rows = rows.withColumn("_share", F.array(1 - share, share))
            rows = rows.withColumn("_raw", F.array(-F.get("_raw", 0), F.get("_raw", 0)))
        else:
            rows = rows.withColumn("_share", F.expr(boosting.class_shares("_raw")))
        best = F.array_position("_raw", F.array_max("_raw")) - 1
        return rows.withColumns({
            "rawPrediction": array_to_vector(F.col("_raw")), "probability": array_to_vector(F.col("_share")),
            "prediction": best.cast("double")}).drop("_raw", "_share")


class HistogramBoosting(_Supervised):
    """Boosted trees grown best first over binned features, all classes of a round together.

    ``leaves`` bounds the leaves of a tree; 0 leaves that to ``depth``.
    """

    kind = Param(Params._dummy(), "kind", "classification or regression", TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "boosting rounds", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "tree depth", TypeConverters.toInt)
    leaves = Param(Params._dummy(), "leaves", "leaves of a tree", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)
    sample = Param(Params._dummy(), "sample", "row share per round", TypeConverters.toFloat)
    ridge = Param(Params._dummy(), "ridge", "added to Hessian sums", TypeConverters.toFloat)
    leastRows = Param(Params._dummy(), "leastRows", "rows of a leaf", TypeConverters.toInt)
    leastHessian = Param(Params._dummy(), "leastHessian", "Hessian of a leaf", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, kind="classification", rounds=100, depth=6, leaves=0, rate=0.1, sample=1.0, ridge=0.0,
                 leastRows=1, leastHessian=1e-3, labelCol="label", featuresCol="features"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(kind="classification", rounds=100, depth=6, leaves=0, rate=0.1, sample=1.0, ridge=0.0,
                         leastRows=1, leastHessian=1e-3, labelCol="label", featuresCol="features")

    def _fit(self, dataset):
        get = self.getOrDefault
        growth = boosting.Growth(
            rounds=get("rounds"), depth=get("depth"), leaves=get("leaves") or None, rate=get("rate"),
            ridge=get("ridge"), least_rows=get("leastRows"), least_hessian=get("leastHessian"),
            sample=get("sample"), seed=SEED)
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("_features"), F.col(self.getLabelCol()).alias("_label"))
        objective, classes = boosting.SQUARED, 1
        if get("kind") == "classification":
            classes = _class_count(dataset, self.getLabelCol())
            objective = boosting.LOGISTIC if classes <= 2 else boosting.SOFTMAX
        boosted = boosting.fit_boosting(rows, "_features", "_label", objective, classes, growth)
        return HistogramModel(boosted, self.getFeaturesCol())


class BoostedClassifier(_Supervised):
    """Gradient boosted trees for any number of classes: one tree a round for two, joint trees on shared
    residuals, one per class and round, for more."""

    rounds = Param(Params._dummy(), "rounds", "boosting rounds", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "tree depth", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)
    sample = Param(Params._dummy(), "sample", "row share per round", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, rounds=100, depth=3, rate=0.1, sample=1.0,
                 labelCol="label", featuresCol="features"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(rounds=100, depth=3, rate=0.1, sample=1.0,
                         labelCol="label", featuresCol="features")

    def _fit(self, dataset):
        get = self.getOrDefault
        return HistogramBoosting(
            rounds=get("rounds"), depth=get("depth"), rate=get("rate"), sample=get("sample"),
            labelCol=self.getLabelCol(), featuresCol=self.getFeaturesCol()).fit(dataset)


class NeighborsModel(Model):
    """Votes of the k nearest rows: ``prediction``, and ``probability``, the share of the votes per class."""

    def __init__(self, train=None, keys=None, label=None, features=None, k=5, classes=2):
        super().__init__()
        self.train, self.keys, self.label, self.features, self.k = train, keys, label, features, k
        self.classes = classes

    def _transform(self, dataset):
        asked = dataset.select(_row_key(self.keys), vector_to_array(self.features).alias("_vector"))
        found = nearest_neighbors(self.train, asked, "_key", "_vector", self.label, self.k)
        found = materialize(found, "neighbors")
        votes = [F.avg((F.col(self.label) == c).cast("double")) for c in range(self.classes)]
        shares = found.groupBy("_key").agg(F.array(*votes).alias("_shares"))
        chosen = vote(found, "_key", self.label)
        joined = dataset.withColumn("_key", _row_key(self.keys)).join(chosen, "_key", "left").join(shares, "_key", "left")
        return joined.withColumn("probability", array_to_vector("_shares")).drop("_key", "_shares")


def _row_key(keys: list[str]) -> Column:
    """One column that identifies a row by all its keys."""
    if len(keys) == 1:
        return F.col(keys[0]).alias("_key")
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key")


class Neighbors(_Supervised):
    """Exact k nearest neighbours; ``keyCols`` together must identify the rows."""

    k = Param(Params._dummy(), "k", "neighbours that vote", TypeConverters.toInt)
    keyCols = Param(Params._dummy(), "keyCols", "row keys", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, k=5, keyCols=None, labelCol="label", featuresCol="features"):
        super().__init__()
        self._set(**{name: value for name, value in self._input_kwargs.items() if value is not None})
        self._setDefault(k=5, labelCol="label", featuresCol="features")

    def _fit(self, dataset):
        if not self.isSet("keyCols"):
            raise ValueError("nearest neighbours need the row key columns")
        keys, label = self.getOrDefault("keyCols"), self.getLabelCol()
        train = dataset.select(
            _row_key(keys), label, vector_to_array(self.getFeaturesCol()).alias("_vector")
        )
        return NeighborsModel(
            train, keys, label, self.getFeaturesCol(), self.getOrDefault("k"), _class_count(dataset, label))


class DeepForestModel(Model):
    """A forest whose subtrees lie in a table; classifiers add ``probability``."""

    def __init__(self, forest=None, features=None):
        super().__init__()
        self.forest, self.features = forest, features

    def _transform(self, dataset):
        # The row numbers must survive a recomputation, so they are written with the rows.
        rows = materialize(dataset.withColumn("_row", F.monotonically_increasing_id()), "forest-asked")
        asked = rows.select("_row", vector_to_array(self.features).alias("_features"))
        found = forest_scores(self.forest, asked, "_features", "_row")
        rows = rows.join(found, "_row", "left")
        if not self.forest.classes:
            return rows.withColumn("prediction", F.get("scores", 0)).drop("_row", "scores")
        best = F.array_position("scores", F.array_max("scores")) - 1
        return rows.withColumns({
            "probability": array_to_vector(F.col("scores")), "prediction": best.cast("double")}).drop("_row", "scores")


class DeepForest(_Supervised):
    """Random forest whose trees grow until their leaves are pure, or to ``depth`` if that is not 0."""

    kind = Param(Params._dummy(), "kind", "classification or regression", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "tree depth, 0 for no limit", TypeConverters.toInt)
    localRows = Param(Params._dummy(), "localRows", "rows of a node that one task takes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, kind="classification", trees=100, depth=0, localRows=LOCAL_ROWS,
                 labelCol="label", featuresCol="features"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(kind="classification", trees=100, depth=0, localRows=LOCAL_ROWS,
                         labelCol="label", featuresCol="features")

    def getNumTrees(self) -> int:
        return self.getOrDefault("trees")

    def getFeatureSubsetStrategy(self) -> str:
        """Features tried per node: "sqrt" for classes, "all" for figures."""
        return "sqrt" if self.getOrDefault("kind") == "classification" else "all"

    def _fit(self, dataset):
        classify = self.getOrDefault("kind") == "classification"
        growth = ForestGrowth(
            trees=self.getNumTrees(), depth=self.getOrDefault("depth") or None,
            subset=self.getFeatureSubsetStrategy(), local_rows=self.getOrDefault("localRows"), seed=SEED)
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("_features"), F.col(self.getLabelCol()).alias("_label"))
        classes = _class_count(dataset, self.getLabelCol()) if classify else 0
        return DeepForestModel(fit_forest(rows, "_features", "_label", classes, growth), self.getFeaturesCol())


def _forest(kind, subset: str) -> Callable[..., Estimator]:
    def make(n_estimators=100, max_depth=None, **_):
        if max_depth is None:
            task = "classification" if kind is RandomForestClassifier else "regression"
            return DeepForest(kind=task, trees=int(n_estimators))
        return kind(
            numTrees=int(n_estimators),
            maxDepth=int(max_depth),
            featureSubsetStrategy=subset,
            seed=SEED,
            maxMemoryInMB=TREE_MEMORY_MB,
        )

    return make


def _boosted_classifier(default_depth: int) -> Callable[..., Estimator]:
    def make(n_estimators=100, max_depth=default_depth, learning_rate=0.1, subsample=1.0, **_):
        return BoostedClassifier(
            rounds=int(n_estimators), depth=int(max_depth), rate=learning_rate, sample=subsample
        )

    return make


def _boosted_regressor(default_depth: int) -> Callable[..., Estimator]:
    def make(n_estimators=100, max_depth=default_depth, learning_rate=0.1, subsample=1.0, **_):
        return GBTRegressor(
            maxIter=int(n_estimators),
            maxDepth=int(max_depth),
            stepSize=learning_rate,
            subsamplingRate=subsample,
            seed=SEED,
            maxMemoryInMB=TREE_MEMORY_MB,
        )

    return make


def _histogram(kind: str, **fixed) -> Callable[..., Estimator]:
    def make(n_estimators=100, max_depth=6, learning_rate=0.1, num_leaves=0, **_):
        given = {**fixed, **({"leaves": int(num_leaves)} if num_leaves else {})}
        return HistogramBoosting(
            kind=kind, rounds=int(n_estimators), depth=int(max_depth), rate=float(learning_rate), **given)

    return make


# The penalties and leaf bounds that users of the two external boosters expect.
LEVEL_WISE = {"ridge": 1.0, "leastHessian": 1.0}
LEAF_WISE = {"leaves": 31, "leastRows": 20, "leastHessian": 1e-3}

MODELS: dict[str, Callable[..., Estimator]] = {
    "LogisticRegression": lambda C=1.0, max_iter=1000, **_: PenalisedLogistic(
        strength=float(C), maxIter=int(max_iter)
    ),
    "RandomForestClassifier": _forest(RandomForestClassifier, "sqrt"),
    "GradientBoostingClassifier": _boosted_classifier(3),
    "SVC": lambda C=1.0, **_: KernelMargin(strength=float(C)),
    "KNeighborsClassifier": lambda n_neighbors=5, key=None, **_: Neighbors(
        k=int(n_neighbors), keyCols=[key] if isinstance(key, str) else key
    ),
    "XGBClassifier": _histogram("classification", **LEVEL_WISE),
    "LGBMClassifier": _histogram("classification", **LEAF_WISE),
    "Ridge": lambda alpha=1.0, **_: Ridge(strength=float(alpha)),
    "RandomForestRegressor": _forest(RandomForestRegressor, "all"),
    "GradientBoostingRegressor": _boosted_regressor(3),
    "XGBRegressor": _histogram("regression", **LEVEL_WISE),
    "LGBMRegressor": _histogram("regression", **LEAF_WISE),
}
# No distributed kernel regressor exists; a request for one gets the fallback model.
MODELS["SVR"] = MODELS[FALLBACK_REGRESSOR]
UNKNOWN_MODEL = "RandomForestClassifier"


def make_model(name: str, parameters: dict | None = None, key: str | list[str] | None = None) -> Estimator:
    """Estimator for a model name; parameters it does not take are ignored."""
    name = name if name in MODELS else UNKNOWN_MODEL
    allowed = MODEL_PARAMETERS[name]
    kept = {p: v for p, v in (parameters or {}).items() if p in allowed and v is not None}
    if name == "KNeighborsClassifier":
        kept["key"] = key
    return MODELS[name](**kept)
