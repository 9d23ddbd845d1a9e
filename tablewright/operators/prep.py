"""Feature preparation as pyspark.ml stages.

A fit is one aggregate that leaves a few numbers per column; a transform is a projection.
Stages work on plain columns: unless ``inputCols`` is set, on every numeric or boolean
column that is not listed in ``excludeCols`` (label, keys, split marks).
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import PCA as MlPca
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.kinds import (
    CATEGORICAL, chunked, columns_of_kind, moments_as_numbers, present_value, quoted)
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.range_finder import principal_components, project
from tablewright.operators.ranking import running_totals
from tablewright.session import materialize

CHUNK = 100


class _Columns(HasInputCols):
    """Which columns a stage works on."""

    excludeCols = Param(Params._dummy(), "excludeCols", "columns that are not features",
                        TypeConverters.toListString)

    def _init_columns(self, inputCols=None, excludeCols=None):
        self._setDefault(excludeCols=[])
        if inputCols is not None:
            self._set(inputCols=list(inputCols))
        if excludeCols is not None:
            self._set(excludeCols=list(excludeCols))

    def features(self, df: DataFrame) -> list[str]:
        if self.isSet("inputCols"):
            return self.getInputCols()
        skipped = set(self.getOrDefault("excludeCols"))
        return [
            f.name
            for f in df.schema.fields
            if f.name not in skipped and isinstance(f.dataType, (T.NumericType, T.BooleanType))
        ]


class _Step(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, excludeCols=None):
        super().__init__()
        self._init_columns(inputCols, excludeCols)


class _Fitted(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted stage: its columns and two numbers for each, all kept as Params."""

    first = Param(Params._dummy(), "first", "first number per column", TypeConverters.toListFloat)
    second = Param(Params._dummy(), "second", "second number per column", TypeConverters.toListFloat)
    dropped = Param(Params._dummy(), "dropped", "columns removed", TypeConverters.toListString)

    def __init__(self, inputCols=(), first=(), second=(), dropped=()):
        super().__init__()
        self._set(inputCols=list(inputCols), first=[float(v) for v in first],
                  second=[float(v) for v in second], dropped=list(dropped))

    def numbers(self) -> list[tuple[str, float, float]]:
        first, second = self.getOrDefault("first"), self.getOrDefault("second")
        return list(zip(self.getInputCols(), first, second or first))

    def _value(self, column: Column, first: float, second: float) -> Column:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        changed = {
            name: self._value(present_value(dataset, name).cast("double"), first, second)
            for name, first, second in self.numbers()
        }
        return dataset.withColumns(changed).drop(*self.getOrDefault("dropped"))


def _aggregate(df: DataFrame, names: list[str], *functions) -> list[list[float | None]]:
    """Each function over each column, one pass per chunk of columns."""
    columns: list[list[float | None]] = [[] for _ in functions]
    for chunk in chunked(names, CHUNK):
        row = df.agg(
            *[
                fn(present_value(df, name).cast("double")).alias(f"a{i}_{j}")
                for i, fn in enumerate(functions)
                for j, name in enumerate(chunk)
            ]
        ).first()
        for i in range(len(functions)):
            columns[i] += [row[f"a{i}_{j}"] for j in range(len(chunk))]
    return columns


class FillModel(_Fitted):
    def _value(self, column, first, second):
        return F.coalesce(column, F.lit(first))


def _fill_model(names: list[str], fills: list[float | None]) -> FillModel:
    known = [(name, fill) for name, fill in zip(names, fills) if fill is not None]
    empty = [name for name, fill in zip(names, fills) if fill is None]
    return FillModel([n for n, _ in known], [v for _, v in known], dropped=empty)


class MedianImputer(_Step):
    """Fill gaps with the exact median; a column without any value is dropped."""

    def _fit(self, dataset):
        names = self.features(dataset)
        medians = exact_quantiles(dataset, names, 0.5)
        return _fill_model(names, [medians[name] for name in names])


class ApproximateMedianImputer(_Step):
    """One-pass variant with a rank error of 0.01 % of the rows."""

    def _fit(self, dataset):
        names = self.features(dataset)
        (fills,) = _aggregate(dataset, names, lambda v: F.percentile_approx(v, 0.5, 10_000))
        return _fill_model(names, fills)


def column_modes(df: DataFrame, names: list[str]) -> DataFrame:
    """Most frequent present value per numeric column, the smallest on ties."""
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("column"), present_value(df, name).cast("double").alias("v"))
            for name in names
        ]
    )
    counts = df.select(F.inline(cells)).filter(F.col("v").isNotNull()).groupBy("column", "v").count()
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col("v").alias("v")))
    return counts.groupBy("column").agg(best.alias("best")).select(
        "column", F.col("best.v").alias("mode"), (-F.col("best.n")).alias("n")
    )


class ModeImputer(_Step):
    """Fill gaps with the most frequent value."""

    def _fit(self, dataset):
        names = self.features(dataset)
        modes = {row["column"]: row["mode"] for row in column_modes(dataset, names).collect()}
        return _fill_model(names, [modes.get(name) for name in names])


def mode_of_text(df: DataFrame, column: str) -> DataFrame:
    """Most frequent present value of one text column, the smallest on ties."""
    counts = df.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("v")).count()
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col("v").alias("v")))
    return counts.agg(best.alias("best")).select(F.col("best.v").alias("mode"))


def fill_text_mode(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(quoted(column), mode_of_text(df, column).scalar()))


class ScaleModel(_Fitted):
    def _value(self, column, first, second):
        return (column - F.lit(first)) / F.lit(second)


def _scale_model(names, offsets, widths) -> ScaleModel:
    return ScaleModel(names, [o or 0.0 for o in offsets], [w or 1.0 for w in widths])


class PopulationScaler(_Step):
    """(x - mean) / population deviation; a constant column becomes 0."""

    def _fit(self, dataset):
        names = self.features(dataset)
        means, deviations = _aggregate(dataset, names, F.avg, F.stddev_pop)
        return _scale_model(names, means, deviations)


class RangeScaler(_Step):
    """Onto 0..1; a constant column becomes 0."""

    def _fit(self, dataset):
        names = self.features(dataset)
        lows, highs = _aggregate(dataset, names, F.min, F.max)
        widths = [h - l if l is not None else None for l, h in zip(lows, highs)]
        return _scale_model(names, lows, widths)


class DropModel(_Fitted):
    def _transform(self, dataset):
        return dataset.drop(*self.getOrDefault("dropped"))


class VarianceFilter(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Drop columns whose population variance does not exceed the threshold."""

    threshold = Param(Params._dummy(), "threshold", "smallest variance kept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, excludeCols=None, threshold=0.01):
        super().__init__()
        self._init_columns(inputCols, excludeCols)
        self._set(threshold=threshold)

    def _fit(self, dataset):
        names = self.features(dataset)
        (variances,) = _aggregate(dataset, names, F.var_pop)
        limit = self.getOrDefault("threshold")
        kept = [n for n, v in zip(names, variances) if v is not None and v > limit]
        if not kept:
            raise ValueError(f"no feature has a variance above {limit}")
        return DropModel(kept, dropped=[n for n in names if n not in kept])


def column_variances(df: DataFrame, names: list[str]) -> DataFrame:
    """Population variance per column, in long form."""
    records = [
        F.struct(F.lit(name).alias("column"), F.var_pop(present_value(df, name).cast("double")).alias("variance"))
        for name in names
    ]
    return df.agg(F.array(*records).alias("r")).select(F.inline("r"))


def covariance_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """Sample covariance of every column pair, upper triangle in long form.

    All pairs come from one aggregate per chunk of pairs. For hundreds of columns use
    the vector route that ``PcaStep`` takes.
    """
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    result = None
    for start in range(0, len(pairs), 200):
        records = [
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                F.covar_samp(quoted(a).cast("double"), quoted(b).cast("double")).alias("covariance"),
            )
            for a, b in pairs[start : start + 200]
        ]
        part = df.agg(F.array(*records).alias("r")).select(F.inline("r"))
        result = part if result is None else result.unionByName(part)
    return result


# --- categories -------------------------------------------------------------------

MISSING_CATEGORY = "nan"


def category_text(name: str) -> Column:
    """Text of a category; a missing one is a category of its own."""
    return F.coalesce(quoted(name).cast("string"), F.lit(MISSING_CATEGORY))


def category_codes(df: DataFrame, name: str, as_text: Column | None = None, **options) -> DataFrame:
    """(value, code): every distinct value and its place in sorted order, from 0.

    Values are ordered range by range, so a column with very many distinct values is
    coded as well as one with five.
    """
    text = category_text(name) if as_text is None else as_text
    distinct = df.select(text.alias("value")).distinct().withColumn("one", F.lit(1).cast("long"))
    ordered = running_totals(distinct, ["value"], ["one"], **options)
    return ordered.select("value", F.col("one_before").cast("double").alias("code"))


FREQUENT = 1_000  # a value of at least one in so many rows of its column is frequent


def all_category_codes(df: DataFrame, names: list[str], **options) -> DataFrame:
    """(column, value, code, frequent) of several text columns, learnt in one pass.

    At most ``FREQUENT`` values a column can be frequent, however many there are.
    """
    cells = F.array(
        *[F.struct(F.lit(name).alias("column"), category_text(name).alias("value")) for name in names]
    )
    distinct = df.select(F.inline(cells)).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.lit(1).cast("long").alias("one"))
    ordered = running_totals(distinct, ["value"], ["one"], ["column"], **options)
    totals = ordered.groupBy(F.col("column").alias("_column")).agg(F.sum("n").alias("_rows"))
    return ordered.join(totals, F.col("column") == F.col("_column")).select(
        "column", "value", F.col("one_before").cast("double").alias("code"),
        (F.col("n") * FREQUENT >= F.col("_rows")).alias("frequent"))


class CategoryModel(Model):
    """Replaces categories by their codes; a value not seen in training becomes -1.

    The code table is read back from the shared folder. Frequent values, at most ``FREQUENT``
    of a column, are looked up in a broadcast table; the rows left over join the others, a small table broadcast
    by its measured size, a large one shuffled. Rows already coded are spread by a hash of
    themselves there, so no value that holds many rows is one key of a shuffle.
    """

    def __init__(self, names=(), codes: DataFrame | None = None):
        super().__init__()
        self.names, self.codes = list(names), codes

    def _transform(self, dataset):
        order = dataset.columns
        for name in self.names:
            own = self.codes.filter(F.col("column") == name)
            common = own.filter("frequent").select(
                F.col("value").alias("_value"), F.col("code").alias("_common"))
            rare = own.filter("not frequent").select(
                F.lit(False).alias("_known"), F.xxhash64("value").alias("_hash"),
                F.col("value").alias("_value"), F.col("code").alias("_code"))
            found = dataset.join(F.broadcast(common), category_text(name) == F.col("_value"), "left").drop("_value")
            known = F.col("_common").isNotNull()
            found = found.withColumns({
                "_is_known": known,
                "_text": F.when(~known, category_text(name)).otherwise(F.lit("")),
                "_spread": F.when(known, F.xxhash64(*[quoted(c) for c in order])).otherwise(
                    F.xxhash64(category_text(name)))})
            same = ((F.col("_is_known") == F.col("_known")) & (F.col("_spread") == F.col("_hash"))
                    & (F.col("_text") == F.col("_value")))
            dataset = (
                found.join(rare, same, "left")
                .withColumn(name, F.coalesce("_common", "_code", F.lit(-1.0)))
                .select(*[quoted(c) for c in order])
            )
        return dataset


class CategoryEncoder(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Ordinal codes for text columns, fitted on the rows given to ``fit``."""

    @keyword_only
    def __init__(self, *, inputCols=None, excludeCols=None):
        super().__init__()
        self._init_columns(inputCols, excludeCols)

    def text_columns(self, df: DataFrame) -> list[str]:
        if self.isSet("inputCols"):
            return self.getInputCols()
        skipped = set(self.getOrDefault("excludeCols"))
        return columns_of_kind(df, [c for c in df.columns if c not in skipped], CATEGORICAL)

    def _fit(self, dataset):
        names = self.text_columns(dataset)
        if not names:
            return CategoryModel()
        return CategoryModel(names, materialize(all_category_codes(dataset, names), "codes"))


def encode_target(
    df: DataFrame, target: str, task_type: str, output: str = "label"
) -> tuple[DataFrame, DataFrame | None]:
    """Add the numeric label, and give the (value, code) table of a classification.

    Classes are numbered in sorted order (numbers by value, text by text). A regression
    target stays a double; its gaps get the median.
    """
    if task_type == "regression":
        median = exact_quantiles(df, [target])[target]
        value = F.coalesce(present_value(df, target).cast("double"), F.lit(median))
        return df.withColumn(output, value), None
    numeric = isinstance(df.schema[target].dataType, T.NumericType)
    value = quoted(target).cast("double") if numeric else category_text(target)
    source = df.filter(quoted(target).isNotNull()) if numeric else df
    codes = materialize(category_codes(source, target, value), "classes")
    renamed = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    coded = df.join(renamed, value == F.col("_value"), "left")
    return coded.withColumn(output, F.coalesce("_code", F.lit(-1.0))).drop("_value", "_code"), codes


def one_hot_columns(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """One 0/1 column per listed value."""
    text = category_text(name)
    return df.withColumns({f"{name}={v}": (text == F.lit(v)).cast("int") for v in values}).drop(name)


class OneHotModel(Model):
    def __init__(self, model=None, names=()):
        super().__init__()
        self.model, self.names = model, list(names)

    def _transform(self, dataset):
        if self.model is None:
            return dataset
        # Codes of categories unseen in training are -1: they get the spare last slot.
        last = {n: size - 1 for n, size in zip(self.names, self.model.categorySizes)}
        shifted = dataset.withColumns(
            {n: F.when(quoted(n) < 0, F.lit(float(last[n]))).otherwise(quoted(n)) for n in self.names}
        )
        return self.model.transform(shifted).drop(*self.names)


class OneHotStep(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Sparse indicator vector for each coded category column.

    Only the largest code is learnt, never the list of categories, so the width of the
    vector is the sole cost of a column with many values. Runs after ``CategoryEncoder``.
    """

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._init_columns(inputCols or [])

    def _fit(self, dataset):
        names = [n for n in self.getInputCols() if n in dataset.columns]
        if not names:
            return OneHotModel()
        (highest,) = _aggregate(dataset, names, F.max)
        outputs = [f"{name}_onehot" for name in names]
        # One row with the spare code (highest + 1) tells the encoder the sizes.
        sizes = dataset.sparkSession.createDataFrame(
            [tuple(float(h) + 1 for h in highest)], [n for n in names]
        )
        encoder = OneHotEncoder(inputCols=names, outputCols=outputs, dropLast=True)
        model = encoder.fit(sizes)
        return OneHotModel(model, names)


# --- principal components and assembly --------------------------------------------


def _feature_inputs(stage: _Columns, df: DataFrame) -> list[str]:
    skipped = set(stage.getOrDefault("excludeCols"))
    vectors = [f.name for f in df.schema.fields
               if isinstance(f.dataType, VectorUDT) and f.name not in skipped]
    return stage.features(df) + vectors


class PcaModel(Model):
    """Projects onto the kept components; ``offset`` moves the origin to the mean."""

    def __init__(self, inputs=(), model=None, offset=(), k=0, explained=()):
        super().__init__()
        self.inputs, self.model, self.offset = list(inputs), model, list(offset)
        self.k, self.explained = k, list(explained)

    def _transform(self, dataset):
        assembled = _as_vector(dataset, self.inputs, "_pca_in")
        projected = self.model.transform(assembled).withColumn("_pca", vector_to_array("_pca_out"))
        components = {f"pc_{i + 1}": F.col("_pca")[i] - F.lit(self.offset[i]) for i in range(self.k)}
        return projected.withColumns(components).drop(*self.inputs, "_pca_in", "_pca_out", "_pca")


def _as_vector(df: DataFrame, inputs: list[str], output: str) -> DataFrame:
    doubles = {
        name: quoted(name).cast("double")
        for name in inputs
        if not isinstance(df.schema[name].dataType, VectorUDT)
    }
    return VectorAssembler(inputCols=inputs, outputCol=output).transform(df.withColumns(doubles))


class WidePcaModel(Model):
    """Projects onto components that the range finder found."""

    def __init__(self, inputs=(), components=None, k=0):
        super().__init__()
        self.inputs, self.components, self.k = list(inputs), components, k
        self.explained = [float(v) for v in components.shares[:k]] if components else []

    def _transform(self, dataset):
        assembled = _as_vector(dataset, self.inputs, "_pca_vector")
        arrays = assembled.withColumn("_pca_in", vector_to_array("_pca_vector")).drop("_pca_vector", *self.inputs)
        return project(arrays, "_pca_in", self.components.first(self.k)).drop("_pca_in")


class PcaStep(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Smallest number of components whose explained share exceeds ``share``.

    The covariance does not depend on the origin, so the rows are projected as they are
    and the projected mean is taken off afterwards. The fit keeps every component and
    cuts on the cumulative explained share. Tables of more than ``exactWidth`` columns have a
    covariance too large for one machine: theirs come from a randomised range finder that looks
    for twice as many components until the share is exceeded.
    """

    share = Param(Params._dummy(), "share", "explained share to exceed", TypeConverters.toFloat)
    exactWidth = Param(Params._dummy(), "exactWidth", "widest exact covariance", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, excludeCols=None, share=0.95, exactWidth=1000):
        super().__init__()
        self._init_columns(inputCols, excludeCols)
        self._set(share=share, exactWidth=exactWidth)

    def _fit_wide(self, vectors, inputs, width):
        arrays = vectors.select(vector_to_array("_pca_in").alias("v"))
        share, k = self.getOrDefault("share"), 32
        found = principal_components(arrays, "v", k)
        while k < width and found.shares.sum() <= share:
            k = min(width, 2 * k)
            found = principal_components(arrays, "v", k)
        return WidePcaModel(inputs, found, found.count_for(share))

    def _fit(self, dataset):
        inputs = _feature_inputs(self, dataset)
        vectors = _as_vector(dataset.select(*[quoted(name) for name in inputs]), inputs, "_pca_in")
        mean = vectors.select(Summarizer.mean(F.col("_pca_in"))).first()[0].toArray()
        if len(mean) > self.getOrDefault("exactWidth"):
            return self._fit_wide(vectors, inputs, len(mean))
        model = MlPca(k=len(mean), inputCol="_pca_in", outputCol="_pca_out").fit(vectors.select("_pca_in"))
        explained = [float(v) for v in model.explainedVariance.toArray()]
        total, k = 0.0, 0
        while k < len(mean) and total <= self.getOrDefault("share"):
            total += explained[k]
            k += 1
        offset = [float(v) for v in model.pc.toArray().T @ mean]
        return PcaModel(inputs, model, offset, k, explained)


class Assemble(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Gather what the steps left of the features into the ``features`` vector."""

    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, excludeCols=None, outputCol="features"):
        super().__init__()
        self._init_columns(inputCols, excludeCols)
        self._set(outputCol=outputCol)

    def _transform(self, dataset):
        return _as_vector(dataset, _feature_inputs(self, dataset), self.getOrDefault("outputCol"))


def cast_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles plus the ``features`` vector made of them."""
    df = moments_as_numbers(df, columns)
    return Assemble(inputCols=columns).transform(df.withColumns({c: quoted(c).cast("double") for c in columns}))
