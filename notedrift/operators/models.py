"""Models and experiments on Spark ML.

Each fit is a distributed Spark ML job; folds are a column (``stratified_folds``)
and the experiment result is a long table ``(seed, fold, accuracy, f1_macro)``.
The kernel SVM of the reference (an exact single-machine solver) is replaced by
random Fourier features (Rahimi & Recht, 2007) feeding a linear SVM - an
approximation of the RBF kernel, stated as such.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (LinearSVC, LogisticRegression, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, PCA, HashingTF, MinMaxScaler, Normalizer, PolynomialExpansion, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import seeded_uniform, stratified_folds
from .metrics import classification_metrics


# ------------------------------------------------------------------ feature maps
def rff_map(df: DataFrame, col: str, dim: int, n_features: int, gamma: float | None = None,
            seed: int = 0, out: str = "rff") -> DataFrame:
    """Random Fourier features z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma),
    b ~ U(0, 2 pi); ``gamma=None`` means 1 / #features (the 'auto' default).
    W is a D x d constant shipped with the UDF; rows are mapped in Arrow batches."""
    gamma = gamma if gamma is not None else 1.0 / n_features
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(dim, n_features))
    b = rng.uniform(0.0, 2.0 * np.pi, size=dim)
    scale = np.sqrt(2.0 / dim)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _map(x: pd.Series) -> pd.Series:
        m = np.stack([np.asarray(v, dtype="float64") for v in x]) if len(x) else np.zeros((0, n_features))
        z = scale * np.cos(m @ w.T + b)
        return pd.Series(list(z))

    return df.withColumn(out, array_to_vector(_map(F.col(col))))


def polynomial_features(df: DataFrame, col: str, degree: int = 2, out: str = "poly") -> DataFrame:
    """Polynomial expansion (no bias column)."""
    return PolynomialExpansion(degree=degree, inputCol=col, outputCol=out).transform(df)


def pca(df: DataFrame, col: str, k: int = 2, out: str = "pca") -> DataFrame:
    """Centre and scale, then PCA to k components."""
    sc = StandardScaler(inputCol=col, outputCol="_std", withMean=True, withStd=True).fit(df).transform(df)
    return PCA(k=k, inputCol="_std", outputCol=out).fit(sc).transform(sc).drop("_std")


# ------------------------------------------------------------------ estimators
def complement_nb(features: str = "features", label: str = "label") -> NaiveBayes:
    """J11 (features must be non-negative)."""
    return NaiveBayes(modelType="complement", smoothing=1.0, featuresCol=features, labelCol=label)


class NonNegative(Transformer):
    """Negative entries of a vector column become 0 (the vectors become dense)."""

    def __init__(self, col: str, out: str):
        super().__init__()
        self.col, self.out = col, out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = F.transform(vector_to_array(self.col), lambda v: F.greatest(v, F.lit(0.0)))
        return dataset.withColumn(self.out, array_to_vector(held)).drop(self.col)


def scaled(estimator, inputs: str = "features", out: str = "nn") -> Pipeline:
    """Min-max scaling and the estimator in one Pipeline, so that the scaler learns from the
    training rows alone; unseen values under their minimum count as the minimum, since
    complement NB takes no negative features."""
    return Pipeline(stages=[MinMaxScaler(inputCol=inputs, outputCol="_scaled"), NonNegative("_scaled", out), estimator])


def standardised(estimator, inputs: str = "features", out: str = "std") -> Pipeline:
    """Mean 0 and deviation 1 by the training rows, then the estimator, in one Pipeline."""
    return Pipeline(stages=[StandardScaler(inputCol=inputs, outputCol=out, withMean=True, withStd=True), estimator])


def hashed_counts(df: DataFrame, text: str, out: str = "counts", bits: int = 18) -> DataFrame:
    """How often each hashed word occurs in a text, as a sparse vector; a null text has no words."""
    own = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    words = RegexTokenizer(inputCol="_text", outputCol="_words", gaps=False, pattern=r"[\p{L}\p{N}_]{2,}").transform(own)
    return HashingTF(inputCol="_words", outputCol=out, numFeatures=1 << bits).transform(words).drop("_text", "_words")


def weighted_vectors(df: DataFrame, counts: str, numbers: Sequence[str], out: str = "features") -> DataFrame:
    """Hashed counts with idf and unit length beside numbers as one sparse vector; ``numbers`` must not be null.

    The counts are read twice, for the idf and for the vectors."""
    stages = [IDF(inputCol=counts, outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_unit"),
              VectorAssembler(inputCols=["_unit", *numbers], outputCol=out)]
    return Pipeline(stages=stages).fit(df).transform(df).drop(counts, "_idf", "_unit")


def text_vectors(df: DataFrame, text: str, numbers: Sequence[str], out: str = "features", bits: int = 18) -> DataFrame:
    """Hashed TF-IDF of unit length beside numbers as one sparse vector, made on the JVM: no vocabulary is kept.

    A null text has no terms; ``numbers`` must not be null."""
    return weighted_vectors(hashed_counts(df, text, "_tf", bits), "_tf", numbers, out)


def random_forest(features: str = "features", label: str = "label") -> RandomForestClassifier:
    """100 trees of depth 2, seed 0."""
    return RandomForestClassifier(numTrees=100, maxDepth=2, seed=0, featuresCol=features, labelCol=label)


def logistic(c: float = 1.0, n: int = 1, features: str = "features", label: str = "label") -> LogisticRegression:
    """L2 logistic regression; C maps to regParam = 1 / (C * n)."""
    return LogisticRegression(regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, featuresCol=features, labelCol=label)


def ridge(alpha: float = 1.0, n: int = 1, features: str = "features", label: str = "label") -> LinearRegression:
    """Ridge regression; alpha maps to regParam = alpha / n."""
    return LinearRegression(regParam=alpha / max(n, 1), elasticNetParam=0.0, standardization=False,
                            featuresCol=features, labelCol=label)


def linear_svm_ovr(c: float = 1.0, features: str = "features", label: str = "label", max_iter: int = 50) -> OneVsRest:
    """Linear SVM, one-vs-rest for several classes (regParam = 1 / C)."""
    return OneVsRest(classifier=LinearSVC(regParam=1.0 / c, maxIter=max_iter), featuresCol=features, labelCol=label)


def bootstrap(df: DataFrame, id_col: str, rate: float, seed: int) -> DataFrame:
    """Rows drawn with replacement: each occurs a Poisson(rate) number of times,
    decided by its seeded key, so the draw does not depend on partitioning."""
    weights = rate ** np.arange(12) * np.exp(-rate) / np.cumprod(np.maximum(np.arange(12), 1))
    u = seeded_uniform(id_col, seed)
    times = sum((u >= F.lit(float(c))).cast("int") for c in np.cumsum(weights))
    return (df.withColumn("_times", F.explode(F.array_repeat(F.lit(1), times))).drop("_times"))


def bagged_rbf_svm(train: DataFrame, test: DataFrame, col: str, n_features: int, id_col: str = "id",
                   label: str = "label", n_estimators: int = 5, max_samples: float = 0.2, dim: int = 256,
                   seed: int = 0, c: float = 1.0, max_iter: int = 25) -> DataFrame:
    """``n_estimators`` RBF SVMs (RFF approximation), each on a bootstrap
    of ``max_samples`` of the training rows, majority vote (ties: lowest class).
    Returns (id, label, prediction) for ``test``."""
    tr = rff_map(train, col, dim, n_features, seed=seed).persist()
    te = rff_map(test, col, dim, n_features, seed=seed)
    votes = None
    for m in range(n_estimators):
        bag = bootstrap(tr, id_col, max_samples, seed * 100 + m)
        model = linear_svm_ovr(c, "rff", label, max_iter).fit(bag)
        p = model.transform(te).select(id_col, label, F.col("prediction").cast("long").alias("p"))
        votes = p if votes is None else votes.unionByName(p)
    tr.unpersist()
    counts = votes.groupBy(id_col, label, "p").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(id_col, label).agg(F.max_by("p", F.struct(F.col("n"), -F.col("p"))).alias("prediction"))
    return best


def rbf_svm(train: DataFrame, test: DataFrame, col: str, n_features: int, id_col: str = "id",
            label: str = "label", gamma: float | None = None, c: float = 1.0, dim: int = 256, seed: int = 0) -> DataFrame:
    """One RBF SVM (RFF approximation)."""
    tr = rff_map(train, col, dim, n_features, gamma, seed)
    te = rff_map(test, col, dim, n_features, gamma, seed)
    model = linear_svm_ovr(c, "rff", label).fit(tr)
    return model.transform(te).select(id_col, label, F.col("prediction").cast("long").alias("prediction"))


# ------------------------------------------------------------------ experiments
def repeated_cv(df: DataFrame, make_estimator: Callable[[], object], id_col: str = "id", label: str = "label",
                k: int = 5, seeds: Sequence[int] = range(30), parallel: int = 8) -> DataFrame:
    """For every seed, stratified k folds; fit on k-1, score on the held-out
    fold.  Long result ``(seed, fold, accuracy, f1_macro)``.

    The fits are independent; ``parallel`` of them are submitted at a time.
    Preparation that learns from the data (scaling) belongs into the estimator
    (a Pipeline), so that each fold fits it on its training part alone."""
    from .many_svm import packed_folds
    from .nb_cv import repeated_folds
    from ..session import materialize
    order = sorted(seeds)
    # the folds of all seeds are one array a row, attached once
    packed = packed_folds(repeated_folds(df.select(id_col, label), id_col, label, k, order).select(F.col(id_col).alias("id"), F.col(label).alias("label"), "seed", "fold"), len(order))
    data = materialize(df.join(packed.select(F.col("id").alias(id_col), F.col("folds").alias("_folds")), id_col), "folds").persist()

    def fit(task: tuple[int, int]) -> tuple:
        seed, fold = task
        own = F.col("_folds")[order.index(seed)]
        model = make_estimator().fit(data.filter(own != fold))
        pred = model.transform(data.filter(own == fold))
        m = classification_metrics(pred.select(F.col(label).cast("long").alias("label"),
                                               F.col("prediction").cast("long").alias("prediction")))
        r = m.collect()[0]  # one metric row per fit
        return seed, fold, float(r["accuracy"]), float(r["f1_macro"])

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(inheritable_thread_target(df.sparkSession)(fit), [(s, f) for s in seeds for f in range(k)]))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "seed INT, fold INT, accuracy DOUBLE, f1_macro DOUBLE")


def _one_task_a_core(df: DataFrame) -> DataFrame:
    """As many partitions as cores: an iterative fit starts a job a step, and every task of it reports to the
    driver, so the number of partitions must not grow with the rows."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def fold_scores(df: DataFrame, grid: dict, fold: str = "fold", label: str = "label", parallel: int = 8) -> DataFrame:
    """Every estimator of ``grid`` (by its name) on every fold of one fold column: ``(params, fold, accuracy, f1_macro)``.

    Estimators of different kinds and with different preparation (Pipelines) stand side by side; ``parallel`` fits
    are submitted at a time."""
    data = _one_task_a_core(df).persist()
    folds = sorted(r[0] for r in data.select(fold).distinct().collect())  # few

    def fit(task: tuple) -> tuple:
        name, f = task
        model = grid[name].copy().fit(data.filter(F.col(fold) != f))
        pred = model.transform(data.filter(F.col(fold) == f))
        r = classification_metrics(pred.select(F.col(label).cast("long").alias("label"), F.col("prediction").cast("long").alias("prediction"))).collect()
        return name, int(f), *((float(r[0]["accuracy"]), float(r[0]["f1_macro"])) if r else (None, None))

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(inheritable_thread_target(df.sparkSession)(fit), [(n, f) for n in grid for f in folds]))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "params STRING, fold INT, accuracy DOUBLE, f1_macro DOUBLE")


def grid_search(df: DataFrame, estimator, grid: dict, fold_col: str = "fold", label: str = "label", k: int = 5):
    """Choose parameters by mean cross-validated accuracy over ``fold_col``."""
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(param, list(values))
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=ev,
                        foldCol=fold_col, numFolds=k)
    return cv.fit(_one_task_a_core(df))


def ols_summary(df: DataFrame, y: str, xs: Sequence[str], intercept: bool = True) -> DataFrame:
    """Least squares with coefficient, std error, t and p (normal
    equations aggregated on the executors, solved on the driver)."""
    va = VectorAssembler(inputCols=list(xs), outputCol="_x")
    lr = LinearRegression(featuresCol="_x", labelCol=y, solver="normal", fitIntercept=intercept, regParam=0.0)
    m = lr.fit(va.transform(df))
    s = m.summary
    names = list(xs) + (["const"] if intercept else [])
    coefs = list(m.coefficients) + ([m.intercept] if intercept else [])
    rows = [(n, float(c), float(se), float(t), float(p), float(s.r2))
            for n, c, se, t, p in zip(names, coefs, s.coefficientStandardErrors, s.tValues, s.pValues)]
    return df.sparkSession.createDataFrame(rows, "term STRING, coef DOUBLE, std_err DOUBLE, t DOUBLE, p DOUBLE, r2 DOUBLE")


def ml_stages(df: DataFrame, inputs: Sequence[str], label: str = "label") -> PipelineModel:
    """Assemble -> min-max scale -> complement naive Bayes, as one Pipeline."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="_raw"),
                            MinMaxScaler(inputCol="_raw", outputCol="features"),
                            complement_nb("features", label)])
    return pipe.fit(df)


def fitted_values(model: PipelineModel, inputs: Sequence[str], spark) -> DataFrame:
    """What the stages of `ml_stages` learned: ``(stage, name, feature, value)`` - the range of every input and its
    log weight in every class (one row a value; a model is small)."""
    rows = []
    for i, stage in enumerate(model.stages):
        if hasattr(stage, "originalMin"):
            rows += [(i, name, f, float(v)) for name, vector in (("min", stage.originalMin), ("max", stage.originalMax)) for f, v in zip(inputs, vector)]
        elif hasattr(stage, "theta"):
            rows += [(i, f"class {c}", f, float(stage.theta[c, k])) for c in range(stage.theta.numRows) for k, f in enumerate(inputs)]
    return spark.createDataFrame(rows, "stage INT, name STRING, feature STRING, value DOUBLE")
