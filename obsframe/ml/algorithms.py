"""The algorithm list: Spark's own estimators where it has them, aggregates and Columns elsewhere."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Estimator, Pipeline
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.ml.metrics import class_curves
from obsframe.ml.prepare import SEED
from obsframe.ml.together import classes_of
from obsframe.operators import neighbours
from obsframe.operators.hinge_products import fit_products
from obsframe.operators.mars import fit_hinges
from obsframe.operators.stats import loess_vertices
from obsframe.session import pin

Predictor = Callable[[DataFrame], DataFrame]

REGRESSION: dict[str, Callable[..., Estimator]] = {
    "lm": lambda **p: R.LinearRegression(solver="normal", regParam=0.0, **p),
    "glm": lambda **p: R.GeneralizedLinearRegression(**{"family": "gaussian", **p}),
    "glmnet": lambda **p: R.LinearRegression(**{"elasticNetParam": 0.5, "regParam": 0.1, **p}),
    "enet": lambda **p: R.LinearRegression(**{"elasticNetParam": 0.9, "regParam": 0.01, **p}),
    "rlm": lambda **p: R.LinearRegression(loss="huber", **{"maxIter": 50, **p}),
    "rpart": lambda **p: R.DecisionTreeRegressor(seed=SEED, **p),
    "treebag": lambda **p: R.RandomForestRegressor(seed=SEED, featureSubsetStrategy="all", **{"numTrees": 10, **p}),
    "rf": lambda **p: R.RandomForestRegressor(seed=SEED, **{"numTrees": 10, **p}),
    "boosted": lambda **p: R.GBTRegressor(seed=SEED, **{"maxIter": 10, **p}),
}
CLASSIFICATION: dict[str, Callable[..., Estimator]] = {
    "logistic": lambda **p: C.LogisticRegression(**p),
    "plr": lambda **p: C.LogisticRegression(**{"regParam": 0.1, "elasticNetParam": 0.0, **p}),
    "svm_linear": lambda **p: C.LinearSVC(**{"maxIter": 30, **p}),
    "nb": lambda **p: C.NaiveBayes(modelType="gaussian", **p),
    "rpart": lambda **p: C.DecisionTreeClassifier(seed=SEED, **p),
    "treebag": lambda **p: C.RandomForestClassifier(seed=SEED, featureSubsetStrategy="all", **{"numTrees": 10, **p}),
    "rf": lambda **p: C.RandomForestClassifier(seed=SEED, **{"numTrees": 10, **p}),
    "boosted": lambda **p: C.GBTClassifier(seed=SEED, **{"maxIter": 10, **p}),
}


# Algorithms that are not one of Spark's estimators by themselves.
OWN = {"regression": ("earth", "null", "pcr", "knn"), "classification": ("null", "lda", "qda", "oner", "nnet", "knn")}


def check_algorithm(algorithm: str, task: str) -> None:
    known = REGRESSION if task == "regression" else CLASSIFICATION
    if algorithm not in known and algorithm not in OWN[task]:
        raise ValueError(f"unknown algorithm {algorithm} for {task}")


def estimator(algorithm: str, task: str, xs: Sequence[str], y: str, **params) -> Pipeline:
    """A pipeline from plain columns to a ``prediction`` column."""
    check_algorithm(algorithm, task)
    known = REGRESSION if task == "regression" else CLASSIFICATION
    stages: list = [VectorAssembler(inputCols=list(xs), outputCol="features")]
    if algorithm == "pcr":
        k = params.pop("k", max(1, len(xs) - 1))
        stages += [PCA(k=k, inputCol="features", outputCol="scores"), R.LinearRegression(solver="normal", featuresCol="scores", labelCol=y)]
    elif algorithm == "nnet":
        hidden, classes = params.pop("size", 5), params.pop("classes", 2)
        stages.append(C.MultilayerPerceptronClassifier(
            layers=[len(xs), hidden, classes], seed=SEED, labelCol=y, **{"maxIter": 50, **params}
        ))
    else:
        stages.append(known[algorithm](labelCol=y, **params))
    return Pipeline(stages=stages)


_SCRATCH = ("features", "scores", "rawPrediction", "probability")


def fit(df: DataFrame, algorithm: str, task: str, xs: Sequence[str], y: str, **params) -> Predictor:
    """Train and return a function that adds ``prediction``."""
    check_algorithm(algorithm, task)
    if algorithm == "earth":
        column = hinges(df, xs, y, **params)
        return lambda d: d.withColumn("prediction", column)
    if algorithm == "nnet" and "classes" not in params:
        # Labels are numbered from 0.
        params["classes"] = int(df.agg(F.max(y)).first()[0]) + 1
    if algorithm == "null":
        return null_model(df, y, task)
    if algorithm in ("lda", "qda"):
        return discriminant(df, xs, y, quadratic=algorithm == "qda")
    if algorithm == "oner":
        return one_rule(df, xs, y)
    if algorithm == "knn":
        return nearest_rows(df, xs, y, task, **params)
    if algorithm == "boosted" and set(params) <= COMBINABLE:
        df, params = combined(df, task, xs, y), {**params, "weightCol": "weight_"}
    model = estimator(algorithm, task, xs, y, **params).fit(df)
    return lambda d: model.transform(d).drop(*_SCRATCH)


# Boosting under other parameters than these may tell equal rows apart.
COMBINABLE = {"maxDepth", "maxBins", "maxIter", "stepSize"}


def combined(df: DataFrame, task: str, xs: Sequence[str], y: str) -> DataFrame:
    """Rows with equal predictors as one with their number as its weight and, for a number, their mean response.

    Squared loss and its gradient sums are the same on either, and so is the gain of every split. Spark keeps what a tree
    grows from in memory, a task as much as it read; combined rows are as many as there are different ones.
    """
    if task == "regression":
        cells = df.groupBy(*xs).agg(F.avg(y).alias(y), F.count(F.lit(1)).cast("double").alias("weight_"))
    else:
        cells = df.groupBy(*xs, y).agg(F.count(F.lit(1)).cast("double").alias("weight_"))
    return pin(cells)


def hinges(df: DataFrame, xs: Sequence[str], y: str, **params) -> Column:
    """A hinge model of one predictor, or of several with products up to ``degree``; a missing predictor leaves no prediction."""
    if len(xs) == 1 and params.get("degree", 1) == 1:
        return fit_hinges(df, xs[0], y, **{k: v for k, v in params.items() if k != "degree"}).predict()
    return fit_products(df, xs, y, **params).predict()


def null_model(df: DataFrame, y: str, task: str) -> Predictor:
    """The mean, or the commonest class (ties: the smallest)."""
    if task == "regression":
        value = df.agg(F.avg(y)).first()[0]
    else:
        counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
        value = counts.agg(F.min_by(y, F.struct(-F.col("n"), F.col(y)))).first()[0]
    return lambda d: d.withColumn("prediction", F.lit(value))


def nearest_rows(df: DataFrame, xs: Sequence[str], y: str, task: str, k: int = 5) -> Predictor:
    """The mean or the commonest class of the ``k`` nearest training rows; equal predictors are asked for once."""
    place = F.array(*[F.col(c).cast("double") for c in xs])
    train = df.dropna(subset=[*xs, y]).select(place.alias("place_"), F.col(y).alias("response_"))
    refs = pin(train.withColumn("ref_", F.monotonically_increasing_id()))

    def predict(d: DataFrame) -> DataFrame:
        asked = pin(d.dropna(subset=list(xs)).select(place.alias("place_")).distinct().withColumn("ref_", F.monotonically_increasing_id()))
        near = neighbours.nearest(asked, refs, "ref_", "place_", k)
        answer = neighbours.average if task == "regression" else neighbours.vote
        told = asked.join(answer(near, refs, "ref_", "response_"), F.col("ref_") == F.col("query_id")).select("place_", "prediction")
        return d.withColumn("place_", place).join(told, "place_", "left").drop("place_")

    return predict


def one_rule(df: DataFrame, xs: Sequence[str], y: str) -> Predictor:
    """The one categorical predictor whose majority rule errs least; unseen levels get the commonest class."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in xs], F.col(y).alias("response")).unpivot(
        ["response"], list(xs), "variable", "level"
    )
    cells = long.groupBy("variable", "level", "response").agg(F.count(F.lit(1)).alias("n"))
    rules = cells.groupBy("variable", "level").agg(
        F.min_by("response", F.struct(-F.col("n"), F.col("response"))).alias("answer"), F.max("n").alias("right")
    )
    best = rules.groupBy("variable").agg(F.sum("right").alias("right")).orderBy(F.desc("right"), "variable").first()["variable"]
    rule = rules.where(F.col("variable") == best).select(F.col("level").alias(best), "answer")
    common = cells.where(F.col("variable") == best).groupBy("response").agg(F.sum("n").alias("n")).agg(
        F.min_by("response", F.struct(-F.col("n"), F.col("response")))
    ).first()[0]

    def predict(d: DataFrame) -> DataFrame:
        return d.join(rule, best, "left").withColumn("prediction", F.coalesce("answer", F.lit(common))).drop("answer")

    return predict


def discriminant(df: DataFrame, xs: Sequence[str], y: str, quadratic: bool) -> Predictor:
    """Linear or quadratic discriminant scores from class counts, means and covariances."""
    p = len(xs)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = df.dropna(subset=[*xs, y]).groupBy(F.col(y).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(xs)],
        *[F.covar_samp(xs[i], xs[j]).alias(f"cov_{i}_{j}") for i, j in pairs],
    ).orderBy("label").collect()
    total = sum(r["n"] for r in rows)
    covs = []
    for r in rows:
        m = np.zeros((p, p))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"cov_{i}_{j}"] or 0.0
        covs.append(m)
    pooled = sum((r["n"] - 1) * m for r, m in zip(rows, covs)) / (total - len(rows))
    x = [F.col(c).cast("double") for c in xs]
    scores: list[tuple[object, Column]] = []
    for r, own in zip(rows, covs):
        mean = np.array([r[f"mean_{i}"] for i in range(p)])
        cov = own if quadratic else pooled
        if np.linalg.matrix_rank(cov) < p:
            raise ValueError(f"class {r['label']} has too few or too similar rows for a covariance of {p} predictors")
        inverse = np.linalg.inv(cov)
        prior = math.log(r["n"] / total)
        if quadratic:
            gap = [x[i] - F.lit(float(mean[i])) for i in range(p)]
            form = sum((F.lit(float(inverse[i, j])) * gap[i] * gap[j] for i in range(p) for j in range(p)), F.lit(0.0))
            score = F.lit(prior - 0.5 * math.log(np.linalg.det(cov))) - 0.5 * form
        else:
            weights = inverse @ mean
            score = sum((F.lit(float(w)) * c for w, c in zip(weights, x)), F.lit(float(prior - 0.5 * mean @ weights)))
        scores.append((r["label"], score))
    best = F.greatest(*[s for _, s in scores]) if len(scores) > 1 else scores[0][1]
    label = F.coalesce(*[F.when(s == best, F.lit(v)) for v, s in scores])
    return lambda d: d.withColumn("prediction", label)


def _smooth_r2(df: DataFrame, x: str, y: str, span: float = 0.75) -> float:
    """The share of the response's variation that a local quadratic of one predictor explains; 0 for too few positions."""
    data = df.dropna(subset=[x, y]).select(F.col(x).cast("double").alias("x_"), F.col(y).cast("double").alias("y_"))
    per = data.groupBy("x_").agg(F.count(F.lit(1)).alias("n"), F.sum("y_").alias("s"), F.sum(F.col("y_") * F.col("y_")).alias("ss"))
    n, s, f = F.col("n"), F.col("s"), F.col("fit_")
    joined = per.join(loess_vertices(data, [], "x_", "y_", span, "fit_"), "x_")
    row = joined.agg(F.sum(F.col("ss") - 2 * f * s + n * f * f).alias("rest"), F.sum("ss").alias("ss"), F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    whole = (row["ss"] or 0.0) - (row["s"] or 0.0) ** 2 / (row["n"] or 1)
    if row["rest"] is None or not math.isfinite(row["rest"]) or whole <= 0:
        return 0.0
    return max(0.0, 1 - row["rest"] / whole)


def _largest_area(df: DataFrame, x: str, y: str, labels: Sequence) -> float:
    """The greatest area under a ROC curve of one predictor as a score, over pairs of classes, in its better direction."""
    areas = [0.5]
    for i, a in enumerate(labels):
        for b in labels[i + 1 :]:
            row = class_curves(df.where(F.col(y).isin([a, b])), y, {a: x}).first()
            if row is not None and row["roc"] is not None:
                areas.append(max(row["roc"], 1 - row["roc"]))
    return max(areas)


def importance(df: DataFrame, algorithm: str, task: str, xs: Sequence[str], y: str, **params) -> DataFrame:
    """Importance of each predictor, the largest scaled to 100.

    A tree model has its own; a linear one the size of each coefficient times its predictor's spread. Any other algorithm
    is measured by each predictor alone: for a number by what a local fit explains (R2), for classes by the area under
    the predictor's ROC curve, the greatest over the pairs of classes.
    """
    check_algorithm(algorithm, task)
    model = estimator(algorithm, task, xs, y, **params).fit(df).stages[-1] if algorithm not in (*OWN[task],) else None
    if hasattr(model, "featureImportances"):
        raw = [float(v) for v in model.featureImportances.toArray()]
    elif hasattr(model, "coefficients") and (task == "regression" or model.numClasses == 2):
        spread = df.agg(*[F.stddev(c).alias(c) for c in xs]).first()
        raw = [abs(float(b)) * (spread[c] or 0.0) for c, b in zip(xs, model.coefficients.toArray())]
    elif task == "regression":
        raw = [_smooth_r2(df, c, y) for c in xs]
    else:
        labels = classes_of(df, y)
        raw = [_largest_area(df.dropna(subset=[c]), c, y, labels) for c in xs]
    top = max(raw) or 1.0
    return df.sparkSession.createDataFrame([(c, v, v / top * 100) for c, v in zip(xs, raw)], "predictor string, importance double, overall double")
