"""Experiments: tasks crossed with alternatives, and tables of what they gave.

Only descriptions of tasks and their few result rows live on the driver; every fit and
every score is a Spark job.
"""

from __future__ import annotations

import datetime
import itertools
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.functions.scalar import hash_fold
from obsframe.ml.algorithms import check_algorithm, estimator, fit
from obsframe.ml.metrics import classification_metrics, regression_metrics
from obsframe.ml.resample import LINE_METRICS, MAX_MOMENTS, Scheme, resample_models, score_fits, score_penalised
from obsframe.ml.together import score_depths, score_together


@dataclass(frozen=True)
class Task:
    """A named model: response, predictors, algorithm and the parameters it was crossed with; ``kind`` is regression or classification."""

    name: str
    response: str
    predictors: tuple[str, ...] = ()
    algorithm: str = "lm"
    parameters: Mapping[str, object] = field(default_factory=dict)
    kind: str = "regression"


METRICS = {"regression": ("rmse", "r2", "mae"), "classification": ("accuracy", "kappa")}


def cross(task: Task, **alternatives: Sequence) -> list[Task]:
    """One task per combination; the alternatives are kept as its parameters."""
    out = []
    for combo in itertools.product(*alternatives.values()):
        chosen = dict(zip(alternatives, combo))
        name = "_".join([task.name, *[str(v) for v in combo]])
        predictors = (chosen["predictor"],) if "predictor" in chosen else task.predictors
        out.append(Task(name, task.response, predictors, chosen.get("algorithm", task.algorithm), {**task.parameters, **chosen}, task.kind))
    return out


def resample_table(df: DataFrame, tasks: Sequence[Task], ids: Sequence[str], scheme: Scheme, **params: Mapping[str, object]) -> DataFrame:
    """Metrics of every resample of every task: those of numbers, of classes, or both where the tasks are of both kinds.

    Lines and means of one response are fitted together from sums, and so are trees and the models of classes that sums
    suffice for; any other algorithm is fitted once per resample, with the parameters given under its name. An unknown
    algorithm is an error.
    """
    names = list(dict.fromkeys(k for t in tasks for k in t.parameters))
    labels = df.sparkSession.createDataFrame(
        [(t.name, *[str(t.parameters.get(k)) if k in t.parameters else None for k in names]) for t in tasks],
        ", ".join(["name string", *[f"{k} string" for k in names]]),
    )
    for t in tasks:
        check_algorithm(t.algorithm, t.kind)
    lines = [t for t in tasks if t.kind == "regression" and t.algorithm in ("lm", "null")]
    parts = []
    for response in dict.fromkeys(t.response for t in lines):
        models = {t.name: [] if t.algorithm == "null" else list(t.predictors) for t in lines if t.response == response}
        parts.append(resample_models(df, models, response, ids, scheme).withColumnRenamed("model", "name"))
    for kind, measure in (("regression", regression_metrics), ("classification", classification_metrics)):
        scored: dict[str, DataFrame] = {}
        for t in tasks:
            if t.kind == kind and t not in lines:
                own = dict(params.get(t.algorithm, {}))
                one = score_together(df, t.algorithm, kind, t.predictors, t.response, ids, scheme, **own)
                if one is None:
                    one = score_fits(df, lambda d, t=t, own=own: fit(d, t.algorithm, kind, t.predictors, t.response, **own), t.predictors, t.response, ids, scheme)
                one = one.select(F.lit(t.name).alias("name"), "resample", F.col(t.response).alias("observed"), "prediction")
                as_type = "double" if kind == "regression" else one.schema["observed"].dataType
                one = one.withColumns({c: F.col(c).cast(as_type) for c in ("observed", "prediction")})
                key = str(as_type)  # labels of one type are measured in one pass
                scored[key] = scored[key].unionByName(one) if key in scored else one
        parts += [measure(one, "observed", "prediction", ["name", "resample"]) for one in scored.values()]
    return labels.join(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), "name")


def query_table(df: DataFrame, tasks: Sequence[Task], ids: Sequence[str], scheme: Scheme, **params: Mapping[str, object]) -> DataFrame:
    """One row per task: its name, its parameters and its mean metrics."""
    per = resample_table(df, tasks, ids, scheme, **params)
    measures = [m for own in METRICS.values() for m in own if m in per.columns]
    keys = [c for c in per.columns if c not in ("resample", "n", *measures)]
    return per.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures], F.count(F.lit(1)).alias("resamples"))


def run_all(spark: SparkSession, tasks: Sequence[Task], train: Callable[[Task], object]) -> tuple[dict[str, object], DataFrame]:
    """Run every fit; a failing one is recorded, not raised. Gives the results and the status table."""
    results, rows = {}, []
    for t in tasks:
        started = datetime.datetime.now()
        error = ""
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            try:
                results[t.name] = train(t)
            except Exception as problem:  # noqa: BLE001
                error = f"{type(problem).__name__}: {problem}"
        finished = datetime.datetime.now()
        rows.append((
            t.name, t.algorithm, not error, int(bool(error)), error, "; ".join(str(w.message) for w in seen),
            started, finished, (finished - started).total_seconds(),
        ))
    schema = "name string, algorithm string, succeeded boolean, errors int, messages string, warnings string, started timestamp, finished timestamp, seconds double"
    return results, spark.createDataFrame(rows, schema)


def _judge(task: str, y: str, metric: str | None):
    """Spark's evaluator for a metric: rmse, mae, r2 ... for numbers, accuracy, f1, logLoss ... for classes."""
    if task == "regression":
        return RegressionEvaluator(labelCol=y, metricName=metric or "rmse")
    return MulticlassClassificationEvaluator(labelCol=y, metricName=metric or "accuracy")


def _scored(df: DataFrame, maps, model, grid: Mapping[str, Sequence], scores: Sequence[float], judge) -> DataFrame:
    """A row per combination of a grid, the best one marked."""
    best = (max if judge.isLargerBetter() else min)(range(len(maps)), key=scores.__getitem__)
    rows = [
        (i + 1, *[float(m[model.getParam(n)]) for n in grid], float(scores[i]), i == best) for i, m in enumerate(maps)
    ]
    schema = ", ".join(["index int", *[f"{n} double" for n in grid], f"{judge.getMetricName()} double", "best boolean"])
    return df.sparkSession.createDataFrame(rows, schema)


def tune(
    df: DataFrame, algorithm: str, xs: Sequence[str], y: str, ids: Sequence[str], grid: Mapping[str, Sequence], k: int = 3, seed: int = 7,
    task: str = "regression", metric: str | None = None, fixed: Mapping[str, object] | None = None,
) -> DataFrame:
    """The cross-validated metric of every combination of a tuning grid, the best one marked; ``fixed`` parameters hold for all.

    Depths of a tree are tuned on trees of all folds that are grown together once, to the greatest depth. Penalties of a
    line are tuned from sums per fold: one scan for all fits, one to score them.
    """
    direct = {"regression": ("rmse", "mae"), "classification": ("accuracy", "kappa")}[task]
    chosen = metric or direct[0]
    if algorithm == "rpart" and set(grid) == {"maxDepth"} and chosen in direct and set(fixed or {}) <= {"maxBins", "minInstancesPerNode"}:
        depths = [int(d) for d in grid["maxDepth"]]
        found = score_depths(df, task, xs, y, ids, Scheme("cv", number=k, seed=seed), depths, chosen, **dict(fixed or {}))
        best = (min if task == "regression" else max)(range(len(depths)), key=lambda i: found[depths[i]])
        rows = [(i + 1, float(d), float(found[d]), i == best) for i, d in enumerate(depths)]
        return df.sparkSession.createDataFrame(rows, f"index int, maxDepth double, {chosen} double, best boolean")
    pipeline = estimator(algorithm, task, xs, y, **dict(fixed or {}))
    model = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), list(values))
    maps = builder.build()
    judge = _judge(task, y, metric)
    penalties = {"regParam", "elasticNetParam"}
    if algorithm in ("lm", "glmnet", "enet") and judge.getMetricName() in LINE_METRICS and {*grid, *(fixed or {})} <= penalties and len(xs) <= MAX_MOMENTS:
        wanted = [{p.name: float(v) for p, v in m.items()} for m in maps]
        base = {n: float(model.getOrDefault(n)) for n in penalties}
        pairs = [({**base, **w}["regParam"], {**base, **w}["elasticNetParam"]) for w in wanted]
        scores = score_penalised(df, xs, y, ids, k, seed, pairs, judge.getMetricName())
        return _scored(df, maps, model, grid, scores, judge)
    folded = df.withColumn("fold", hash_fold(k, seed, *ids))
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=judge, numFolds=k, foldCol="fold", parallelism=4, seed=seed)
    scores = cv.fit(folded).avgMetrics
    return _scored(df, maps, model, grid, scores, judge)


def augment(df: DataFrame, predict: Callable[[DataFrame], DataFrame], response: str) -> DataFrame:
    """``<response>_prediction`` and, for a number, ``<response>_residual``."""
    out = predict(df).withColumnRenamed("prediction", f"{response}_prediction")
    kind = dict(out.dtypes)[response]
    if kind == "string":
        return out
    return out.withColumn(f"{response}_residual", F.col(response) - F.col(f"{response}_prediction"))
