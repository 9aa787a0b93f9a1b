"""Penalties tuned from sums per fold, against Spark's own cross-validation."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from obsframe.functions.scalar import hash_fold
from obsframe.ml import experiment as E
from obsframe.ml.algorithms import estimator

GRID = {"regParam": [0.0, 0.3, 4.0], "elasticNetParam": [0.0, 0.5, 1.0]}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3)) * [1, 5, 0.2] + [0, 40, 3]
    y = x @ [2.0, -0.7, 4.0] + rng.normal(size=240) * 2 + 10
    return spark.createDataFrame([(i, *[float(a) for a in v], 7.0, float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, same double, y double")


@pytest.mark.parametrize("metric", ["rmse", "mae", "r2"])
def test_scores_are_those_of_single_fits(spark, rows, monkeypatch, metric):
    monkeypatch.setattr(E, "CrossValidator", None)  # no fit per fold
    xs = ["a", "b", "c", "same"]
    out = E.tune(rows, "glmnet", xs, "y", ["id"], GRID, metric=metric).collect()
    folded, judge = rows.withColumn("fold", hash_fold(3, 7, "id")), RegressionEvaluator(labelCol="y", metricName=metric)
    assert len(out) == 9 and sum(r["best"] for r in out) == 1
    for r in out:
        if (r["regParam"], r["elasticNetParam"]) not in ((0.0, 0.5), (0.3, 0.0), (4.0, 0.5), (4.0, 1.0)):
            continue
        one = estimator("glmnet", "regression", xs, "y", regParam=r["regParam"], elasticNetParam=r["elasticNetParam"], tol=1e-10)
        scores = [judge.evaluate(one.fit(folded.where(F.col("fold") != f)).transform(folded.where(F.col("fold") == f))) for f in range(3)]
        assert r[metric] == pytest.approx(np.mean(scores), rel=1e-6)
