"""Smoothing at vertices against a plain implementation, and its growth."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.operators import stats


def plain(x, y, span, cell=0.2):
    """Cell tree, local quadratics by least squares at its vertices, cubic blending; x sorted, repeats allowed."""
    n = len(x)
    q = max(4, min(n, int(np.floor(n * span + 1e-5))))
    cuts = []

    def divide(low, high):
        if high - low <= int(n * span * cell):
            return
        middle = (low + 1 + high) // 2
        borders = [i for i in range(low + 1, high) if x[i - 1] < x[i]]
        if not borders:
            return
        at = min(borders, key=lambda i: (abs(i - middle), -i))
        cuts.append((x[at - 1] + x[at]) / 2)
        divide(low, at)
        divide(at, high)

    divide(0, n)
    margin = 0.005 * max(x[-1] - x[0], 1e-3 * max(abs(x[0]), abs(x[-1])) + 1e-30)
    vs = np.array([x[0] - margin, *sorted(cuts), x[-1] + margin])
    fits = []
    for v in vs:
        near = np.argsort(np.abs(x - v), kind="stable")[:q]
        h = np.abs(x[near] - v).max()
        w = (1 - (np.abs(x - v) / h) ** 3) ** 3
        keep = np.abs(x - v) < h
        u = (x[keep] - v) / h
        basis = np.column_stack([np.ones(keep.sum()), u, u * u]) * np.sqrt(w[keep])[:, None]
        coef = np.linalg.lstsq(basis, y[keep] * np.sqrt(w[keep]), rcond=None)[0]
        fits.append((coef[0], coef[1] / h))
    out = {}
    for at in np.unique(x):
        k = np.searchsorted(vs, at, side="right") - 1
        w = vs[k + 1] - vs[k]
        t = (at - vs[k]) / w
        (f0, g0), (f1, g1) = fits[k], fits[k + 1]
        out[at] = (2 * t**3 - 3 * t**2 + 1) * f0 + (t**3 - 2 * t**2 + t) * w * g0 + (3 * t**2 - 2 * t**3) * f1 + (t**3 - t**2) * w * g1
    return out


@pytest.mark.parametrize("span, repeats", [(0.2, 1), (0.05, 1), (0.3, 6)])
def test_agrees_with_a_plain_implementation(spark, span, repeats):
    rng = np.random.default_rng(int(span * 100))
    x = np.sort(rng.choice(3000, 400 // repeats, replace=False)).astype(float)
    x = np.sort(rng.choice(x, 400)) if repeats > 1 else x
    y = np.sin(x / 300) + rng.normal(0, 0.1, len(x))
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (5.0, None), (None, 1.0)], "x double, y double")
    got = {r["x"]: r["fit"] for r in stats.loess_vertices(df, [], "x", "y", span, "fit").collect()}
    want = plain(x, y, span)
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-7)


def test_close_to_the_fit_at_every_point(spark):
    df = spark.range(600).select(F.col("id").alias("x"), F.sin(F.col("id") / 60).alias("y"))
    both = stats.loess_vertices(df, [], "x", "y", 0.2, "a").join(stats.loess(df, [], "x", "y", 0.2, "b"), "x")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 0.002


def test_series_of_their_own_and_no_rows(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"), (F.col("id") * F.col("id") * (1 + F.col("id") % 2)).cast("double").alias("y"))
    out = stats.loess_vertices(df, ["g"], "x", "y", 0.4, "fit").join(df, ["g", "x"])
    assert out.count() == 200 and out.where("abs(fit - y) > 1e-5 * (1 + abs(y))").count() == 0  # a parabola is reproduced
    assert stats.loess_vertices(df.limit(0), ["g"], "x", "y", 0.4, "fit").count() == 0


def test_many_positions(spark):
    df = spark.range(100_000).select(F.col("id").alias("x"), (F.sin(F.col("id") / 9000) + F.rand(3)).alias("y"))
    start = time.time()
    out = stats.loess_vertices(df, [], "x", "y", 0.01, "fit")
    error = out.agg(F.avg(F.abs(F.col("fit") - F.sin(F.col("x") / 9000) - 0.5))).first()[0]
    assert error < 0.05 and time.time() - start < 60
