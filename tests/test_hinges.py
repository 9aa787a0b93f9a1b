"""Hinge models from moments against plain least squares on rows, and against a slow search."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.functions.scalar import hash_fold
from obsframe.ml import algorithms as A
from obsframe.ml.lags import lag_hinges
from obsframe.ml.resample import Scheme, resamples
from obsframe.operators import hinge_products, mars


def hinge(x, side, knot):
    return np.maximum(0.0, side * (x - knot))


def rss_of(x, y, w, terms):
    basis = np.column_stack([np.ones(len(x)), *[hinge(x, s, k) for s, k in terms]])
    root = np.sqrt(w)[:, None]
    coef = np.linalg.lstsq(basis * root, y * root[:, 0], rcond=1e-10)[0]
    return float((w * (y - basis @ coef) ** 2).sum()), coef, basis


def slow_search(x, y, w, knots, max_terms):
    terms, start = [], rss_of(x, y, w, [])[0]
    now = start
    while 1 + len(terms) + 2 <= max_terms:
        trials = [(rss_of(x, y, w, [*terms, (1, k), (-1, k)])[0], k) for k in knots if k not in {k for _, k in terms}]
        lowest = min(trials)[0]
        best, k = next((r, k) for r, k in sorted(trials, key=lambda t: t[1]) if r <= lowest + 1e-9 * start)
        if now - best <= 1e-3 * start:
            break
        new = [*terms, (1, k), (-1, k)]
        if np.linalg.matrix_rank(rss_of(x, y, w, new)[2]) <= len(new):  # one of the pair is spanned already
            new = [*terms, min((round(rss_of(x, y, w, [*terms, (s, k)])[0], 6), -s) for s in (1, -1))[1] * -1]
            new = [*terms, (new[-1], k)]
        terms, now = new, best
    path = [terms]
    while terms:
        trials = [[t for t in terms if t != d] for d in terms]
        errors = [rss_of(x, y, w, left)[0] for left in trials]
        terms = next(t for t, e in zip(trials, errors) if e <= min(errors) + 1e-9 * (w * y * y).sum())
        path.append(terms)
    return path


def gcv(n, terms, rss, penalty=2.0):
    cost = len(terms) + 1 + penalty * len(terms) / 2
    return np.inf if cost >= n else rss / n / (1 - cost / n) ** 2


@pytest.fixture(scope="module")
def bent():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 300).astype(float)
    return x, 2 * np.maximum(0, x - 11) - 5 * np.maximum(0, x - 27) + rng.normal(0, 1.5, 300)


def test_search_matches_least_squares_on_rows(spark, bent):
    x, y = bent
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1.0), (2.0, None)], "x double, y double")
    model = mars.fit_hinges(df, "x", "y", max_terms=9)
    path = slow_search(x, y, np.ones(300), sorted(set(x)), 9)
    scores = [gcv(300, t, rss_of(x, y, np.ones(300), t)[0]) for t in path]
    assert np.isclose(model.gcv, min(scores), rtol=1e-6)
    rss, coef, basis = rss_of(x, y, np.ones(300), [(s, k) for s, k, _ in model.terms])
    got = df.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y", model.predict().alias("p")).toPandas()
    assert np.isclose(((got["y"] - got["p"]) ** 2).sum(), rss) and np.isclose(model.r2, 1 - rss / ((y - y.mean()) ** 2).sum())
    assert any(abs(k - 11) <= 2 for k in model.knots()) and any(abs(k - 27) <= 2 for k in model.knots())
    assert df.where("x IS NULL").select(model.predict()).first()[0] is None


def test_many_positions_are_all_knots(spark):
    df = spark.range(30000).select((F.col("id") / 3).alias("x"), F.greatest(F.lit(0.0), F.col("id") / 3 - 7001.0).alias("y"))
    assert mars.fit_hinges(df, "x", "y", max_terms=5, max_knots=40000).knots() == [7001.0]
    assert len(mars._candidate_knots(df, "x", 500)) == 500


def test_number_of_terms_is_chosen_on_held_out_rows(spark, bent):
    x, y = bent
    df = spark.createDataFrame(list(zip(range(300), x.tolist(), y.tolist())), "id int, x double, y double")
    fold = hash_fold(4, 3, "id")
    model, table = mars.tune_hinges(df, "x", "y", fold, max_terms=9)
    folds = np.array([r["f"] for r in df.select("id", fold.alias("f")).orderBy("id").collect()])
    knots, errors = sorted(set(x)), np.zeros(len(table))
    for f in range(4):
        out = folds == f
        path = slow_search(x[~out], y[~out], np.ones((~out).sum()), knots, 9)
        for i, (size, _, _) in enumerate(table):
            terms = next(t for t in path if len(t) + 1 <= size)
            coef = rss_of(x[~out], y[~out], np.ones((~out).sum()), terms)[1]
            basis = np.column_stack([np.ones(out.sum()), *[hinge(x[out], s, k) for s, k in terms]])
            errors[i] += np.sqrt(((y[out] - basis @ coef) ** 2).mean()) / 4
    assert np.allclose([e for _, e, _ in table], errors)
    best = [size for size, _, b in table if b]
    assert len(best) == 1 and len(model.terms) + 1 <= best[0] and errors[best[0] - 1] == errors.min()


def test_lags_under_bootstrap(spark):
    rng = random.Random(4)
    start, rows = datetime.date(2000, 1, 1), []
    soi = [round(rng.gauss(0, 1), 1) for _ in range(150)]
    for m in range(150):
        day = datetime.date(start.year + m // 12, 1 + m % 12, 1)
        rows.append((day, 3.0 * max(0, soi[m - 2] - 0.5) + rng.gauss(0, 0.3) if m >= 2 else None, soi[m]))
    series = spark.createDataFrame(rows, "date date, y double, x double")
    scheme = Scheme("boot", number=4, seed=9)
    got = {(r["algorithm"], r["n_lag"]): r for r in lag_hinges(series, "y", "x", range(4), scheme, max_terms=7).collect()}
    assert len(got) == 8 and all(r["resamples"] == 4 for r in got.values())
    assert min((r["rmse"], k) for k, r in got.items())[1] == ("earth", 2) and got["earth", 2]["rmse"] < 0.5 * got["null", 2]["rmse"]
    for lag in range(4):
        pairs = [(rows[m][0], soi[m - lag], rows[m][1]) for m in range(lag, 150) if rows[m][1] is not None]
        frame = spark.createDataFrame(pairs, "date date, x double, y double")
        drawn = resamples(frame, scheme, ["date"]).toPandas()
        knots = sorted({v for m in range(4) for v in (soi[i - m] for i in range(m, 150) if rows[i][1] is not None)})
        errors, plain = [], []
        for _, own in drawn.groupby("resample"):
            x, y, w = (own[c].to_numpy(float) for c in ("x", "y", "weight"))
            path = slow_search(x[w > 0], y[w > 0], w[w > 0], knots, 7)
            terms = min(path[::-1], key=lambda t: gcv(w.sum(), t, rss_of(x[w > 0], y[w > 0], w[w > 0], t)[0]))
            coef = rss_of(x[w > 0], y[w > 0], w[w > 0], terms)[1]
            out = w == 0
            basis = np.column_stack([np.ones(out.sum()), *[hinge(x[out], s, k) for s, k in terms]])
            errors.append(np.sqrt(((y[out] - basis @ coef) ** 2).mean()))
            plain.append(np.sqrt(((y[out] - (w * y).sum() / w.sum()) ** 2).mean()))
        assert np.isclose(got["null", lag]["rmse"], np.mean(plain)) and np.isclose(got["earth", lag]["rmse"], np.mean(errors), rtol=1e-6)


def test_products_of_hinges_are_found(spark):
    rng = np.random.default_rng(7)
    a, b, c = rng.integers(0, 25, (3, 1500)) / 2.5
    y = 1.0 + 2.0 * np.maximum(0, a - 4) * np.maximum(0, 6 - b) + 0.5 * c + rng.normal(0, 0.05, 1500)
    df = spark.createDataFrame([*map(tuple, np.column_stack([a, b, c, y]).tolist()), (None, 1.0, 1.0, 5.0)], "a double, b double, c double, y double")
    sums = hinge_products.fit_products(df, ["a", "b", "c"], "y")
    products = hinge_products.fit_products(df, ["a", "b", "c"], "y", degree=2)
    assert sums.r2 < 0.95 < 0.999 < products.r2
    assert all(len(f) <= 1 for f, _ in sums.terms) and any({x for x, *_ in f} == {"a", "b"} for f, _ in products.terms)
    scored = df.withColumn("p", products.predict())
    rows = scored.where("a IS NOT NULL").toPandas()
    assert np.sqrt(((rows["y"] - rows["p"]) ** 2).mean()) < 0.2 and scored.where("a IS NULL").first()["p"] is None
    basis = np.column_stack([np.prod([hinge(rows[x].to_numpy(), s, k) for x, s, k in f], axis=0) * np.ones(len(rows)) for f, _ in products.terms])
    direct = basis @ np.linalg.lstsq(basis, rows["y"].to_numpy(), rcond=1e-10)[0]
    assert np.allclose(direct, rows["p"], atol=1e-6)
    fit = A.fit(df, "earth", "regression", ["a", "b"], "y", degree=2)(df).where("a IS NOT NULL").toPandas()
    assert np.corrcoef(fit["y"], fit["prediction"])[0, 1] > 0.95


def test_equal_responses_and_one_position(spark):
    flat = spark.createDataFrame([(float(i), 2.0) for i in range(9)], "x double, y double")
    model = mars.fit_hinges(flat, "x", "y")
    assert model.terms == () and np.isclose(model.intercept, 2.0)
    single = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    assert np.isclose(mars.fit_hinges(single, "x", "y").intercept, 3.0)
    with pytest.raises(ValueError):
        mars.fit_hinges(single.limit(0), "x", "y")
