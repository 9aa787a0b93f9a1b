import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.ml import metrics as M
from obsframe.ml import prepare as P
from obsframe.ml import resample as S
from obsframe.operators import mars, neighbours, spatial, stats


def series(spark, x, y):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")


def test_loess_matches_weighted_least_squares(spark):
    rng = np.random.default_rng(0)
    x = np.sort(rng.choice(np.arange(200), 60, replace=False)).astype(float)
    y = np.sin(x / 20) + rng.normal(0, 0.1, 60)
    got = {r["x"]: r["fit"] for r in stats.loess(series(spark, x, y), [], "x", "y", 0.3, "fit").collect()}
    q = int(60 * 0.3 + 1e-5)
    for x0 in x:
        near = np.argsort(np.abs(x - x0), kind="stable")[:q]
        h = np.abs(x[near] - x0).max()
        w = (1 - (np.abs(x[near] - x0) / h) ** 3) ** 3
        a = np.vander((x[near] - x0) / h, 3, increasing=True)
        fit = np.linalg.lstsq(a * np.sqrt(w)[:, None], y[near] * np.sqrt(w), rcond=None)[0][0]
        assert got[x0] == pytest.approx(fit, abs=1e-9)


def test_loess_reproduces_a_parabola_per_group(spark):
    df = spark.createDataFrame([(g, i, float(i * i * s)) for g, s in (("a", 1), ("b", -2)) for i in range(25)], "g string, x int, y double")
    out = stats.loess(df, ["g"], "x", "y", 0.4, "fit").join(df, ["g", "x"])
    assert out.count() == 50 and out.where(F.abs(F.col("fit") - F.col("y")) > 1e-6).count() == 0


def test_linear_fit_against_known_values(spark):
    rng = np.random.default_rng(2)
    x = np.arange(30.0)
    y = 2 + 0.5 * x + rng.normal(0, 1, 30)
    r = stats.linear_fit(series(spark, x, y), [], "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    e = y - slope * x - intercept
    se = np.sqrt(e @ e / 28 / ((x - x.mean()) ** 2).sum())
    assert r["slope"] == pytest.approx(slope) and r["slope_se"] == pytest.approx(se)
    # Student's t with 28 degrees of freedom: the 97.5 % point is 2.048407.
    assert (r["slope_high"] - r["slope"]) / se == pytest.approx(2.048407, abs=2e-5)
    assert r["slope_low"] < 0.5 < r["slope_high"] and r["p_value"] < 1e-6


def test_t_tail_values():
    p = stats.t_two_sided(np.array([2.228139, 12.7062]), np.array([10.0, 1.0]))
    assert p == pytest.approx([0.05, 0.05], abs=2e-4)


def test_constant_x_gives_null_not_an_error(spark):
    r = stats.linear_fit(series(spark, [1, 1, 1], [1, 2, 3]), [], "x", "y").first()
    assert r["slope"] is None and r["p_value"] is None


def test_hinges_find_the_bend(spark):
    x = np.arange(1900, 2021)
    y = np.where(x < 1970, 0.001 * (x - 1900), 0.07 + 0.02 * (x - 1970))
    df = series(spark, x, y)
    model = mars.fit_hinges(df, "x", "y")
    assert model.r2 > 0.999 and any(abs(k - 1970) <= 1 for k in model.knots())
    worst = df.select(F.max(F.abs(model.predict() - F.col("y")))).first()[0]
    assert worst < 0.01


def test_density_integrates_to_one_and_matches_kernel_sum(spark):
    rng = np.random.default_rng(5)
    v = rng.gamma(2, 10, 500)
    df = spark.createDataFrame([("g", float(a)) for a in v], "g string, v double")
    rows = stats.kernel_density(df, ["g"], "v", points=256).orderBy("point").collect()
    x, d = np.array([r["x"] for r in rows]), np.array([r["density"] for r in rows])
    assert np.trapezoid(d, x) == pytest.approx(1, abs=0.01)
    iqr = np.quantile(v, 0.75) - np.quantile(v, 0.25)
    bw = 0.9 * min(v.std(ddof=1), iqr / 1.34) * 500 ** -0.2
    exact = np.exp(-0.5 * ((x[:, None] - v) / bw) ** 2).sum(1) / (500 * bw * np.sqrt(2 * np.pi))
    assert np.abs(d - exact).max() < 0.02 * exact.max()


def test_grid_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    lon, lat, v = rng.uniform(110, 116, 40), rng.uniform(-44, -40, 40), rng.normal(size=40)
    lon[0], lat[0] = 113.0, -42.0
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(lon, lat, v)], "longitude double, latitude double, v double")
    got = {(r["longitude"], r["latitude"]): r["v"] for r in spatial.grid_interpolate(df, "v", (112, 115), (-43, -41)).collect()}
    assert len(got) == 12 and got[113, -42] == pytest.approx(v[0])
    for (x, y), value in got.items():
        if (x, y) != (113, -42):
            w = 1 / np.hypot(lon - x, lat - y) ** 5
            assert value == pytest.approx((w * v).sum() / w.sum())


@pytest.mark.parametrize("send_limit", [10_000, 0])
def test_nearest_matches_brute_force_on_both_ways(spark, send_limit):
    """A third of the reference rows are one point; the second way uses cells, blocks and slices."""
    rng = np.random.default_rng(4)
    r = rng.normal(size=(300, 3))
    r[:100] = r[0]
    q = np.vstack([rng.normal(size=(40, 3)), r[:2]])
    refs = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(r)], "id long, v array<double>")
    queries = spark.createDataFrame([(1000 + i, [float(a) for a in v]) for i, v in enumerate(q)], "id long, v array<double>")
    out = neighbours.nearest(queries, refs, "id", "v", 4, send_limit=send_limit, pivots=8, block_rows=40, query_rows=15).collect()
    for i, point in enumerate(q):
        d = np.round(np.linalg.norm(r - point, axis=1), 9)
        want = list(np.lexsort((np.arange(300), d))[:4])
        got = sorted((x["rank"], x["ref_id"]) for x in out if x["query_id"] == 1000 + i)
        assert [b for _, b in got] == want


def test_nearest_skips_the_row_itself(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "id long, v array<double>")
    for limit in (100, 0):
        out = neighbours.nearest(df, df, "id", "v", 1, skip_self=True, send_limit=limit, pivots=3).collect()
        assert len(out) == 10 and all(r["distance"] == 1.0 for r in out)


def test_split_is_stratified_and_whole(spark):
    rows = [(i, "a" if i % 4 else "b") for i in range(400)] + [(1000 + i, None) for i in range(10)]
    out = P.split(spark.createDataFrame(rows, "id int, y string"), "y", ["id"]).groupBy("y", "part").count().collect()
    got = {(r["y"], r["part"]): r["count"] for r in out}
    assert got == {("a", "train"): 240, ("a", "validation"): 60, ("b", "train"): 80, ("b", "validation"): 20, (None, "test"): 10}


def test_numeric_split_takes_a_share_of_every_quantile_group(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") * 37 % 1000).cast("double"))
    out = P.split(df, "y", ["id"])
    per = out.where("part = 'train'").groupBy(F.floor(F.col("y") / 200)).count().collect()
    assert all(158 <= r["count"] <= 162 for r in per) and out.count() == 1000


def test_loocv_equals_refitting(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=25), rng.normal(size=25)
    df = series(spark, x, y).withColumn("id", F.monotonically_increasing_id())
    got = S.resample_linear(df, ["x"], "y", ["id"], S.Scheme("loocv")).first()
    errors = []
    for i in range(25):
        keep = np.arange(25) != i
        b, a = np.polyfit(x[keep], y[keep], 1)
        errors.append(y[i] - a - b * x[i])
    assert got["rmse"] == pytest.approx(np.sqrt(np.mean(np.square(errors))))


def test_bootstrap_draws_about_n_rows(spark):
    drawn = S.resamples(spark.range(20000), S.Scheme("boot", number=10), ["id"])
    for r in drawn.groupBy("resample").agg(F.sum("weight").alias("w"), F.avg((F.col("weight") == 0).cast("double")).alias("out")).collect():
        assert abs(r["w"] - 20000) < 600 and abs(r["out"] - np.exp(-1)) < 0.02


def test_two_class_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, p double")
    r = M.two_class_metrics(df, "y", "p").first()
    assert (r["roc"], r["sens"], r["spec"]) == (0.875, 1.0, 0.5)


def test_kappa_and_constant_predictions(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "o string, p string")
    r = M.classification_metrics(df, "o", "p").first()
    assert r["accuracy"] == 0.75 and r["kappa"] == pytest.approx(0.5)
    flat = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "o double, p double")
    assert M.regression_metrics(flat, "o", "p").first()["r2"] is None


def test_learnt_steps_use_training_rows_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double")
    new = spark.createDataFrame([(None,), (100.0,)], "v double")
    assert sorted(r["v"] for r in P.impute_median(train, ["v"])(new).collect()) == [2.0, 100.0]


def test_too_many_levels_is_an_error(spark):
    with pytest.raises(ValueError):
        P.dummies(spark.range(20).select(F.col("id").cast("string").alias("c")), "c", max_levels=10)
