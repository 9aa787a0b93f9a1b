"""Models of all resamples fitted together, against one fit per resample by other means."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.ml import algorithms as A
from obsframe.ml import experiment as E
from obsframe.ml import together, trees
from obsframe.ml.resample import Scheme, held_out, names_of, resamples, score_fits, shares

SCHEMES = [Scheme("cv", number=4), Scheme("repeatedcv", number=3, repeats=2), Scheme("boot", number=5), Scheme("none")]


def slow_tree(x, y, w, depth, classes=0):
    """Exact cuts by trying them all; gives a function of a row."""
    keep = w > 0
    x, y, w = x[keep], y[keep], w[keep]
    if classes:
        mean = int(np.argmax([w[y == c].sum() for c in range(classes)]))
    else:
        mean = float((w * y).sum() / w.sum())
    if depth == 0:
        return lambda row: mean

    def purity(part):
        if classes:
            return sum(w[part & (y == c)].sum() ** 2 for c in range(classes)) / w[part].sum()
        return (w[part] * y[part]).sum() ** 2 / w[part].sum()

    best = None
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            gain = purity(left) + purity(~left) - purity(np.ones(len(y), bool))
            if best is None or gain > best[0] + 1e-9 * abs(best[0]):
                best = (gain, f, cut)
    if best is None or best[0] <= 1e-12 * purity(np.ones(len(y), bool)):
        return lambda row: mean
    _, f, cut = best
    left = x[:, f] <= cut
    a, b = slow_tree(x[left], y[left], w[left], depth - 1, classes), slow_tree(x[~left], y[~left], w[~left], depth - 1, classes)
    return lambda row: a(row) if row[f] <= cut else b(row)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        a, b = rng.randrange(15), rng.randrange(12) / 4
        kind = "xyz"[(a > 6) + (b > 1.5) * (rng.random() < 0.8)]
        rows.append((i, float(a), b, 3.0 * (a > 6) + 2 * b * (a > 9) + rng.gauss(0, 0.5), kind, rng.choice("pq") if kind == "x" else rng.choice("qrs")))
    rows += [(1000, None, 1.0, 2.0, "x", "p"), (1001, 1.0, 2.0, None, None, None)]
    return spark.createDataFrame(rows, "id int, a double, b double, y double, kind string, level string").cache()


def by_resample(marked, per, scheme):
    rows = marked.select("*", *[w.alias(f"w{i}") for i, w in enumerate(per)]).toPandas()
    held = {}
    for i, name in enumerate(names_of(scheme)):
        w = rows[f"w{i}"].to_numpy(float)
        held[name] = (rows, w, np.ones(len(w), bool) if scheme.method == "none" else w == 0)
    return held


@pytest.mark.parametrize("scheme", SCHEMES, ids=lambda s: s.method)
@pytest.mark.parametrize("depth", [1, 4])
@pytest.mark.parametrize("kind", ["regression", "classification"])
def test_trees_match_exact_cuts(table, scheme, depth, kind):
    y = "y" if kind == "regression" else "kind"
    data = table.dropna(subset=["a", "b", y])
    scored = together.score_trees(table, kind, ["a", "b"], y, ["id"], scheme, maxDepth=depth).toPandas()
    marked, per = shares(data, scheme, ["id"])
    for name, (rows, w, held) in by_resample(marked, per, scheme).items():
        x, target = rows[["a", "b"]].to_numpy(), rows[y].to_numpy()
        codes = {"x": 0, "y": 1, "z": 2}
        grown = slow_tree(x, target if y == "y" else np.array([codes[k] for k in target]), w, depth, 0 if y == "y" else 3)
        want = [grown(row) for row in x[held]]
        own = scored[scored["resample"] == name]
        if y == "y":
            assert np.allclose(sorted(own["prediction"]), sorted(want)) and np.allclose(sorted(own["y"]), sorted(target[held]))
            assert np.isclose(((own["y"] - own["prediction"]) ** 2).sum(), ((target[held] - want) ** 2).sum())
        else:
            assert sorted(zip(own["kind"], own["prediction"])) == sorted(zip(target[held], ["xyz"[c] for c in want]))


def test_many_values_are_cut_at_quantiles(spark):
    df = spark.range(5000).select("id", (F.col("id") / 7).alias("x"), F.when(F.col("id") < 2500, 1.0).otherwise(5.0).alias("y"))
    scored = together.score_trees(df, "regression", ["x"], "y", ["id"], Scheme("cv", number=3), maxDepth=1, maxBins=16).toPandas()
    assert len(scored) == 5000 and (abs(scored["y"] - scored["prediction"]) < 0.5).mean() > 0.97
    assert len(trees.cut_points(df, ["x"], 16)["x"]) == 15


def test_small_nodes_stay_whole(table):
    marked, per = shares(table.dropna(subset=["a", "b", "y"]), Scheme("none"), ["id"])
    grown = trees.grow(marked, ["a", "b"], [F.col("y")], per, trees.TreeSettings(max_depth=6, min_rows=60))
    scored = grown.predict(marked, F.lit(0)).groupBy("prediction").count().collect()
    assert len(scored) > 2 and min(r["count"] for r in scored) >= 60
    flat = trees.grow(marked, ["a"], [F.lit(2.0)], per).predict(marked, F.lit(0))
    assert {r["prediction"] for r in flat.collect()} == {2.0}


@pytest.mark.parametrize("scheme", SCHEMES, ids=lambda s: s.method)
@pytest.mark.parametrize("algorithm", ["null", "lda", "qda", "nb", "oner"])
def test_class_models_match_one_fit_per_resample(spark, table, scheme, algorithm):
    numbered = table.where("kind IS NOT NULL").withColumn("kind", F.when(F.col("kind") == "x", 0).when(F.col("kind") == "y", 1).otherwise(2).cast("double"))
    xs = ["level", "b"] if algorithm == "oner" else ["a", "b"]
    data = numbered.dropna(subset=xs)
    if algorithm == "oner":
        data = data.withColumn("b", F.col("b").cast("string"))
    plain = score_fits(data, lambda d: A.fit(d, algorithm, "classification", xs, "kind"), xs, "kind", ["id"], scheme)
    own = together.score_together(data, algorithm, "classification", xs, "kind", ["id"], scheme)
    counts = [sorted(map(tuple, df.groupBy("resample", "kind", F.col("prediction").cast("double")).count().collect())) for df in (own, plain)]
    assert counts[0] == counts[1] and len(counts[0]) >= 3


def test_probabilities_add_up(table):
    out = together.score_forms(table, "lda", ["a", "b"], "kind", ["id"], Scheme("cv", number=3), probabilities=True).toPandas()
    p = out[["p_x", "p_y", "p_z"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (out["prediction"] == np.array(list("xyz"))[p.argmax(axis=1)]).all()


def test_experiment_of_both_kinds(table):
    tasks = E.cross(E.Task("t", "y", ("a", "b")), algorithm=["lm", "null", "rpart", "knn", "glmnet"])
    tasks += E.cross(E.Task("c", "kind", ("a", "b"), kind="classification"), algorithm=["null", "lda", "rpart", "knn"])
    out = {r["name"]: r for r in E.query_table(table, tasks, ["id"], Scheme("cv", number=3), knn={"k": 7}).collect()}
    assert len(out) == 9 and all(r["resamples"] == 3 for r in out.values())
    assert out["t_knn"]["rmse"] < out["t_rpart"]["rmse"] * 1.3 < out["t_null"]["rmse"] and out["t_knn"]["accuracy"] is None
    assert out["c_knn"]["accuracy"] > 0.75 > out["c_null"]["accuracy"] and abs(out["c_null"]["kappa"]) < 1e-9 and out["c_lda"]["rmse"] is None
    with pytest.raises(ValueError):
        E.query_table(table, [E.Task("t", "kind", ("a",), "glmnet", kind="classification")], ["id"], Scheme("cv"))


def test_knn_against_all_rows(table):
    data = table.dropna(subset=["a", "b", "y"])
    train, rest = data.where("id % 3 > 0"), data.where("id % 3 = 0")
    got = {r["id"]: r["prediction"] for r in A.fit(train, "knn", "regression", ["a", "b"], "y", k=4)(rest).collect()}
    rows, asked = train.toPandas(), rest.toPandas()
    for _, q in asked.iterrows():
        d = (rows["a"] - q["a"]) ** 2 + (rows["b"] - q["b"]) ** 2
        near = rows.assign(d=d).sort_values("d")
        low, high = near["y"][near["d"] <= near["d"].iloc[3]].agg(["min", "max"])
        assert low <= got[q["id"]] <= high
        if near["d"].iloc[4] > near["d"].iloc[3]:
            assert np.isclose(got[q["id"]], near["y"].iloc[:4].mean())
    assert len(got) == len(asked)


def test_held_out_rows(table):
    for scheme in SCHEMES:
        marked, per = shares(table, scheme, ["id"])
        held = held_out(marked, per, scheme, ["id"])
        n = {"cv": 402, "repeatedcv": 804, "none": 402}.get(scheme.method)
        assert held.count() == n if n else held.count() == resamples(table, scheme, ["id"]).where("weight = 0").count()


def test_importance_without_a_model_of_its_own(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        a, b, c = rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(-3, 3)
        rows.append((a, b, c, a * a + 0.3 * b + rng.gauss(0, 0.2), "xyz"[(a > 0) + (a > 1.5)], int(b > 0.5)))
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, kind string, flag int")
    number = {r["predictor"]: r["importance"] for r in A.importance(df, "earth", "regression", ["a", "b", "c"], "y").collect()}
    assert number["a"] > 0.9 > 0.2 > number["b"] > number["c"] and number["c"] < 0.05  # a parabola that no line shows
    kinds = {r["predictor"]: r["importance"] for r in A.importance(df, "lda", "classification", ["a", "b"], "kind").collect()}
    assert kinds["a"] == 1.0 and 0.5 <= kinds["b"] < 0.65
    flags = {r["predictor"]: r["overall"] for r in A.importance(df, "knn", "classification", ["b", "c"], "flag").collect()}
    assert flags["b"] == 100.0 and flags["c"] < 65


def test_depths_are_tuned_on_one_growth(table):
    data = table.dropna(subset=["a", "b", "y"])
    out = {r["maxDepth"]: r for r in E.tune(data, "rpart", ["a", "b"], "y", ["id"], {"maxDepth": [1, 2, 5]}, k=4, metric="mae").collect()}
    for depth, row in out.items():
        scored = together.score_trees(data, "regression", ["a", "b"], "y", ["id"], Scheme("cv", number=4), maxDepth=int(depth))
        per = scored.groupBy("resample").agg(F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("m")).agg(F.avg("m")).first()[0]
        assert np.isclose(per, row["mae"])
    assert [d for d, r in out.items() if r["best"]] == [min(out, key=lambda d: out[d]["mae"])]
