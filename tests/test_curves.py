"""Areas under exact curves against a plain walk over all thresholds."""

import random

import numpy as np
import pytest

from obsframe.ml import metrics as M
from obsframe.operators import ranking


def slow_areas(scores, events):
    """Area under ROC by pairs, and under precision against recall by trapezoids."""
    pos, neg = scores[events == 1], scores[events == 0]
    roc = np.mean([(a > neg).mean() + (a == neg).mean() / 2 for a in pos]) if len(pos) and len(neg) else None
    points = []
    for t in sorted(set(scores), reverse=True):
        called = scores >= t
        points.append((events[called].sum() / len(pos), events[called].mean()))
    return roc, sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(600):
        label = rng.choice("aabc")
        raw = [rng.random() + 0.6 * (v == label) for v in "abc"]
        p = [round(x / sum(raw), 2) for x in raw]
        rows.append((label, *p, "abc"[int(np.argmax(p))]))
    rows += [(None, 0.2, 0.3, 0.5, "a"), ("b", None, 0.9, 0.1, "b")]
    return spark.createDataFrame(rows, "kind string, pa double, pb double, pc double, told string").cache()


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_curves(scored, limit):
    got = {r["level"]: r for r in M.class_curves(scored, "kind", {"a": "pa", "b": "pb", "c": "pc"}, direct_limit=limit).collect()}
    rows = scored.where("kind IS NOT NULL").toPandas()
    for v in "abc":
        own = rows[rows[f"p{v}"].notna()]
        roc, pr = slow_areas(own[f"p{v}"].to_numpy(), (own["kind"] == v).to_numpy(int))
        assert np.isclose(got[v]["roc"], roc) and np.isclose(got[v]["pr"], pr) and got[v]["events"] == (own["kind"] == v).sum()


def test_multi_class(scored):
    whole = scored.dropna()
    row = M.multi_class_metrics(whole, "kind", "told", {"a": "pa", "b": "pb", "c": "pc"}).first()
    rows = whole.toPandas()
    p = [max(r[f"p{r['kind']}"], 1e-15) for _, r in rows.iterrows()]
    assert np.isclose(row["log_loss"], -np.log(p).mean())
    areas = [slow_areas(rows[f"p{v}"].to_numpy(), (rows["kind"] == v).to_numpy(int)) for v in "abc"]
    assert np.isclose(row["auc"], np.mean([a for a, _ in areas])) and np.isclose(row["pr_auc"], np.mean([b for _, b in areas]))
    right = [((rows["told"] == v) & (rows["kind"] == v)).sum() for v in "abc"]
    assert np.isclose(row["mean_npv"], np.mean([((rows["told"] != v) & (rows["kind"] != v)).sum() / (rows["told"] != v).sum() for v in "abc"]))
    assert np.isclose(row["mean_detection"], np.mean(right) / len(rows)) and np.isclose(row["mean_balanced"], (row["mean_sens"] + row["mean_spec"]) / 2)


def test_one_class_and_no_rows(spark, scored):
    only = M.class_curves(scored.where("kind = 'a'"), "kind", {"a": "pa", "b": "pb"}).collect()
    assert [(r["level"], r["roc"]) for r in only] == [("a", None)]
    assert M.class_curves(scored.limit(0), "kind", {"a": "pa"}).count() == 0
    two = spark.createDataFrame([(1, 0.9, 1), (0, 0.8, 1), (1, 0.7, 0), (0, 0.1, 0)], "y int, p double, told int")
    row = M.precision_recall(two, "y", "told", "p").first()
    assert row["precision"] == row["recall"] == 0.5 and np.isclose(row["pr_auc"], slow_areas(np.array([0.9, 0.8, 0.7, 0.1]), np.array([1, 0, 1, 0]))[1])


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_weighted_ranks_are_those_of_copied_rows(spark, limit):
    rng = random.Random(2)
    rows = [(g, float(v), rng.randrange(1, 5)) for g in "xy" for v in range(60) if rng.random() < 0.9]
    counted = spark.createDataFrame(rows, "g string, v double, n long")
    copied = spark.createDataFrame([(g, v) for g, v, n in rows for _ in range(n)], "g string, v double")
    a = ranking.weighted_ranks(counted, ["g"], "v", "n", limit).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, ranking.value_ranks(copied, ["g"], "v").collect()))
