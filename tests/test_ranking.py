import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.functions.scalar import hash_key
from obsframe.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value most of that group; one group is all NULL, one a single row."""
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in np.where(rng.random(4000) < 0.4, 0.0, rng.gamma(1.0, 30.0, 4000))]
    rows += [("hot", None)] * 50 + [("cold", float(v)) for v in rng.normal(0, 1, 37)] + [("one", 5.0), ("none", None), ("none", None)]
    return spark.createDataFrame(rows, "k string, v double"), rows


# All in one task, one cut, two cuts.
LIMITS = [500_000, 200, 20]


def test_limits_reach_every_way(skewed):
    df, _ = skewed
    largest = ranking._distinct_in_largest(df, ["k"], "v")
    assert [ranking._levels(largest, limit) for limit in LIMITS] == [0, 1, 2]


@pytest.mark.parametrize("limit", LIMITS)
def test_quantiles_match_numpy(skewed, limit):
    df, rows = skewed
    probs = {f"q{i}": p for i, p in enumerate([0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0])}
    got = {r["k"]: r for r in ranking.quantiles(df, ["k"], "v", probs, direct_limit=limit).collect()}
    for k in ("hot", "cold", "one"):
        want = np.quantile([v for g, v in rows if g == k and v is not None], list(probs.values()))
        assert [got[k][q] for q in probs] == pytest.approx(list(want), rel=1e-12)
    assert "none" not in got


def test_quantiles_without_keys(skewed):
    df, rows = skewed
    got = ranking.quantiles(df, [], "v", {"a": 0.5, "b": 0.9}).first()
    values = [v for _, v in rows if v is not None]
    assert got["a"] == pytest.approx(np.median(values)) and got["b"] == pytest.approx(np.quantile(values, 0.9))


@pytest.mark.parametrize("limit", LIMITS)
def test_value_ranks_cover_every_row(skewed, limit):
    df, rows = skewed
    ranks = ranking.value_ranks(df, ["k"], "v", direct_limit=limit).where("k = 'hot'").orderBy("v").collect()
    values = sorted(v for g, v in rows if g == "hot" and v is not None)
    assert sum(r["n"] for r in ranks) == len(values) == ranks[0]["total"]
    assert [r["below"] for r in ranks] == [values.index(r["v"]) for r in ranks]


def test_percent_rank_of_single_row_is_zero(skewed):
    df, _ = skewed
    assert ranking.percent_rank(df, ["k"], "v").where("k = 'one'").first()["percent_rank"] == 0.0


def test_hash_rank_numbers_each_group(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, "big").otherwise("small")).withColumn("h", hash_key(3, "id"))
    out = ranking.hash_rank(df, ["g"], "h").collect()
    for g, n in (("big", 4000), ("small", 1000)):
        part = sorted((r["h"], r["position"]) for r in out if r["g"] == g)
        assert [p for _, p in part] == list(range(1, n + 1))
        assert {r["group_n"] for r in out if r["g"] == g} == {n}


def test_mode_tie_gives_smallest(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("a", None), ("a", None), ("a", None)], "k string, v double")
    assert ranking.mode(df, ["k"], "v").first()["mode"] == 1.0


@pytest.mark.parametrize("values, flag", [
    ([1.0] * 10, True), ([None, None], True), ([0.0] * 96 + [1.0] * 5, True), ([0.0] * 90 + [1.0] * 10, False),
    ([0.0] * 50 + [1.0] * 50, False),
])
def test_near_zero_variance(spark, values, flag):
    df = spark.createDataFrame([("s", v) for v in values], "k string, v double")
    assert ranking.near_zero_variance(df, ["k"], "v").first()["near_zero_var"] is flag


def test_first_per_key_keeps_whole_rows(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 5, "z")], "k string, o int, v string")
    got = {r["k"]: (r["o"], r["v"]) for r in ranking.first_per_key(df, ["k"], ["o"]).collect()}
    assert got == {"a": (1, None), "b": (5, "z")}
