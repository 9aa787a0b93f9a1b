import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from obsframe.functions import scalar as S
from obsframe.functions.aggregates import skew_adjusted
from obsframe.operators import baseline as B
from obsframe.operators import quality as Q
from obsframe.operators import rainfall as R
from obsframe.operators.relational import complete_months, pooled_mean, rolling_sums, splice

OBS = "zone string, station string, date date, value double, measurement_days int, source string"


def obs(spark, rows):
    return spark.createDataFrame([("AUS", s, dt.date.fromisoformat(d), v, 1, "src") for s, d, v in rows], OBS)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_dates(spark):
    assert one(spark, S.safe_date(F.lit(2001), F.lit(2), F.lit(30))) is None
    assert one(spark, S.safe_date(F.lit(2000), F.lit(2), F.lit(29))) == dt.date(2000, 2, 29)
    assert one(spark, S.century_date(F.lit("781116"))) == dt.date(1978, 11, 16)
    assert one(spark, S.century_date(F.lit("031001"))) == dt.date(2003, 10, 1)
    assert one(spark, S.mid_date(F.lit(dt.date(2000, 1, 1)), F.lit(dt.date(2000, 1, 4)))) == dt.date(2000, 1, 2)


def test_lenient_casts(spark):
    assert one(spark, S.to_double(F.lit("*****"))) is None
    assert one(spark, S.to_double(F.lit(" -.18 "))) == -0.18
    assert one(spark, S.lenient_number(F.lit(" 11.3 mm"))) == 11.3
    assert one(spark, S.percent(F.lit(1), F.lit(0))) is None


def test_skew_type_three(spark):
    x = [1.0, 2.0, 2.5, 9.0, 4.0]
    n, mean = len(x), sum(x) / len(x)
    sd = math.sqrt(sum((v - mean) ** 2 for v in x) / (n - 1))
    want = sum((v - mean) ** 3 for v in x) / n / sd ** 3
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert df.agg(skew_adjusted("x")).first()[0] == pytest.approx(want)
    assert spark.createDataFrame([(1.0,), (1.0,)], "x double").agg(skew_adjusted("x")).first()[0] is None


def test_splice_keeps_each_year_once(spark):
    old = spark.createDataFrame([(1958, 1.0, 5.0), (1959, 2.0, 6.0)], "year int, co2 double, extra double")
    new = spark.createDataFrame([(1959, 20.0), (1960, 30.0)], "year int, co2 double")
    got = {r["year"]: (r["co2"], r["extra"]) for r in splice(old, new, "year").collect()}
    assert got == {1958: (1.0, 5.0), 1959: (20.0, None), 1960: (30.0, None)}


def test_complete_months_fills_whole_years(spark):
    df = spark.createDataFrame([("a", 2000, 3, 1.0), ("a", 2002, 11, 2.0), ("b", 1999, 12, 3.0)], "s string, y int, m int, v double")
    out = complete_months(df, ["s"], "y", "m").collect()
    cells = {(r["s"], r["y"], r["m"]): r["v"] for r in out}
    assert len(out) == len(cells) == 36 + 12
    assert {k: v for k, v in cells.items() if v is not None} == {("a", 2000, 3): 1.0, ("a", 2002, 11): 2.0, ("b", 1999, 12): 3.0}


def test_rolling_sums_do_not_cross_stations(spark):
    rows = [(s, i, float(i)) for s in ("a", "b") for i in range(1, 5)] + [("c", i, None if i == 2 else 1.0) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "s string, i int, v double")
    got = {(r["s"], r["i"]): r["v_l3"] for r in rolling_sums(df, ["s"], ["i"], "v", (3,)).collect()}
    assert [got["a", i] for i in range(1, 5)] == [got["b", i] for i in range(1, 5)] == [None, None, 6.0, 9.0]
    assert all(got["c", i] is None for i in range(1, 5))


def test_monthly_chain_imputes_with_month_median(spark):
    rows = [("a", f"{y}-{m:02d}-01", float(10 * m + y - 2000)) for y in (2000, 2001, 2002) for m in range(1, 13) if (y, m) != (2001, 5)]
    months = R.monthly_observations(obs(spark, rows)).collect()
    gap = next(r for r in months if (r["major_period"], r["minor_period"]) == (2001, 5))
    assert len(months) == 36 and gap["rainfall_original"] is None and gap["rainfall"] == 51.0
    twelve = {(r["major_period"], r["minor_period"]): r for r in months}
    assert twelve[2000, 12]["rainfall_l12"] == sum(twelve[2000, m]["rainfall"] for m in range(1, 13))
    assert twelve[2000, 11]["rainfall_l12"] is None


def test_all_null_month_sums_to_zero(spark):
    got = R.monthly_totals(obs(spark, [("a", "2000-01-01", None), ("a", "2000-01-02", None)])).first()
    assert got["rainfall"] == 0.0


@pytest.fixture(scope="module")
def arid(spark):
    """A dry station: most Januaries are 0, so several breaks are equal."""
    rows = [("dry", f"{1990 + i}-{m:02d}-01", 0.0 if i < 8 else float(i)) for i in range(11) for m in range(1, 13)]
    rows += [("wet", f"{1990 + i}-{m:02d}-01", float(100 + i)) for i in range(11) for m in range(1, 13)]
    return R.monthly_observations(obs(spark, rows))


def test_one_pass_rating_equals_joined(arid):
    base = R.rain_baselines(arid, 1990, 2000)
    order = ["station", "major_period", "minor_period"]
    joined = [tuple(r) for r in R.rain_ratings(arid, base).orderBy(*order).collect()]
    assert joined == [tuple(r) for r in R.rate_months(arid, 1990, 2000).orderBy(*order).collect()]


def test_rating_range_and_edges(arid):
    rows = R.rate_months(arid, 1990, 2000).collect()
    assert all(-5 <= r["rainfall_rating"] <= 5 for r in rows)
    wet = {r["major_period"]: r["rainfall_rating"] for r in rows if r["station"] == "wet" and r["minor_period"] == 1}
    assert [wet[y] for y in range(1990, 2001)] == list(range(-5, 6))
    dry = {r["major_period"]: r["rainfall_rating"] for r in rows if r["station"] == "dry" and r["minor_period"] == 1}
    assert dry[1990] == dry[1997] > -5 and dry[2000] == 5
    assert all(r["rainfall_l24_rating"] is None for r in rows if r["major_period"] == 1990)


def test_baseline_anomaly_averages_to_zero(spark):
    rows = [("a", f"{y}-{m:02d}-{d:02d}", float((y * 7 + m * 3 + d * d) % 13)) for y in (1996, 1997, 1998) for m in (1, 2) for d in range(1, 20)]
    o = obs(spark, rows)
    info = B.temperature_valuation(baseline_start=1996, baseline_end=1998, minor_period=B.month_period)
    values = B.valuations(o, info, B.baselines(o, info))
    for r in values.groupBy("minor_period").agg(F.avg("value_anomaly").alias("a")).collect():
        assert abs(r["a"]) < 1e-9
    rain = B.rainfall_valuation(baseline_start=1996, baseline_end=1998)
    spread = B.valuations(o, rain, B.baselines(o, rain)).groupBy("minor_period").agg(F.stddev("value_anomaly").alias("s"))
    assert all(r["s"] == pytest.approx(1.0) for r in spread.collect())


def test_leap_day_without_baseline(spark):
    o = obs(spark, [("a", "1997-12-31", 1.0), ("a", "1996-01-01", 2.0), ("a", "2000-12-31", 3.0)])
    info = B.temperature_valuation(baseline_start=1997, baseline_end=1998)
    last = B.valuations(o, info, B.baselines(o, info)).where("major_period = 2000").first()
    assert last["minor_period"] == 366 and last["value_anomaly"] is None
    smooth = B.smoothed_anomalies(o, "value", B.smoothed_baselines(o, "value", 1997, 1998))
    assert smooth.where("doy = 366").count() == 0


def test_pooled_mean_reads_rows_outside_the_window(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(1, 6)], "s string, i int, v double")
    out = pooled_mean(df, ["s"], ["i"], "v", ["s", "i"], F.col("i") == 3, 1, "m").collect()
    assert [(r["i"], r["m"]) for r in out] == [(3, 3.0)]


def test_quality_rules(spark):
    stations = spark.createDataFrame(
        [("AUS", "a", "A", -30.0, 140.0), ("AUS", "b", "B", -30.0, 100.0), ("AUS", "c", "C", -30.0, 140.0),
         ("AUS", "d", "D1", -30.0, 140.0), ("AUS", "d", "D2", -31.0, 140.0)],
        "zone string, station string, name string, latitude double, longitude double",
    )
    days = [(s, f"{y}-01-{d:02d}", 1.0) for s in ("a", "b", "d") for y in (2000, 2001, 2002) for d in range(1, 11)]
    o = obs(spark, days)
    status = {r["station"]: (r["status"], r["n"]) for r in Q.observation_summary(stations, o, "value").collect()}
    assert status == {"a": ("Good", 30), "b": ("Good", 30), "c": ("Data Missing", 0), "d": ("Duplicate", 0)}
    info = Q.CleanInfo("t", yearly_n_target=9, yearly_present_target=9, clean_years_target=2)
    clean = {r["station"]: r["clean"] for r in Q.clean_summary(stations, Q.yearly_counts(o, "value"), info).collect()}
    assert clean == {"a": True, "b": False, "c": False, "d": False}
    strict = Q.CleanInfo("t", yearly_n_target=9, yearly_present_target=9, clean_years_target=3)
    assert Q.clean_summary(stations, Q.yearly_counts(o, "value"), strict).where("clean").count() == 0
    picked = Q.baseline_stations(stations.where("station = 'a'"), o, "value", info, 2000, 2002).collect()
    assert [(r["station"], r["n_years"]) for r in picked] == [("a", 3)]


def test_single_row_summary(spark):
    got = Q.yearly_summary(obs(spark, [("a", "2000-01-01", 0.0)]), "value").first()
    assert (got["n"], got["n_zero"], got["sd"], got["skew"]) == (1, 1, None, None)


def test_max_dissimilarity_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.normal(size=(60, 3))
    df = spark.createDataFrame([("AUS", f"s{i}", *map(float, v)) for i, v in enumerate(data)], "zone string, station string, a double, b double, c double")
    out = Q.max_dissimilarity(df, ["zone", "station"], ["a", "b", "c"], start=3, more=6, seed=5).orderBy("step").collect()
    z = (data - data.mean(0)) / data.std(0, ddof=1)
    chosen = [int(r["station"][1:]) for r in out[:3]]
    for r in out[3:]:
        gap = np.min(np.linalg.norm(z[:, None] - z[chosen], axis=2), axis=1)
        assert int(r["station"][1:]) == int(gap.argmax()) and r["min_distance"] == pytest.approx(gap.max())
        chosen.append(int(gap.argmax()))
