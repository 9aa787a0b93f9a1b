"""Cases found in review: results that must not depend on size, on neighbours, or on damaged input."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.ml import algorithms as A
from obsframe.ml import experiment as E
from obsframe.ml import prepare as P
from obsframe.ml import resample as S
from obsframe.operators import mars, quality, ranking, stats
from obsframe.sources import archives, html


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 40, 600).astype(float)
    z = np.where(rng.random(600) < 0.15, rng.normal(0, 1, 600), np.nan)
    y = np.where(x < 20, 1.0, 5.0) + rng.normal(0, 0.1, 600)
    data = [(i, float(a), None if np.isnan(b) else float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))]
    return spark.createDataFrame(data, "id long, x double, z double, y double")


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_a_task_is_the_same_alone_and_beside_others(rows):
    tasks = [E.Task("a", "y", ("x",), "lm", {"t": 1}), E.Task("b", "y", ("z",), "lm", {"t": 2}), E.Task("n", "y", (), "null", {"t": 3})]
    together = by_name(E.query_table(rows, tasks, ["id"], S.Scheme("cv", number=4)))
    for t in tasks:
        assert by_name(E.query_table(rows, [t], ["id"], S.Scheme("cv", number=4)))[t.name]["rmse"] == pytest.approx(together[t.name]["rmse"], rel=1e-12)
    assert S.resample_models(rows, {"a": ["x"], "b": ["z"]}, "y", ["id"], S.Scheme("none")).where("model = 'a'").first()["n"] == 600


@pytest.mark.parametrize("method", ["none", "cv", "boot"])
def test_every_algorithm_is_scored_by_itself(rows, method):
    tasks = E.cross(E.Task("m", "y", ("x",)), algorithm=["lm", "null", "rpart"])
    got = by_name(E.query_table(rows, tasks, ["id"], S.Scheme(method, number=3), rpart={"maxDepth": 1, "maxBins": 64}))
    assert got["m_rpart"]["rmse"] < 0.2 < got["m_lm"]["rmse"] < got["m_null"]["rmse"]
    assert {r["resamples"] for r in got.values()} == {1 if method == "none" else 3}


def test_an_unknown_algorithm_is_an_error(rows, spark):
    with pytest.raises(ValueError, match="nonsense"):
        E.query_table(rows, [E.Task("m", "y", ("x",), "nonsense")], ["id"], S.Scheme("cv"))
    long = "x" * 2000

    def fails(task):
        raise RuntimeError(long)

    status = E.run_all(spark, [E.Task("m", "y")], fails)[1].first()
    assert status["messages"] == f"RuntimeError: {long}" and status["errors"] == 1


def test_hinges_use_every_predictor(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0, 10, (2, 500))
    y = np.maximum(0, a - 4) - 2 * np.maximum(0, 6 - b)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, y)], "a double, b double, y double")
    both = A.fit(df, "earth", "regression", ["a", "b"], "y")(df).select(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    one = A.fit(df, "earth", "regression", ["a"], "y")(df).select(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert both < 0.1 < one


@pytest.mark.parametrize("n", [20, 160, 161, 1000])
def test_knots_follow_one_rule(spark, n):
    df = spark.range(n * 3).select((F.col("id") % n).cast("double").alias("x"))
    knots = mars._candidate_knots(df, "x", 160)
    assert knots == pytest.approx(list(np.quantile(np.arange(n), np.linspace(0, 1, min(n, 160)))))


def test_numbers_are_stratified_by_quantiles_whatever_their_count(spark):
    for distinct in (4, 5, 6, 50):
        df = spark.range(400).select("id", (F.col("id") % distinct).cast("double").alias("v"))
        got = P.split(df, "v", ["id"]).where("part = 'train'").count()
        strata = np.digitize(np.arange(400) % distinct, np.quantile(np.arange(400) % distinct, [0.2, 0.4, 0.6, 0.8]), right=True)
        assert got == sum(int(np.ceil(0.8 * c)) for c in np.bincount(strata) if c)
        by_value = P.split(df, "v", ["id"], by="value").where("part = 'train'").count()
        assert by_value == sum(int(np.ceil(0.8 * c)) for c in np.bincount(np.arange(400) % distinct))


def zipped(code, lines):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        body = "\n".join([",".join(archives.heading(archives.RAINFALL)), *[f"IDCJAC0009,{code},2000,01,01,{n % 97}.5,1,Y" for n in range(lines)]])
        z.writestr(archives.RAINFALL.member_of(code), body + "\n")
    return bytearray(out.getvalue())


@pytest.mark.parametrize("lines", [10, 19_999, 20_000, 25_000, 45_000])
def test_long_archives_are_whole_and_damaged_ones_empty(spark, lines):
    good, checksum, stream, cut = (zipped(c, lines) for c in "1234")
    at = checksum.find(b"PK\x01\x02") + 16
    checksum[at : at + 4] = checksum[14:18] = b"\xde\xad\xbe\xef"
    body = 30 + len(archives.RAINFALL.member_of("3"))
    stream[body : body + 3] = b"\xff\xff\xff"
    cut = cut[: len(cut) // 2]
    content = spark.createDataFrame([("1", good), ("2", checksum), ("3", stream), ("4", cut)], "station string, content binary")
    loaded = {r["station"]: r["count"] for r in archives.load_archives(content, archives.RAINFALL, "s").groupBy("station").count().collect()}
    assert loaded == {"1": lines}
    listed = spark.createDataFrame([(c,) for c in "12345"], "station string")
    found = {r["station"]: (r["status"], r["rows"]) for r in archives.validate_archives(listed, content, archives.RAINFALL).collect()}
    assert found == {"1": ("Good", lines), **{c: ("Read Error", 0) for c in "234"}, "5": ("Data Missing", 0)}


def test_a_station_listed_twice_is_not_clean(spark):
    stations = spark.createDataFrame([("A", c, n, 130.0, -20.0) for c, n in (("1", "x"), ("2", "y"), ("2", "z"))], "zone string, station string, name string, longitude double, latitude double")
    obs = spark.range(1000).select(F.lit("A").alias("zone"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("station"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit(1.0).alias("value"))
    info = quality.CleanInfo("t", yearly_n_target=300, yearly_present_target=300, clean_years_target=1)
    got = {r["station"]: (r["data_available"], r["clean"]) for r in quality.clean_summary(stations, quality.yearly_counts(obs, "value"), info).collect()}
    assert got == {"1": (True, True), "2": (False, False)}


def test_loess_counts_rows_at_repeated_positions(spark):
    rng = np.random.default_rng(7)
    x = np.repeat(np.arange(30.0), rng.integers(1, 5, 30))
    y = 10 * np.sin(x / 5) + rng.normal(0, 1, len(x))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {r["x"]: r["fit"] for r in stats.loess(df, [], "x", "y", 0.3, "fit").collect()}
    q = int(np.floor(len(x) * 0.3 + 1e-5))
    for x0 in np.unique(x):
        d = np.abs(x - x0)
        h = np.sort(d)[q - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        basis = np.vstack([np.ones_like(x), x - x0, (x - x0) ** 2]).T * np.sqrt(w)[:, None]
        assert got[x0] == pytest.approx(np.linalg.lstsq(basis, y * np.sqrt(w), rcond=None)[0][0], abs=1e-6)


@pytest.mark.parametrize("t, dof, p", [(0.0, 5, 1.0), (12.706204736, 1, 0.05), (2.570581836, 5, 0.05), (1.959963985, 1e9, 0.05), (1.983971519, 100, 0.05), (63.656741, 1, 0.01)])
def test_t_tail(t, dof, p):
    assert stats.t_two_sided(np.array([t]), np.array([float(dof)]))[0] == pytest.approx(p, abs=2e-6)


def test_links_stay_inside_their_element(spark):
    page = (
        "<a href='/0'>x</a><div><DIV class=c id='b'><div><a href=/1>One</a></div><a title=t HREF = '/2?a=1&amp;b=2'>Two &lt;<i>2</i></a></DIV>"
        '<a href="/3">x</a></div><div id="bb"><a href="/4">x</a></div><a name=n>x</a>'
    )
    df = spark.createDataFrame([(page,), ("<div id=b><a href='/5'>open</a>",), ("nothing",), ("",)], "html string")
    got = [(r["href"], r["text"]) for r in html.find_links(df, "html", [], block="b").collect()]
    assert got == [("/1", "One"), ("/2?a=1&b=2", "Two <2"), ("/5", "open")]
    assert [r["href"] for r in html.find_links(df, "html", [], text="x").collect()] == ["/0", "/3", "/4"]


def test_two_commonest_values_with_ties(spark):
    df = spark.createDataFrame([("a", v) for v in [1, 1, 2, 2, 3]] + [("b", 1)], "k string, v int")
    got = {r["k"]: r["freq_ratio"] for r in ranking.near_zero_variance(df, ["k"], "v").collect()}
    assert got == {"a": 1.0, "b": 0.0}
