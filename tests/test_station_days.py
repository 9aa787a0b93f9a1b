"""Readings dealt by station: as many tasks as they need, one shuffle for all grains, and the same days as `observations`."""

from __future__ import annotations

import datetime

import pytest

from obsframe.operators import quality
from obsframe.plans import binding, catalog

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grains_shuffle_the_readings_once(spark):
    assert _plan(catalog.queries()["agg_multigrain"](spark, SF)).count("Exchange hashpartitioning") == 1


def test_tasks_grow_with_the_readings(spark):
    readings = binding.table(spark, SF, "lineitem").count()
    days = binding.station_days(spark, SF, task_readings=100)
    parts = -(-readings // 100)
    assert f", {parts}), REPARTITION_BY_NUM" in _plan(days)
    summary = quality.grain_summary(days, "value", keys=["l_suppkey"])
    assert _plan(summary).count("Exchange hashpartitioning") == 1


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A busy station, one of NULLs only, rows without station or date, and a station that no list holds."""
    sf = str(tmp_path_factory.mktemp("odd"))
    for name in ("nation", "region", "supplier"):
        binding.table(spark, SF, name).write.parquet(f"{sf}/{name}.parquet")
    day = datetime.datetime(1996, 1, 1)
    rows = [(1, 1 + i % 3, float(i % 50), "A", day + datetime.timedelta(days=i % 40)) for i in range(3000)]
    rows += [(2, 7, 5.0, "N", day), (2, 7, 6.0, "R", day + datetime.timedelta(days=900))]
    rows += [(None, 1, 9.0, "A", day), (3, 1, 9.0, "A", None), (3, 2, 8.0, "N", None), (3, 2, 8.5, "N", day), (999, 1, 9.0, "A", day)]
    columns = ["l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in binding.table(spark, SF, "lineitem").select(*columns).schema)
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/lineitem.parquet")
    return sf


@pytest.mark.parametrize("busy", [2_000_000, 1000, 0])
def test_days_equal_those_of_observations(spark, odd, busy):
    days = binding.name_stations(spark, odd, binding.station_days(spark, odd, 10, busy))
    want = binding.observations(spark, odd).select(*days.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, days.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) != []


def test_grains_of_dealt_rows_equal_those_of_observations(spark, odd):
    dealt = quality.grain_summary(binding.station_days(spark, odd, 10, 1000), "value", keys=["l_suppkey"])
    dealt = binding.name_stations(spark, odd, dealt)
    want = quality.grain_summary(binding.observations(spark, odd), "value").select(*dealt.columns)
    key = lambda r: tuple(str(x) for x in r[:5])
    for a, b in zip(sorted(dealt.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, rel=1e-9) if isinstance(y, float) else y)


def test_no_readings(spark, tmp_path):
    sf = str(tmp_path)
    binding.table(spark, SF, "lineitem").where("false").write.parquet(f"{sf}/lineitem.parquet")
    assert binding.station_days(spark, sf).count() == 0
