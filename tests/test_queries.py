"""Every registered query against its SQL check on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"
# No row of the smallest tables reaches the limits of these queries.
EMPTY_WHEN_SMALL = {"agg_filter_after", "dom_station_screen", "dom_baseline_stations", "dom_clean_observations"}


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    verdict, rows, _ = compare.run(spark, duck, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert verdict in ("", "rows-only"), verdict
    assert rows > 0 or name in EMPTY_WHEN_SMALL


def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert {"zone", "major_period", "value_anomaly", "n_stations"} == set(df.columns)
    assert df.count() > 0
