"""A value beside a break of its station."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.operators import rainfall


def test_a_value_beside_a_break_is_rated_as_in_sql(spark):
    """170 + (247 - 170) * 3 / 11 is 191, but the SQL's break lies one bit above it."""
    totals = [(1995, 191.0), (1996, 247.0), (1997, 170.0), (1998, 100.0), (1999, 67.0), (2000, 159.0)]
    rows = [("Z", "1", y, 5, v, None, None, None, "N") for y, v in totals]
    months = spark.createDataFrame(
        rows, "zone string, station string, major_period int, minor_period int, rainfall double, rainfall_l3 double, "
        "rainfall_l12 double, rainfall_l24 double, rainfall_source string",
    ).withColumn("date", F.make_date("major_period", "minor_period", F.lit(1)))
    at_once = rainfall.rate_months(months, 1996, 2000)
    joined = rainfall.rain_ratings(months, rainfall.rain_baselines(months, 1996, 2000))
    for rated in (at_once, joined):
        assert rated.where("major_period = 1995").first()["rainfall_rating"] == 3
