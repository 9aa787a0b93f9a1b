"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.functions.aggregates import quantile_breaks
from obsframe.functions.scalar import in_years
from obsframe.operators.relational import find_interval, splice
from obsframe.plans.binding import (
    ANNUAL, KEYS, OBS, PRICES, READ, STN, annual_orders, daily_prices, observations, readings, stations, table,
)
from obsframe.plans.registry import query


def annual_readings(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(
        F.round(F.avg("l_quantity"), 4).alias("co2_global"), F.lit("archive").alias("co2_source")
    )


ANNUAL_READ = """annual_read AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(avg(l_quantity),4) AS co2_global,
 'archive' AS co2_source FROM lineitem GROUP BY 1)"""


@query("join_inner_year", f"""WITH {ANNUAL}, {ANNUAL_READ} SELECT a.year, data_mean_global AS ta_global, co2_global
FROM annual a JOIN annual_read r ON a.year = r.year""")
def inner_year(spark, sf):
    return annual_orders(spark, sf).join(annual_readings(spark, sf), "year").select(
        "year", F.col("data_mean_global").alias("ta_global"), "co2_global"
    )


@query("join_inner_keys", f"""WITH {OBS}, y AS (SELECT zone, station, year, count(*) AS n, sum(value) AS total FROM obs GROUP BY ALL),
c AS (SELECT zone, station, year FROM y WHERE n > 60)
SELECT o.zone, o.station, o.date, o.value, o.year FROM obs o JOIN c ON o.zone=c.zone AND o.station=c.station AND o.year=c.year""")
def inner_keys(spark, sf):
    obs = observations(spark, sf).withColumn("year", F.year("date"))
    clean = obs.groupBy(*KEYS, "year").agg(F.count(F.lit(1)).alias("n")).where("n > 60").drop("n")
    return obs.join(clean, [*KEYS, "year"]).select(*KEYS, "date", "value", "year")


@query("join_inner_date", f"""WITH {PRICES}, d AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
SELECT d.date, price, quantity FROM d JOIN prices p ON d.date=p.date""")
def inner_date(spark, sf):
    shipped = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.sum("l_quantity").alias("quantity")
    )
    return shipped.join(daily_prices(spark, sf), "date").select("date", "price", "quantity")


@query("join_left", f"""WITH {OBS}, b AS (SELECT zone, station, month, avg(value) AS baseline_mean FROM obs
 WHERE year BETWEEN 1996 AND 1996 GROUP BY ALL)
SELECT o.zone, o.station, o.date, o.value, round(b.baseline_mean, 6) AS baseline_mean
FROM obs o LEFT JOIN b ON o.zone=b.zone AND o.station=b.station AND o.month=b.month""")
def left(spark, sf):
    obs = observations(spark, sf).withColumn("month", F.month("date"))
    base = obs.where(in_years("date", 1996, 1996)).groupBy(*KEYS, "month").agg(F.round(F.avg("value"), 6).alias("baseline_mean"))
    return obs.join(base, [*KEYS, "month"], "left").select(*KEYS, "date", "value", "baseline_mean")


@query("join_anti", f"""WITH {ANNUAL} SELECT year, data_mean_global FROM annual
WHERE year NOT IN (SELECT year(l_shipdate) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01')""")
def anti(spark, sf):
    modern = table(spark, sf, "lineitem").where(
        F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")
    ).select(F.year("l_shipdate").alias("year")).distinct()
    return annual_orders(spark, sf).join(modern, "year", "left_anti").select("year", "data_mean_global")


@query("join_semi", f"""WITH {STN}, {READ} SELECT zone, station, name FROM stations
WHERE station IN (SELECT station FROM readings WHERE value >= 50)""")
def semi(spark, sf):
    hit = readings(spark, sf).where(F.col("value") >= 50).select("station")
    return stations(spark, sf).join(hit, "station", "left_semi").select("zone", "station", "name")


@query("join_full", f"""WITH {STN}, a AS (SELECT CAST(c_custkey AS VARCHAR) AS station, c_acctbal AS annual FROM customer)
SELECT coalesce(s.station, a.station) AS station, longitude, latitude, annual
FROM stations s FULL OUTER JOIN a ON s.station = a.station WHERE annual IS NULL OR annual > 0 OR longitude IS NOT NULL""")
def full(spark, sf):
    annual = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("station"), F.col("c_acctbal").alias("annual")
    )
    return (
        stations(spark, sf).select("station", "longitude", "latitude")
        .join(annual, "station", "full")
        .where(F.col("annual").isNull() | (F.col("annual") > 0) | F.col("longitude").isNotNull())
    )


@query("join_cross", """SELECT y.year, m.month, l.n_lag FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) y,
(SELECT CAST(unnest(range(1,13)) AS INTEGER) AS month) m, (SELECT CAST(unnest([0,6,12]) AS INTEGER) AS n_lag) l""")
def cross(spark, sf):
    """Years x months x lags: the fixed lists are generated per row, no cartesian join."""
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    months = years.select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return months.select("year", "month", F.explode(F.array(F.lit(0), F.lit(6), F.lit(12))).alias("n_lag"))


@query("join_range_lookup", f"""WITH {OBS}, m AS (SELECT zone, station, year, month, coalesce(sum(value),0.0) AS total FROM obs GROUP BY ALL),
b AS (SELECT zone, station, month, quantile_cont(total, [0.0,0.25,0.5,0.75,1.0]) AS br FROM m GROUP BY ALL)
SELECT m.zone, m.station, m.year, m.month, m.total, CAST(len(list_filter(b.br, lambda x: x <= m.total)) AS INTEGER) AS bin
FROM m JOIN b ON m.zone=b.zone AND m.station=b.station AND m.month=b.month""")
def range_lookup(spark, sf):
    monthly = observations(spark, sf).groupBy(
        *KEYS, F.year("date").alias("year"), F.month("date").alias("month")
    ).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
    breaks = monthly.groupBy(*KEYS, "month").agg(quantile_breaks("total", 4).alias("br"))
    return monthly.join(breaks, [*KEYS, "month"]).withColumn(
        "bin", find_interval(F.col("total"), F.col("br"))
    ).drop("br")


@query("join_splice", f"""WITH {ANNUAL}, {ANNUAL_READ}, modern AS (SELECT * FROM annual_read WHERE year >= 1998)
SELECT year, data_mean_global AS co2_global, data_mean_nh AS co2_nhem, 'historic' AS co2_source FROM annual
WHERE year NOT IN (SELECT year FROM modern)
UNION ALL SELECT year, co2_global, NULL, co2_source FROM modern""")
def join_splice(spark, sf):
    old = annual_orders(spark, sf).select(
        "year", F.col("data_mean_global").alias("co2_global"), F.col("data_mean_nh").alias("co2_nhem"),
        F.lit("historic").alias("co2_source"),
    )
    new = annual_readings(spark, sf).where(F.col("year") >= 1998)
    return splice(old, new, "year").select("year", "co2_global", "co2_nhem", "co2_source")
