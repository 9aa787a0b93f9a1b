"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.functions.aggregates import (
    agg_columns, open_breaks, quantile_breaks, skew_adjusted, sum_or_zero, variable_summary,
)
from obsframe.functions.scalar import in_years, mid_date
from obsframe.operators import quality, ranking
from obsframe.operators.relational import pooled_mean
from obsframe.plans.binding import (
    BASE_END, BASE_START, KEYS, OBS, READ, name_stations, observations, readings, station_days, table,
)
from obsframe.plans.registry import query


@query("agg_mean", f"""WITH {READ} SELECT station, round(avg(value),6) AS mean_value FROM readings GROUP BY station""")
def mean(spark, sf):
    return readings(spark, sf).groupBy("station").agg(F.round(F.avg("value"), 6).alias("mean_value"))


@query("agg_sum", f"""WITH {READ} SELECT station, date, coalesce(sum(value),0.0) AS total FROM readings GROUP BY ALL""")
def total(spark, sf):
    return readings(spark, sf).groupBy("station", "date").agg(sum_or_zero("value").alias("total"))


@query("agg_count", f"""WITH {READ} SELECT station, CAST(year(date) AS INTEGER) AS year, count(*) AS n FROM readings GROUP BY ALL""")
def count(spark, sf):
    return readings(spark, sf).groupBy("station", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_count_null", f"""WITH {READ} SELECT station, count(*) AS n, count(*) FILTER (value IS NULL) AS n_na FROM readings GROUP BY station""")
def count_null(spark, sf):
    s = variable_summary("value")
    return readings(spark, sf).groupBy("station").agg(*agg_columns({k: s[k] for k in ("n", "n_na")}))


@query("agg_count_present", f"""WITH {READ} SELECT station, count(value) AS n_present FROM readings GROUP BY station""")
def present(spark, sf):
    return readings(spark, sf).groupBy("station").agg(F.count("value").alias("n_present"))


@query("agg_count_zero", f"""WITH {READ} SELECT station, count(*) FILTER (value = 0) AS n_zero FROM readings GROUP BY station""")
def count_zero(spark, sf):
    return readings(spark, sf).groupBy("station").agg(F.count_if(F.col("value") == 0).alias("n_zero"))


@query("agg_count_nonzero", f"""WITH {READ} SELECT station, count(*) FILTER (value <> 0) AS n_nonzero FROM readings GROUP BY station""")
def count_nonzero(spark, sf):
    return readings(spark, sf).groupBy("station").agg(F.count_if(F.col("value") != 0).alias("n_nonzero"))


@query("agg_count_flag", f"""WITH {READ}, y AS (SELECT station, CAST(year(date) AS INTEGER) AS year, count(value) > 70 AS year_clean FROM readings GROUP BY ALL)
SELECT station, count(*) FILTER (year_clean) AS clean_years FROM y GROUP BY station""")
def count_flag(spark, sf):
    yearly = readings(spark, sf).groupBy("station", F.year("date").alias("year")).agg(
        (F.count("value") > 70).alias("year_clean")
    )
    return yearly.groupBy("station").agg(F.count_if("year_clean").alias("clean_years"))


@query("agg_count_distinct", f"""WITH {READ} SELECT CAST(year(date) AS INTEGER) AS year, count(DISTINCT station) AS n_stations FROM readings GROUP BY 1""")
def count_distinct(spark, sf):
    return readings(spark, sf).groupBy(F.year("date").alias("year")).agg(F.countDistinct("station").alias("n_stations"))


@query("agg_min_max", f"""WITH {READ} SELECT station, min(value) AS min_value, max(value) AS max_value, min(date) AS min_date,
 max(date) AS max_date FROM readings GROUP BY station""")
def min_max(spark, sf):
    return readings(spark, sf).groupBy("station").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.min("date").alias("min_date"), F.max("date").alias("max_date"),
    )


@query("agg_sd", f"""WITH {READ} SELECT station, CAST(year(date) AS INTEGER) AS year, round(stddev_samp(value),6) AS sd FROM readings GROUP BY ALL""")
def sd(spark, sf):
    return readings(spark, sf).groupBy("station", F.year("date").alias("year")).agg(
        F.round(F.stddev("value"), 6).alias("sd")
    )


@query("agg_median", """SELECT l_returnflag, round(median(l_extendedprice),4) AS median_price FROM lineitem GROUP BY 1""")
def median(spark, sf):
    out = ranking.quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"median_price": 0.5})
    return out.withColumn("median_price", F.round("median_price", 4))


@query("agg_quantile", """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice,0.25),4) AS first_q,
 round(quantile_cont(l_extendedprice,0.75),4) AS third_q FROM lineitem GROUP BY ALL""")
def quantile(spark, sf):
    out = ranking.quantiles(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice",
        {"first_q": 0.25, "third_q": 0.75},
    )
    return out.withColumns({c: F.round(c, 4) for c in ("first_q", "third_q")})


MONTHLY = """monthly AS (SELECT zone, station, year, month, coalesce(sum(value),0.0) AS total FROM obs GROUP BY ALL)"""


def monthly_totals(spark, sf):
    return observations(spark, sf).groupBy(*KEYS, F.year("date").alias("year"), F.month("date").alias("month")).agg(
        sum_or_zero("value").alias("total")
    )


@query("agg_quantile_vector", f"""WITH {OBS}, {MONTHLY}, b AS (SELECT zone, station, month,
 quantile_cont(total, [i/11.0::DOUBLE FOR i IN range(0,12)]) AS br FROM monthly GROUP BY ALL)
SELECT zone, station, month, CAST(i AS INTEGER) AS pos, round(br[i+1],6) AS break_value FROM b, (SELECT unnest(range(0,12)) AS i)""")
def quantile_vector(spark, sf):
    b = monthly_totals(spark, sf).groupBy(*KEYS, "month").agg(quantile_breaks("total", 11).alias("br"))
    return b.select(*KEYS, "month", F.posexplode("br").alias("pos", "break_value")).withColumn(
        "break_value", F.round("break_value", 6)
    )


@query("agg_open_quantile", f"""WITH {OBS}, {MONTHLY}, b AS (SELECT zone, station, month,
 quantile_cont(total, [i/11.0::DOUBLE FOR i IN range(0,12)]) AS br FROM monthly GROUP BY ALL)
SELECT zone, station, month, CAST(i AS INTEGER) AS pos, CASE WHEN i=0 THEN 0.0 WHEN i=11 THEN 'inf'::DOUBLE ELSE round(br[i+1],6) END AS break_value
FROM b, (SELECT unnest(range(0,12)) AS i)""")
def open_quantile(spark, sf):
    b = monthly_totals(spark, sf).groupBy(*KEYS, "month").agg(open_breaks(quantile_breaks("total", 11), 11).alias("br"))
    return b.select(*KEYS, "month", F.posexplode("br").alias("pos", "break_value")).withColumn(
        "break_value", F.when(F.col("pos") == 11, F.col("break_value")).otherwise(F.round("break_value", 6))
    )


@query("agg_iqr", """SELECT o_orderstatus, round(quantile_cont(o_totalprice,0.75)-quantile_cont(o_totalprice,0.25),4) AS iqr FROM orders GROUP BY 1""")
def iqr(spark, sf):
    q = ranking.quantiles(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", {"q1": 0.25, "q3": 0.75})
    return q.select("o_orderstatus", F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"))


@query("agg_skew", f"""WITH {READ}, m AS (SELECT station, avg(value) AS mu, stddev_samp(value) AS sd FROM readings GROUP BY station)
SELECT r.station, round(avg(power(value-mu,3))/power(any_value(sd),3),6) AS skew FROM readings r JOIN m ON r.station=m.station GROUP BY r.station""")
def skew(spark, sf):
    return readings(spark, sf).groupBy("station").agg(F.round(skew_adjusted("value"), 6).alias("skew"))


NZV = """cells AS (SELECT l_linestatus, l_discount, count(*) AS n FROM lineitem GROUP BY ALL)"""


@query("agg_near_zero_var", f"""WITH {READ}, c AS (SELECT station, value, count(*) n FROM readings GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY n DESC, value) rn FROM c WHERE value IS NOT NULL),
t AS (SELECT station, sum(n) AS rows, count(value) AS distinct_n FROM c GROUP BY station),
u AS (SELECT station, max(n) FILTER (rn=1) AS t1, max(n) FILTER (rn=2) AS t2 FROM r GROUP BY station)
SELECT t.station, round(CASE WHEN distinct_n<=1 THEN 0.0 ELSE t1/t2::DOUBLE END,6) AS freq_ratio,
 round(distinct_n*100.0/rows::DOUBLE,6) AS percent_unique,
 distinct_n<=1 OR (t1/t2::DOUBLE > 19 AND distinct_n*100.0/rows <= 10) AS near_zero_var
FROM t LEFT JOIN u ON t.station=u.station""")
def near_zero_var(spark, sf):
    out = ranking.near_zero_variance(readings(spark, sf), ["station"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("freq_ratio", "percent_unique")})


@query("agg_mode", f"""WITH {READ}, c AS (SELECT station, value, count(*) AS n FROM readings WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY n DESC, value) rn FROM c)
SELECT station, value AS mode, n AS mode_n FROM r WHERE rn=1""")
def mode(spark, sf):
    return ranking.mode(readings(spark, sf), ["station"], "value")


@query("agg_first", f"""WITH {OBS} SELECT zone, station, arg_min(source, date) AS first_source, min(date) AS first_date FROM obs GROUP BY ALL""")
def first(spark, sf):
    return observations(spark, sf).groupBy(*KEYS).agg(
        F.min_by("source", "date").alias("first_source"), F.min("date").alias("first_date")
    )


@query("agg_mid_date", f"""WITH {READ} SELECT station, CAST(year(date) AS INTEGER) AS year,
 DATE '1970-01-01' + CAST(floor((date_diff('day', DATE '1970-01-01', min(date)) + date_diff('day', DATE '1970-01-01', max(date)))/2.0) AS INTEGER) AS median_date
FROM readings GROUP BY ALL""")
def mid(spark, sf):
    return readings(spark, sf).groupBy("station", F.year("date").alias("year")).agg(
        mid_date(F.min("date"), F.max("date")).alias("median_date")
    )


@query("agg_pooled_mean", f"""WITH {OBS}, f AS (SELECT zone, station, date, year, CAST(dayofyear(date) AS INTEGER) AS doy,
 sum(value) OVER w AS s, count(value) OVER w AS c FROM obs WINDOW w AS (PARTITION BY zone, station ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT zone, station, doy, round(sum(s)/sum(c),6) AS baseline FROM f WHERE year BETWEEN 1996 AND 1998 GROUP BY ALL""")
def pooled(spark, sf):
    obs = observations(spark, sf).withColumn("doy", F.dayofyear("date"))
    keep = in_years("date", BASE_START, BASE_END)
    out = pooled_mean(obs, KEYS, ["date"], "value", [*KEYS, "doy"], keep, 5, "baseline")
    return out.withColumn("baseline", F.round("baseline", 6))


GRAIN_SUMS = """count(*) AS n, count(*) FILTER (value IS NULL) AS n_na, count(value) AS n_present,
 count(*) FILTER (value=0) AS n_zero, count(*) FILTER (value<>0) AS n_nonzero, min(value) AS min, round(avg(value),6) AS mean,
 median(value) AS median, max(value) AS max, quantile_cont(value,0.25) AS first_q, quantile_cont(value,0.75) AS third_q,
 round(stddev_samp(value),6) AS sd,
 CASE WHEN stddev_samp(value) > 0 THEN round((sum(value*value*value)/count(value) - 3*avg(value)*sum(value*value)/count(value) + 2*power(avg(value),3))/power(stddev_samp(value),3),5) END AS skew"""


@query("agg_multigrain", f"""WITH {OBS}, d AS (SELECT *, CAST(floor(year/10)*10 AS INTEGER) AS decade FROM obs)
SELECT CASE WHEN grouping(decade)=0 THEN 'decadal' WHEN grouping(year)=0 THEN 'yearly' ELSE 'all' END AS grain, zone, station, decade, year, {GRAIN_SUMS}
FROM d GROUP BY GROUPING SETS ((zone, station), (zone, station, decade), (zone, station, year))""")
def multigrain(spark, sf):
    summary = quality.grain_summary(station_days(spark, sf), "value", keys=["l_suppkey"])
    return name_stations(spark, sf, summary).withColumns(
        {"mean": F.round("mean", 6), "sd": F.round("sd", 6), "skew": F.round("skew", 5)}
    )


@query("agg_filter_after", f"""WITH {READ} SELECT station, count(value) AS n_days FROM readings
WHERE year(date) BETWEEN 1996 AND 1998 GROUP BY station HAVING count(value) >= 210""")
def filter_after(spark, sf):
    return (
        readings(spark, sf).where(in_years("date", BASE_START, BASE_END))
        .groupBy("station").agg(F.count("value").alias("n_days")).where("n_days >= 210")
    )


@query("agg_nest", f"""WITH {READ}, y AS (SELECT station, CAST(year(date) AS INTEGER) AS year, count(*) AS n, max(value) AS top FROM readings GROUP BY ALL)
SELECT station, CAST(count(*) AS INTEGER) AS n_nested, string_agg(year || ':' || n, ',' ORDER BY year) AS years FROM y GROUP BY station""")
def nest(spark, sf):
    """One nested row per calendar year, so the list is bounded by the length of the record."""
    nested = quality.nested_years(readings(spark, sf), ["station"], "value")
    return nested.select(
        "station", F.size("yearly").alias("n_nested"),
        F.array_join(F.transform("yearly", lambda y: F.concat_ws(":", y["year"], y["n"])), ",").alias("years"),
    )


@query("agg_unnest", f"""WITH {READ} SELECT station, CAST(year(date) AS INTEGER) AS year, count(*) AS n, max(value) AS top FROM readings GROUP BY ALL""")
def unnest(spark, sf):
    return quality.nested_years(readings(spark, sf), ["station"], "value").select("station", F.inline("yearly"))


@query("agg_dynamic", f"""WITH {OBS} SELECT zone, count(*) AS rain_n, count(*) FILTER (value IS NULL) AS rain_n_na, count(value) AS rain_n_present,
 count(*) FILTER (value=0) AS rain_n_zero, count(*) FILTER (value<>0) AS rain_n_nonzero, min(value) AS rain_min, round(avg(value),6) AS rain_mean,
 max(value) AS rain_max, round(stddev_samp(value),6) AS rain_sd, round(quantile_cont(value,0.25),6) AS rain_first_q, round(median(value),6) AS rain_median,
 round(quantile_cont(value,0.75),6) AS rain_third_q, round((SELECT avg(power(b.value-m.mu,3))/power(m.sd,3) FROM obs b WHERE b.zone=obs.zone),6) AS rain_skew
FROM obs JOIN (SELECT zone AS mzone, avg(value) AS mu, stddev_samp(value) AS sd FROM obs GROUP BY 1) m ON mzone=zone GROUP BY zone, mu, sd""")
def dynamic(spark, sf):
    named = variable_summary("value", prefix="rain")
    quarters = {"rain_first_q": 0.25, "rain_median": 0.5, "rain_third_q": 0.75}
    for name in quarters:  # a zone is too large for one buffer
        named.pop(name)
    obs = observations(spark, sf)
    out = obs.groupBy("zone").agg(*agg_columns(named)).join(ranking.quantiles(obs, ["zone"], "value", quarters), "zone")
    return out.withColumns({c: F.round(c, 6) for c in ("rain_mean", "rain_sd", "rain_skew", *quarters)})
