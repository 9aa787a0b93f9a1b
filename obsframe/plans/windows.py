"""Window, ordering, set, reshape, sampling and imputation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from obsframe.functions.scalar import hash_key
from obsframe.operators import quality, ranking, relational
from obsframe.plans.aggregations import MONTHLY, monthly_totals
from obsframe.plans.binding import ANNUAL, KEYS, OBS, SOI, STN, annual_orders, monthly_index, observations, stations, table
from obsframe.plans.registry import query


@query("win_lag_lead", f"""WITH {OBS} SELECT zone, station, date, value, lag(value,1) OVER w AS value_lag1, lag(value,2) OVER w AS value_lag2,
 lead(value,1) OVER w AS value_lead1, lead(value,2) OVER w AS value_lead2 FROM obs WINDOW w AS (PARTITION BY zone, station ORDER BY date)""")
def lag_lead(spark, sf):
    obs = observations(spark, sf).select(*KEYS, "date", "value")
    return relational.lag_lead(obs, KEYS, ["date"], "value", 2, 2)


@query("win_lag_param", f"""WITH {SOI} SELECT s.date, s.soi, CAST(l.n_lag AS INTEGER) AS n_lag, p.soi AS soi_lag FROM soi s, (SELECT unnest(range(0,25)) AS n_lag) l
JOIN soi p ON p.date = CAST(s.date - to_months(CAST(n_lag AS INTEGER)) AS DATE)""")
def lag_param(spark, sf):
    series = monthly_index(spark, sf).select("date", "soi")
    return series.join(relational.month_lags(series, "date", "soi", range(25)), "date")


@query("win_rolling_sum", f"""WITH {OBS}, {MONTHLY} SELECT zone, station, year, month, total,
 {", ".join(f"CASE WHEN count(total) OVER w{k} = {k} THEN sum(total) OVER w{k} END AS total_l{k}" for k in (3, 6, 12, 24))}
FROM monthly WINDOW {", ".join(f"w{k} AS (PARTITION BY zone, station ORDER BY year, month ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (3, 6, 12, 24))}""")
def rolling_sum(spark, sf):
    return relational.rolling_sums(monthly_totals(spark, sf), KEYS, ["year", "month"], "total", (3, 6, 12, 24))


@query("win_percent_rank", """SELECT DISTINCT l_returnflag, l_extendedprice, round(100*percent_rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice),6) AS pct
FROM lineitem""")
def percent_rank(spark, sf):
    ranks = ranking.percent_rank(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return ranks.select("l_returnflag", "l_extendedprice", F.round(F.col("percent_rank") * 100, 6).alias("pct"))


@query("win_group_scale", f"""WITH {OBS} SELECT zone, station, date, round((value - avg(value) OVER w)/stddev_samp(value) OVER w, 6) AS value_scaled
FROM obs WINDOW w AS (PARTITION BY zone)""")
def group_scale(spark, sf):
    return relational.group_scaled(observations(spark, sf), ["zone"], ["value"]).select(
        *KEYS, "date", F.round("value_scaled", 6).alias("value_scaled")
    )


@query("win_global_scale", f"""WITH {OBS}, s AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM obs)
SELECT zone, station, date, round((value - mu)/sd, 6) AS value_scaled FROM obs, s""")
def global_scale(spark, sf):
    return relational.scaled(observations(spark, sf), ["value"]).select(
        *KEYS, "date", F.round("value_scaled", 6).alias("value_scaled")
    )


@query("win_first_in_group", f"""WITH {OBS}, {MONTHLY}, b AS (SELECT zone, station, month, quantile_cont(total,[0.0,0.5,1.0]) AS br FROM monthly GROUP BY ALL)
SELECT m.zone, m.station, m.year, m.month, b.br[1] AS first_break, b.br[2] AS mid_break FROM monthly m JOIN b USING (zone, station, month)""")
def first_in_group(spark, sf):
    monthly = monthly_totals(spark, sf)
    breaks = monthly.groupBy(*KEYS, "month").agg(F.percentile("total", F.array(*map(F.lit, (0.0, 0.5, 1.0)))).alias("br"))
    return monthly.join(breaks, [*KEYS, "month"]).select(
        *KEYS, "year", "month", F.col("br")[0].alias("first_break"), F.col("br")[1].alias("mid_break")
    )


@query("win_cumsum", f"""WITH {OBS}, {MONTHLY} SELECT zone, station, year, month, sum(total) OVER
 (PARTITION BY zone, station ORDER BY year, month ROWS UNBOUNDED PRECEDING) AS running_total FROM monthly""")
def cumsum(spark, sf):
    w = Window.partitionBy(*KEYS).orderBy("year", "month").rowsBetween(Window.unboundedPreceding, 0)
    return monthly_totals(spark, sf).select(*KEYS, "year", "month", F.sum("total").over(w).alias("running_total"))


@query("win_row_index", f"""WITH {OBS}, {MONTHLY} SELECT zone, station, year, month, CAST(row_number() OVER (PARTITION BY zone, station ORDER BY year, month) AS INTEGER) AS index FROM monthly""")
def row_index(spark, sf):
    w = Window.partitionBy(*KEYS).orderBy("year", "month")
    return monthly_totals(spark, sf).select(*KEYS, "year", "month", F.row_number().over(w).alias("index"))


@query("srt_order", f"""WITH {OBS}, {MONTHLY} SELECT * FROM monthly ORDER BY zone, station, year, month""")
def order(spark, sf):
    return monthly_totals(spark, sf).orderBy(*KEYS, "year", "month")


@query("lim_slice", f"""WITH {STN} SELECT zone, station, name FROM stations ORDER BY zone, station LIMIT 9""")
def slice_first(spark, sf):
    return stations(spark, sf).select(*KEYS, "name").orderBy(*KEYS).limit(9)


@query("smp_random", f"""WITH {STN} SELECT zone, station, name FROM stations ORDER BY md5(zone || ':' || station || ':99') LIMIT 25""")
def random(spark, sf):
    return ranking.hash_sample(stations(spark, sf).select(*KEYS, "name"), hash_key(99, *KEYS), 25)


@query("smp_max_dissim")
def max_dissim(spark, sf):
    summary = quality.grain_summary(observations(spark, sf), "value", grains=("all",))
    features = ["n", "n_na", "n_zero", "mean", "median", "max", "sd", "skew"]
    return quality.max_dissimilarity(summary.select(*KEYS, *features), KEYS, features, start=5, more=20, seed=101)


@query("set_union_all", f"""WITH {ANNUAL} SELECT year, data_mean_global AS ta_global, NULL::DOUBLE AS ta_nhem, 'early' AS ta_source FROM annual WHERE year < 1998
UNION ALL SELECT year, data_mean_global, data_mean_nh, 'later' FROM annual WHERE year >= 1997""")
def union_all(spark, sf):
    a = annual_orders(spark, sf)
    early = a.where("year < 1998").select("year", F.col("data_mean_global").alias("ta_global"), F.lit("early").alias("ta_source"))
    later = a.where("year >= 1997").select(
        "year", F.col("data_mean_global").alias("ta_global"), F.col("data_mean_nh").alias("ta_nhem"), F.lit("later").alias("ta_source")
    )
    return early.unionByName(later, allowMissingColumns=True)


@query("set_bind_cols", f"""WITH {OBS}, a AS (SELECT zone, station, count(*) AS n, max(value) AS top FROM obs GROUP BY ALL),
b AS (SELECT zone, station, min(year) AS min_year, max(year) AS max_year, count(DISTINCT year) AS n_year FROM obs GROUP BY ALL)
SELECT s.zone, s.station, s.name, a.n, a.top, b.min_year, b.max_year, b.n_year FROM stations s JOIN a USING (zone, station) JOIN b USING (zone, station)""")
def bind_cols(spark, sf):
    """Side-by-side frames are bound by their key; the position of a row means nothing in Spark."""
    obs = observations(spark, sf).withColumn("year", F.year("date"))
    yearly = obs.groupBy(*KEYS, "year").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    both = yearly.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.max("top").alias("top"), F.min("year").alias("min_year"),
        F.max("year").alias("max_year"), F.count(F.lit(1)).alias("n_year"),
    )
    return stations(spark, sf).select(*KEYS, "name").join(both, KEYS)


@query("rsh_gather", f"""WITH {ANNUAL} SELECT year, k AS key, CASE k WHEN 'data_mean_global' THEN data_mean_global WHEN 'data_mean_nh' THEN data_mean_nh ELSE data_mean_sh END AS value
FROM annual, (SELECT unnest(['data_mean_global','data_mean_nh','data_mean_sh']) AS k)""")
def gather(spark, sf):
    df = annual_orders(spark, sf)
    return relational.gather(df, ["year"], [c for c in df.columns if c.startswith("data_mean")], "key", "value")


@query("rsh_spread", f"""WITH {OBS}, {MONTHLY} SELECT zone, station, year, {", ".join(f"max(total) FILTER (month={m}) AS rainfall_{m}" for m in range(1, 13))}
FROM monthly GROUP BY ALL""")
def spread(spark, sf):
    return relational.spread(monthly_totals(spark, sf), [*KEYS, "year"], "month", range(1, 13), "total", "rainfall_")


COMPLETE = f"""{OBS}, {MONTHLY}, span AS (SELECT zone, station, min(year) AS y0, max(year) AS y1 FROM monthly GROUP BY ALL),
yrs AS (SELECT zone, station, CAST(unnest(range(y0, y1+1)) AS INTEGER) AS year FROM span),
grid AS (SELECT zone, station, year, CAST(unnest(range(1,13)) AS INTEGER) AS month FROM yrs),
full_months AS (SELECT g.zone, g.station, g.year, g.month, m.total FROM grid g LEFT JOIN monthly m USING (zone, station, year, month))"""


@query("rsh_complete", f"""WITH {COMPLETE} SELECT * FROM full_months""")
def complete(spark, sf):
    return relational.complete_months(monthly_totals(spark, sf), KEYS, "year", "month")


@query("imp_group_median", f"""WITH {COMPLETE}, med AS (SELECT zone, station, month, median(total) AS median FROM monthly GROUP BY ALL)
SELECT zone, station, year, month, f.total AS total_original, coalesce(f.total, median) AS total FROM full_months f JOIN med USING (zone, station, month)""")
def group_median(spark, sf):
    full = relational.complete_months(monthly_totals(spark, sf), KEYS, "year", "month")
    return relational.impute_group_median(full, [*KEYS, "month"], "total")
