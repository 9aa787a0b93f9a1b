"""Rainfall rating, region and lag queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.functions.scalar import hash_fold
from obsframe.ml import lags
from obsframe.ml.resample import Scheme
from obsframe.operators import rainfall as R
from obsframe.operators import regions as G
from obsframe.operators.spatial import grid_interpolate, location_percentile
from obsframe.plans.binding import BASE_END, BASE_START, KEYS, OBS, READ, SOI, STN, monthly_index, observations, readings, stations, table
from obsframe.plans.stations import RAIN, RAINED, VALUED, rounded, valued
from obsframe.plans.registry import query
from obsframe.sources.tables import wide_months_annual, wide_months_long


def monthly(spark, sf):
    return R.monthly_observations(observations(spark, sf))


def ratings(spark, sf):
    return R.rate_months(monthly(spark, sf), BASE_START, 2000)


def zone_regions(spark, sf):
    """A fixed grouping, the zone, where a check has to know the region of a station."""
    return stations(spark, sf).join(
        table(spark, sf, "region").select(F.col("r_name").alias("zone"), F.col("r_regionkey").alias("region_id")), "zone"
    ).select(*KEYS, "region_id")


REGION = "regions AS (SELECT s.zone, s.station, r_regionkey AS region_id FROM stations s JOIN region ON r_name = s.zone)"
_ROLL = ", ".join(
    f"CASE WHEN count(rainfall) OVER w{k} = {k} THEN sum(rainfall) OVER w{k} END AS rainfall_l{k}" for k in (3, 6, 12, 24)
)
_FRAMES = ", ".join(
    f"w{k} AS (PARTITION BY zone, station ORDER BY major_period, minor_period ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    for k in (3, 6, 12, 24)
)
MONTHS = f"""{OBS}, tot AS (SELECT zone, station, year AS major_period, month AS minor_period, coalesce(sum(value),0.0) AS rainfall, arg_min(source, date) AS rainfall_source FROM obs GROUP BY ALL),
med AS (SELECT zone, station, minor_period, median(rainfall) AS md FROM tot GROUP BY ALL),
yrs AS (SELECT zone, station, CAST(unnest(range(min(major_period), max(major_period)+1)) AS INTEGER) AS major_period FROM tot GROUP BY zone, station),
grid AS (SELECT *, CAST(unnest(range(1,13)) AS INTEGER) AS minor_period FROM yrs),
filled AS (SELECT g.zone, g.station, make_date(g.major_period, g.minor_period, 1) AS date, g.major_period, g.minor_period, coalesce(t.rainfall, md) AS rainfall,
 t.rainfall AS rainfall_original, rainfall_source FROM grid g LEFT JOIN tot t USING (zone, station, major_period, minor_period) JOIN med USING (zone, station, minor_period)),
months AS (SELECT *, {_ROLL} FROM filled WINDOW {_FRAMES})"""
_LEVELS = "[i/11.0::DOUBLE FOR i IN range(0,12)]"
_MEASURES = ("rainfall", "rainfall_l3", "rainfall_l12", "rainfall_l24")
RBASE = f"""rbase AS (SELECT zone, station, minor_period, {", ".join(
    f"max({m}) AS {m}_max, min({m}) AS {m}_min, quantile_cont({m},0.25) AS {m}_q1, median({m}) AS {m}_median, quantile_cont({m},0.75) AS {m}_q3, quantile_cont({m}, {_LEVELS}) AS {m}_br"
    for m in _MEASURES)} FROM months WHERE major_period BETWEEN 1996 AND 2000 GROUP BY ALL)"""
RATED = f"""{MONTHS}, {RBASE}, rated AS (SELECT m.*, b.rainfall_l12_median, {", ".join(
    f"CASE WHEN m.{m} IS NOT NULL THEN CAST(1 + (CASE WHEN m.{m} < 0 THEN -1 ELSE 0 END) + len(list_filter(b.{m}_br[2:11], lambda x: x <= m.{m})) - 6 AS INTEGER) END AS {m}_rating"
    for m in _MEASURES)} FROM months m JOIN rbase b USING (zone, station, minor_period))"""


@query("dom_monthly_observations", f"WITH {MONTHS} SELECT * FROM months")
def monthly_observations(spark, sf):
    return monthly(spark, sf)


@query("dom_rain_baselines", f"""WITH {MONTHS}, {RBASE} SELECT zone, station, minor_period, {", ".join(
    f"{m}_max, {m}_min, round({m}_q1,6) AS {m}_q1, {m}_median, round({m}_q3,6) AS {m}_q3, round({m}_br[4],6) AS {m}_break3" for m in _MEASURES)} FROM rbase""")
def rain_baselines(spark, sf):
    base = R.rain_baselines(monthly(spark, sf), BASE_START, 2000)
    cols = []
    for m in R.MEASURES:
        cols += [
            f"{m}_max", f"{m}_min", F.round(f"{m}_q1", 6).alias(f"{m}_q1"), f"{m}_median",
            F.round(f"{m}_q3", 6).alias(f"{m}_q3"), F.round(F.col(f"{m}_quantiles")[3], 6).alias(f"{m}_break3"),
        ]
    return base.select(*KEYS, "minor_period", *cols)


@query("dom_rain_rating", f"""WITH {RATED} SELECT zone, station, major_period, minor_period, date, rainfall_l12_median, rainfall, rainfall_rating, rainfall_l3, rainfall_l3_rating,
 rainfall_l12, rainfall_l12_rating, rainfall_l24, rainfall_l24_rating, rainfall_source FROM rated""")
def rain_rating(spark, sf):
    return ratings(spark, sf)


@query("dom_rain_regions")
def rain_regions(spark, sf):
    places = stations(spark, sf)
    features = G.rating_features(places, ratings(spark, sf), 1996, 5, 12, 3.0)
    return G.kmeans_regions(features, 7)


@query("dom_region_sweep")
def region_sweep(spark, sf):
    features = G.rating_features(stations(spark, sf), ratings(spark, sf), 1996, 5, 12, 3.0)
    return G.region_sweep(features, range(4, 8))


@query("dom_region_features", f"""WITH {RAINED}, f AS (SELECT zone, station, {", ".join(f"round(max(mu) FILTER (minor_period={m}),6) AS mean_{m}, round(max(sd) FILTER (minor_period={m}),6) AS sd_{m}" for m in range(1, 13))} FROM b GROUP BY ALL)
SELECT f.*, {", ".join(f"a.anomaly_{i}" for i in range(1, 37))} FROM f JOIN (SELECT zone, station, {", ".join(
    f"round(max(anomaly) FILTER (major_period={1996 + (i - 1) // 12} AND minor_period={(i - 1) % 12 + 1}),4) AS anomaly_{i}" for i in range(1, 37))}
 FROM rained WHERE major_period BETWEEN 1996 AND 1998 GROUP BY ALL) a USING (zone, station)""")
def region_features(spark, sf):
    from obsframe.operators import baseline as B

    obs = observations(spark, sf)
    base = B.baselines(obs, RAIN)
    means = G.monthly_features(base, "baseline_mean", "mean_")
    sds = G.monthly_features(base, "baseline_sd", "sd_")
    both = means.join(sds, KEYS)
    anomalies = G.anomaly_features(B.valuations(obs, RAIN, base), "value_anomaly", BASE_START, BASE_END)
    out = rounded(both, *[c for c in both.columns if c not in KEYS])
    return out.join(rounded(anomalies, *[c for c in anomalies.columns if c not in KEYS], digits=4), KEYS)


@query("dom_region_order", f"""WITH {STN}, {REGION} SELECT region_id, median(longitude) AS median_longitude, count(*) AS n_stations FROM regions JOIN stations USING (zone, station) GROUP BY 1 ORDER BY 2, 1""")
def region_order(spark, sf):
    return G.region_order(zone_regions(spark, sf), stations(spark, sf))


RSERIES = f"""{RATED}, {REGION}, series AS (SELECT region_id, date, median(rainfall_l12) AS rainfall_l12_median FROM rated JOIN regions USING (zone, station)
 WHERE rainfall_l12 IS NOT NULL GROUP BY ALL)"""


def l12_series(spark, sf):
    return G.region_series(
        ratings(spark, sf).drop("rainfall_l12_median"), zone_regions(spark, sf), "rainfall_l12"
    )


@query("dom_region_series", f"""WITH {RSERIES}, t AS (SELECT region_id, regr_slope(rainfall_l12_median, date_diff('day', DATE '1970-01-01', date)) AS b,
 regr_intercept(rainfall_l12_median, date_diff('day', DATE '1970-01-01', date)) AS a FROM series GROUP BY 1)
SELECT s.region_id, date, rainfall_l12_median, round(b,6) AS slope, round(a + b*date_diff('day', DATE '1970-01-01', date),4) AS trend FROM series s JOIN t USING (region_id)""")
def region_series(spark, sf):
    series = l12_series(spark, sf)
    fits = G.region_trend(series, "rainfall_l12_median").select("region_id", "slope", "intercept")
    return series.join(fits, "region_id").select(
        "region_id", "date", "rainfall_l12_median", F.round("slope", 6).alias("slope"),
        F.round(F.col("intercept") + F.col("slope") * F.unix_date("date"), 4).alias("trend"),
    )


@query("dom_region_anomaly", f"""WITH {VALUED}, {REGION} SELECT region_id, date AS median_date, round(avg(value_anomaly),5) AS value_anomaly FROM valued JOIN regions USING (zone, station)
WHERE major_period > 1996 GROUP BY ALL""")
def region_anomaly(spark, sf):
    return rounded(G.region_anomaly(valued(spark, sf), zone_regions(spark, sf), "value_anomaly", 1996), "value_anomaly", digits=5)


RSOI = f"""{RATED}, {REGION}, {SOI}, rg AS (SELECT region_id, date, median(rainfall) AS rain, avg(rainfall_rating) AS rating FROM rated JOIN regions USING (zone, station) GROUP BY ALL),
rz AS (SELECT *, (rain-avg(rain) OVER w)/stddev_samp(rain) OVER w AS rain_scaled, (rating-avg(rating) OVER w)/stddev_samp(rating) OVER w AS rating_scaled FROM rg WINDOW w AS (PARTITION BY region_id)),
sz AS (SELECT date, soi, (soi-avg(soi) OVER ())/stddev_samp(soi) OVER () AS soi_scaled FROM soi)"""


def soi_regions(spark, sf):
    return G.region_index(ratings(spark, sf), zone_regions(spark, sf), monthly_index(spark, sf))


@query("dom_region_soi", f"""WITH {RSOI} SELECT region_id, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, rain, round(rating,6) AS rating, round(rain_scaled,5) AS rain_scaled, round(rating_scaled,5) AS rating_scaled,
 soi, round(soi_scaled,5) AS soi_scaled FROM rz JOIN sz USING (date)""")
def region_soi(spark, sf):
    out = soi_regions(spark, sf)
    return rounded(rounded(out, "rating"), "rain_scaled", "rating_scaled", "soi_scaled", digits=5)


@query("dom_seasonal_adjust", f"""WITH {RSERIES}, mm AS (SELECT region_id, month(date) AS mo, avg(rainfall_l12_median) AS mu FROM series GROUP BY ALL),
ww AS (SELECT region_id, stddev_samp(rainfall_l12_median) AS sd, median(rainfall_l12_median) AS md FROM series GROUP BY 1)
SELECT s.region_id, date, CAST(mo AS INTEGER) AS month, rainfall_l12_median AS rain, round(rainfall_l12_median-mu,5) AS rain_residual, round(rainfall_l12_median-mu+md,5) AS rain_adjusted,
 round((rainfall_l12_median-mu)/sd,5) AS rain_adjusted_scaled FROM series s JOIN mm ON mm.region_id=s.region_id AND mo=month(date) JOIN ww ON ww.region_id=s.region_id""")
def seasonal_adjust(spark, sf):
    series = l12_series(spark, sf).withColumnRenamed("rainfall_l12_median", "rain")
    out = G.seasonal_adjust(series, ["region_id"], "rain")
    return rounded(out, "rain_residual", "rain_adjusted", "rain_adjusted_scaled", digits=5)


@query("dom_lag_experiment", f"""WITH {RATED}, {SOI}, s AS (SELECT date, avg(rainfall_rating) AS y FROM rated GROUP BY 1),
l AS (SELECT s.date, s.y, p.soi AS x, CAST(n_lag AS INTEGER) AS n_lag, CAST(('0x' || substr(md5(CAST(s.date AS VARCHAR) || ':100'),1,8))::BIGINT % 10 AS INTEGER) AS fold
 FROM s, (SELECT unnest(range(0,25)) AS n_lag) JOIN soi p ON p.date = CAST(s.date - to_months(CAST(n_lag AS INTEGER)) AS DATE)),
f AS (SELECT DISTINCT n_lag, fold FROM l),
fit AS (SELECT f.n_lag, f.fold, regr_slope(l.y,l.x) AS b, regr_intercept(l.y,l.x) AS a, avg(l.y) AS my FROM f JOIN l ON l.n_lag=f.n_lag AND l.fold<>f.fold GROUP BY ALL),
e AS (SELECT 'lm' AS algorithm, n_lag, fold, y-a-b*x AS er FROM l JOIN fit USING (n_lag, fold) UNION ALL SELECT 'null', n_lag, fold, y-my FROM l JOIN fit USING (n_lag, fold)),
pf AS (SELECT algorithm, n_lag, fold, sqrt(avg(er*er)) AS rmse, avg(abs(er)) AS mae FROM e GROUP BY ALL)
SELECT algorithm, n_lag, round(avg(rmse),5) AS rmse, round(avg(mae),5) AS mae, count(*) AS resamples FROM pf GROUP BY ALL""")
def lag_experiment(spark, sf):
    rating = ratings(spark, sf).groupBy("date").agg(F.avg("rainfall_rating").alias("rating"))
    series = rating.join(monthly_index(spark, sf).select("date", "soi"), "date", "full")
    out = G.lag_experiment(series, "rating", "soi", range(25), hash_fold(10, 100, "date"), 10)
    return rounded(out, "rmse", "mae", digits=5)


@query("dom_lag_hinges")
def lag_hinge_models(spark, sf):
    """Hinge models and plain means for 25 lags of the index, each under 25 bootstrap samples."""
    rating = ratings(spark, sf).groupBy("date").agg(F.avg("rainfall_rating").alias("rating"))
    series = rating.join(monthly_index(spark, sf).select("date", "soi"), "date", "full")
    out = lags.lag_hinges(series, "rating", "soi", range(25), Scheme("boot", number=25, seed=100))
    return rounded(out, "rmse", "mae", "terms", digits=5)


WIDE = f"""wide AS (SELECT station, CAST(year(date) AS INTEGER) AS year, {", ".join(f"CASE WHEN count(value) FILTER (month(date)={m}) >= 6 THEN CAST(sum(value) FILTER (month(date)={m}) AS VARCHAR) ELSE 'n/a' END AS m{m}" for m in range(1, 13))},
 CASE WHEN count(value) >= 70 THEN CAST(sum(value) AS VARCHAR) ELSE 'n/a' END AS annual FROM readings GROUP BY ALL)"""


def wide_station_file(spark, sf):
    """Twelve text months and a text annual total per station and year; thin months read 'n/a'."""
    month = F.month("date")

    def cell(value, enough):
        return F.when(F.count(value) >= enough, F.sum(value).cast("string")).otherwise(F.lit("n/a"))

    return readings(spark, sf).groupBy("station", F.year("date").alias("year")).agg(
        *[cell(F.when(month == m, F.col("value")), 6).alias(f"m{m}") for m in range(1, 13)], cell(F.col("value"), 70).alias("annual")
    )


@query("dom_rain_annual", f"""WITH {READ}, {WIDE} SELECT station, year, TRY_CAST(annual AS DOUBLE) AS annual FROM wide WHERE TRY_CAST(annual AS DOUBLE) IS NOT NULL""")
def rain_annual(spark, sf):
    return wide_months_annual(wide_station_file(spark, sf))


@query("dom_rain_monthly_wide", f"""WITH {READ}, {WIDE} SELECT * FROM (
 {" UNION ALL ".join(f"SELECT station, year, CAST({m} AS INTEGER) AS month, TRY_CAST(m{m} AS DOUBLE) AS rain FROM wide" for m in range(1, 13))}) WHERE rain IS NOT NULL""")
def rain_monthly_wide(spark, sf):
    return wide_months_long(wide_station_file(spark, sf))


@query("dom_region_station_count", f"""WITH {STN}, {REGION} SELECT region_id, count(*) AS n_stations FROM regions GROUP BY 1""")
def region_station_count(spark, sf):
    return zone_regions(spark, sf).groupBy("region_id").agg(F.count(F.lit(1)).alias("n_stations"))


@query("dom_location_percentile", f"""WITH {OBS}, y AS (SELECT longitude, latitude, year, avg(t) AS rain FROM (SELECT zone, station, year, sum(value) AS t FROM obs GROUP BY ALL)
 JOIN stations USING (zone, station) GROUP BY ALL)
SELECT longitude, latitude, year, round(rain,6) AS rain, round(pr*100,6) AS percent FROM (SELECT *, percent_rank() OVER (PARTITION BY longitude, latitude ORDER BY rain) AS pr FROM y WHERE rain IS NOT NULL) WHERE year = 1998""")
def place_percentile(spark, sf):
    annual = observations(spark, sf).groupBy(*KEYS, F.year("date").alias("year")).agg(F.sum("value").alias("rain"))
    ranked = location_percentile(annual.join(stations(spark, sf), KEYS), ["year"], "rain")
    return rounded(ranked, "rain", "percent").where("year = 1998")


@query("dom_grid_interpolate", f"""WITH {RAINED}, sv AS (SELECT zone, station, avg(anomaly) AS v FROM rained WHERE major_period BETWEEN 1999 AND 2000 GROUP BY ALL),
p AS (SELECT s.longitude, s.latitude, v FROM sv JOIN stations s USING (zone, station) WHERE v IS NOT NULL),
g AS (SELECT CAST(unnest(range(112,156)) AS INTEGER) AS longitude), h AS (SELECT CAST(unnest(range(-44,-9)) AS INTEGER) AS latitude),
d AS (SELECT g.longitude, h.latitude, v, sqrt(power(p.longitude-g.longitude,2)+power(p.latitude-h.latitude,2)) AS d FROM g, h, p)
SELECT longitude, latitude, round(coalesce(avg(v) FILTER (d=0), sum(v/power(d,5)) FILTER (d>0)/sum(1/power(d,5)) FILTER (d>0)),5) AS value_anomaly FROM d GROUP BY ALL""")
def grid(spark, sf):
    per_station = valued(spark, sf, RAIN).where("major_period BETWEEN 1999 AND 2000").groupBy(*KEYS).agg(
        F.avg("value_anomaly").alias("value_anomaly")
    )
    return rounded(grid_interpolate(per_station.join(stations(spark, sf), KEYS), "value_anomaly"), "value_anomaly", digits=5)
