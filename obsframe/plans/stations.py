"""Annual series, station quality, baseline and anomaly queries."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.operators import baseline as B
from obsframe.operators import quality as Q
from obsframe.operators.relational import gather, scaled, splice
from obsframe.operators.stats import loess
from obsframe.plans.binding import (
    ANNUAL, BASE_END, BASE_START, KEYS, OBS, PRICES, STN, annual_orders, daily_prices, observations, stations, table,
)
from obsframe.plans.joins import ANNUAL_READ, annual_readings
from obsframe.plans.registry import query
from obsframe.sources import archives

CLEAN = Q.CleanInfo("sample", yearly_n_target=60, yearly_present_target=50, clean_years_target=3)
TEMP = B.temperature_valuation(baseline_start=BASE_START, baseline_end=BASE_END, minor_period=B.month_period)
DAILY = B.temperature_valuation(baseline_start=BASE_START, baseline_end=BASE_END)
RAIN = B.rainfall_valuation(baseline_start=BASE_START, baseline_end=BASE_END)


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("dom_splice_annual", f"""WITH {ANNUAL}, {ANNUAL_READ}, modern AS (SELECT * FROM annual_read WHERE year >= 1999)
SELECT year, data_mean_global AS co2_global, data_mean_nh AS co2_nhem, data_mean_sh AS co2_shem, 'historic' AS co2_source FROM annual WHERE year NOT IN (SELECT year FROM modern)
UNION ALL SELECT year, co2_global, NULL, NULL, co2_source FROM modern ORDER BY year""")
def splice_annual(spark, sf):
    old = annual_orders(spark, sf).select(
        "year", F.col("data_mean_global").alias("co2_global"), F.col("data_mean_nh").alias("co2_nhem"),
        F.col("data_mean_sh").alias("co2_shem"), F.lit("historic").alias("co2_source"),
    )
    return splice(old, annual_readings(spark, sf).where("year >= 1999"), "year").select(
        "year", "co2_global", "co2_nhem", "co2_shem", "co2_source"
    ).orderBy("year")


MONTH_TEMP = """mt AS (SELECT CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE) AS x, soi AS y FROM soi)"""


def loess_sql(source: str, x: str, y: str, span: float, out: str = "lo") -> str:
    """The same local quadratic fit as plain SQL over every pair of points."""
    return f"""{out}_p AS (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source} WHERE {y} IS NOT NULL),
{out}_q AS (SELECT greatest(4, least(count(*), CAST(floor(count(*)*{span} + 1e-5) AS BIGINT))) AS q FROM {out}_p),
{out}_c AS (SELECT a.x AS x0, b.x, b.y, abs(b.x-a.x) AS d, row_number() OVER (PARTITION BY a.x ORDER BY abs(b.x-a.x), b.x) AS rn FROM {out}_p a, {out}_p b),
{out}_k AS (SELECT *, max(d) OVER (PARTITION BY x0) AS h FROM {out}_c, {out}_q WHERE rn <= q),
{out}_w AS (SELECT x0, (x-x0)/h AS u, y, power(1-power(d/h,3),3) AS w FROM {out}_k),
{out}_s AS (SELECT x0, sum(w) s0, sum(w*u) s1, sum(w*u*u) s2, sum(w*u*u*u) s3, sum(w*u*u*u*u) s4, sum(w*y) t0, sum(w*u*y) t1, sum(w*u*u*y) t2 FROM {out}_w GROUP BY x0),
{out} AS (SELECT x0 AS x, (t0*(s2*s4-s3*s3) - s1*(t1*s4-t2*s3) + s2*(t1*s3-t2*s2)) / (s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2)) AS fit FROM {out}_s)"""


ORD_DAY = f"""{PRICES}, ship AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1)"""


def daily_quantity(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.avg("l_quantity").alias("quantity")
    )


@query("dom_combined_annual", f"""WITH {PRICES}, ta AS (SELECT year(date)*12+month(date) AS period, round(avg(price),7) AS ta_global FROM prices GROUP BY 1),
co AS (SELECT year(l_shipdate)*12+month(l_shipdate) AS period, round(avg(l_quantity),7) AS co2_global FROM lineitem GROUP BY 1),
j AS (SELECT ta.period, ta_global, co2_global FROM ta JOIN co ON ta.period=co.period), {loess_sql("j", "period", "ta_global", 0.2)},
s AS (SELECT avg(ta_global) m1, stddev_samp(ta_global) s1, avg(co2_global) m2, stddev_samp(co2_global) s2 FROM j)
SELECT CAST(j.period AS INTEGER) AS period, ta_global, co2_global, round(fit,5) AS ta_global_smooth, round((ta_global-m1)/s1,6) AS ta_global_scaled,
 round((co2_global-m2)/s2,6) AS co2_global_scaled FROM j JOIN lo ON lo.x = j.period, s""")
def combined_annual(spark, sf):
    def period(c):
        return (F.year(c) * 12 + F.month(c)).alias("period")

    ta = daily_prices(spark, sf).groupBy(period("date")).agg(F.round(F.avg("price"), 7).alias("ta_global"))
    co2 = table(spark, sf, "lineitem").groupBy(period("l_shipdate")).agg(F.round(F.avg("l_quantity"), 7).alias("co2_global"))
    joined = ta.join(co2, "period")
    smooth = loess(joined, [], "period", "ta_global", 0.2, "ta_global_smooth")
    out = scaled(joined.join(smooth, "period"), ["ta_global", "co2_global"])
    return rounded(rounded(out, "ta_global_scaled", "co2_global_scaled"), "ta_global_smooth", digits=5)


ZONAL = """zonal AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice),2) AS ta_global,
 round(avg(o_totalprice) FILTER (o_orderstatus='F'),2) AS ta_nhem, round(avg(o_totalprice) FILTER (o_orderstatus='O'),2) AS ta_shem,
 round(avg(o_totalprice) FILTER (o_orderpriority='1-URGENT'),2) AS ta_nband, round(avg(o_totalprice) FILTER (o_orderpriority='2-HIGH'),2) AS ta_cband,
 round(avg(o_totalprice) FILTER (o_orderpriority='5-LOW'),2) AS ta_sband FROM orders GROUP BY 1)"""


def zonal(spark, sf):
    price = F.col("o_totalprice")

    def where(column, value):
        return F.round(F.avg(F.when(F.col(column) == value, price)), 2)

    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.round(F.avg(price), 2).alias("ta_global"),
        where("o_orderstatus", "F").alias("ta_nhem"), where("o_orderstatus", "O").alias("ta_shem"),
        where("o_orderpriority", "1-URGENT").alias("ta_nband"), where("o_orderpriority", "2-HIGH").alias("ta_cband"),
        where("o_orderpriority", "5-LOW").alias("ta_sband"),
    )


@query("dom_zone_long", f"""WITH {ZONAL} SELECT year, zone, CASE zone WHEN 'ta_nband' THEN ta_nband WHEN 'ta_cband' THEN ta_cband ELSE ta_sband END AS ta
FROM zonal, (SELECT unnest(['ta_nband','ta_cband','ta_sband']) AS zone)""")
def zone_long(spark, sf):
    return gather(zonal(spark, sf), ["year"], ["ta_nband", "ta_cband", "ta_sband"], "zone", "ta")


@query("dom_hemisphere", f"""WITH {ZONAL}, fit AS (SELECT regr_slope(ta_global, year) AS b, regr_intercept(ta_global, year) AS a FROM zonal)
SELECT year, z.zone, CASE z.zone WHEN 'Northern Hemisphere' THEN ta_nhem ELSE ta_shem END AS temp, round(a+b*year,3) AS ta_global_prediction
FROM zonal, fit, (SELECT unnest(['Northern Hemisphere','Southern Hemisphere']) AS zone) z""")
def hemisphere(spark, sf):
    df = zonal(spark, sf)
    fit = df.agg(F.struct(
        F.regr_slope("ta_global", "year").alias("b"), F.regr_intercept("ta_global", "year").alias("a")
    ).alias("f")).select("f").scalar()
    trend = df.select("year", F.round(fit.getField("a") + fit.getField("b") * F.col("year"), 3).alias("ta_global_prediction"))
    both = df.select("year", F.col("ta_nhem").alias("Northern Hemisphere"), F.col("ta_shem").alias("Southern Hemisphere"))
    return gather(both, ["year"], both.columns[1:], "zone", "temp").join(trend, "year")


@query("dom_solar_yearly", f"""WITH {ORD_DAY}, {ZONAL}, p AS (SELECT year(date) y, round(avg(price),4) AS irradiance FROM prices WHERE date >= DATE '1996-06-01' GROUP BY 1),
s AS (SELECT year(date) y, round(avg(quantity),4) AS sunspots FROM ship GROUP BY 1)
SELECT year, ta_global, irradiance, sunspots FROM zonal LEFT JOIN p ON p.y=year LEFT JOIN s ON s.y=year""")
def solar_yearly(spark, sf):
    irradiance = daily_prices(spark, sf).where("date >= DATE '1996-06-01'").groupBy(F.year("date").alias("year")).agg(
        F.round(F.avg("price"), 4).alias("irradiance")
    )
    sunspots = daily_quantity(spark, sf).groupBy(F.year("date").alias("year")).agg(F.round(F.avg("quantity"), 4).alias("sunspots"))
    return zonal(spark, sf).select("year", "ta_global").join(irradiance, "year", "left").join(sunspots, "year", "left")


@query("dom_solar_monthly", f"""WITH {PRICES} SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, round(avg(price),7) AS sunspots,
 round(avg(price_sd),7) AS sunspots_sd, round(avg(n_orders),7) AS sunspots_observations FROM prices GROUP BY ALL""")
def solar_monthly(spark, sf):
    return daily_prices(spark, sf).groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.round(F.avg("price"), 7).alias("sunspots"), F.round(F.avg("price_sd"), 7).alias("sunspots_sd"),
        F.round(F.avg("n_orders"), 7).alias("sunspots_observations"),
    )


@query("dom_variable_summary", f"""WITH {OBS}, c AS (SELECT zone, station, year, value, count(*) n FROM obs GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY zone, station, year ORDER BY n DESC, value) rn FROM c WHERE value IS NOT NULL),
t AS (SELECT zone, station, year, sum(n) AS rows, count(value) AS dn FROM c GROUP BY ALL),
u AS (SELECT zone, station, year, max(n) FILTER (rn=1) AS t1, max(n) FILTER (rn=2) AS t2 FROM r GROUP BY ALL),
z AS (SELECT t.zone, t.station, t.year, dn<=1 OR (t1/t2::DOUBLE > 19 AND dn*100.0/rows <= 10) AS near_zero_var FROM t LEFT JOIN u USING (zone, station, year)),
g AS (SELECT zone, station, year, count(*) AS n, count(*) FILTER (value IS NULL) AS n_na, count(value) AS n_present, count(*) FILTER (value=0) AS n_zero,
 count(*) FILTER (value<>0) AS n_nonzero, min(value) AS min, round(avg(value),6) AS mean, median(value) AS median, max(value) AS max,
 quantile_cont(value,0.25) AS first_q, quantile_cont(value,0.75) AS third_q, round(stddev_samp(value),6) AS sd,
 CASE WHEN stddev_samp(value) > 0 THEN round((sum(value*value*value)/count(value) - 3*avg(value)*sum(value*value)/count(value) + 2*power(avg(value),3))/power(stddev_samp(value),3),5) END AS skew
 FROM obs GROUP BY ALL)
SELECT g.*, z.near_zero_var FROM g JOIN z USING (zone, station, year)""")
def variable_summary(spark, sf):
    obs = observations(spark, sf).withColumn("year", F.year("date"))
    flags = Q.ranking.near_zero_variance(obs, [*KEYS, "year"], "value").select(*KEYS, "year", "near_zero_var")
    out = Q.yearly_summary(obs.drop("year"), "value").join(flags, [*KEYS, "year"])
    return rounded(rounded(out, "mean", "sd"), "skew", digits=5)


YEARLY = """yearly AS (SELECT zone, station, year, count(*) AS n, count(value) AS n_present, count(*) FILTER (value=0) AS n_zero,
 count(*) FILTER (value<>0) AS n_nonzero FROM obs GROUP BY ALL)"""
SUMMARY = f"""{OBS}, {YEARLY}, summary AS (SELECT s.zone, s.station, s.longitude, s.latitude, s.name, CASE WHEN y.station IS NULL THEN 'Data Missing' ELSE 'Good' END AS status,
 count(y.year) AS n_year, min(y.year) AS min_year, max(y.year) AS max_year, CAST(coalesce(sum(n),0) AS BIGINT) AS n, CAST(coalesce(sum(n_present),0) AS BIGINT) AS n_present,
 CAST(coalesce(sum(n_zero),0) AS BIGINT) AS n_zero, CAST(coalesce(sum(n_nonzero),0) AS BIGINT) AS n_nonzero, CAST(coalesce(sum(n)-sum(n_present),0) AS BIGINT) AS n_na
 FROM stations s LEFT JOIN yearly y ON s.zone=y.zone AND s.station=y.station GROUP BY ALL)"""


def listed_twice(spark, sf) -> DataFrame:
    """The station list with every tenth code a second time, under another name and place."""
    one = stations(spark, sf)
    again = one.where(F.col("station").cast("int") % 10 == 3)
    return one.unionAll(again.withColumns({"name": F.concat("name", F.lit(" (moved)")), "latitude": F.col("latitude") + 1}))


# By the last digit of a station: what the validator found in its archive.
_STATUS = """CASE WHEN CAST(station AS INTEGER)%10=3 THEN 'Duplicate' WHEN CAST(station AS INTEGER)%10=5 THEN 'Data Missing' WHEN CAST(station AS INTEGER)%10=6 THEN 'Read Error'
 WHEN CAST(station AS INTEGER)%10=7 THEN 'No Data' ELSE status END"""


@query("dom_observation_summary", f"""WITH {SUMMARY}, st AS (SELECT * EXCLUDE (status), {_STATUS} AS status FROM summary)
SELECT zone, station, status, CASE WHEN CAST(station AS INTEGER)%10=6 THEN 'BadZipFile' ELSE '' END AS error, 'value' AS variable, 'mm' AS units,
 CASE WHEN status='Good' THEN min_year END AS min_year, CASE WHEN status='Good' THEN max_year END AS max_year,
 {", ".join(f"CASE WHEN status='Good' THEN {c} ELSE 0 END AS {c}" for c in ("n_year", "n", "n_present", "n_zero", "n_nonzero", "n_na"))} FROM st""")
def observation_summary(spark, sf):
    """Every status: the validator reads real archives, of which some are missing, broken or empty."""
    listed, digit = listed_twice(spark, sf), F.substring("station", -1, 1)
    row = F.concat(F.lit("IDCJAC0009,"), F.col("station"), F.lit(",2000,01,01,1.5,1,Y"))
    lines = listed.select("station").distinct().where(~digit.isin("5")).select("station", F.when(digit == "7", "").otherwise(row).alias("line"))
    # A list is few bytes, which Spark would leave in one task; an archive is work.
    lines = lines.repartition(max(spark.sparkContext.defaultParallelism, 2), "station")
    packed = archives.pack_archives(lines, archives.RAINFALL)
    packed = packed.withColumn("content", F.when(digit == "6", F.encode(F.lit("no zip"), "utf-8")).otherwise(F.col("content")))
    validated = archives.validate_archives(listed, packed, archives.RAINFALL)
    out = Q.observation_summary(listed, observations(spark, sf), "value", validated)
    return out.withColumns({"variable": F.lit("value"), "units": F.lit("mm")})


QUALITY = f"""{SUMMARY}, quality AS (SELECT *, round(n/nullif(n_year*365,0)::DOUBLE*100,6) AS n_pct, round(n_na/nullif(n,0)::DOUBLE*100,6) AS na_pct,
 round(n_zero/nullif(n_zero+n_nonzero,0)::DOUBLE*100,6) AS zero_pct FROM summary)"""


@query("dom_quality_summary", f"""WITH {QUALITY} SELECT * EXCLUDE (name) FROM quality""")
def quality_summary(spark, sf):
    return rounded(Q.quality_summary(stations(spark, sf), observations(spark, sf), "value"), "n_pct", "na_pct", "zero_pct")


@query("dom_station_screen", f"""WITH {QUALITY} SELECT zone, station, n_year, na_pct FROM quality
WHERE status='Good' AND longitude BETWEEN 112 AND 155 AND latitude BETWEEN -44 AND -10 AND n_nonzero>0 AND n_year>=7 AND na_pct>=12""")
def station_screen(spark, sf):
    quality = Q.quality_summary(stations(spark, sf), observations(spark, sf), "value")
    out = Q.station_screen(quality, CLEAN, min_years=7, na_percent=12.0)
    return rounded(out.select(*KEYS, "n_year", "na_pct"), "na_pct")


@query("dom_station_consistency", f"""WITH {SUMMARY}, c AS (SELECT zone, station, count(*) AS n_consistent FROM yearly WHERE n > 70 AND n_present/n::DOUBLE > 0.85 GROUP BY ALL)
SELECT s.zone, s.station, s.n_year, coalesce(c.n_consistent,0) AS n_consistent, round(n_present/n::DOUBLE,6) AS present_ratio
FROM summary s LEFT JOIN c USING (zone, station) WHERE coalesce(c.n_consistent,0) > 2""")
def station_consistency(spark, sf):
    out = Q.station_consistency(stations(spark, sf), observations(spark, sf), "value", 70, 0.85, 2)
    return rounded(out.select(*KEYS, "n_year", "n_consistent", "present_ratio"), "present_ratio")


@query("dom_clean_info", f"""WITH {STN} SELECT zone, station, name, longitude BETWEEN 112 AND 155 AS longitude_target_met, latitude BETWEEN -44 AND -10 AS latitude_target_met,
 360.0::DOUBLE AS yearly_n_target, 350.0::DOUBLE AS yearly_present_target, 50 AS clean_years_target FROM stations""")
def clean_info(spark, sf):
    """The rainfall limits, applied to every station's place."""
    limits = asdict(Q.RAINFALL)
    lon, lat = Q.inside(Q.RAINFALL)
    return stations(spark, sf).select(
        *KEYS, "name", lon.alias("longitude_target_met"), lat.alias("latitude_target_met"),
        F.lit(float(limits["yearly_n_target"])).alias("yearly_n_target"),
        F.lit(float(limits["yearly_present_target"])).alias("yearly_present_target"),
        F.lit(limits["clean_years_target"]).alias("clean_years_target"),
    )


CLEANED = f"""{OBS}, {YEARLY}, cy AS (SELECT *, n > 60 AND n_present > 50 AS year_clean FROM yearly),
ps AS (SELECT zone, station, count(*) AS n_year, count(*) FILTER (year_clean) AS clean_years, min(year) AS min_year, max(year) AS max_year, sum(n_nonzero) AS nz FROM cy GROUP BY ALL),
cs AS (SELECT s.*, n_year IS NOT NULL AND CAST(s.station AS INTEGER)%10<>3 AS data_available, n_year IS NOT NULL AND CAST(s.station AS INTEGER)%10<>3 AND longitude BETWEEN 112 AND 155 AS longitude_target_met,
 n_year IS NOT NULL AND CAST(s.station AS INTEGER)%10<>3 AND latitude BETWEEN -44 AND -10 AS latitude_target_met, coalesce(nz > 0, false) AS is_present_target_met, n_year, clean_years, min_year, max_year,
 coalesce(n_year IS NOT NULL AND CAST(s.station AS INTEGER)%10<>3 AND longitude BETWEEN 112 AND 155 AND latitude BETWEEN -44 AND -10 AND nz > 0 AND clean_years > 3, false) AS clean
 FROM stations s LEFT JOIN ps USING (zone, station)),
clean_sy AS (SELECT cy.zone, cy.station, cy.year FROM cy JOIN cs USING (zone, station) WHERE cs.clean AND year_clean)"""


@query("dom_clean_summary", f"""WITH {CLEANED} SELECT * FROM cs""")
def clean_summary(spark, sf):
    yearly = Q.yearly_counts(observations(spark, sf), "value")
    return Q.clean_summary(listed_twice(spark, sf), yearly, CLEAN)


@query("dom_clean_observations", f"""WITH {CLEANED} SELECT o.zone, o.station, o.date, o.value, o.measurement_days, o.source FROM obs o JOIN clean_sy USING (zone, station, year)""")
def clean_observations(spark, sf):
    return Q.clean_observations(listed_twice(spark, sf), observations(spark, sf), "value", CLEAN)


@query("dom_baseline_stations", f"""WITH {CLEANED}, b AS (SELECT zone, station, count(*) AS n_years FROM clean_sy WHERE year BETWEEN 1996 AND 1998 GROUP BY ALL)
SELECT s.*, n_years FROM stations s JOIN b USING (zone, station) WHERE n_years >= 3""")
def baseline_stations(spark, sf):
    return Q.baseline_stations(listed_twice(spark, sf), observations(spark, sf), "value", CLEAN, BASE_START, BASE_END)


@query("dom_baseline_stations_ratio", f"""WITH {OBS}, b AS (SELECT zone, station, count(*) AS n_days FROM obs WHERE value IS NOT NULL AND year BETWEEN 1996 AND 1998 GROUP BY ALL)
SELECT s.*, n_days FROM stations s JOIN b USING (zone, station) WHERE n_days >= 2*365*0.28""")
def baseline_ratio(spark, sf):
    return Q.baseline_stations_ratio(stations(spark, sf), observations(spark, sf), "value", BASE_START, BASE_END, 0.28)


@query("dom_baseline_stations_span", f"""WITH {OBS}, b AS (SELECT zone, station, min(year) AS min_year, max(year) AS max_year FROM obs GROUP BY ALL)
SELECT s.*, min_year, max_year FROM stations s JOIN b USING (zone, station) WHERE min_year <= 1996 AND max_year >= 1998""")
def baseline_span(spark, sf):
    return Q.baseline_stations_span(stations(spark, sf), observations(spark, sf), BASE_START, BASE_END)


@query("dom_valuation_info", f"""WITH {OBS} SELECT zone, station, year AS major_period, 0 AS minor_period, date AS median_date, value, sqrt(value) AS rooted FROM obs""")
def valuation_info(spark, sf):
    """A configuration of one's own: one period a year and a derived column."""
    info = B.ValuationInfo(
        "custom", minor_period=B.constant_period, mutators={"rooted": lambda: F.sqrt(F.col("value"))}, output="rooted"
    )
    return B.valuations(observations(spark, sf), info).drop("min_date", "max_date")


BASE = """base AS (SELECT zone, station, month AS minor_period, count(value) AS baseline_n, avg(value) AS baseline_mean, stddev_samp(value) AS baseline_sd
 FROM obs WHERE year BETWEEN 1996 AND 1998 GROUP BY ALL)"""


@query("dom_baselines", f"""WITH {OBS}, {BASE} SELECT zone, station, minor_period, baseline_n, round(baseline_mean,6) AS baseline_mean, round(baseline_sd,6) AS baseline_sd FROM base""")
def baselines(spark, sf):
    return rounded(B.baselines(observations(spark, sf), TEMP), "baseline_mean", "baseline_sd")


VALUED = f"""{OBS}, {BASE}, valued AS (SELECT o.*, o.year AS major_period, o.month AS minor_period, baseline_mean, baseline_sd, value - baseline_mean AS value_anomaly
 FROM obs o LEFT JOIN base b ON o.zone=b.zone AND o.station=b.station AND o.month=b.minor_period)"""


def valued(spark, sf, info=TEMP):
    obs = observations(spark, sf)
    return B.valuations(obs, info, B.baselines(obs, info))


@query("dom_valuations", f"""WITH {VALUED} SELECT zone, station, major_period, minor_period, value, round(baseline_mean,6) AS baseline_mean, round(baseline_sd,6) AS baseline_sd,
 round(value_anomaly,6) AS value_anomaly, date AS median_date, date AS min_date, date AS max_date FROM valued""")
def valuations(spark, sf):
    return rounded(valued(spark, sf), "baseline_mean", "baseline_sd", "value_anomaly")


@query("dom_temp_instances", f"""WITH {OBS}, d AS (SELECT *, CAST(dayofyear(date) AS INTEGER) AS doy FROM obs),
b AS (SELECT zone, station, doy, avg(value) AS m FROM d WHERE year BETWEEN 1996 AND 1998 GROUP BY ALL)
SELECT d.zone, d.station, d.date AS median_date, d.doy AS minor_period, round(value - m, 6) AS value_anomaly FROM d LEFT JOIN b USING (zone, station, doy)""")
def temp_instances(spark, sf):
    return rounded(valued(spark, sf, DAILY).select(*KEYS, "median_date", "minor_period", "value_anomaly"), "value_anomaly")


RAINED = f"""{OBS}, m AS (SELECT zone, station, year AS major_period, month AS minor_period, coalesce(sum(value),0.0) AS monthly_total,
 sqrt(coalesce(sum(value),0.0)+0.1) AS sq, min(date) AS min_date, max(date) AS max_date FROM obs GROUP BY ALL),
b AS (SELECT zone, station, minor_period, avg(sq) AS mu, stddev_samp(sq) AS sd FROM m WHERE major_period BETWEEN 1996 AND 1998 GROUP BY ALL),
rained AS (SELECT m.*, mu, sd, CASE WHEN sd <> 0 THEN (sq-mu)/sd END AS anomaly FROM m LEFT JOIN b USING (zone, station, minor_period))"""


@query("dom_rainfall_instance", f"""WITH {RAINED} SELECT zone, station, major_period, minor_period, monthly_total, round(sq,6) AS sqrt_monthly_total,
 round(anomaly,5) AS value_anomaly, min_date, max_date FROM rained""")
def rainfall_instance(spark, sf):
    out = valued(spark, sf, RAIN).select(
        *KEYS, "major_period", "minor_period", "monthly_total", "sqrt_monthly_total", "value_anomaly", "min_date", "max_date"
    )
    return rounded(rounded(out, "sqrt_monthly_total"), "value_anomaly", digits=5)


@query("dom_anomaly_smoothed", f"""WITH {OBS}, f AS (SELECT *, CAST(dayofyear(date) AS INTEGER) AS doy, sum(value) OVER w AS s, count(value) OVER w AS c FROM obs
 WINDOW w AS (PARTITION BY zone, station ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
b AS (SELECT zone, station, doy, sum(s)/sum(c) AS base FROM f WHERE year BETWEEN 1996 AND 1998 GROUP BY ALL)
SELECT f.zone, f.station, f.date, f.value, round(base,6) AS value_baseline, round(value-base,6) AS value_anomaly FROM f JOIN b USING (zone, station, doy)""")
def anomaly_smoothed(spark, sf):
    obs = observations(spark, sf)
    out = B.smoothed_anomalies(obs, "value", B.smoothed_baselines(obs, "value", BASE_START, BASE_END))
    return rounded(out.select(*KEYS, "date", "value", "value_baseline", "value_anomaly"), "value_baseline", "value_anomaly")


@query("dom_anomaly_yearly_station", f"""WITH {VALUED}, y AS (SELECT zone, station, major_period, round(avg(value_anomaly),5) AS value_anomaly FROM valued GROUP BY ALL)
SELECT y.*, s.name, s.longitude, s.latitude FROM y JOIN stations s USING (zone, station)""")
def yearly_station(spark, sf):
    return rounded(B.yearly_station_anomaly(valued(spark, sf), "value_anomaly", stations(spark, sf)), "value_anomaly", digits=5)


@query("dom_anomaly_yearly_region", f"""WITH {VALUED} SELECT zone, major_period, round(avg(value_anomaly),5) AS value_anomaly, count(DISTINCT station) AS n_stations FROM valued GROUP BY ALL""")
def yearly_region(spark, sf):
    return rounded(B.yearly_region_anomaly(valued(spark, sf), "value_anomaly"), "value_anomaly", digits=5)


@query("dom_anomaly_vs_global", f"""WITH {VALUED}, {ANNUAL}, r AS (SELECT zone, major_period, round(avg(value_anomaly),5) AS value_anomaly, count(DISTINCT station) AS n_stations FROM valued GROUP BY ALL),
span AS (SELECT min(major_period) a, max(major_period) b FROM r)
SELECT r.*, data_mean_global FROM r JOIN annual ON annual.year = r.major_period, span WHERE annual.year BETWEEN a AND b""")
def vs_global(spark, sf):
    regional = rounded(B.yearly_region_anomaly(valued(spark, sf), "value_anomaly"), "value_anomaly", digits=5)
    return B.versus_global(regional, annual_orders(spark, sf), "year", "data_mean_global")


@query("dom_anomaly_bbox_trend", f"""WITH {VALUED} SELECT date AS median_date, round(avg(value_anomaly),5) AS value_anomaly FROM valued JOIN stations s USING (zone, station)
WHERE major_period > 1996 AND s.longitude > 130 AND s.latitude < -20 GROUP BY 1""")
def bbox_trend(spark, sf):
    return rounded(B.box_trend(valued(spark, sf), stations(spark, sf), "value_anomaly", 1996, 130, -20), "value_anomaly", digits=5)


@query("dom_relative_range", f"""WITH {PRICES}, w AS (SELECT date_trunc('week', date)::DATE AS week, avg(price) AS p FROM prices GROUP BY 1),
n AS (SELECT CAST(week - DATE '1970-01-01' AS INTEGER) AS x, p FROM w), {loess_sql("n", "x", "p", 0.1)}
SELECT round((max(fit)-min(fit))/avg(fit)*100, 1) AS relative_range FROM lo""")
def relative_range(spark, sf):
    weekly = daily_prices(spark, sf).groupBy(F.trunc("date", "week").alias("week")).agg(F.avg("price").alias("p"))
    smooth = loess(weekly.withColumn("x", F.unix_date("week")), [], "x", "p", 0.1, "fit")
    return smooth.agg(
        F.round(F.try_divide(F.max("fit") - F.min("fit"), F.avg("fit")) * 100, 1).alias("relative_range")
    )


@query("dom_scaled_overlay", f"""WITH {ORD_DAY}, p AS (SELECT CAST(date_trunc('week', date)::DATE - DATE '1970-01-01' AS INTEGER) AS x, avg(price) AS price FROM prices GROUP BY 1),
s AS (SELECT CAST(date_trunc('week', date)::DATE - DATE '1970-01-01' AS INTEGER) AS x, avg(quantity) AS quantity FROM ship GROUP BY 1),
{loess_sql("p", "x", "price", 0.1, "lp")}, {loess_sql("s", "x", "quantity", 0.05, "ls")},
j AS (SELECT lp.x, lp.fit AS price_smooth, ls.fit AS quantity_smooth FROM lp JOIN ls ON lp.x=ls.x),
m AS (SELECT avg(price_smooth) a, stddev_samp(price_smooth) b, avg(quantity_smooth) c, stddev_samp(quantity_smooth) d FROM j)
SELECT CAST(x AS INTEGER) AS x, round((price_smooth-a)/b,4) AS price_smooth_scaled, round((quantity_smooth-c)/d,4) AS quantity_smooth_scaled FROM j, m""")
def scaled_overlay(spark, sf):
    def weekly(df, value):
        return df.groupBy(F.unix_date(F.trunc("date", "week")).alias("x")).agg(F.avg(value).alias(value))

    price = loess(weekly(daily_prices(spark, sf), "price"), [], "x", "price", 0.1, "price_smooth")
    quantity = loess(weekly(daily_quantity(spark, sf), "quantity"), [], "x", "quantity", 0.05, "quantity_smooth")
    both = scaled(price.join(quantity, "x"), ["price_smooth", "quantity_smooth"])
    return rounded(both.select("x", "price_smooth_scaled", "quantity_smooth_scaled"), "price_smooth_scaled", "quantity_smooth_scaled", digits=4)


@query("dom_period_slices", f"""WITH {ZONAL}, s AS (SELECT 'classic' AS slice, * FROM zonal WHERE year <= 1997 UNION ALL SELECT 'transitional', * FROM zonal WHERE year BETWEEN 1996 AND 1999
 UNION ALL SELECT 'modern', * FROM zonal WHERE year >= 1998)
SELECT slice, count(*) AS n, round(regr_slope(ta_nhem, year),4) AS nhem_slope, round(regr_slope(ta_shem, year),4) AS shem_slope FROM s GROUP BY slice""")
def period_slices(spark, sf):
    """Overlapping slices: each year is sent to every slice it belongs to, in one pass."""
    limits = {"classic": (None, 1997), "transitional": (1996, 1999), "modern": (1998, None)}
    year = F.col("year")

    def inside(first, last):
        low = F.lit(True) if first is None else year >= first
        return low & (F.lit(True) if last is None else year <= last)

    tags = F.array_compact(F.array(*[F.when(inside(a, b), F.lit(n)) for n, (a, b) in limits.items()]))
    sliced = zonal(spark, sf).withColumn("slice", F.explode(tags))
    return sliced.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("ta_nhem", "year"), 4).alias("nhem_slope"),
        F.round(F.regr_slope("ta_shem", "year"), 4).alias("shem_slope"),
    )
