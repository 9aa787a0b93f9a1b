"""Statistics queries."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from obsframe.functions.scalar import hash_fold
from obsframe.operators import mars, stats
from obsframe.operators.relational import scaled
from obsframe.plans.binding import OBS, PRICES, daily_prices, table
from obsframe.plans.stations import loess_sql, rounded
from obsframe.plans.rain import RSERIES, l12_series
from obsframe.plans.registry import query
from obsframe.session import pin


@query("st_scale", """WITH s AS (SELECT avg(o_totalprice) AS mu, stddev_samp(o_totalprice) AS sd FROM orders)
SELECT o_orderkey, round((o_totalprice-mu)/sd,6) AS o_totalprice_scaled FROM orders, s""")
def scale(spark, sf):
    return rounded(scaled(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).drop("o_totalprice"), "o_totalprice_scaled")


@query("st_loess", f"""WITH {PRICES}, d AS (SELECT CAST(date - DATE '1970-01-01' AS INTEGER) AS x, price FROM prices), {loess_sql("d", "x", "price", 0.05)}
SELECT CAST(x AS INTEGER) AS x, round(fit,4) AS price_smooth FROM lo""")
def loess(spark, sf):
    daily = daily_prices(spark, sf).select(F.unix_date("date").alias("x"), "price")
    return rounded(stats.loess(daily, [], "x", "price", 0.05, "price_smooth"), "price_smooth", digits=4)


@query("st_loess_vertices", f"""WITH RECURSIVE {PRICES}, d AS (SELECT CAST(CAST(date - DATE '1970-01-01' AS INTEGER) AS DOUBLE) AS x, price AS y FROM prices WHERE price IS NOT NULL),
p AS (SELECT x, y, row_number() OVER (ORDER BY x) AS n FROM d), nn AS (SELECT count(*) AS n, greatest(4, least(count(*), CAST(floor(count(*)*0.05 + 1e-5) AS BIGINT))) AS q, CAST(floor(count(*)*0.05*0.2) AS BIGINT) AS most FROM p),
cells AS (SELECT CAST(0 AS BIGINT) AS lo, n AS hi FROM nn UNION ALL SELECT unnest([lo, m]), unnest([m, hi]) FROM (SELECT lo, hi, (lo+1+hi)//2 AS m FROM cells, nn WHERE hi-lo > most)),
cut AS (SELECT (a.x+b.x)/2 AS v FROM cells, nn, p a, p b WHERE hi-lo > most AND a.n = (lo+1+hi)//2 AND b.n = a.n+1),
box AS (SELECT min(x) AS lo, max(x) AS hi, 0.005*greatest(max(x)-min(x), 1e-3*greatest(abs(min(x)), abs(max(x)))+1e-30) AS margin FROM p),
vs AS (SELECT v FROM cut UNION ALL SELECT lo-margin FROM box UNION ALL SELECT hi+margin FROM box),
c AS (SELECT v, x, y, abs(x-v) AS d, row_number() OVER (PARTITION BY v ORDER BY abs(x-v), x) AS rn FROM vs, p), k AS (SELECT *, max(d) OVER (PARTITION BY v) AS h FROM c, nn WHERE rn <= q),
w AS (SELECT v, h, (x-v)/h AS u, y, power(1-power(d/h,3),3) AS w FROM k),
s AS (SELECT v, h, sum(w) s0, sum(w*u) s1, sum(w*u*u) s2, sum(w*u*u*u) s3, sum(w*u*u*u*u) s4, sum(w*y) t0, sum(w*u*y) t1, sum(w*u*u*y) t2 FROM w GROUP BY v, h),
f AS (SELECT v, (t0*(s2*s4-s3*s3)-s1*(t1*s4-t2*s3)+s2*(t1*s3-t2*s2))/b AS f, (s0*(t1*s4-s3*t2)-t0*(s1*s4-s3*s2)+s2*(s1*t2-t1*s2))/b/h AS g FROM (SELECT *, s0*(s2*s4-s3*s3)-s1*(s1*s4-s2*s3)+s2*(s1*s3-s2*s2) AS b FROM s)),
e AS (SELECT v, f, g, lead(v) OVER o AS v1, lead(f) OVER o AS f1, lead(g) OVER o AS g1 FROM f WINDOW o AS (ORDER BY v)),
t AS (SELECT x, (x-v)/(v1-v) AS t, v1-v AS w, f, g, f1, g1 FROM p JOIN e ON x >= v AND x < v1)
SELECT CAST(x AS INTEGER) AS x, round((2*t*t*t-3*t*t+1)*f+(t*t*t-2*t*t+t)*w*g+(3*t*t-2*t*t*t)*f1+(t*t*t-t*t)*w*g1,4) AS price_smooth FROM t""")
def loess_at_vertices(spark, sf):
    """The same trend fitted at the vertices of a cell tree and blended between them."""
    daily = daily_prices(spark, sf).select(F.unix_date("date").alias("x"), "price")
    return rounded(stats.loess_vertices(daily, [], "x", "price", 0.05, "price_smooth"), "price_smooth", digits=4)


def _t_quantile() -> str:
    """The 97.5 % point of the t distribution in SQL, from its series in the inverse degrees of freedom."""
    z = 1.959963984540054
    terms = (
        (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    return f"({z!r}::DOUBLE" + "".join(f" + {t!r}::DOUBLE/power({{df}},{i + 1})" for i, t in enumerate(terms)) + ")"


T_QUANTILE = _t_quantile()


@query("st_loess_repeated", f"""WITH d AS (SELECT year(o_orderdate)*12+month(o_orderdate) AS x, o_totalprice/1000 AS y FROM orders),
p AS (SELECT CAST(x AS DOUBLE) AS x, count(*) AS c, sum(y) AS y FROM d GROUP BY 1), q AS (SELECT greatest(4, CAST(floor(sum(c)*0.3 + 1e-5) AS BIGINT)) AS q FROM p),
k AS (SELECT a.x AS x0, b.x, b.c, b.y, abs(b.x-a.x) AS d, coalesce(sum(b.c) OVER (PARTITION BY a.x ORDER BY abs(b.x-a.x), b.x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p a, p b),
n AS (SELECT *, max(d) OVER (PARTITION BY x0) AS h FROM k, q WHERE before < q), w AS (SELECT x0, (x-x0)/h AS u, c, y, power(1-power(d/h,3),3) AS w FROM n),
s AS (SELECT x0, sum(w*c) s0, sum(w*u*c) s1, sum(w*u*u*c) s2, sum(w*u*u*u*c) s3, sum(w*u*u*u*u*c) s4, sum(w*y) t0, sum(w*u*y) t1, sum(w*u*u*y) t2 FROM w GROUP BY x0)
SELECT CAST(x0 AS INTEGER) AS x, round((t0*(s2*s4-s3*s3) - s1*(t1*s4-t2*s3) + s2*(t1*s3-t2*s2)) / (s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2)),4) AS price_smooth FROM s""")
def loess_repeated(spark, sf):
    """Every order as a point of its own, many at one month."""
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    prices = table(spark, sf, "orders").select(month.alias("x"), (F.col("o_totalprice") / 1000).alias("price"))
    return rounded(stats.loess(prices, [], "x", "price", 0.3, "price_smooth"), "price_smooth", digits=4)


# The check adds up the t density over 4000 steps for the p value.
@query("st_lm_simple", """WITH m AS (SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice,l_quantity) AS b, regr_intercept(l_extendedprice,l_quantity) AS a,
 regr_r2(l_extendedprice,l_quantity) AS r2, regr_sxx(l_extendedprice,l_quantity) AS sxx, regr_syy(l_extendedprice,l_quantity) AS syy, regr_sxy(l_extendedprice,l_quantity) AS sxy FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, round(b,4) AS slope, round(a,3) AS intercept, round(r2,8) AS r2, round(se,5) AS slope_se, round(b/se,4) AS t_value,
 round(1-2*(SELECT sum(power(1+power(abs(b/se)*(i+0.5)/4000,2)/(n-2),-(n-1)/2)) FROM range(4000) t(i))*abs(b/se)/4000*exp(lgamma((n-1)/2)-lgamma((n-2)/2))/sqrt((n-2)*pi()),5) AS p_value, round(b-tq*se,3) AS slope_low, round(b+tq*se,3) AS slope_high
FROM (SELECT *, sqrt((syy-sxy*sxy/sxx)/(n-2))/sqrt(sxx) AS se, """ + T_QUANTILE.format(df="(n-2)") + """ AS tq FROM m)""")
def lm_simple(spark, sf):
    fit = stats.linear_fit(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return fit.select(
        "l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"),
        F.round("r2", 8).alias("r2"), F.round("slope_se", 5).alias("slope_se"), F.round("t_value", 4).alias("t_value"),
        F.round("p_value", 5).alias("p_value"), F.round("slope_low", 3).alias("slope_low"), F.round("slope_high", 3).alias("slope_high"),
    )


@query("st_lm_trend", f"""WITH {RSERIES}, d AS (SELECT region_id, date, rainfall_l12_median AS y, date_diff('day', DATE '1970-01-01', date) AS x FROM series),
t AS (SELECT region_id, count(*) AS n, regr_slope(y,x) AS b, regr_intercept(y,x) AS a, regr_avgx(y,x) AS mx, regr_sxx(y,x) AS sxx, regr_syy(y,x) AS syy, regr_sxy(y,x) AS sxy FROM d GROUP BY 1)
SELECT region_id, date, round(fit,4) AS fit, round(fit-tq*fit_se,4) AS fit_low, round(fit+tq*fit_se,4) AS fit_high FROM (
 SELECT d.region_id, d.date, a+b*x AS fit, sqrt((syy-sxy*sxy/sxx)/(n-2))*sqrt(1.0/n+(x-mx)*(x-mx)/sxx) AS fit_se, {T_QUANTILE.format(df="(n-2)")} AS tq FROM d JOIN t USING (region_id))""")
def lm_trend(spark, sf):
    series = l12_series(spark, sf).withColumn("day", F.unix_date("date"))
    band = stats.trend_band(series, ["region_id"], "day", "rainfall_l12_median")
    return band.select("region_id", "date", *[F.round(c, 4).alias(c) for c in ("fit", "fit_low", "fit_high")])


def daily_trend(spark, sf):
    """The trend of the mean daily price with the number of terms that predicts best over ten folds, and the error of each number."""
    daily = pin(daily_prices(spark, sf).select(F.unix_date("date").alias("x"), "price"))
    return daily, *mars.tune_hinges(daily, "x", "price", hash_fold(10, 7, "x"), max_terms=15)


@query("st_mars_trend")
def mars_trend(spark, sf):
    daily, model, _ = daily_trend(spark, sf)
    return rounded(daily.withColumn("price_prediction", model.predict()), "price_prediction", digits=4)


@query("st_mars_sizes")
def mars_sizes(spark, sf):
    _, _, sizes = daily_trend(spark, sf)
    return rounded(spark.createDataFrame(sizes, "terms int, rmse double, best boolean"), "rmse", digits=4)


@query("st_kmeans")
def kmeans(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=10, seed=101, maxIter=20, predictionCol="cluster").fit(vectors)
    return model.transform(vectors).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy("cluster")


@query("st_pca", """WITH c AS (SELECT covar_pop(l_quantity,l_quantity) AS a, covar_pop(l_quantity,l_extendedprice/1000) AS b, covar_pop(l_extendedprice/1000,l_extendedprice/1000) AS d FROM lineitem),
e AS (SELECT 1 AS component, ((a+d)+sqrt((a-d)*(a-d)+4*b*b))/2 AS variance FROM c UNION ALL SELECT 2, ((a+d)-sqrt((a-d)*(a-d)+4*b*b))/2 FROM c)
SELECT component, round(variance,4) AS variance, round(variance/sum(variance) OVER (),6) AS pev, round(sum(variance) OVER (ORDER BY component)/sum(variance) OVER (),6) AS cev FROM e""")
def pca(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("thousands"))
    out = stats.principal_components(df, ["l_quantity", "thousands"])
    return out.select("component", F.round("variance", 4).alias("variance"), F.round("pev", 6).alias("pev"), F.round("cev", 6).alias("cev"))


@query("st_histogram", """WITH s AS (SELECT min(value) AS lo, (max(value)-min(value))/30.0::DOUBLE AS w FROM events),
b AS (SELECT CAST(least(floor((value-lo)/w), 29) AS INTEGER) AS bin FROM events, s)
SELECT bin, count(*) AS n, round(any_value(lo)+bin*any_value(w),6) AS bin_start, round(any_value(lo)+(bin+1)*any_value(w),6) AS bin_end FROM b, s GROUP BY bin""")
def histogram(spark, sf):
    return rounded(stats.histogram(table(spark, sf, "events"), "value", 30), "bin_start", "bin_end")


@query("st_boxplot", """SELECT event_type, min(value) AS lowest, round(quantile_cont(value,0.25),6) AS first_q, round(quantile_cont(value,0.5),6) AS median,
 round(quantile_cont(value,0.75),6) AS third_q, max(value) AS highest FROM events GROUP BY 1""")
def boxplot(spark, sf):
    return rounded(stats.five_numbers(table(spark, sf, "events"), ["event_type"], "value"), "first_q", "median", "third_q")


@query("st_density", """WITH m AS (SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi,
 0.9*least(stddev_samp(value),(quantile_cont(value,0.75)-quantile_cont(value,0.25))/1.34)*power(count(*),-0.2) AS bw FROM events GROUP BY 1),
s AS (SELECT event_type, n, bw, lo-3*bw AS start, (hi-lo+6*bw)/63 AS step FROM m),
p AS (SELECT e.event_type, (value-start)/step AS place FROM events e JOIN s USING (event_type)),
c AS (SELECT event_type, floor(place) AS cell, 1-(place-floor(place)) AS w FROM p UNION ALL SELECT event_type, floor(place)+1, place-floor(place) FROM p),
wt AS (SELECT event_type, cell, sum(w) AS w FROM c GROUP BY ALL), g AS (SELECT CAST(unnest(range(0,64)) AS INTEGER) AS point)
SELECT s.event_type, g.point, round(start+g.point*step,5) AS x,
 round(sum(w*exp(-0.5*power((g.point-cell)*step/bw,2)))/(n*bw*sqrt(2*pi())),7) AS density FROM s JOIN wt ON s.event_type=wt.event_type, g GROUP BY s.event_type, g.point, start, step, n, bw""")
def density(spark, sf):
    out = stats.kernel_density(table(spark, sf, "events"), ["event_type"], "value", points=64)
    return rounded(rounded(out, "x", digits=5), "density", digits=7)


def _per_variable(select: str, source: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS variable, {select.replace('@', n)} FROM {source}" for n in names)


@query("st_distribution", _per_variable(
    """count(*) AS n, count(*) FILTER (@ IS NULL) AS n_na, round(avg(@),6) AS mean, round(stddev_samp(@),6) AS sd, min(@) AS lowest, round(quantile_cont(@,0.25),6) AS first_q,
 round(median(@),6) AS median, round(quantile_cont(@,0.75),6) AS third_q, max(@) AS highest,
 round((SELECT avg(power(l2.@-mu,3))/power(sd2,3) FROM lineitem l2, (SELECT avg(@) AS mu, stddev_samp(@) AS sd2 FROM lineitem) GROUP BY sd2),6) AS skew""", "lineitem", ["l_quantity", "l_discount", "l_extendedprice"]))
def distribution(spark, sf):
    out = stats.variable_distribution(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])
    return rounded(out, "skew", "mean", "sd", "first_q", "median", "third_q")


@query("st_degeneracy", """WITH l AS (SELECT 'c_nationkey' AS variable, CAST(c_nationkey AS DOUBLE) AS v FROM customer UNION ALL SELECT 'c_acctbal', c_acctbal FROM customer),
c AS (SELECT variable, v, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, v) AS rn FROM c WHERE v IS NOT NULL),
t AS (SELECT variable, sum(n) AS rows, count(v) AS dn FROM c GROUP BY 1), u AS (SELECT variable, max(n) FILTER (rn=1) AS t1, max(n) FILTER (rn=2) AS t2 FROM r GROUP BY 1)
SELECT variable, round(t1/t2::DOUBLE,6) AS freq_ratio, round(dn*100.0/rows::DOUBLE,6) AS percent_unique, dn<=1 OR (t1/t2::DOUBLE>19 AND dn*100.0/rows<=10) AS near_zero_var FROM t JOIN u USING (variable)""")
def degeneracy(spark, sf):
    return rounded(stats.variable_degeneracy(table(spark, sf, "customer"), ["c_nationkey", "c_acctbal"]), "freq_ratio", "percent_unique")


@query("st_data_statistics", f"""WITH {OBS} SELECT count(*) AS n_rows, 6 AS n_columns, count(*) FILTER (value IS NULL) AS n_missing, count(value) AS n_complete FROM obs""")
def data_statistics(spark, sf):
    from obsframe.plans.binding import observations

    return stats.data_statistics(observations(spark, sf))


@query("st_level_statistics", """WITH l AS (SELECT 'o_orderstatus' AS variable, o_orderstatus AS level FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
c AS (SELECT variable, level, count(*) AS n FROM l GROUP BY variable, level)
SELECT variable, level, n, round(n*100.0/(sum(n) OVER (PARTITION BY variable))::DOUBLE,6) AS percent FROM c""")
def level_statistics(spark, sf):
    return rounded(stats.level_statistics(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]), "percent")
